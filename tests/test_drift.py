"""Drift of run files, against a plain reading of the definition."""

import datetime as dt
import json
import re

from pyspark.sql import functions as F

from vellumflow.operators import drift

SCHEMA = "file_id long, series string, path string, modified_at timestamp, collected_at timestamp, body string"


def _files(spark, bodies, series="s"):
    t = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, series, f"p{i}", t + dt.timedelta(hours=i), t, b) for i, b in enumerate(bodies)], SCHEMA)


def _changes(df):
    return sorted((r.file_id, r.field, r.change) for r in drift.changes(df).collect())


def test_changes_by_hand(spark):
    bodies = [
        '{"epg_temp": 0.1, "think": "high"}', '{"epgTemp": 0.1, "think": null}', '{"temps": {"epg": "0,3"}, "think": true}', "", '{"x": 1}{"y": 2}', '{"epg": ', None, "[1]", "3",
        '﻿{"epg_temp": [0.7], "think": {"mode": "low"}, "inference_type": null}', '{"epg_temp": 0.7, "inference_type": "cloud"}', '{"epg_temp": 0.7, "run": {"inference_type": "cloud"}}}', '{"host": {"type": "hpc"}, "epg_temp": {"value": 1.0}}',
    ]
    df = _files(spark, bodies).withColumn("think", F.lit("clash"))
    assert _changes(df) == sorted([
        (1, "epg_temp", "renamed"), (2, "epg_temp", "renamed"), (2, "epg_temp", "retyped"), (2, "think", "retyped"),
        (9, "epg_temp", "renamed"), (9, "epg_temp", "retyped"), (9, "inference_type", "added"), (9, "think", "retyped"),
        (10, "epg_temp", "retyped"), (10, "think", "removed"), (12, "epg_temp", "retyped"), (12, "inference_type", "renamed"),
    ])
    rows = {r.file_id: r for r in drift.unified(df).collect()}
    assert len(rows) == len(bodies)
    assert rows[2].epg_temp == 0.3 and rows[9].epg_temp == 0.7 and rows[12].epg_temp == 1.0 and rows[12].inference_type == "hpc"
    assert rows[9].think == "low" and rows[2].think == "true" and not rows[4]._readable and not rows[11]._readable
    assert json.loads(rows[4]._rescued) == bodies[4] and rows[6]._rescued is None
    assert _changes(df.limit(0)) == [] and drift.unified(df.limit(0)).count() == 0


def test_fields_moved_several_objects_deep_are_renamed(spark):
    deep = lambda n, inner: inner if n == 0 else {f"o{n}": deep(n - 1, inner)}
    df = _files(spark, ['{"epg_temp": 0.1}', *(json.dumps(deep(n, {"epgTemp": 0.5})) for n in (1, 2, 4, 5)), '{"run": {"host": {"type": "hpc"}}, "epg_temp": 1}'])
    assert _changes(df) == [(1, "epg_temp", "renamed"), (2, "epg_temp", "renamed"), (3, "epg_temp", "renamed"), (4, "epg_temp", "removed"), (5, "epg_temp", "added"), (5, "inference_type", "added")]
    rows = {r.file_id: r for r in drift.unified(df).collect()}
    assert [rows[k].epg_temp for k in range(6)] == [0.1, 0.5, 0.5, 0.5, None, 1.0] and [rows[k]._deeper for k in range(6)] == [False] * 4 + [True, False]


def test_rescued_values_are_kept_and_replayed(spark):
    df = _files(spark, ['{"a \\"q\\"": [1, {"b": 2}], "epg_temp": "warm", "other": "x"}'])
    first = drift.ingest(df).collect()[0]
    assert first.epg_temp is None and json.loads(first._rescued) == {'a "q"': [1, {"b": 2}], "epg_temp": "warm", "other": "x"}
    more = (*drift.RUN_FIELDS, drift.Field("extra", "string", r"^other$"))
    later = drift.replay(drift.ingest(df, more), more).collect()[0]
    assert later.extra == "x" and json.loads(later._rescued) == {'a "q"': [1, {"b": 2}], "epg_temp": "warm"}


def test_against_plain_reading_of_the_test_tables(spark):
    files = spark.read.parquet("/root/testdata/sf0.1/run_files.parquet")
    wrappers = {f.name: re.compile(f.promoted) for f in drift.RUN_FIELDS}
    snake = lambda p: re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", p).lower()
    kind = lambda v: "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "number"
    by, seen, wanted = {}, {}, set()
    for r in files.orderBy("modified_at", "file_id").collect():
        try:
            body = json.loads(r.body.lstrip("﻿"))
        except ValueError:
            continue
        if not isinstance(body, dict):
            continue
        flat = {k: v for k, v in body.items()} | {f"{k}.{c}": v for k, d in body.items() if isinstance(d, dict) for c, v in d.items()}
        now = {}
        for field, pattern in wrappers.items():
            hits = sorted(p for p in flat if pattern.search(snake(p)))
            if hits:
                p = field if field in hits else hits[0]
                now[field] = (p, kind(flat[p]))
        before = by.get(r.series)
        for field in wrappers:
            was, is_ = (before or {}).get(field), now.get(field)
            last = seen.get((r.series, field))
            if before is not None:
                if was and not is_:
                    wanted.add((r.file_id, field, "removed"))
                elif is_ and not was:
                    wanted.add((r.file_id, field, "added"))
                elif is_:
                    if was[0] != is_[0]:
                        wanted.add((r.file_id, field, "renamed"))
                    if is_[1] != "null" and last not in (None, is_[1]):
                        wanted.add((r.file_id, field, "retyped"))
            if is_ and is_[1] != "null":
                seen[r.series, field] = is_[1]
        by[r.series] = now
    assert set(_changes(files)) == wanted and len(wanted) > 300
