"""Queries of the general training-data problems (1 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumflow.operators import drift, nested
from vellumflow.plans.annotation import POINTS_SQL
from vellumflow.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "run_files")).select("file_id", "field", "change").distinct()


def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified(table(spark, sf_dir, "run_files")).select(
        "file_id", "series", "epg_temp", "think", "inference_type", "_readable", "_rescued"
    )


def p1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "run_files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.points(table(spark, sf_dir, "page_scans")).drop("x", "y")


def p3_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.regions(table(spark, sf_dir, "page_scans"))


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.lines(table(spark, sf_dir, "page_scans"))


#: Names under which the run files of the tables hold each field: canonical first, then by code points.
_PATHS = {
    "epg_temp": ["epg_temp", "epgTemp", "epg_temperature", "stages.epg_temp", "temp_epg", "temps.epg"],
    "think": ["think", "options.think", "params.thinking", "reasoning", "think_mode", "thinking"],
    "inference_type": ["inference_type", "host.type", "infer_kind", "inference", "inferenceType", "run.inference_type"],
}


def _changes_sql(whole: bool = False) -> str:
    """p1_found, or with ``whole`` p1_changes with paths and kinds."""
    def cases(paths: list[str], what: str) -> str:
        return "case " + " ".join(f"when json_exists(b, '$.{p}') then " + what.format(p=p) for p in paths) + " end"

    kinds = "case when {t} is not null then case {t} when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then null else 'number' end end"
    columns = ", ".join(
        f"{cases(paths, chr(39) + '{p}' + chr(39))} as path_{f}, {cases(paths, 'json_type(b, ' + chr(39) + '$.{p}' + chr(39) + ')')} as type_{f}" for f, paths in _PATHS.items()
    )
    plain = ", ".join(f"path_{f}, {kinds.format(t=f'type_{f}')} as kind_{f}" for f in _PATHS)
    before = ", ".join(f"lag(path_{f}) over w as was_{f}, last_value(kind_{f} ignore nulls) over (partition by series order by modified_at, file_id rows between unbounded preceding and 1 preceding) as seen_{f}" for f in _PATHS)
    parts = []
    for f in _PATHS:
        for change, when in (
            ("added", f"was_{f} is null and path_{f} is not null"),
            ("removed", f"was_{f} is not null and path_{f} is null"),
            ("renamed", f"was_{f} <> path_{f}"),
            ("retyped", f"was_{f} is not null and path_{f} is not null and seen_{f} <> kind_{f}"),
        ):
            more = f", series, was_{f} as was_path, path_{f} as is_path, seen_{f} as was_kind, kind_{f} as is_kind" if whole else ""
            parts.append(f"select file_id, '{f}' as field, '{change}' as change{more} from o where before is not null and {when}")
    return f"""with f as (select file_id, series, modified_at, ltrim(body, chr(65279)) as b from run_files), ok as (select * from f where json_valid(b) and json_type(b) = 'OBJECT'),
    k as (select file_id, series, modified_at, {columns} from ok), n as (select file_id, series, modified_at, {plain} from k),
    o as (select *, lag(file_id) over w as before, {before} from n window w as (partition by series order by modified_at, file_id))
    """ + (" union all " if whole else " union ").join(parts)


def _index_sql(custom: str) -> str:
    return rf"try_cast(nullif(regexp_extract({custom}, 'readingOrder\s*\{{[^}}]*?index\s*:\s*([0-9]+)', 1), '') as int)"


_REGIONS_SQL = r"""with held as (select rec_id, list_filter(coalesce(reading_order, []), lambda o: o is not null) as ro, list_filter(coalesce(regions, []), lambda x: x is not null) as l from page_scans),
 top as (select rec_id, ro, unnest(l) as r, generate_subscripts(l, 1) as i from held), subs as (select rec_id, ro, r.region_id as parent, list_filter(coalesce(r.sub_regions, []), lambda x: x is not null) as l from top),
 below as (select rec_id, ro, parent, unnest(l) as r, generate_subscripts(l, 1) as i from subs),
 regs as (select rec_id, ro, '' as parent_region_id, r.region_id as region_id, (i - 1)::int as region_idx, false as is_sub, r.custom as custom, r.coords.points as points, r.text_lines as text_lines from top
 union all select rec_id, ro, coalesce(parent, ''), r.region_id, (i - 1)::int, true, r.custom, r.coords.points, r.text_lines from below),
 placed as (select *, coalesce({index}, list_filter(ro, lambda o: o.region_ref = region_id)[1].idx) as place, list_filter(coalesce(text_lines, []), lambda x: x is not null) as ls from regs)
""".replace("{index}", _index_sql("custom"))
_LINES_SQL = _REGIONS_SQL + f""", each as (select *, unnest(ls) as x, generate_subscripts(ls, 1) as k from placed),
 texts as (select *, list_filter(coalesce(x.text_equiv, []), lambda t: coalesce(t.unicode_text, t.plain_text) is not null)[1] as first from each),
 lines as (select rec_id, parent_region_id, region_id, x.line_id as line_id, is_sub, place as region_reading_idx, region_idx, (k - 1)::int as line_idx, {_index_sql('x.custom')} as reading_idx, x.coords.points as coords, x.baseline.points as baseline, first.conf as conf, coalesce(first.unicode_text, first.plain_text) as text from texts)
"""
QUERIES = {f.__name__: f for f in (p1_found, p1_changes, p1_table, p3_found, p3_regions, p3_lines)}
SQL: dict[str, str] = {
    "p1_found": _changes_sql(), "p1_changes": _changes_sql(True), "p3_found": POINTS_SQL,
    "p3_regions": _REGIONS_SQL + " select rec_id, parent_region_id, region_id, region_idx, is_sub, place as reading_idx, custom, points, len(ls)::int as n_lines from placed",
    "p3_lines": _LINES_SQL + " select * from lines",
}
