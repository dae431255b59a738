"""Rescue-column ingestion of JSON files whose fields drift.

``ingest`` enforces a target schema on each body: a field that stands under its
canonical name with a value castable to its type fills its typed column, all else
is kept whole in ``_rescued``, a JSON object. ``replay`` runs promotion rules over
``_rescued`` and fills the typed columns from values under other names, in other
objects or of other types. ``changes`` lists what changed from file to file of a
series. The parse, the matching and the casts are JVM expressions in one
projection over the scan; only ``changes`` shuffles, and only narrow rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.operators.ordered import with_neighbours

# Closes the object into which a body is put; a body that isn't exactly one value hides it.
_END = "_vf_end_of_body"
#: Objects in objects that are looked into, counted from the body; what lies deeper stays rescued and is reported.
DEPTH = 5


@dataclass(frozen=True)
class Field:
    """A column of the target schema.

    name: canonical name. kind: ``double`` or ``string``. promoted: a regular
    expression over paths (``key``, ``object.key`` and so on, in snake case) that
    are approved to mean this field. wrappers: keys that may wrap the value in an
    object of its own.
    """

    name: str
    kind: str
    promoted: str
    wrappers: tuple[str, ...] = ("value", "mode", "kind")


#: Approved names, written in snake case, of the fields of run files.
RUN_FIELDS = (
    Field("epg_temp", "double", r"^(\w+\.)*(epg_temp(erature)?|temp(erature)?_epg)$|(^|\.)temp(erature)?s?\.epg$"),
    Field("think", "string", r"^(\w+\.)*(think|thinking|reasoning)(_mode|_level)?$"),
    Field("inference_type", "string", r"^(\w+\.)*(inference|infer)(_type|_kind|_mode)?$|(^|\.)host\.(type|kind)$"),
)


def parsed(body: str) -> Column:
    """The body as a variant if it is exactly one JSON object, else null.

    A byte-order mark and white space around the object are no fault. The body is
    parsed as a member of an outer object with a closing member, so that text after
    the object (a second object, a stray brace) hides the closing member.
    """
    text = F.regexp_replace(F.col(body), r"^[﻿\s]+", "")
    outer = F.try_parse_json(F.concat(F.lit('{"b":'), text, F.lit(f',"{_END}":1}}')))
    whole = F.try_variant_get(outer, f"$.{_END}", "int") == 1
    inner = F.try_variant_get(outer, "$.b", "variant")
    return F.when(whole & F.schema_of_variant(inner).startswith("OBJECT"), inner)


def _kind(v: Column) -> Column:
    said = F.schema_of_variant(v)
    return (
        F.when(said == "VOID", "null")
        .when(said == "STRING", "string")
        .when(said == "BOOLEAN", "boolean")
        .when(said.startswith("ARRAY"), "array")
        .when(said.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def _snake(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"([a-z0-9])([A-Z])", r"$1_$2"), r"[-\s]+", "_"))


def _members(v: Column) -> Column:
    return F.map_entries(v.cast("map<string,variant>"))


def _described(path: Column, v: Column) -> Column:
    return F.struct(path.alias("path"), _kind(v).alias("kind"), F.to_json(v).alias("json"))


def _inside(level: Column) -> Column:
    """Members of the objects among array<struct<path, v>>, their paths with the object's before."""

    def members(e: Column) -> Column:
        held = F.when(F.schema_of_variant(e["v"]).startswith("OBJECT"), F.map_entries(e["v"].try_cast("map<string,variant>")))
        return F.transform(F.coalesce(held, F.array().cast("array<struct<key:string,value:variant>>")), lambda c: F.struct(F.concat(e["path"], F.lit("."), c["key"]).alias("path"), c["value"].alias("v")))

    return F.flatten(F.transform(level, members))


def entries(v: Column, depth: int = DEPTH) -> tuple[Column, Column, Column]:
    """(members of an object; those and the members of objects in it, ``depth`` objects deep, with their paths in snake case; whether objects lie deeper).

    Both arrays hold struct<path, v>, the second also ``snake``.
    """
    own = level = F.transform(_members(v), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("v")))
    levels = [level]
    for _ in range(depth - 1):
        level = _inside(level)
        levels.append(level)
    named = F.transform(F.concat(*levels), lambda e: F.struct(e["path"].alias("path"), _snake(e["path"]).alias("snake"), e["v"].alias("v")))
    return own, named, F.exists(level, lambda e: F.schema_of_variant(e["v"]).startswith("OBJECT<"))


def _scalar(found: Column, field: Field) -> Column:
    """The value of a found member as text: unwrapped, null where there is no single value."""
    json, kind = found["json"], found["kind"]
    value = (
        F.when(kind == "string", F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v"))
        .when(kind.isin("number", "boolean"), json)
        .when((kind == "array") & F.get_json_object(json, "$[1]").isNull(), F.get_json_object(json, "$[0]"))
        .when(kind == "object", F.coalesce(*[F.get_json_object(json, f"$.{w}") for w in field.wrappers]))
    )
    if field.kind == "double":
        return F.regexp_replace(F.trim(value), r"^([+-]?\d+),(\d+)$", "$1.$2").try_cast("double")
    return value


def _object(members: Column) -> Column:
    """Members as the text of a JSON object."""

    def quoted(path: Column) -> Column:
        listed = F.to_json(F.array(path))
        return F.substr(listed, F.lit(2), F.length(listed) - 2)

    return F.concat(
        F.lit("{"), F.array_join(F.transform(members, lambda e: F.concat(quoted(e["path"]), F.lit(":"), e["json"])), ","), F.lit("}")
    )


def ingest(files: DataFrame, fields: tuple[Field, ...] = RUN_FIELDS, body: str = "body") -> DataFrame:
    """Enforce the target schema; keep all other members as JSON in ``_rescued``.

    Adds for each field its typed column, ``<field>_path`` (where it was found,
    null if absent) and ``<field>_kind`` (its JSON type), then ``_rescued`` and
    ``_readable`` (false: null, empty, cut off or glued body; its typed columns are
    null and its whole text is the rescued value, as a JSON string). Input columns
    with names of these are replaced. Every row is kept.
    """
    own = [f.name for f in fields] + [f"{f.name}_{x}" for f in fields for x in ("path", "kind")] + ["_rescued", "_readable"]
    kept = [c for c in files.columns if c not in own or c == body]
    df = files.select(*kept).withColumn("_vf_v", parsed(body))
    df = df.withColumn("_vf_top", F.transform(_members(F.col("_vf_v")), lambda e: _described(e["key"], e["value"])))
    fitting = {"double": ("number",), "string": ("string",)}
    for f in fields:
        hit = F.filter("_vf_top", lambda e: (e["path"] == f.name) & e["kind"].isin(*fitting[f.kind]))
        df = df.withColumn(f"_vf_{f.name}", F.get(hit, F.lit(0)))
    placed = F.array_compact(F.array(*[F.col(f"_vf_{f.name}.path") for f in fields]))
    rest = F.filter("_vf_top", lambda e: ~F.array_contains(placed, e["path"]))
    columns = []
    for f in fields:
        found = F.col(f"_vf_{f.name}")
        columns += [_scalar(found, f).alias(f.name), found["path"].alias(f"{f.name}_path"), found["kind"].alias(f"{f.name}_kind")]
    unread = F.to_json(F.array(F.col(body)))
    rescued = F.when(F.col("_vf_v").isNotNull(), _object(rest)).when(F.col(body).isNotNull(), F.substr(unread, F.lit(2), F.length(unread) - 2))
    return df.select(*kept, *columns, rescued.alias("_rescued"), F.col("_vf_v").isNotNull().alias("_readable"))


def replay(ingested: DataFrame, fields: tuple[Field, ...] = RUN_FIELDS) -> DataFrame:
    """Fill typed columns that are still absent from ``_rescued`` by the promotion rules.

    Of several approved members the canonical name comes first, then the first path
    by code points. A member that holds null is present with kind ``null``. A
    promoted member at the top leaves ``_rescued`` if its value could be cast (or is
    null); one inside another object stays there as well, so nothing is lost.
    ``_deeper`` says that objects lie more than ``DEPTH`` deep, which no rule sees.
    """
    df = ingested.withColumn("_vf_v", F.when(F.col("_readable"), F.try_parse_json("_rescued")))
    own, members, deeper = entries(F.col("_vf_v"))
    df = df.withColumns({"_vf_own": own, "_vf_all": members, "_deeper": F.coalesce(deeper, F.lit(False))})
    for f in fields:
        approved = F.filter("_vf_all", lambda e: e["snake"].rlike(f.promoted))
        first = F.array_min(F.transform(approved, lambda e: F.struct((e["path"] != f.name).alias("r"), e["path"].alias("path"))))["path"]
        df = df.withColumn(f"_vf_{f.name}_p", F.when(F.col(f"{f.name}_path").isNull(), first))
        # Only what is chosen is written as JSON.
        hit = F.get(F.filter("_vf_all", lambda e: e["path"] == F.col(f"_vf_{f.name}_p")), F.lit(0))
        df = df.withColumn(f"_vf_{f.name}", F.when(F.col(f"_vf_{f.name}_p").isNotNull(), _described(hit["path"], hit["v"])))
        df = df.withColumn(f"_vf_{f.name}_v", _scalar(F.col(f"_vf_{f.name}"), f))
    placed = F.array_compact(
        F.array(*[F.when(F.col(f"_vf_{f.name}_v").isNotNull() | (F.col(f"_vf_{f.name}.kind") == "null"), F.col(f"_vf_{f.name}.path")) for f in fields])
    )
    rest = F.transform(F.filter("_vf_own", lambda e: ~F.array_contains(placed, e["path"])), lambda e: F.struct(e["path"].alias("path"), F.to_json(e["v"]).alias("json")))
    new = {"_rescued": F.when(F.col("_readable"), _object(rest)).otherwise(F.col("_rescued"))}
    for f in fields:
        new[f.name] = F.coalesce(f.name, f"_vf_{f.name}_v")
        new[f"{f.name}_path"] = F.coalesce(f"{f.name}_path", f"_vf_{f.name}.path")
        new[f"{f.name}_kind"] = F.coalesce(f"{f.name}_kind", f"_vf_{f.name}.kind")
    kept = [c for c in ingested.columns if c != "_deeper"]
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in kept], "_deeper")


def unified(files: DataFrame, fields: tuple[Field, ...] = RUN_FIELDS, body: str = "body") -> DataFrame:
    """One consistent table of all files: ``ingest``, then ``replay``."""
    return replay(ingest(files, fields, body), fields)


def changes(
    files: DataFrame,
    fields: tuple[Field, ...] = RUN_FIELDS,
    series: str = "series",
    time: str = "modified_at",
    file_id: str = "file_id",
    body: str = "body",
) -> DataFrame:
    """Each change of a field between successive readable files of a series.

    Columns: series, file_id, field, change (``added``, ``removed``, ``renamed``,
    ``retyped``), was_path, is_path, was_kind, is_kind. Files that hold no single
    JSON object are left out. The first file of a series has no change. A member
    holding null keeps the kind last seen in the series; while none was seen, no
    change of kind is reported. A null series is a series of its own. An empty
    table gives an empty table.
    """
    marks = [F.col(f"{f.name}_{x}").alias(f"_{x}_{i}") for i, f in enumerate(fields) for x in ("path", "kind")]
    narrow = unified(files, fields, body).where("_readable").select(
        F.col(series).alias("series"), F.col(time).alias("at"), F.col(file_id).alias("file_id"), *marks
    )
    for i, _ in enumerate(fields):
        narrow = narrow.withColumn(f"_kind_{i}", F.when(F.col(f"_kind_{i}") != "null", F.col(f"_kind_{i}")))
    rows = with_neighbours(
        narrow,
        ["series"],
        ["at", "file_id"],
        previous={"was": ["file_id", *[f"_path_{i}" for i, _ in enumerate(fields)]]},
        last_seen={f"_seen_{i}": f"_kind_{i}" for i, _ in enumerate(fields)},
        costly=True,
    )
    listed = []
    for i, f in enumerate(fields):
        was, now = F.col(f"was._path_{i}"), F.col(f"_path_{i}")
        seen, kind = F.col(f"_seen_{i}"), F.col(f"_kind_{i}")
        both = was.isNotNull() & now.isNotNull()
        found = F.array_compact(
            F.array(
                F.when(was.isNull() & now.isNotNull(), "added"),
                F.when(was.isNotNull() & now.isNull(), "removed"),
                F.when(both & (was != now), "renamed"),
                F.when(both & (seen != kind), "retyped"),
            )
        )
        listed.append(
            F.transform(
                found,
                lambda c: F.struct(
                    F.lit(f.name).alias("field"), c.alias("change"), was.alias("was_path"), now.alias("is_path"), seen.alias("was_kind"), kind.alias("is_kind")
                ),
            )
        )
    return rows.where(F.col("was").isNotNull()).select("series", "file_id", F.inline(F.flatten(F.array(*listed))))
