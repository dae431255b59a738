"""Values of the preceding row within a key, where one key may hold most of the rows.

A window over the key alone puts a hot key into one task. Here the rows are
range-partitioned by (key, order), each range carries only its last state to the
ranges after it, and the windows run inside a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.session import cut


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    previous: dict[str, list[str]] | None = None,
    following: dict[str, list[str]] | None = None,
    last_seen: dict[str, str] | None = None,
    costly: bool = False,
) -> DataFrame:
    """Add neighbouring values in ``order`` within ``keys``.

    previous, following: new column -> columns of the row before / after, as one
    struct (null where there is none). last_seen: new column -> column whose last
    non-null value in the rows before is wanted.

    Nulls in keys form a key of their own; nulls in order come first. Rows that
    tie on the whole order stand in any order, so give a unique last column.
    An empty table gives an empty table. Columns whose names begin with ``_vf_``
    are reserved. Finding the ranges reads the rows once before they are shuffled:
    costly says that making them is dear, so they are written first.
    """
    previous, following, last_seen = previous or {}, following or {}, last_seen or {}
    ranged = cut((cut(df) if costly else df).repartitionByRange(*keys, *order).withColumn("_vf_chunk", F.spark_partition_id()))
    inside = Window.partitionBy("_vf_chunk", *keys).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged
    for name, columns in previous.items():
        rows = rows.withColumn(name, F.lag(F.struct(*columns)).over(inside))
    for name, columns in following.items():
        rows = rows.withColumn(name, F.lead(F.struct(*columns)).over(inside))
    for name, column in last_seen.items():
        rows = rows.withColumn(name, F.last(column, ignorenulls=True).over(before))

    # One row for each (range, key): a key has at most as many rows as there are ranges.
    position = F.struct(*order)
    aggregates: list[Column] = [F.count(F.lit(1)).alias("_vf_n")]
    aggregates += [F.max_by(F.struct(*c), position).alias(f"_vf_p_{n}") for n, c in previous.items()]
    aggregates += [F.min_by(F.struct(*c), position).alias(f"_vf_f_{n}") for n, c in following.items()]
    aggregates += [
        F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_vf_s_{n}") for n, c in last_seen.items()
    ]
    ends = ranged.groupBy("_vf_chunk", *keys).agg(*aggregates)
    across = Window.partitionBy(*keys).orderBy("_vf_chunk")
    carried = ends.select(
        F.col("_vf_chunk").alias("_vf_c"),
        *[F.col(k).alias(f"_vf_k{i}") for i, k in enumerate(keys)],
        *[F.lag(f"_vf_p_{n}").over(across).alias(f"_vf_p_{n}") for n in previous],
        *[F.lead(f"_vf_f_{n}").over(across).alias(f"_vf_f_{n}") for n in following],
        *[
            F.last(f"_vf_s_{n}", ignorenulls=True)
            .over(across.rowsBetween(Window.unboundedPreceding, -1))
            .alias(f"_vf_s_{n}")
            for n in last_seen
        ],
    )
    on = F.col("_vf_chunk") == F.col("_vf_c")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_vf_k{i}"))
    joined = rows.join(carried, on, "left")
    for n in previous:
        joined = joined.withColumn(n, F.coalesce(n, f"_vf_p_{n}"))
    for n in following:
        joined = joined.withColumn(n, F.coalesce(n, f"_vf_f_{n}"))
    for n in last_seen:
        joined = joined.withColumn(n, F.coalesce(n, f"_vf_s_{n}"))
    return joined.select(*df.columns, *previous, *following, *last_seen)
