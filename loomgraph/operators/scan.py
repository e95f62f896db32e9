"""Running totals and previous values over ordered groups of any size.

``sliced`` cuts the rows at quantiles of (group, order), so a group with many rows is spread over
many slices and a slice is about one partition.  ``running`` works in two phases: every slice
is scanned on its own, the totals at its end are combined along each group, and what the earlier
slices amount to is applied to the rows of the later ones.  Only groups that cross a cut have
anything to carry: at most two entries per cut, whatever the size of the table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.session import materialize

#: How a total is made within a slice, and how two totals of one group become one.
_FOLDS = {
    "sum": (F.sum, lambda a, b: a + b),
    "max": (F.max, F.greatest),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
}


def sliced(df: DataFrame, keys: list[str], order: list[str], label: str = "slices",
           parts: int | None = None) -> DataFrame:
    """``df``, stored, with ``slice``: numbers that rise with (keys, order), null first."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows equal in keys and order may be many as well; a row number lets a cut fall between them
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    return materialize(rows.repartitionByRange(parts, *keys, *order, "_row")
                       .withColumn("slice", F.spark_partition_id()), label)


def running(cut: DataFrame, keys: list[str], order: list[str],
            totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """``cut`` (of :func:`sliced`) with a column for each of ``totals``: name -> (kind, value).

    ``sum``, ``max`` and ``xor`` run over the rows of the group up to this one; ``prev`` is the
    value of the row before, null for the first.  Groups may have null keys.  Rows of one group equal
    in all of ``order`` follow each other in a fixed but arbitrary order.
    """
    order = [*order, "_row"]
    in_slice = Window.partitionBy(*keys, "slice").orderBy(*order)
    up_to = in_slice.rowsBetween(Window.unboundedPreceding, 0)
    values = {f"_v_{n}": v for n, (_, v) in totals.items()}
    rows = cut.withColumns(values)

    at_end, carry, within, applied = [], [], {}, {}
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in totals.items():
        value, total, carried = f"_v_{name}", f"_t_{name}", F.col(f"_c_{name}")
        if kind == "prev":
            at_end.append(F.max_by(F.struct(value), F.struct(*order)).alias(total))
            carry.append(F.lag(total).over(Window.partitionBy(*keys).orderBy("slice")).alias(f"_c_{name}"))
            within[f"_w_{name}"] = F.lag(value).over(in_slice)
            within["_first"] = F.row_number().over(in_slice) == 1
            applied[name] = F.when(F.col("_first"), carried[value]).otherwise(F.col(f"_w_{name}"))
        else:
            fold, join = _FOLDS[kind]
            at_end.append(fold(value).alias(total))
            carry.append(fold(total).over(earlier).alias(f"_c_{name}"))
            within[f"_w_{name}"] = fold(value).over(up_to)
            here = F.col(f"_w_{name}")
            applied[name] = F.when(carried.isNull(), here).when(here.isNull(), carried).otherwise(
                join(here, carried))

    ends = cut.withColumns(values).groupBy(*keys, "slice").agg(*at_end)
    crossing = (ends.groupBy(*keys).agg(F.collect_list(F.struct("slice", *[c for c in ends.columns if c.startswith("_t_")])).alias("_ends"))
                .where(F.size("_ends") > 1).select(*keys, F.inline("_ends")))
    carries = crossing.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                              F.col("slice").alias("_at"), *carry)
    same = F.col("slice") == F.col("_at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # at most two rows for each cut between slices
    met = rows.withColumns(within).join(F.broadcast(carries), same, "left")
    return met.withColumns(applied).select(*cut.columns, *totals)
