"""Block grid: compare every left row with every right row in bounded tasks.

Both sides are cut into blocks of bounded size by a hash of their ids.  Each (left block, right
block) cell is one task group; its kernel reduces before anything is emitted, so no pair is ever
written out.  Rows travel once per block of the other side; neither side is broadcast or collected.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_count(rows: int, block_rows: int) -> int:
    return max(1, math.ceil(rows / block_rows))


def grid_apply(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
               kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
               left_rows: int, right_rows: int, block_rows: int) -> DataFrame:
    n_left = block_count(left_rows, block_rows)
    n_right = block_count(right_rows, block_rows)

    def cells(df: DataFrame, id_col: str, own: str, own_n: int, other: str, other_n: int):
        # fresh column identities, as both sides may come from one table
        return (df.select(*[F.col(c).alias(c) for c in df.columns])
                .withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(own_n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))))

    a = cells(left, left_id, "_lb", n_left, "_rb", n_right)
    b = cells(right, right_id, "_rb", n_right, "_lb", n_left)
    return (a.groupBy("_lb", "_rb").cogroup(b.groupBy("_lb", "_rb"))
             .applyInPandas(kernel, schema))
