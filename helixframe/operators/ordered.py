"""Running sums, maxima and neighbours along a coordinate, in blocks.

A window over a whole sequence would be one task. Here the coordinate is cut into blocks: each block is summed up first,
a small window over the block sums gives what comes before a block, and the rows' own windows stay within their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _blocked(df: DataFrame, pos: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(pos) / block))


def with_running(df: DataFrame, keys: list[str], pos: str, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, order: list[str] | None = None, block: int = BLOCK, inclusive: bool = True, ahead: str | None = None) -> DataFrame:
    """Adds running sums and maxima of the given columns by `keys`, in the order of `pos` and then `order`.

    inclusive=False leaves the row itself out: sums start with 0, maxima with null. Rows that tie in the whole order
    count one after the other. ahead: a column with the next row's `pos`, null at the end, in the same pass.
    """
    sums, maxima = sums or {}, maxima or {}
    df = _blocked(df, pos, block).withColumns({f"_v_{k}": v for k, v in {**sums, **maxima}.items()})
    by_block = df.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums], *[F.max(f"_v_{k}").alias(f"_t_{k}") for k in maxima], F.min(pos).alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    following = [F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block")).alias("_next")] if ahead else []
    before = by_block.select(*keys, "_block", *[F.sum(f"_t_{k}").over(earlier).alias(f"_b_{k}") for k in sums], *[F.max(f"_t_{k}").over(earlier).alias(f"_b_{k}") for k in maxima], *following)
    inside = Window.partitionBy(*keys, "_block").orderBy(pos, *(order or [])).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = df.join(before, [*keys, "_block"])
    added = {k: F.coalesce(f"_b_{k}", F.lit(0)) + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums}
    added |= {k: F.greatest(f"_b_{k}", F.max(f"_v_{k}").over(inside)) for k in maxima}
    if ahead:
        added[ahead] = F.coalesce(F.lead(pos).over(Window.partitionBy(*keys, "_block").orderBy(pos, *(order or []))), F.col("_next"))
    return out.withColumns(added).drop("_block", "_next", *[f"_{x}_{k}" for k in {**sums, **maxima} for x in "vb"])


def with_neighbour(df: DataFrame, keys: list[str], pos: str, columns: dict[str, Column], ahead: bool, order: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds the given columns as they are in the next row (ahead) or the one before, null at the ends."""
    order = order or []
    df = _blocked(df, pos, block).withColumns({f"_v_{k}": v for k, v in columns.items()})
    values = F.struct(*[F.col(f"_v_{k}").alias(k) for k in columns])
    place = F.struct(pos, *order)
    edge = (F.min_by if ahead else F.max_by)(values, place)
    by_block = df.groupBy(*keys, "_block").agg(edge.alias("_edge"))
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    beyond = by_block.select(*keys, "_block", (F.lead if ahead else F.lag)("_edge").over(over_blocks).alias("_beyond"))
    inside = Window.partitionBy(*keys, "_block").orderBy(pos, *order)
    near = (F.lead if ahead else F.lag)(values).over(inside)
    out = df.join(beyond, [*keys, "_block"]).withColumn("_near", F.coalesce(near, F.col("_beyond")))
    return out.withColumns({k: F.col(f"_near.{k}") for k in columns}).drop("_block", "_beyond", "_near", *[f"_v_{k}" for k in columns])
