"""Row numbers and top-k per group that do not put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

# A block spans 2^21 order values, a region 2^21 blocks; 63 bits of order values make at most 2^22 regions.
_BITS = 21


def dense_index(df: DataFrame, groups: Sequence[str], order: str, name: str) -> DataFrame:
    """0-based position of each row in its group by the bigint column ``order``, unique within the group.

    ``row_number`` over the group would sort a group that holds a third of the table in one task. Here rows are counted
    per block of order values, the counts are summed up in two levels, and rows are numbered within their block only.
    As order values are unique, no task sees more than 2^21 rows of a block (or 2^22 partial counts) whatever the
    distribution. The rows themselves are exchanged once, on the block; ``groups`` must not be NULL.
    """
    block, region, start, n = f"__{name}_block", f"__{name}_region", f"__{name}_start", f"__{name}_n"
    blocked = df.withColumns(
        {
            block: F.coalesce(F.shiftright(order, _BITS), F.lit(-1).cast("bigint")),
            region: F.coalesce(F.shiftright(order, 2 * _BITS), F.lit(-1).cast("bigint")),
        }
    )
    in_region = [*groups, region]
    in_block = [*in_region, block]

    def before(window) -> Column:
        return F.coalesce(F.sum(n).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    per_block = blocked.groupBy(*in_block).agg(F.count(F.lit(1)).alias(n))
    per_region = per_block.groupBy(*in_region).agg(F.sum(n).alias(n))
    region_start = per_region.select(*in_region, before(W.partitionBy(*groups).orderBy(region)).alias("__r"))
    block_start = per_block.select(*in_block, before(W.partitionBy(*in_region).orderBy(block)).alias("__b"))
    starts = block_start.join(region_start, in_region).select(*in_block, (F.col("__b") + F.col("__r")).alias(start))

    rank = F.row_number().over(W.partitionBy(*in_block).orderBy(order))
    return (
        blocked.join(starts, in_block)
        .withColumn(name, (F.col(start) + rank - 1).cast("bigint"))
        .select(*[F.col(c) for c in df.columns], name)
    )


def numbered(df: DataFrame, name: str, order: Sequence[Column | str] = ()) -> DataFrame:
    """Add the 0-based position of each row among all rows, for tables without an order column that is unique.

    With ``order`` by these columns, rows that are equal in them in some order; else as the rows are read. Two passes and
    no window over the rows: they are written once, with their place in their task, to the shared folder; sizes of tasks
    are summed up, and each row adds its place to where its task begins. Only the sizes, one row a task, are ever in one
    place. As the written rows are read again, the numbers do not change when a task is repeated.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place, task, start = f"__{name}_place", f"__{name}_task", f"__{name}_start"
    # The number holds the task in its upper bits and the place in it in the lower 33.
    kept = stored(df.withColumn(place, F.monotonically_increasing_id()), "numbered")
    sizes = kept.groupBy(F.shiftright(place, 33).alias(task)).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy(task).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(task, before.alias(start))
    at = F.col(start) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    placed = kept.withColumn(task, F.shiftright(place, 33)).join(starts, task)
    return placed.select(*[F.col(c) for c in df.columns if c != name], at.cast("bigint").alias(name))


# Up to this k Spark prunes every task to k rows a group before the exchange.
_PRUNED = 1000
_SPREAD = 64


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows per group.

    Spark prunes to ``k`` per group in every task before the exchange (WindowGroupLimit), so a hot group costs ``k``
    rows per task, not its size. It does so up to spark.sql.optimizer.windowGroupLimitThreshold, 1000 by default; for
    larger ``k`` a group is first dealt out to ``_SPREAD`` parts, of which each keeps its own first ``k`` rows.
    """

    def first(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        return rows.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")

    if k <= _PRUNED:
        return first(df, groups)
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(_SPREAD)))
    return first(first(dealt, [*groups, "__part"]), groups).drop("__part")


# Classes of keys for each of the k rows that are wanted; the bound lies a little above the k-th key.
_CLASSES = 4


def below_kth(df: DataFrame, groups: Sequence[str], key: Sequence[str], order: Column, k: int) -> DataFrame:
    """The rows of which ``order`` is not above a bound; it leaves out none of the first ``k`` different keys of a group.

    Keys are dealt by hash into ``_CLASSES * k`` classes. The least order value of each class belongs to a key of its own,
    so the k-th least of these values is not below that of the k-th key; as the first k keys mostly lie in different
    classes, it is not far above it. Only least values are exchanged, one for each class and group from a task, however
    many different keys there are. Rows then meet the bound of their group; NULL order values and groups with fewer
    classes than ``k`` are kept whole. ``order`` must be a function of the key; NULL groups are groups.
    """
    if not groups:
        return df
    names = [f"__group_{i}" for i in range(len(groups))]
    keyed = df.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], F.pmod(F.xxhash64(*key), F.lit(_CLASSES * k)).alias("__class"), order.alias("__order"))
    least = keyed.groupBy(*names, "__class").agg(F.min("__order").alias("__least"))
    bounds = least.groupBy(*names).agg(F.get(F.array_sort(F.collect_list("__least")), F.lit(k - 1)).alias("__bound"))
    valued = df.withColumn("__order", order)
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names)]
    met = same[0]
    for condition in same[1:]:
        met = met & condition
    held = F.col("__order").isNull() | F.col("__bound").isNull() | (F.col("__order") <= F.col("__bound"))
    return valued.join(bounds, met).where(held).select(*df.columns)
