"""Ordered computations inside groups of any size.

A window over a group runs in one task. That is right for ordinary groups, but a
group may hold a large share of all rows. ``split_hot`` finds such groups and cuts
them, and only them, into ordered parts; the window then runs per part, and a small
table of part totals carries the result across parts. The result is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.session import durable

HOT_ROWS = 2_000_000  # rows of one group that one task may order
BROADCAST_ROWS = 200_000  # a keyed helper table up to this size may be broadcast


def _match(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Null-safe equi-join; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in names else c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names]
    return left.join(renamed, on, how).drop(*[f"_r_{c}" for c in names])


def split_hot(df: DataFrame, keys: list[str], order: list, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """Add ``_part``: 0 for ordinary groups, 1.. in order inside groups above ``hot_rows``.

    Returns the frame and the number of parts hot groups were cut into. Without hot
    groups that is 0 and the frame comes back as it is.
    """
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    n_keys, n_rows = hot.agg(F.count("*"), F.sum("_n")).first()
    if not n_keys:
        return df, 0
    marks = durable(hot.select(*keys, F.lit(True).alias("_hot")))
    if n_keys <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    marked = _match(df, marks, keys, "left")
    parts = max(2, math.ceil(n_rows / hot_rows) * 2)
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").withColumn("_part", F.lit(0))
    # Range bounds come from a sample, so both readers below must see one result.
    cut = durable(
        marked.where(F.col("_hot").isNotNull())
        .drop("_hot")
        .repartitionByRange(parts, *[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id() + 1)
    )
    return cold.unionByName(cut), parts


def running(
    df: DataFrame,
    keys: list[str],
    order: list,
    sums: dict[str, Column],
    inclusive: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Prefix sums inside each group; ``inclusive`` counts the row itself.

    ``order`` must be a total order inside the group. Empty prefixes give 0.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parted, parts = split_hot(df, keys, order, hot_rows)
    last = Window.currentRow if inclusive else -1
    # Without parts the window's partitioning is the keys alone, which later steps can reuse.
    within = [*keys, "_part"] if parts else keys
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    local = parted.withColumns({n: F.coalesce(F.sum(e).over(w), F.lit(0)) for n, e in sums.items()})
    if not parts:
        return local
    carried = (
        parted.where(F.col("_part") > 0)
        .groupBy(*keys, "_part")
        .agg(*[F.sum(e).alias(f"_c_{n}") for n, e in sums.items()])
    )
    # At most one group continues across each cut, so this is at most 2 x parts rows.
    wp = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumns({f"_c_{n}": F.sum(f"_c_{n}").over(wp) for n in sums})
    joined = _match(local, F.broadcast(carried) if parts <= BROADCAST_ROWS else carried, [*keys, "_part"], "left")
    return joined.withColumns({n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}).drop(
        "_part", *[f"_c_{n}" for n in sums]
    )


def numbered(df: DataFrame, keys: list[str], order: list, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact 1-based row number inside each group."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, True, hot_rows)


def top_k(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group, numbered.

    Below 1000 rows Spark limits every group on the map side already. Above, a first
    round over salted groups does the same, so no task sorts a whole hot group.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if k >= 1000:
        salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
