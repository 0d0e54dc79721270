"""Order statistics of groups of any size: exact, by counts, with no group gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.sources.written import written

#: A round splits what is left of a group into so many cells by value; a group of at most ``GATHER`` values is sorted as it is.
CELLS, GATHER = 1 << 12, 1 << 15


def medians(df: DataFrame, key: str, value: str, cells: int = CELLS, gather: int = GATHER) -> DataFrame:
    """(key, n, median): the middle value of each group, or the mean of the two, as doubles; n counts the group's values. Nulls are left out.

    Both middle ranks are narrowed down together: the range that holds a rank is cut into cells, the cells are counted (on
    the map side first), and the cell with the rank is the next range, from its least value to its greatest. Rounds end when
    a range is one value or holds few: then those are sorted. Rows within the ranges are all that a round reads again.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x")).where("x is not null")
    sizes = written(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    ranks = F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("which"), F.floor(F.col("n") / 2).alias("rank")))
    left = sizes.select("k", F.inline(ranks), "n", "low", "high")
    found = None
    while True:
        same = left.where("low = high or isnan(high)").select("k", "which", F.coalesce(F.when(F.isnan("high"), F.col("high")), F.col("low")).alias("x"))
        few = left.where(f"low < high and not isnan(high) and n <= {gather}")
        inside = _within(rows, few)
        picked = inside.groupBy("k", "which", "rank").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        here = same.unionAll(picked.select("k", "which", F.get("xs", F.col("rank").cast("int")).alias("x")))
        found = here if found is None else found.unionAll(here)
        many = left.where(f"low < high and not isnan(high) and n > {gather}")
        if many.isEmpty():
            break
        cell = F.least(F.lit(cells - 1), F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * cells).cast("int"))
        counts = _within(rows, many).groupBy("k", "which", "rank", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        listed = counts.groupBy("k", "which", "rank").agg(F.sort_array(F.collect_list(F.struct("cell", "n", "low", "high"))).alias("c"))  # at most ``cells`` of them
        before = F.aggregate("c", F.array(F.lit(0).cast("long")), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c["n"])))
        at = listed.select("k", "which", "rank", "c", before.alias("before")).select("k", "which", "rank", "before", F.posexplode("c").alias("i", "c"))
        at = at.withColumn("first", F.get("before", "i")).where((F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("first") + F.col("c.n")))
        left = written(at.select("k", "which", (F.col("rank") - F.col("first")).alias("rank"), "c.n", "c.low", "c.high"))
    two = found.groupBy("k").agg(F.avg("x").alias("median"))
    return two.join(sizes.select(F.col("k").alias("__k"), "n"), F.col("k").eqNullSafe(F.col("__k"))).select(F.col("k").alias(key), "n", "median")


def _within(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of each range that is looked at: (k, which, rank, low, high, x). A range is two rows a group at most."""
    ranges = ranges.select(F.col("k").alias("__k"), "which", "rank", "low", "high")
    return rows.join(ranges, F.col("k").eqNullSafe(F.col("__k")) & F.col("x").between(F.col("low"), F.col("high"))).select("k", "which", "rank", "low", "high", "x")
