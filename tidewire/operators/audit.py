"""Coverage audit: shares, concentration, buckets of a fixed domain, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concentration(counts: DataFrame, name: str, value: str, top: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: n, total, hhi (sum of squared shares) and the share of the greatest `top`; null where the total isn't positive.

    Shares need the total only, so names are aggregated in place; the greatest come from a limit, not from a sort of all.
    """
    most = max(top)
    whole = counts.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.sum(F.col(value).cast("double") * F.col(value)).alias("squares"))
    first = counts.orderBy(F.desc(value), name).limit(most).select(F.col(value).alias("v"))
    ranked = first.agg(F.sort_array(F.collect_list("v"), asc=False).alias("values"))
    both = whole.join(ranked, F.lit(True))
    share = lambda k: F.aggregate(F.slice("values", 1, k), F.lit(0).cast("double"), lambda a, x: a + x) / F.col("total")
    some = F.col("total") > 0
    return both.select("n", "total", F.when(some, F.col("squares") / F.pow(F.col("total").cast("double"), F.lit(2))).alias("hhi"), *(F.when(some, share(k)).alias(f"top{k}") for k in top))


def buckets(domain: DataFrame, counts: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Every bucket of the domain with its count and state: missing (0), weak (below 1 % or 3), ok."""
    total = counts.agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))
    rows = domain.join(counts, key, "left").withColumn(value, F.coalesce(value, F.lit(0))).join(F.broadcast(total), F.lit(True))
    weak = F.col(value) < F.greatest(F.lit(3.0), F.col("total") * 0.01)
    return rows.withColumn("state", F.when(F.col(value) == 0, "missing").when((F.col("total") <= 0) | weak, "weak").otherwise("ok")).drop("total")


def overrepresented(counts: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Names with more than twice the mean share."""
    whole = counts.agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("names"))
    rows = counts.join(F.broadcast(whole), F.lit(True)).withColumn("share", F.col(value) / F.col("total"))
    return rows.where(F.col("share") > 2.0 / F.col("names")).select(key, value, "share")


def rollups(rows: DataFrame, sets: list[list[str]], **measures) -> DataFrame:  # noqa: ANN003
    """Several groupings in one pass; columns outside a grouping are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*(m.alias(k) for k, m in measures.items()))


def redundant(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Keys with several names, and how many."""
    return rows.groupBy(key).agg(F.count_distinct(name).alias("n")).where("n > 1")


def argmax(rows: DataFrame, key: str, value: str, *order: str, descending: bool = True) -> DataFrame:
    """The row of each key with the greatest value; ties by `order`."""
    first = F.desc(value) if descending else F.asc(value)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(first, *order))).where("_n = 1").drop("_n")


#: What an audit advises of a source: the first row of conditions that holds, on its numbers. Each condition is (number, at least, below); None leaves a side open.
ADVICE = [
    ("unreachable", [("success_rate", None, 0.5), ("attempts", 3, None)]),
    ("silent", [("fetched", None, 1)]),
    ("unused", [("fetched", 5, None), ("useful", None, 1)]),
    ("mostly repeats", [("fetched", 5, None), ("duplicate_rate", 0.5, None)]),
    ("weak", [("fetched", 5, None), ("useful_rate", None, 0.2)]),
    ("keep", []),
]


def contributions(sources: DataFrame, advice: list = ADVICE) -> DataFrame:
    """Rows of sources (name, attempts, successes, fetched, useful, duplicates) with their rates (null where nothing was tried or fetched), advice by the first row that holds, and their place by what they contribute.

    The place is a rank over useful, from counts: sources with one number share a window of their own no more than ties do. A null rate meets no condition.
    """
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    rows = sources.withColumns({"success_rate": rate("successes", "attempts"), "useful_rate": rate("useful", "fetched"), "duplicate_rate": rate("duplicates", "fetched")})
    said = F.lit(None).cast("string")
    for name, needs in reversed(advice):
        met = F.lit(True)
        for number, least, below in needs:
            x = F.col(number)
            met = met & (F.lit(True) if least is None else x >= least) & (F.lit(True) if below is None else x < below)
        said = F.when(met, F.lit(name)).otherwise(said)
    # places from how many sources have each number of useful stories: a table of distinct numbers, not of sources
    counts = rows.groupBy("useful").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.withColumn("place", F.sum("_n").over(Window.orderBy(F.desc("useful"))) - F.col("_n") + 1).drop("_n")
    return rows.withColumn("advice", said).join(ahead, "useful")
