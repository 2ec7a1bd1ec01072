"""Order statistics, quantiles and the first of an order, found by counts: no task ranks or gathers all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets that a range is cut into at each level.
BUCKETS = 65_536
#: Levels of refinement: a cut's last bucket holds about a BUCKETS^LEVELS-th of the rows, or copies of few values.
LEVELS = 1


def magnitude(value: Column) -> Column:
    """An integer that never falls as `value` (double) rises: sign and exponent. 0 for zeros, the ends for infinities and NaN."""
    exponent = F.greatest(F.floor(F.log2(F.abs(value))), F.lit(-1100)) + 1101
    return (
        F.when(F.isnan(value), F.lit(5000)).when(value == float("inf"), F.lit(4000)).when(value == float("-inf"), F.lit(-4000))
        .when(value == 0, F.lit(0)).when(value > 0, exponent).otherwise(-exponent).cast("int")
    )


def _located(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Of `counts` (keys, rank, bucket, n, lo, hi) the bucket of each key's rank, and the rank within it."""
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy(bucket))  # BUCKETS rows at most, or one an exponent
    found = counts.withColumn("_upto", upto).filter((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("n")))
    return found.withColumn("rank", F.col("rank") - F.col("_upto") + F.col("n")).drop("_upto", "n")


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, cut, n, value): for each group the value of the rank (from 0, ascending) that `ranks` has for each cut.

    Ranks are expressions of `n`, the group's rows whose value isn't null; a rank that
    isn't one of 0 to n - 1 has no row. Values are counted by sign and exponent, then by even
    ranges within the exponent of the cut, then by even ranges within the range of the cut;
    what is left there, counted by value, is ranked. Values of one group are never
    together in one place, copies of a value are one row. NaN is greater than all. Ties
    need no care. Groups' columns may be null.
    """
    group = [f"_g{i}" for i in range(len(by))]
    safe = [F.struct(F.col(c)).alias(g) for c, g in zip(by, group, strict=True)]  # equal where both are null
    values = rows.filter(F.col(value).isNotNull()).select(*safe, F.col(value).cast("double").alias("v"))
    values = values.select(*group, "v", magnitude(F.col("v")).alias("e"))
    first = values.groupBy(*group, "e").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    whole = first.withColumn("total", F.sum("n").over(W.partitionBy(*group)) if group else F.sum("n").over(W.partitionBy()))
    cut = F.inline(F.array(*[F.struct(F.lit(k).alias("cut"), r.cast("long").alias("rank")) for k, r in ranks.items()]))
    asked = whole.withColumn("_n", F.col("n")).withColumn("n", F.col("total")).select(*group, "e", "_n", "lo", "hi", "total", cut)
    cuts = _located(asked.withColumnRenamed("_n", "n"), [*group, "cut"], "e")
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).otherwise(0)
    for _ in range(LEVELS):
        inside = _within(values, cuts, group).withColumn("b", bucket)
        counts = inside.groupBy(*group, "e", "cut", "total", "rank", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        cuts = _located(counts, [*group, "cut"], "b").drop("b")
    last = _within(values, cuts, group).groupBy(*group, "cut", "total", "rank", "v").agg(F.count("*").alias("n"))
    found = _located(last, [*group, "cut"], "v")
    return found.select(*[F.col(f"{g}.{c}").alias(c) for c, g in zip(by, group, strict=True)], "cut", F.col("total").alias("n"), F.col("v").alias("value"))


def _within(values: DataFrame, cuts: DataFrame, group: list[str]) -> DataFrame:
    """The values between lo and hi of a cut of their group and exponent; one row for each cut they are in."""
    keys = [*group, "e"]
    between = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    return values.join(cuts, keys).filter(between | F.isnan("v"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, share, n, value): exact quantiles, linear between the two values next to the place share * (n - 1)."""
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = {f"{i}{end}": f(place(p)) for i, p in enumerate(shares) for end, f in (("a", F.floor), ("b", F.ceil))}
    found = order_statistics(rows, by, value, ranks)
    listed = F.array(*map(F.lit, shares))
    share = F.get(listed, F.regexp_replace("cut", "[ab]", "").cast("int"))
    at = lambda end: F.max(F.when(F.col("cut").endswith(end), F.col("value")))
    both = found.withColumn("share", share).groupBy(*by, "share", "n").agg(at("a").alias("a"), at("b").alias("b"))
    part = F.col("share") * (F.col("n") - 1)
    between = F.col("a") + (F.col("b") - F.col("a")) * (part - F.floor(part))
    return both.select(*by, "share", "n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("value"))


def quantile_columns(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, p05, p50, ...): `quantiles` side by side; a row for each group that has a value."""
    found = quantiles(rows, by, value, shares)
    named = [F.max(F.when(F.col("share") == F.lit(p), F.col("value"))).alias(f"p{round(100 * p):02d}") for p in shares]
    return found.groupBy(*by).agg(*named)


def first_in_order(rows: DataFrame, order: Column, column: str, k: Column) -> DataFrame:
    """One row (h, id), or none: hash and `column` of the k-th of `rows` by `order` (hex digits), then `column`.

    `k` is an expression of `n`, the number of rows; with k over n it is the last row.
    Rows are counted by the first three digits, those that share the k-th row's by the next
    three, and only rows that share all six are ranked.
    """
    keyed = rows.select(order.alias("h"), F.col(column).alias("id"))
    parts = keyed.select("*", F.substring("h", 1, 3).alias("d0"), F.substring("h", 4, 3).alias("d1"))
    ordered = lambda d: W.partitionBy().orderBy(d)  # noqa: E731  over 4096 rows
    first = parts.groupBy("d0").agg(F.count("*").alias("c"))
    first = first.select("d0", "c", F.sum("c").over(ordered("d0")).alias("upto"), F.sum("c").over(W.partitionBy()).alias("n"))
    first = first.select("d0", "c", "upto", F.least(k.cast("long"), F.col("n")).alias("k"))
    hit = (F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("c"))
    at = first.filter(hit).select("d0", (F.col("k") - F.col("upto") + F.col("c")).alias("k"))  # one row
    second = parts.join(F.broadcast(at), "d0").groupBy("d0", "d1", "k").agg(F.count("*").alias("c"))
    second = second.withColumn("upto", F.sum("c").over(ordered("d1")))
    at = second.filter(hit).select("d0", "d1", (F.col("k") - F.col("upto") + F.col("c")).alias("k"))
    few = parts.join(F.broadcast(at), ["d0", "d1"]).withColumn("_r", F.row_number().over(W.partitionBy().orderBy("h", "id")))
    return few.filter(F.col("_r") == F.col("k")).select("h", "id")


def take_first(rows: DataFrame, order: Column, column: str, k: Column, name: str) -> DataFrame:
    """`rows` with `name`: whether a row is one of the first k by `order`, then `column`. No row is ranked or moved."""
    last = first_in_order(rows, order, column, k).select(F.col("h").alias("_last_h"), F.col("id").alias("_last_id"))
    joined = rows.withColumn("_h", order).join(F.broadcast(last), F.lit(True), "left")  # one row, or none
    among = (F.col("_h") < F.col("_last_h")) | ((F.col("_h") == F.col("_last_h")) & (F.col(column) <= F.col("_last_id")))
    return joined.select(*rows.columns, F.coalesce(among, F.lit(False)).alias(name))
