"""Thresholds, confusion counts and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaline.operators.selection import order_statistics, quantile_columns

FPR_TARGET = 0.0069


def calibrate(scores: DataFrame, target: float = FPR_TARGET, least: int = 10) -> DataFrame:
    """(layer, tau): the (floor(target * n) + 1)-th greatest score of the clean rows.

    With `score > tau` flagged, no more than `target` of them are. Layers with fewer than
    `least` clean rows get no threshold. The cut is found by counts (`order_statistics`).
    """
    clean = scores.filter(~F.col("is_poisoned"))
    found = order_statistics(clean, ["layer"], "score", {"tau": F.col("n") - 1 - F.floor(F.col("n") * F.lit(target))})
    return found.filter(F.col("n") >= least).select("layer", F.col("value").alias("tau"))


def calibration_rates(scores: DataFrame, taus: DataFrame) -> DataFrame:
    """(layer, tau, fpr, tpr): shares of clean and poisoned rows over the threshold."""
    over = (F.col("score") > F.col("tau")).cast("double")
    return (
        scores.join(F.broadcast(taus), "layer")
        .groupBy("layer", "tau")
        .agg(
            F.avg(F.when(~F.col("is_poisoned"), over)).alias("fpr"),
            F.avg(F.when(F.col("is_poisoned"), over)).alias("tpr"),
        )
    )


def flags(encounters: DataFrame, taus: DataFrame) -> DataFrame:
    """Encounters by layer with their outcome: excluded, by_hash, by_score and flagged.

    `encounters`: query_id, adv, doc_id, is_poisoned, in_calibration, tampered, layer,
    score. A calibration document met by a benign query is excluded from every count; a
    tampered one is flagged in all layers without scoring; the rest if `score > tau`.
    """
    excluded = F.col("in_calibration") & ~F.col("adv")
    by_hash = ~excluded & F.col("tampered")
    by_score = ~excluded & ~F.col("tampered") & (F.col("score") > F.col("tau"))
    return encounters.join(F.broadcast(taus.select("layer", "tau")), "layer").select(
        "layer", "query_id", "adv", "doc_id", "is_poisoned",
        excluded.alias("excluded"), by_hash.alias("by_hash"), F.coalesce(by_score, F.lit(False)).alias("by_score"),
        (by_hash | F.coalesce(by_score, F.lit(False))).alias("flagged"),
    )


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; 0 for a whole of 0."""
    return F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0))


def confusion(flagged: DataFrame, benign_queries: Column) -> DataFrame:
    """One row a layer: counts, ASR, document FPR and query FPR in percent.

    Poison met by a benign query and clean documents met by an attack count nowhere but
    among the catches. `benign_queries`: the number of all benign queries, those too
    whose documents are all excluded.
    """
    seen, adv, bad, hit = ~F.col("excluded"), F.col("adv"), F.col("is_poisoned"), F.col("flagged")
    queries = flagged.groupBy("layer", "query_id").agg(
        F.count_if(seen & adv & bad).alias("attempts"),
        F.count_if(seen & adv & bad & ~hit).alias("successes"),
        F.count_if(seen & ~adv & ~bad).alias("clean_seen"),
        F.count_if(seen & ~adv & ~bad & hit).alias("fp_docs"),
        F.count_if("by_hash").alias("hash_catches"),
        F.count_if("by_score").alias("score_catches"),
    )
    counts = queries.groupBy("layer").agg(
        *[F.sum(c).alias(c) for c in ("attempts", "successes", "clean_seen", "fp_docs", "hash_catches", "score_catches")],
        F.count_if(F.col("fp_docs") > 0).alias("fp_queries"),
    )
    return counts.select(
        "*",
        (F.col("attempts") - F.col("successes")).alias("tp"),
        F.col("successes").alias("fn"),
        F.col("fp_docs").alias("fp"),
        (F.col("clean_seen") - F.col("fp_docs")).alias("tn"),
        percent(F.col("successes"), F.col("attempts")).alias("asr"),
        percent(F.col("fp_docs"), F.col("clean_seen")).alias("doc_fpr"),
        percent(F.col("fp_queries"), benign_queries).alias("query_fpr"),
    )


def relative_flags(records: DataFrame, deviations: float = 1.5, flat: float = 0.02) -> DataFrame:
    """`records` (query_id, id, score) with `flagged`: over the query's mean plus `deviations` of its deviations.

    Where a query's scores are all equal, over the mean plus `flat`.
    """
    by = W.partitionBy("query_id")
    mu, sd = F.avg("score").over(by), F.stddev_pop("score").over(by)
    limit = F.round(F.when(sd > 1e-12, mu + deviations * sd).otherwise(mu + flat), 9)
    return records.select("*", (F.col("score") > limit).alias("flagged"))


def even_thresholds(rows: DataFrame, by: list[str], steps: int, ends: int) -> DataFrame:
    """(by, thresholds): the first `ends` of the thresholds at lo + step * (hi - lo) / steps, rounded to 9 digits."""
    span = rows.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    at = lambda i: F.round(F.col("lo") + i * (F.col("hi") - F.col("lo")) / steps, 9)
    return span.filter("lo IS NOT NULL").select(*by, F.transform(F.sequence(F.lit(0), F.lit(ends - 1)), at).alias("thresholds"))


def _from_top(counts: DataFrame, keys: list[str], bucket: str, names: list[str]) -> list[Column]:
    """Sums of `names` over the buckets above each row's, and over all, by `keys`."""
    by = W.partitionBy(*keys)
    above = by.orderBy(F.desc(bucket)).rowsBetween(W.unboundedPreceding, -1)
    return [F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_over") for c in names] + [F.sum(c).over(by).alias(f"{c}_all") for c in names]


def sweep(rows: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """(by, step, threshold, tpr, fpr) for each of the ascending `thresholds` (by, thresholds: a few dozen) of a group.

    Each row is counted once, in the bucket of how many thresholds are below its score;
    what is over a threshold is the sum of the buckets above it. Equal thresholds agree.
    """
    group = [F.col(c) for c in by]
    bucket = F.size(F.filter("thresholds", lambda t: F.col("score") > t)).alias("bucket")
    joined = rows.join(F.broadcast(thresholds), by) if by else rows.crossJoin(F.broadcast(thresholds))  # a row a group
    counted = joined.select(*group, bucket, F.col("is_poisoned").alias("bad"))
    counts = counted.groupBy(*by, "bucket").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    zeros = thresholds.select(*group, F.explode(F.sequence(F.lit(0), F.size("thresholds"))).alias("bucket")).select("*", F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("good"))
    every = counts.unionByName(zeros).groupBy(*by, "bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    summed = every.select(*group, "bucket", *_from_top(every, by, "bucket", ["bad", "good"]))
    steps = thresholds.select(*group, F.posexplode("thresholds").alias("bucket", "threshold"))
    return steps.join(summed, [*by, "bucket"]).select(
        *group, F.col("bucket").alias("step"), "threshold", F.try_divide("bad_over", "bad_all").alias("tpr"), F.try_divide("good_over", "good_all").alias("fpr")
    )


def threshold_sweep(rows: DataFrame, steps: int = 15, by: list[str] | None = None) -> DataFrame:
    """(by, step, threshold, tpr, fpr) for `steps` thresholds from the least to below the greatest score of each group."""
    return sweep(rows, even_thresholds(rows, by or [], steps, steps), by or [])


def youden_best(rows: DataFrame, steps: int = 20, by: list[str] | None = None) -> DataFrame:
    """(by, threshold, youden): the first threshold of the greatest TPR - FPR among `steps` + 1 even ones from end to end."""
    rated = sweep(rows, even_thresholds(rows, by or [], steps, steps + 1), by or [])
    rated = rated.withColumn("youden", F.round(F.col("tpr") - F.col("fpr"), 9))
    best = F.max_by(F.struct("threshold", "youden"), F.struct("youden", -F.col("step")))
    return rated.groupBy(*(by or [])).agg(best.alias("b")).filter("b IS NOT NULL").select(*(by or []), "b.threshold", "b.youden")


def grid_evaluate(records: DataFrame, grid: DataFrame) -> DataFrame:
    """ASR and document FPR of each setting of `grid` (config, n_std, min_abs, abs_high; nulls switch a part off).

    `records`: query_id, adv, is_poisoned, score. A document is flagged over mean + n_std
    deviations of its query and over min_abs, or over abs_high. The FPR's whole are all
    clean documents, those met by attacks too. Each record is counted once, in a cell of
    two buckets: how many of the grid's n_std, in their order, it passes, and how many of its absolute
    thresholds. The settings are rated on the cells.
    """
    settings = grid.collect()  # some dozens
    deviations = sorted({r.n_std for r in settings if r.n_std is not None})
    limits = sorted({x for r in settings for x in (r.min_abs, r.abs_high) if x is not None})
    by = W.partitionBy("query_id")
    stats = records.select("*", F.avg("score").over(by).alias("mu"), F.stddev_pop("score").over(by).alias("sd"))
    passed = lambda tests: sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0))
    wide = passed([F.col("score") > F.round(F.col("mu") + n * F.col("sd"), 9) for n in deviations])
    high = passed([F.col("score") > x for x in limits])
    adv, bad = F.col("adv"), F.col("is_poisoned")
    cells = stats.groupBy(wide.alias("wide"), high.alias("high")).agg(
        F.count_if(adv & bad).alias("attacks"), F.count_if(~adv & ~bad).alias("benign"), F.count_if(~bad).alias("clean")
    )  # (deviations + 1) times (limits + 1) at most
    place = lambda x, values: None if x is None else values.index(x)
    rows = [(r.config, r.n_std, r.min_abs, r.abs_high, place(r.n_std, deviations), place(r.min_abs, limits), place(r.abs_high, limits)) for r in settings]
    named = records.sparkSession.createDataFrame(rows, "config int, n_std double, min_abs double, abs_high double, d int, m int, h int")
    hit = F.coalesce((F.col("wide") > F.col("d")) & (F.col("high") > F.col("m")), F.lit(False)) | F.coalesce(F.col("high") > F.col("h"), F.lit(False))
    rated = (
        named.crossJoin(F.broadcast(cells))  # settings times cells
        .groupBy("config", "n_std", "min_abs", "abs_high")
        .agg(
            percent(F.sum(F.when(~hit, F.col("attacks")).otherwise(0)), F.sum("attacks")).alias("asr"),
            percent(F.sum(F.when(hit, F.col("benign")).otherwise(0)), F.sum("clean")).alias("doc_fpr"),
        )
    )
    good = F.when((F.col("asr") < 20) & (F.col("doc_fpr") < 10), "best").when((F.col("asr") < 20) & (F.col("doc_fpr") < 15), "good")
    return rated.select("*", F.coalesce(good, F.lit("")).alias("note"))


def quantile_profile(rows: DataFrame, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, is_poisoned, n, mean, std and the quantiles asked for) of score by class."""
    keys = [*(by or []), "is_poisoned"]
    plain = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return plain.join(quantile_columns(rows, keys, "score", shares), keys)


def midpoint_eval(rows: DataFrame, delta: float = 0.02, by: list[str] | None = None) -> DataFrame:
    """(by, threshold, fpr, tpr) at the midpoint of the clean P95 and the poisoned P5, and `delta` on either side."""
    keys = by or []
    ends = quantile_columns(rows, [*keys, "is_poisoned"], "score", [0.05, 0.95])
    both = ends.groupBy(*keys).agg(F.max(F.when(~F.col("is_poisoned"), F.col("p95"))).alias("a"), F.max(F.when(F.col("is_poisoned"), F.col("p05"))).alias("b"))
    mid = (F.col("a") + F.col("b")) / 2
    three = both.filter("a IS NOT NULL AND b IS NOT NULL").select(*keys, F.array(*[F.round(mid + d, 9) for d in (-delta, 0.0, delta)]).alias("thresholds"))
    return sweep(rows, three, keys).select(*keys, "threshold", "fpr", "tpr")
