"""Aggregates over results of several seeds and tiers, gates and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaline.operators.selection import quantile_columns

#: Greatest accepted mean ASR, mean FPR and worst FPR, in percent.
GATE = {"asr": 22.0, "fpr": 3.0, "worst_fpr": 4.0}
#: Greatest accepted ASR and FPR by tier.
TIER_TARGETS = {"p010": (8.0, 2.0), "p050": (20.0, 5.0), "p100": (35.0, 8.0)}


def multi_seed(results: DataFrame) -> DataFrame:
    """Per layer and tier over seeds: mean, population and sample deviation and maximum of ASR and FPR."""
    made = [F.count("*").alias("seeds")]
    for c in ("asr", "doc_fpr"):
        made += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std_pop"), F.stddev_samp(c).alias(f"{c}_std"),
            F.max(c).alias(f"{c}_max"),
        ]
    return results.groupBy("layer", "tier").agg(*made)


def worst_by_seed(results: DataFrame) -> DataFrame:
    return results.groupBy("seed").agg(F.max("asr").alias("worst_asr"), F.max("doc_fpr").alias("worst_fpr"))


def grand_mean(results: DataFrame) -> DataFrame:
    """The mean over tiers of the tiers' means, by layer."""
    tiers = results.groupBy("layer", "tier").agg(F.avg("asr").alias("asr"), F.avg("doc_fpr").alias("doc_fpr"))
    return tiers.groupBy("layer").agg(F.avg("asr").alias("asr"), F.avg("doc_fpr").alias("doc_fpr"))


def tier_pivot(stats: DataFrame, tiers: list[str]) -> DataFrame:
    """The signal-to-noise ratios, one row a signal and one column a tier."""
    return stats.groupBy("signal").pivot("tier", tiers).agg(F.first("snr"))


def gate_verdicts(results: DataFrame) -> DataFrame:
    """Per layer and tier, whether means and worst case are within the gate; per tier targets judged on L1."""
    spark = results.sparkSession
    targets = spark.createDataFrame([(t, a, f) for t, (a, f) in TIER_TARGETS.items()], "tier string, asr_target double, fpr_target double")
    rows = multi_seed(results)
    passed = (F.col("asr_mean") <= GATE["asr"]) & (F.col("doc_fpr_mean") <= GATE["fpr"]) & (F.col("doc_fpr_max") <= GATE["worst_fpr"])
    on_target = (F.col("asr_mean") <= F.col("asr_target")) & (F.col("doc_fpr_mean") <= F.col("fpr_target"))
    return rows.join(F.broadcast(targets), "tier", "left").select(
        "layer", "tier", passed.alias("passed"), F.when(F.col("layer") == "L1", on_target).alias("on_target")
    )


def stability(results: DataFrame) -> DataFrame:
    """Per layer over tiers: range of the mean ASR, whether it is under 8, all FPRs under 5 and all ASRs under 30."""
    tiers = results.groupBy("layer", "tier").agg(F.avg("asr").alias("asr"), F.avg("doc_fpr").alias("doc_fpr"))
    span = F.max("asr") - F.min("asr")
    stable = (span < 8) & F.every(F.col("doc_fpr") < 5) & F.every(F.col("asr") < 30)
    return tiers.groupBy("layer").agg(span.alias("asr_range"), stable.alias("stable"))


def monotonicity(results: DataFrame, slack: float = 5.0) -> DataFrame:
    """Per seed and tier, whether ASR doesn't fall from L1 to L3, or moves by no more than `slack`."""
    wide = results.groupBy("seed", "tier").pivot("layer", ["L1", "L2", "L3"]).agg(F.first("asr"))
    rises = (F.col("L1") <= F.col("L2")) & (F.col("L2") <= F.col("L3"))
    span = F.greatest("L1", "L2", "L3") - F.least("L1", "L2", "L3")
    return wide.select("seed", "tier", (rises | (span <= slack)).alias("monotone"))


def coherence_distribution(rows: DataFrame, limit: float = 0.85) -> DataFrame:
    """One row: mean, deviation, least and greatest coherence, and the percentage below `limit`."""
    below = (F.col("cluster_coh") < limit).cast("double")
    return rows.agg(
        F.avg("cluster_coh").alias("mean"), F.stddev_pop("cluster_coh").alias("std"), F.min("cluster_coh").alias("min"),
        F.max("cluster_coh").alias("max"), (100 * F.avg(below)).alias("below_pct"),
    )


def compare_runs(baseline: DataFrame, changed: DataFrame) -> DataFrame:
    """Per layer: means over seeds of two runs, their difference, and a verdict; seeds that miss in one run still count.

    holds: ASR less than 5 points up; partially: under 25; else defeated.
    """
    left = baseline.select("seed", "layer", F.col("asr").alias("asr_base"), F.col("doc_fpr").alias("fpr_base"))
    right = changed.select("seed", "layer", F.col("asr").alias("asr_new"), F.col("doc_fpr").alias("fpr_new"))
    names = ("asr_base", "asr_new", "fpr_base", "fpr_new")
    means = left.join(right, ["seed", "layer"], "full").groupBy("layer").agg(*[F.avg(c).alias(c) for c in names])
    up = F.col("asr_new") - F.col("asr_base")
    verdict = F.when(up < 5, "holds").when(F.col("asr_new") < 25, "partially").otherwise("defeated")
    return means.select("layer", *names, up.alias("asr_delta"), (F.col("fpr_new") - F.col("fpr_base")).alias("fpr_delta"), verdict.alias("verdict"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def latency_profile(timings: DataFrame, by: str) -> DataFrame:
    """(by, n, mean, p95) of `ms`; the percentile is found by counts."""
    plain = timings.groupBy(by).agg(F.count("ms").alias("n"), F.avg("ms").alias("mean"))
    p95 = quantile_columns(timings, [by], "ms", [0.95])
    return plain.join(p95.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def smoke_gate(confusion: DataFrame, attempts: int = 100, asr: float = 50.0, fpr: float = 5.0) -> DataFrame:
    """(layer, passed): more than `attempts` attempts, ASR and document FPR below their limits."""
    ok = (F.col("attempts") > attempts) & (F.col("asr") < asr) & (F.col("doc_fpr") < fpr)
    return confusion.select("layer", ok.alias("passed"))


def against_constants(results: DataFrame, constants: dict[str, float]) -> DataFrame:
    """(layer, name, lower): whether the layer's mean ASR is below a figure published elsewhere."""
    table = results.sparkSession.createDataFrame(list(constants.items()), "name string, other double")
    means = results.groupBy("layer").agg(F.avg("asr").alias("asr"))
    return means.crossJoin(F.broadcast(table)).select("layer", "name", (F.col("asr") < F.col("other")).alias("lower"))


def older_gate(stats: DataFrame, rates: DataFrame) -> DataFrame:
    """One row: whether two signals are inverted, the TPR of L3, and the verdict on it of the earlier smoke test.

    rates: (layer, tpr). failed: both signals inverted, or a TPR below 0.5; passed: none
    inverted and a TPR of 0.6 or more; adapted: the rest.
    """
    below = lambda name: F.coalesce(F.bool_or((F.col("signal") == name) & (F.col("snr") < 0)), F.lit(False))
    signs = stats.agg(below("punct_signal").alias("punct_inverted"), below("content_ttr_signal").alias("content_inverted"))
    rate = rates.agg(F.max(F.when(F.col("layer") == "L3", F.col("tpr"))).alias("tpr"))
    punct, content, tpr = F.col("punct_inverted"), F.col("content_inverted"), F.coalesce("tpr", F.lit(0.0))
    verdict = (
        F.when((punct & content) | (tpr < 0.5), "failed").when(~punct & ~content & (tpr >= 0.6), "passed").otherwise("adapted")
    )
    return signs.crossJoin(rate).select("*", verdict.alias("verdict"))  # one row each


def hard_stops(runs: DataFrame, tiers: list[str]) -> DataFrame:
    """(seed, tier, reason, reached): why a tier stops its seed's run (null: it doesn't), and whether none before it did.

    Greatest ASR by layer: 1, 15, 50; greatest document FPR: 5 percent; at the last tier
    L3 may not miss nothing with a calibration TPR of 1.
    """
    one = lambda layer, c: F.max(F.when(F.col("layer") == layer, F.col(c)))
    wide = runs.groupBy("seed", "tier").agg(
        one("L1", "asr").alias("a1"), one("L2", "asr").alias("a2"), one("L3", "asr").alias("a3"),
        F.max("doc_fpr").alias("f"), one("L3", "cal_tpr").alias("tpr"),
    )
    saturated = (F.col("tier") == tiers[-1]) & (F.col("a3") == 0) & (F.col("tpr") >= 1)
    reason = (
        F.when(F.col("a1") > 1, "L1 asr").when(F.col("a2") > 15, "L2 asr").when(F.col("a3") > 50, "L3 asr")
        .when(F.col("f") > 5, "fpr").when(saturated, "saturated")
    )
    place = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    earlier = W.partitionBy("seed").orderBy(place).rowsBetween(W.unboundedPreceding, -1)  # a row a tier
    return wide.select("seed", "tier", reason.alias("reason"), place.alias("_p")).select(
        "seed", "tier", "reason", (F.count("reason").over(earlier) == 0).alias("reached")
    )
