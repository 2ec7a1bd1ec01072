"""Published detection results, by tier, seed and layer, and signal-to-noise ratios by tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: tier, seed, layer, ASR, document FPR, query FPR (percent).
RESULTS = [
    ("p010", 7, "L1", 0.0, 0.545, 2.5), ("p010", 7, "L2", 0.0, 0.654, 3.0), ("p010", 7, "L3", 1.6, 0.6, 2.75),
    ("p010", 42, "L1", 0.0, 0.877, 3.875), ("p010", 42, "L2", 0.0, 0.822, 3.75), ("p010", 42, "L3", 1.6, 0.63, 2.875),
    ("p010", 123, "L1", 0.0, 0.765, 3.25), ("p010", 123, "L2", 0.0, 0.738, 3.25), ("p010", 123, "L3", 0.0, 0.929, 4.125),
    ("p050", 7, "L1", 0.0, 0.699, 3.0), ("p050", 7, "L2", 0.0, 0.672, 3.0), ("p050", 7, "L3", 13.6, 0.887, 4.0),
    ("p050", 42, "L1", 0.0, 0.565, 2.375), ("p050", 42, "L2", 1.6, 0.565, 2.5), ("p050", 42, "L3", 17.6, 0.565, 2.5),
    ("p050", 123, "L1", 0.0, 0.624, 2.75), ("p050", 123, "L2", 0.0, 0.624, 2.875), ("p050", 123, "L3", 17.6, 0.543, 2.5),
    ("p100", 7, "L1", 0.0, 0.628, 2.75), ("p100", 7, "L2", 0.0, 0.628, 2.75), ("p100", 7, "L3", 20.8, 0.71, 3.25),
    ("p100", 42, "L1", 0.0, 1.302, 5.75), ("p100", 42, "L2", 0.0, 1.302, 5.75), ("p100", 42, "L3", 15.2, 1.058, 4.75),
    ("p100", 123, "L1", 0.0, 0.93, 4.0), ("p100", 123, "L2", 0.0, 0.93, 4.0), ("p100", 123, "L3", 15.2, 0.903, 4.0),
]
#: signal: ratios at the tiers p010, p050, p100.
SNRS = {
    "topic_drift": (1.33, 0.64, -0.24), "sent_unif": (1.30, 1.52, 0.98), "ttr_signal": (-1.77, -1.90, -1.70),
    "repeat_rate": (-0.35, -0.40, -0.39), "kw_density": (38.42, 34.80, 32.85), "doc_length_signal": (1.16, 1.21, 1.08),
    "avg_sent_len_signal": (1.55, 1.38, 1.39), "punct_signal": (1.43, 1.51, 1.29),
    "content_ttr_signal": (-1.96, -2.18, -1.92), "cluster_coh": (4.72, 4.78, 4.66),
}
TIERS = ["p010", "p050", "p100"]
#: layer: mean ASR and FPR of the run with adaptive documents, at p050.
ADAPTIVE = {"L1": (0.0, 0.57), "L2": (0.0, 0.56), "L3": (0.0, 0.57)}

#: Attack success rates published for two other defences, in percent.
ELSEWHERE = {"first": 24.0, "second": 35.0}


def results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESULTS, "tier string, seed int, layer string, asr double, doc_fpr double, query_fpr double")


def snrs(spark: SparkSession) -> DataFrame:
    rows = [(s, t, v) for s, values in SNRS.items() for t, v in zip(TIERS, values, strict=True)]
    return spark.createDataFrame(rows, "signal string, tier string, snr double")


def adaptive(spark: SparkSession) -> DataFrame:
    rows = [(seed, layer, a, f) for seed in (7, 42, 123) for layer, (a, f) in ADAPTIVE.items()]
    return spark.createDataFrame(rows, "seed int, layer string, asr double, doc_fpr double")
