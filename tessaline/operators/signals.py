"""Text signals per document, corpus constants and per-class statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaline.functions import text as T
from tessaline.operators.selection import quantiles, take_first

#: Layers and the signals each leaves out.
LAYERS = {"L1": [], "L2": ["kw_density"], "L3": ["kw_density", "avg_sent_len_signal"]}
#: A signal counts if its signal-to-noise ratio is over this, either way.
LEAST_SNR = 0.5


def raw_features(docs: DataFrame) -> DataFrame:
    """`docs` (text and other columns) with counts, densities and the signals that need no corpus constants."""
    others = [c for c in docs.columns if c != "text"]
    text = F.col("text")
    base = T.with_base(docs.select(*others, "text"))
    return base.select(
        *others,
        *T.raw_columns(text),
        T.sentence_uniformity().alias("sent_unif"),
        T.variety_loss().alias("ttr_signal"),
        T.repeat_rate().alias("repeat_rate"),
        T.keyword_density(text).alias("kw_density"),
        T.content_variety_loss().alias("content_ttr_signal"),
    )


def norm_config(docs: DataFrame, first: int = 2000, share: float = 0.9) -> DataFrame:
    """One row: the 90th percentiles over the first `first` clean documents by id of word count, words a
    sentence (of documents that have a sentence) and punctuation marks a word.

    The ids are picked first, so that only these texts are taken apart.
    """
    ids = docs.filter(~F.col("is_poisoned")).select("doc_id").orderBy("doc_id").limit(first)
    return _scales(raw_features(docs.filter(~F.col("is_poisoned")).join(F.broadcast(ids), "doc_id", "left_semi")), share)


def norm_of_raw(raw: DataFrame, first: int | None = None, share: float = 0.9) -> DataFrame:
    """The scales of `norm_config` over all clean documents, whose `raw_features` are there already; with `first` over the first ones by id.

    Over all, the percentiles are found by counts (`quantiles`), so that no task gets every value.
    """
    clean = raw.filter(~F.col("is_poisoned"))
    if first is not None:
        return _scales(clean.orderBy("doc_id").limit(first), share)
    values = clean.select(*[c.alias(k) for k, c in _scaled().items()]).unpivot([], list(T.DEFAULT_NORM), "scale", "value")
    found = quantiles(values, ["scale"], "value", [share])
    return found.agg(*[F.coalesce(F.max(F.when(F.col("scale") == k, F.col("value"))), F.lit(v)).alias(k) for k, v in T.DEFAULT_NORM.items()])


def _scaled() -> dict[str, Column]:
    """What the scales are percentiles of; null where a document doesn't count."""
    return {
        "doc_length": F.col("n_words").cast("double"),
        "sent_length": F.when(F.col("n_sentences") > 0, F.col("mean_sent_words").cast("double")),
        "punct_density": F.col("punct_count") / F.greatest(F.col("n_words"), F.lit(1)),
    }


def _scales(clean: DataFrame, share: float) -> DataFrame:
    """For a bounded number of documents: their values meet in one task."""
    return clean.agg(*[F.coalesce(F.percentile(c, share), F.lit(T.DEFAULT_NORM[k])).alias(k) for k, c in _scaled().items()])


def signals(raw: DataFrame, norm: DataFrame | None = None) -> DataFrame:
    """`raw` with all text signals; constants from the one row of `norm`, or the defaults."""
    if norm is None:
        scales: dict[str, Column] = {k: F.lit(v) for k, v in T.DEFAULT_NORM.items()}
        return raw.select("*", *T.normalised_columns(scales))
    joined = raw.crossJoin(F.broadcast(norm))  # one row
    return joined.select("*", *T.normalised_columns({k: F.col(k) for k in T.DEFAULT_NORM})).drop(*T.DEFAULT_NORM)


def unpivot(df: DataFrame, names: list[str] = T.SIGNALS) -> DataFrame:
    """One row for each document and signal: (doc_id, is_poisoned, signal, value)."""
    return df.unpivot(["doc_id", "is_poisoned"], names, "signal", "value")


def class_stats(long: DataFrame) -> DataFrame:
    """Per signal: mean and deviation by class, their gap, and the signal-to-noise ratio."""
    value, bad = F.col("value"), F.col("is_poisoned")
    stats = long.groupBy("signal").agg(
        F.avg(F.when(~bad, value)).alias("clean_mean"),
        F.stddev_pop(F.when(~bad, value)).alias("clean_std"),
        F.avg(F.when(bad, value)).alias("poison_mean"),
        F.stddev_pop(F.when(bad, value)).alias("poison_std"),
    )
    gap = F.col("poison_mean") - F.col("clean_mean")
    return stats.select("*", gap.alias("gap"), (gap / (F.col("clean_std") + 1e-9)).alias("snr"))


def layer_weights(stats: DataFrame, layers: dict[str, list[str]] = LAYERS, least: float = LEAST_SNR) -> DataFrame:
    """(layer, signal, weight, flipped): min(ln(1 + |SNR|), 1) over its sum in the layer, rounded.

    Signals that the layer leaves out or whose |SNR| is not over `least` are not in it.
    A negative ratio flips the signal. Without any signal left a layer has no row.
    """
    spark = stats.sparkSession
    left_out = spark.createDataFrame([(k, v) for k, v in layers.items()], "layer string, left_out array<string>")
    strength = F.least(F.log1p(F.abs("snr")), F.lit(1.0))
    used = (
        stats.filter(F.abs("snr") > least)
        .crossJoin(F.broadcast(left_out))  # a few layers
        .filter(~F.array_contains("left_out", F.col("signal")))
        .select("layer", "signal", strength.alias("strength"), (F.col("snr") < 0).alias("flipped"))
    )
    weight = F.round(F.col("strength") / F.sum("strength").over(W.partitionBy("layer")), 6)
    return used.select("layer", "signal", weight.alias("weight"), "flipped")


def composite_scores(long: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, is_poisoned, layer, score): the weighted sum of signals, flipped ones inverted."""
    value = F.when(F.col("flipped"), 1 - F.col("value")).otherwise(F.col("value"))
    return (
        long.join(F.broadcast(weights), "signal")  # signals times layers
        .groupBy("doc_id", "is_poisoned", "layer")
        .agg(F.round(F.sum(F.col("weight") * value), 9).alias("score"))
    )


def word_entropy(docs: DataFrame) -> DataFrame:
    """(doc_id, entropy): Shannon entropy of the words, in bits; 0 for no words.

    Counted within the row: equal words stand together in the sorted list, so that a
    word's count is the distance between the places where it begins; no word is shuffled.
    """
    words = docs.select("doc_id", F.array_sort(T.words(F.col("text"))).alias("w"))
    begins = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    listed = words.select("doc_id", F.size("w").alias("n"), F.when(F.size("w") > 0, begins).otherwise(F.array().cast("array<int>")).alias("b"))
    after = F.concat(F.slice("b", F.lit(2), F.greatest(F.size("b") - 1, F.lit(0))), F.array("n"))
    counts = listed.select("doc_id", "n", F.when(F.size("b") > 0, F.zip_with(after, "b", lambda x, y: (x - y).cast("double"))).alias("c"))
    mean_log = F.aggregate("c", F.lit(0.0), lambda a, x: a + x * F.log2(x)) / F.col("n")
    return counts.select("doc_id", F.when(F.col("n") > 0, F.abs(F.log2(F.col("n").cast("double")) - mean_log)).otherwise(0.0).alias("entropy"))


def compression_ratio(docs: DataFrame) -> DataFrame:
    """(doc_id, ratio): deflated over raw bytes; 0 for an empty text. One text at a time is taken out of its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ratios = batch.column("text"), np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode()
                ratios[i] = len(zlib.compress(raw)) / len(raw) if raw else 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ratios)], names=["doc_id", "ratio"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ratio double")


def sha_registry(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2("text", 256).alias("sha"))


def tamper_flags(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_id, tampered): the text's hash isn't the registered one; a document that isn't registered is flagged."""
    now = docs.select("doc_id", F.sha2("text", 256).alias("now"))
    return now.join(registry, "doc_id", "left").select("doc_id", (F.col("now") != F.coalesce("sha", F.lit(""))).alias("tampered"))


def hash_order(seed: int, column: str = "doc_id") -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def split(rows: DataFrame, seed: int, share: float = 0.6, column: str = "doc_id") -> DataFrame:
    """`rows` with `side`: the first floor(share * n) in hash order are `cal`, the rest `eval`.

    The last row of `cal` is found by counts (`first_in_order`), the rest is a comparison.
    """
    taken = take_first(rows, hash_order(seed, column), column, F.floor(F.col("n") * F.lit(share)), "_cal")
    return taken.select(*rows.columns, F.when(F.col("_cal"), "cal").otherwise("eval").alias("side"))


def sample(rows: DataFrame, n: int | Column, seed: int, column: str = "doc_id") -> DataFrame:
    """The first `n` rows in hash order; all, if there are fewer. `n` may be an expression of `n`, the number of rows."""
    count = F.lit(n) if isinstance(n, int) else n
    return take_first(rows, hash_order(seed, column), column, count, "_taken").filter("_taken").drop("_taken")
