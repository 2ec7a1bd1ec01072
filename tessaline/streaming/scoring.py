"""Extension: scoring a stream of documents with frozen weights and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessaline.functions import text as T
from tessaline.operators import signals as S


def frozen(model: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, taus, norm) of a stored calibration."""
    weights = model.select("layer", F.inline("weights"))
    return weights, model.select("layer", "tau"), model.select("norm.*").limit(1)


def score_batch(docs: DataFrame, weights: DataFrame, taus: DataFrame, norm: DataFrame) -> DataFrame:
    """(doc_id, layer, score, flagged) for a batch of (doc_id, text), with weights, thresholds and scales made before.

    Signals of vectors are taken from columns of their names, where `docs` has them.
    """
    given = [c for c in T.VECTOR_SIGNALS if c in docs.columns]
    found = S.signals(S.raw_features(docs.withColumn("is_poisoned", F.lit(False))), norm)
    used = [*T.SIGNALS, *given]
    rounded = found.select("doc_id", "is_poisoned", *[F.round(c, 9).alias(c) for c in used])
    scored = S.composite_scores(S.unpivot(rounded, used).filter("value IS NOT NULL"), weights)
    return scored.join(F.broadcast(taus.select("layer", "tau")), "layer").select(
        "doc_id", "layer", "score", (F.col("score") > F.col("tau")).alias("flagged")
    )


def score_stream(docs: DataFrame, weights: DataFrame, taus: DataFrame, norm: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Score a streaming table of (doc_id, text); each micro-batch is written under its own number, so a repeat replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        score_batch(batch, weights, taus, norm).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
