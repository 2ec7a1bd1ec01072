"""Tables, and the corpus views that the analytics read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.functions import text as T

LAYERS = ["L1", "L2", "L3"]
_STATS = "array<struct<signal: string, clean_mean: double, clean_std: double, poison_mean: double, poison_std: double, snr: double>>"
_NORM = "struct<doc_length: double, sent_length: double, punct_density: double>"
#: Schema of a stored calibration, a row for each layer.
CHECKPOINT_SCHEMA = (
    "layer string, tau double, cal_fpr double, cal_tpr double, target_fpr double, cal_seed int, "
    f"weights array<struct<signal: string, weight: double, flipped: boolean>>, stats {_STATS}, norm {_NORM}"
)
#: Schema of stored result documents.
RESULT_SCHEMA = (
    "version string, corpus long, poisoned long, poison_ratio double, cal_seed long, benign_q long, target_fpr double, "
    f"norm_config {_NORM}, snrs map<string, double>, signal_stats {_STATS}, "
    + ", ".join(
        f"{layer} struct<asr: double, doc_fpr: double, query_fpr: double, tau: double, weights: map<string, double>, "
        "counts: struct<TP: long, FN: long, FP: long, TN: long, poison_encounters: long, clean_seen: long>, "
        "catches: struct<hash: long, ml: long>, attacks: struct<successes: long, attempts: long>, "
        "latency: struct<mean: double, p95: double>>"
        for layer in LAYERS
    )
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal `df` over all cores where its files give fewer partitions than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), null texts as empty ones."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, is_poisoned) for documents whose label is 0 or 1."""
    marks = table(spark, sf_dir, "labels").filter("toxic IN (0, 1)").select("doc_id", (F.col("toxic") == 1).alias("is_poisoned"))
    return documents(spark, sf_dir).join(marks, "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v, label): the embeddings as doubles."""
    rows = table(spark, sf_dir, "embeddings")
    return spread(rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label"))


def corpus_scan(docs: DataFrame, n: int, least: int = 300) -> DataFrame:
    """The first `n` documents by id whose stripped text has more than `least` characters; all rows of an id that is in.

    Only ids are put in order; texts stay where they are.
    """
    found = docs.withColumn("text", T.strip(F.col("text"))).filter(F.length("text") > least)
    ids = found.select("doc_id").orderBy("doc_id").limit(n)  # `n` ids
    return found.join(F.broadcast(ids) if n <= 1_000_000 else ids, "doc_id", "left_semi")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A stored corpus: JSON rows of id, text, is_poisoned."""
    return spark.read.schema("id string, text string, is_poisoned boolean").json(path)


def write_corpus(df: DataFrame, path: str) -> None:
    rows = df.select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), "text", "is_poisoned")
    rows.write.mode("overwrite").json(path)


def checkpoint_model(rates: DataFrame, weights: DataFrame, stats: DataFrame, norm: DataFrame, target: float, seed: int) -> DataFrame:
    """A row a layer with all that scoring needs again. `rates`: (layer, tau, fpr, tpr); weights are sorted by signal."""
    by_layer = weights.groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("signal", "weight", "flipped"))).alias("weights"))
    columns = ["signal", "clean_mean", "clean_std", "poison_mean", "poison_std", "snr"]
    every = stats.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("stats"))  # one a signal
    once = every.crossJoin(norm.select(F.struct("doc_length", "sent_length", "punct_density").alias("norm")))
    return (
        rates.join(by_layer, "layer")
        .crossJoin(F.broadcast(once))  # one row
        .select(
            "layer", "tau", F.col("fpr").alias("cal_fpr"), F.col("tpr").alias("cal_tpr"), F.lit(target).alias("target_fpr"),
            F.lit(seed).alias("cal_seed"), "weights", "stats", "norm",
        )
    )


def write_checkpoint(model: DataFrame, ids: DataFrame, path: str) -> None:
    """The calibration: its model as JSON, its document ids as a sorted set in Parquet (they grow with the corpus)."""
    model.coalesce(1).write.mode("overwrite").json(f"{path}/model")
    ids.distinct().orderBy(*ids.columns).write.mode("overwrite").parquet(f"{path}/ids")


def read_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(CHECKPOINT_SCHEMA).json(f"{path}/model"), spark.read.parquet(f"{path}/ids")


def result_document(counts: DataFrame, model: DataFrame, confusion: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """One row of `RESULT_SCHEMA`. counts: corpus, poisoned, benign_q; latency: (layer, mean, p95), null where not measured."""
    if latency is None:
        latency = model.select("layer", F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("p95"))
    rows = model.join(confusion, "layer").join(latency, "layer", "left")
    layer = F.struct(
        "asr", "doc_fpr", "query_fpr", "tau",
        F.map_from_entries(F.transform("weights", lambda w: F.struct(w.signal, w.weight))).alias("weights"),
        F.struct(
            F.col("tp").alias("TP"), F.col("fn").alias("FN"), F.col("fp").alias("FP"), F.col("tn").alias("TN"),
            F.col("attempts").alias("poison_encounters"), "clean_seen",
        ).alias("counts"),
        F.struct(F.col("hash_catches").alias("hash"), F.col("score_catches").alias("ml")).alias("catches"),
        F.struct("successes", "attempts").alias("attacks"),
        F.struct("mean", "p95").alias("latency"),
    )
    merged = rows.agg(
        F.first("target_fpr").alias("target_fpr"), F.first("cal_seed").cast("long").alias("cal_seed"),
        F.first("norm").alias("norm_config"), F.first("stats").alias("signal_stats"),
        *[F.first(F.when(F.col("layer") == k, layer), ignorenulls=True).alias(k) for k in LAYERS],
    )
    snrs = F.map_from_entries(F.transform("signal_stats", lambda s: F.struct(s.signal, s.snr))).alias("snrs")
    return merged.crossJoin(counts).select(
        F.lit("1").alias("version"), "corpus", "poisoned", F.try_divide("poisoned", "corpus").alias("poison_ratio"), "cal_seed",
        "benign_q", "target_fpr", "norm_config", snrs, "signal_stats", *LAYERS,
    )


def write_results(df: DataFrame, path: str) -> None:
    """Result documents, one JSON object a row."""
    df.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Result documents from the paths that exist; the others are skipped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            there.append(path)
    if not there:
        return spark.createDataFrame([], RESULT_SCHEMA)
    return spark.read.schema(RESULT_SCHEMA).option("mode", "PERMISSIVE").json(there)


def markdown_summary(rows: DataFrame, title: str = "Summary") -> str:
    """A small aggregate as a Markdown table; a missing value reads Error."""
    names = rows.columns
    cell = lambda x: "Error" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x)
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join(cell(r[c]) for c in names) + " |" for r in rows.collect()]
    return "\n".join(lines) + "\n"
