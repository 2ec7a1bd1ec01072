"""The analytics as named queries over the tables of a folder."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaline.functions import text as T
from tessaline.functions import vectors as V
from tessaline.operators import detection as D
from tessaline.operators import encode as E
from tessaline.operators import generate as G
from tessaline.operators import neighbours as N
from tessaline.operators import reports as R
from tessaline.operators import signals as S
from tessaline.operators.registry import HashRegistry
from tessaline.plans import golden
from tessaline.sources import tables as IO
from tessaline.sources.phases import Phases
from tessaline.sources.shared import new_path, stored

Query = Callable[[SparkSession, str], DataFrame]
#: Weights in queries count every signal, so that they give rows on tables whose classes hardly differ.
NO_GATE = 0.0
SEED = 42
#: Seeds that the benign queries are split by.
SEEDS = [42, 7, 123]
#: Tier: share of all labelled documents that poisoned ones make up (fewer, where there aren't as many).
TIERS = {"p010": 0.01, "p050": 0.05, "p100": 0.10}
MIDDLE = "p050"
#: Share of the documents, by id, that are overwritten after the hashes were registered.
OVERWRITTEN = 0.05
#: Clean documents, by id, that scales are taken from where a query's scales aren't of all of them (`whole`).
FIRST_CLEAN = 2000
#: Number of benign queries drawn; fewer where there are fewer clean documents.
BENIGN_QUERIES = 2000
QUERY_TARGET = 0.05
# Fixed value: the threshold of the older score.
ABSOLUTE_TAU = 0.4516


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zeros as zeros."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- text --------------------------------------------------------------------


def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = IO.corpus_scan(IO.documents(spark, sf_dir), 100_000)
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha"))


def text_tokens_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = T.with_base(IO.documents(spark, sf_dir))
    return rounded(base.select("doc_id", *T.raw_columns(F.col("text"))))


def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.signals(S.raw_features(IO.documents(spark, sf_dir))).select("doc_id", *T.SIGNALS))


def norm_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.norm_config(IO.labelled(spark, sf_dir)))


def _phase(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], **settings: object) -> DataFrame:
    """A phase that several queries share, worked out by the first of them."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("documents", "labels", "embeddings")]
    return Phases(spark).get(name, inputs, settings, make)


def _vector_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, topic_drift, cluster_coh) of every vector."""

    def make() -> DataFrame:
        vectors = IO.vectors(spark, sf_dir)
        near = N.coherence(_top(spark, sf_dir, 5), vectors).withColumnRenamed("query_id", "id")
        return rounded(N.topic_drift(vectors).join(near, "id", "left"), 9).withColumnRenamed("id", "doc_id")

    return _phase(spark, sf_dir, "vector_signals", make)


def _tier_ids(spark: SparkSession, sf_dir: str, tier: str | None) -> DataFrame:
    """(doc_id, is_poisoned) of a tier: all clean labelled documents, and of the poisoned ones the first in hash order."""

    def make() -> DataFrame:
        ids = stored(IO.labelled(spark, sf_dir).select("doc_id", "is_poisoned"))
        if tier is None:
            return ids
        most = max(1, int(ids.count() * TIERS[tier]))
        return ids.filter(~F.col("is_poisoned")).unionByName(S.sample(ids.filter("is_poisoned"), most, 99))

    return _phase(spark, sf_dir, "tier", make, tier=tier, share=TIERS.get(tier or ""))


def _raw(spark: SparkSession, sf_dir: str, tier: str | None = None, changed: bool = False) -> DataFrame:
    """The `raw_features` of a tier's labelled documents; each text is taken apart once for all tiers.

    changed: the poisoned texts with words dropped, as an attacker who adapts would; only these are taken apart anew.
    """
    labelled = IO.labelled(spark, sf_dir)
    raw = _phase(spark, sf_dir, "raw", lambda: S.raw_features(labelled))
    ids = None if tier is None else _tier_ids(spark, sf_dir, tier).select("doc_id")
    if ids is not None:
        raw = raw.join(ids.hint("merge"), "doc_id", "left_semi")
    if changed:
        bad = labelled.filter("is_poisoned")
        bad = bad if ids is None else bad.join(ids, "doc_id", "left_semi")
        dropped = G.drop_tokens(bad.select("doc_id", "text")).withColumn("is_poisoned", F.lit(True))
        raw = raw.filter(~F.col("is_poisoned")).unionByName(S.raw_features(dropped))
    return raw


def _norm(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The scales, one row, of all clean labelled documents if `whole`, else of the first. Every tier has all clean documents, unchanged."""
    return _phase(spark, sf_dir, "norm", lambda: S.norm_of_raw(_raw(spark, sf_dir), None if whole else FIRST_CLEAN), whole=whole)


def _signals(spark: SparkSession, sf_dir: str, tier: str | None = None, changed: bool = False, whole: bool = False) -> DataFrame:
    """The signals of a tier's documents (by default of all labelled ones) with the scales of `_norm`, a row a document.

    Topic drift and cluster coherence are of the document's vector; null without one.
    """

    def make() -> DataFrame:
        raw = _raw(spark, sf_dir, tier, changed)
        wide = rounded(S.signals(raw, _norm(spark, sf_dir, whole)).select("doc_id", "is_poisoned", *T.SIGNALS), 9)
        return wide.join(_vector_signals(spark, sf_dir).hint("merge"), "doc_id", "left")

    return _phase(spark, sf_dir, "signals", make, tier=tier, changed=changed, whole=whole)


def _long(spark: SparkSession, sf_dir: str, tier: str | None = None, changed: bool = False, whole: bool = False) -> DataFrame:
    """`_signals` with a row for each document and signal that it has."""
    wide = _signals(spark, sf_dir, tier, changed, whole)
    return S.unpivot(wide, T.SIGNALS + T.VECTOR_SIGNALS).filter("value IS NOT NULL")


def _scores_of(spark: SparkSession, sf_dir: str, tier: str | None = None, changed: bool = False, whole: bool = False) -> DataFrame:
    def make() -> DataFrame:
        long = _long(spark, sf_dir, tier, changed, whole)
        return S.composite_scores(long, stored(_weights(long)))

    return _phase(spark, sf_dir, "scores", make, tier=tier, changed=changed, whole=whole)


def class_signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.class_stats(_long(spark, sf_dir)))


def snr_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_long(spark, sf_dir))


def _weights(long: DataFrame, least: float = NO_GATE) -> DataFrame:
    return S.layer_weights(rounded(S.class_stats(long), 9), least=least)


def layer_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(_long(spark, sf_dir))


def layer_weights_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the gate on the signal-to-noise ratio; no row where no signal passes it."""
    return _weights(_long(spark, sf_dir), S.LEAST_SNR)


def _scores(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return _scores_of(spark, sf_dir, whole=whole)


def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scores(spark, sf_dir))


def calibrate_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    return rounded(D.calibration_rates(scores, D.calibrate(scores, target=0.05)))


def calibrate_tau_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the false-positive target of the published runs."""
    scores = _scores(spark, sf_dir)
    return rounded(D.calibration_rates(scores, D.calibrate(scores)))


def doc_sha_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sha_registry(IO.documents(spark, sf_dir))


def tamper_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = IO.documents(spark, sf_dir)
    before = docs.filter("doc_id % 17 <> 0").withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return S.tamper_flags(docs, S.sha_registry(before))


def benign_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IO.documents(spark, sf_dir).select("doc_id", T.query_text(F.col("text")).alias("q"))


def benign_query_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benign queries: a sample of the clean documents, the same for all seeds of the split."""
    clean = IO.labelled(spark, sf_dir).filter(~F.col("is_poisoned")).select("doc_id", "text")
    return S.sample(clean, BENIGN_QUERIES, SEED).select("doc_id", T.query_text(F.col("text")).alias("q"))


def encoded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queries, benign and attacks, encoded in one pass, each text once: the components that aren't zero."""
    texts = benign_query_sample(spark, sf_dir).select(F.concat(F.lit("b"), "doc_id").alias("id"), F.col("q").alias("text")).unionByName(
        cyclic_queries(spark, sf_dir).select(F.concat(F.lit("a"), "query_id").alias("id"), F.col("q").alias("text"))
    )
    parts = E.encode_with(texts, E.HashedWords(256)).select("id", F.posexplode("v").alias("i", "x"))
    return rounded(parts.filter("x <> 0"))


def word_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.word_entropy(IO.documents(spark, sf_dir)))


def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.compression_ratio(IO.documents(spark, sf_dir)))


def split_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split(IO.documents(spark, sf_dir).select("doc_id"), SEED)


def poison_tier_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.round(F.col("l_discount"), 2)
    return IO.table(spark, sf_dir, "lineitem").groupBy(T.tier_tag(ratio + 0.0005).alias("tag")).agg(F.count("*").alias("n"))


# -- vectors -----------------------------------------------------------------


def corpus_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.centroid(IO.vectors(spark, sf_dir)).select(F.posexplode("centroid").alias("i", "x")))


def topic_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.topic_drift(IO.vectors(spark, sf_dir)))


def _top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = IO.vectors(spark, sf_dir)
    return N.top_k(rows, rows, k)


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_top(spark, sf_dir, 5))


def overfetch_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 by coarse vectors (one decimal), of them the best 5 by the exact ones."""
    rows = IO.vectors(spark, sf_dir).select("id", "v")
    coarse = rows.select("id", F.transform("v", lambda x: F.round(x, 1)).alias("v"))
    return rounded(N.rerank(N.top_k(coarse, coarse, 20), rows, rows, 5))


def cluster_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.coherence(_top(spark, sf_dir, 5), IO.vectors(spark, sf_dir)))


def coherence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.coherence_distribution(N.coherence(_top(spark, sf_dir, 5), IO.vectors(spark, sf_dir))), 5)


def label_only_knn_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = IO.vectors(spark, sf_dir).filter("label = 0")
    return rounded(N.coherence(N.top_k(rows, rows, 5), rows))


def intra_inter_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.pair_similarity(IO.vectors(spark, sf_dir)))


def _similarity_to_queries(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """(query_id, min_sim, mean_sim, max_sim) of each of the 25 fixed queries with `rows`."""
    queries = IO.vectors(spark, sf_dir).filter("id < 25").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    pairs = rows.crossJoin(F.broadcast(queries)).select("query_id", V.dot(F.col("v"), F.col("q")).alias("sim"))
    return pairs.groupBy("query_id").agg(F.min("sim").alias("min_sim"), F.avg("sim").alias("mean_sim"), F.max("sim").alias("max_sim"))


def query_sample_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_similarity_to_queries(spark, sf_dir, IO.vectors(spark, sf_dir)))


def retrieved_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = IO.vectors(spark, sf_dir)
    return rounded(N.retrieved_deviation(_top(spark, sf_dir, 5), rows, rows))


def second_vector_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = IO.vectors(spark, sf_dir)
    second = F.transform("v", lambda x: F.round(x, 1))
    return rounded(rows.select("id", V.distance(F.col("v"), second).alias("delta")))


def retrieved_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = IO.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("long").alias("hit"))
    hits = _top(spark, sf_dir, 5).join(labels, "id").groupBy("query_id").agg(F.sum("hit").alias("n_hits"))
    mine = labels.withColumnRenamed("id", "query_id").withColumn("adv", F.col("hit") == 1).drop("hit")
    return rounded(hits.join(mine, "query_id").groupBy("adv").agg(F.count("*").alias("queries"), F.avg("n_hits").alias("mean_hits")))


# -- detection ---------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, adv, id, is_poisoned, score): what each vector retrieves, label 0 as the class looked for."""
    rows = IO.vectors(spark, sf_dir)
    label = rows.select("id", (F.col("label") == 0).alias("is_poisoned"))
    deviation = N.retrieved_deviation(_top(spark, sf_dir, 5), rows, rows)
    own = label.select(F.col("id").alias("query_id"), F.col("is_poisoned").alias("adv"))
    return deviation.join(label, "id").join(own, "query_id").select("query_id", "adv", "id", "is_poisoned", F.round("a_score", 9).alias("score"))


def _rows(spark: SparkSession, sf_dir: str, tier: str | None = None) -> DataFrame:
    """(id, is_poisoned) of the tier's documents that have a vector."""

    def make() -> DataFrame:
        ids = _tier_ids(spark, sf_dir, tier).select(F.col("doc_id").alias("id"), "is_poisoned")
        return ids.join(IO.vectors(spark, sf_dir).filter("v IS NOT NULL").select("id").hint("merge"), "id")

    return _phase(spark, sf_dir, "rows", make, tier=tier)


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each labelled document with a vector, among all of them; tiers pick theirs from it."""

    def make() -> DataFrame:
        pool = IO.vectors(spark, sf_dir).select("id", "v").join(_rows(spark, sf_dir).select("id"), "id", "left_semi")
        return N.top_k(pool, pool, 20)

    return _phase(spark, sf_dir, "fetched", make)


def _met(spark: SparkSession, sf_dir: str, tier: str | None = None) -> DataFrame:
    """(query_id, doc_id): the five nearest of each document of the tier, among its documents."""

    def make() -> DataFrame:
        rows = _rows(spark, sf_dir, tier).select("id")
        vectors = IO.vectors(spark, sf_dir).select("id", "v").join(rows, "id", "left_semi")
        return N.within(_fetched(spark, sf_dir), 20, rows, vectors, 5).select("query_id", F.col("id").alias("doc_id"))

    return _phase(spark, sf_dir, "met", make, tier=tier)


def _tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tampered): the corpus was registered, then the first of its ids were overwritten."""

    def make() -> DataFrame:
        registry = HashRegistry(spark, new_path(spark))
        registry.register(IO.documents(spark, sf_dir))
        return registry.flags(G.inject(IO.documents(spark, sf_dir), G.BASES, OVERWRITTEN).select("doc_id", "text"))

    return _phase(spark, sf_dir, "tampered", make, share=OVERWRITTEN)


class Evaluation:
    """Encounters, thresholds and queries of one split.

    Query: a document's own vector; an attack if its document is poisoned. 60 % of the
    benign queries calibrate, the rest and all attacks evaluate. Joins of tables that grow
    with the corpus are merge joins: what is small enough to be broadcast in each of many
    runs adds up in the driver.
    """

    def __init__(self, scores: DataFrame, rows: DataFrame, met: DataFrame, tampered: DataFrame, seed: int = SEED):
        """What later steps read several times (queries, calibration encounters, thresholds) is stored."""
        benign = S.split(rows.filter(~F.col("is_poisoned")).select(F.col("id").alias("doc_id")), seed)
        queries = stored(
            benign.select(F.col("doc_id").alias("query_id"), F.lit(False).alias("adv"), "side").unionByName(
                rows.filter("is_poisoned").select(F.col("id").alias("query_id"), F.lit(True).alias("adv"), F.lit("eval").alias("side"))
            )
        )
        all_met = met.join(queries.hint("merge"), "query_id")
        calibration = all_met.filter("side = 'cal'")
        enough = calibration.groupBy("query_id").agg(F.count("*").alias("n")).filter("n >= 2").select("query_id")
        scores = scores.hint("merge")
        calibrating = stored(calibration.join(enough.hint("merge"), "query_id").join(scores, "doc_id"))
        used = stored(calibration.select("doc_id").distinct())
        self.taus = stored(D.calibrate(calibrating, target=QUERY_TARGET))
        self.queries = queries.filter("side = 'eval'")
        self.calibration_ids = used
        #: FPR of the calibration encounters, TPR of all poisoned documents.
        columns = ["layer", "score", "is_poisoned"]
        both = calibrating.filter(~F.col("is_poisoned")).select(columns).unionByName(scores.filter("is_poisoned").select(columns))
        self.rates = D.calibration_rates(both, self.taus)
        self.encounters = (
            all_met.filter("side = 'eval'")
            .join(used.withColumn("in_calibration", F.lit(True)).hint("merge"), "doc_id", "left")
            .join(tampered.hint("merge"), "doc_id", "left")
            .join(scores, "doc_id")
            .select(
                "query_id", "adv", "doc_id", "is_poisoned", F.coalesce("in_calibration", F.lit(False)).alias("in_calibration"),
                F.coalesce("tampered", F.lit(True)).alias("tampered"), "layer", "score",
            )
        )

    def confusion(self) -> DataFrame:
        benign = self.queries.filter("NOT adv").agg(F.count("*").alias("benign"))
        found = D.confusion(D.flags(self.encounters, self.taus), F.lit(1))
        rate = D.percent(F.col("fp_queries"), F.col("benign"))
        return found.crossJoin(F.broadcast(benign)).withColumn("query_fpr", rate).drop("benign")  # one row


def _evaluation(
    spark: SparkSession, sf_dir: str, tier: str | None = None, seed: int = SEED, changed: bool = False, whole: bool = False
) -> Evaluation:
    scores = _scores_of(spark, sf_dir, tier, changed, whole)
    return Evaluation(scores, _rows(spark, sf_dir, tier), _met(spark, sf_dir, tier), _tampered(spark, sf_dir), seed)


def registry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after the overwritten corpus was registered too: a second version, of the changed ids alone."""
    registry = HashRegistry(spark, new_path(spark))
    registry.register(IO.documents(spark, sf_dir))
    registry.register(G.inject(IO.documents(spark, sf_dir), G.BASES, OVERWRITTEN))
    return registry.current()


def encounter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _evaluation(spark, sf_dir, whole=True)
    return D.flags(found.encounters, found.taus)


def _confusion(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return rounded(_evaluation(spark, sf_dir, whole=whole).confusion())


def confusion_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir)


def _run(spark: SparkSession, sf_dir: str, tier: str, seed: int, changed: bool = False, whole: bool = False) -> DataFrame:
    """Confusion by layer, with threshold and calibration rates, of one tier and seed; a phase of its own."""

    def make() -> DataFrame:
        found = _evaluation(spark, sf_dir, tier, seed, changed, whole)
        rates = found.rates.select("layer", "tau", F.col("fpr").alias("cal_fpr"), F.col("tpr").alias("cal_tpr"))
        named = found.confusion().join(F.broadcast(rates), "layer")
        return rounded(named.select(F.lit(tier).alias("tier"), F.lit(seed).alias("seed"), "*"))

    settings = {"gate": NO_GATE, "target": QUERY_TARGET, "share": TIERS[tier], "changed": changed, "whole": whole}
    return _phase(spark, sf_dir, f"run,tier={tier},seed={seed}", make, **settings)


def _runs(spark: SparkSession, sf_dir: str, tiers: list[str] | None = None, changed: bool = False, whole: bool = False) -> DataFrame:
    """All tiers and seeds. Finished runs are read; what the seeds of a tier share is worked out once, then seeds run side by side."""
    found = []
    for tier in tiers or list(TIERS):
        _scores_of(spark, sf_dir, tier, changed, whole)
        _met(spark, sf_dir, tier)
        _tampered(spark, sf_dir)
        with ThreadPoolExecutor(len(SEEDS)) as pool:
            found += pool.map(lambda seed: _run(spark, sf_dir, tier, seed, changed, whole), SEEDS)  # noqa: B023
    return reduce(DataFrame.unionByName, found)


def seed_tier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


def seed_tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, deviations and greatest values over the seeds of this engine's own runs."""
    return rounded(R.multi_seed(_runs(spark, sf_dir)), 5)


def hard_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hard_stops(_runs(spark, sf_dir), list(TIERS))


def older_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.older_gate(S.class_stats(_long(spark, sf_dir)), _evaluation(spark, sf_dir).rates))


def _model(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, Evaluation]:
    """The calibration, a row a layer, and its evaluation."""
    stats = stored(rounded(S.class_stats(_long(spark, sf_dir, whole=whole)), 9))
    weights, found = S.layer_weights(stats, least=NO_GATE), _evaluation(spark, sf_dir, whole=whole)
    return IO.checkpoint_model(found.rates, weights, stats, _norm(spark, sf_dir, whole), QUERY_TARGET, SEED), found


def _checkpoint(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The calibration written to the shared folder and read again: a row a layer, and the calibration documents."""
    model, found = _model(spark, sf_dir, whole)
    path = new_path(spark)
    IO.write_checkpoint(model, found.calibration_ids, path)
    return IO.read_checkpoint(spark, path)


def calibration_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _checkpoint(spark, sf_dir, whole=True)
    shown = F.transform("weights", lambda w: F.concat_ws(":", w.signal, F.round(w.weight * 1e6).cast("long").cast("string")))
    flipped = F.transform(F.filter("weights", lambda w: w.flipped), lambda w: w.signal)
    return rounded(
        model.select(
            "layer", "tau", "cal_fpr", "cal_tpr", "target_fpr", "cal_seed", F.array_join(shown, ",").alias("weights"),
            F.array_join(flipped, ",").alias("flipped"), F.size("stats").cast("long").alias("n_signals"), "norm.*",
        )
    )


def calibration_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checkpoint(spark, sf_dir)[1]


def result_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result document of a run, written as JSON and read again, its layers as rows.

    The document has the latency measured (the time of the evaluation over its queries); as it differs each time, the
    rows say only that it is there.
    """
    model, found = _model(spark, sf_dir)
    began = time.perf_counter()
    confusion = stored(rounded(found.confusion()))
    took = 1000 * (time.perf_counter() - began)
    corpus = IO.labelled(spark, sf_dir).agg(F.count("*").alias("corpus"), F.count_if("is_poisoned").alias("poisoned"))
    benign = found.queries.agg(F.count_if(~F.col("adv")).alias("benign_q"))
    queries = found.queries.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    mean = F.lit(took) / F.col("n")
    latency = confusion.select("layer").crossJoin(queries).select("layer", mean.alias("mean"), mean.alias("p95"))  # one batch: all alike
    path = new_path(spark)
    IO.write_results(IO.result_document(corpus.crossJoin(benign), model, confusion, latency), path)
    read = IO.read_results(spark, path, path + "-missing")
    layers = F.explode(F.map_entries(F.create_map(*[c for k in IO.LAYERS for c in (F.lit(k), F.col(k))])))
    flat = read.select("corpus", "poisoned", "poison_ratio", "cal_seed", "benign_q", layers.alias("e")).filter("e.value IS NOT NULL")
    flat = flat.select(*flat.columns[:-1], F.col("e.key").alias("layer"), "e.value.*")
    return rounded(
        flat.select(
            "corpus", "poisoned", "poison_ratio", "cal_seed", "benign_q", "layer", "asr", "doc_fpr", "query_fpr", "tau",
            F.map_values("weights")[0].isNotNull().alias("weighted"), (F.col("latency.mean") > 0).alias("timed"), "counts.*", F.col("catches.hash").alias("hash_catches"),
            F.col("catches.ml").alias("score_catches"),
        )
    )


def relative_threshold_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.relative_flags(_records(spark, sf_dir)))


def absolute_threshold_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _records(spark, sf_dir).withColumn("flagged", F.col("score") > ABSOLUTE_TAU)
    return flagged.groupBy("adv", "is_poisoned").agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each layer."""
    return rounded(D.threshold_sweep(_scores(spark, sf_dir, whole=True), by=["layer"]))


def youden_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.youden_best(_scores(spark, sf_dir), by=["layer"]))


def sweep_grid(spark: SparkSession) -> DataFrame:
    """67 settings: relative with a floor, absolute, and both. Fixed values."""
    rows: list[tuple] = [(n, m, None) for n in (0.5, 0.8, 1.0, 1.2, 1.5, 2.0) for m in (0.0, 0.35, 0.38, 0.40)]
    rows += [(None, None, t) for t in (0.44, 0.46, 0.48, 0.50, 0.52, 0.54, 0.56)]
    rows += [(n, m, h) for n in (1.0, 1.2, 1.5) for m in (0.38, 0.40, 0.42) for h in (0.48, 0.50, 0.52, 0.55)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "config int, n_std double, min_abs double, abs_high double")


def hybrid_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.grid_evaluate(_records(spark, sf_dir), sweep_grid(spark)))


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = hybrid_grid(spark, sf_dir)
    return rated.withColumn("cost", F.round(F.col("asr") + F.col("doc_fpr"), 6)).orderBy("cost", "config").limit(10).select("config", "cost")


def midpoint_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.midpoint_eval(_scores(spark, sf_dir), by=["layer"]))


def quantile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.quantile_profile(_scores(spark, sf_dir), [0.05, 0.10, 0.25, 0.50, 0.85, 0.90, 0.95], by=["layer"]))


# -- generation --------------------------------------------------------------


def injection_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.inject(IO.documents(spark, sf_dir), G.BASES, 0.05)
    return found.select("doc_id", F.sha2("text", 256).alias("sha"), "is_poisoned")


def template_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*[F.lit(t) for t in ("Note {i} for the desk.", "Entry {i} in the book.", "Card {i} on the shelf.")])
    text = F.replace(F.get(forms, (F.col("doc_id") % 3).cast("int")), F.lit("{i}"), F.col("doc_id").cast("string"))
    return IO.documents(spark, sf_dir).select("doc_id", text.alias("text"))


def _cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(base, text): a base text and the first sentence of each document."""
    bases = F.array(*map(F.lit, G.BASES))
    base = F.get(bases, F.pmod(F.col("doc_id"), F.lit(len(G.BASES))).cast("int"))
    docs = IO.documents(spark, sf_dir)
    return docs.select(F.col("doc_id").cast("long").alias("base"), F.concat(base, F.lit(" "), T.query_text(F.col("text"))).alias("text"))


#: Variants made of each document: every 167th, which go through all options of all five dimensions.
VARIANTS = list(range(0, 1920, 167))


def variant_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = G.variants(_cores(spark, sf_dir), VARIANTS)
    return made.select("base", "var", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha"))


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.framed(IO.documents(spark, sf_dir).select("doc_id", T.query_text(F.col("text")).alias("core")))


def framed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framed(spark, sf_dir).select("doc_id", "topic", "structure", F.sha2("text", 256).alias("sha"))


def topic_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(_framed(spark, sf_dir), "topic")


def _perturbed(change: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = change(IO.documents(spark, sf_dir))
        return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha"))

    return query


def perturb_until_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The poisoned documents, perturbed while their neighbourhoods are too coherent."""
    found = E.perturb_until_apart(IO.labelled(spark, sf_dir).filter("is_poisoned").select("doc_id", "text"))
    return rounded(found.select("doc_id", "rounds", "cluster_coh", F.length("text").alias("n_chars")))


def cyclic_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 attack queries from 25 texts: the first sentences of the first poisoned documents."""
    first = IO.labelled(spark, sf_dir).filter("is_poisoned").select("doc_id", T.query_text(F.col("text")).alias("q")).orderBy("doc_id").limit(25)
    placed = first.select((F.row_number().over(W.partitionBy().orderBy("doc_id")) - 1).cast("long").alias("place"), "q")  # 25 rows
    return G.cyclic(placed, 50)


def snr_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 clean documents, and all poisoned ones, that the signal statistics are taken from."""
    docs = IO.labelled(spark, sf_dir).select("doc_id", "is_poisoned")
    return S.sample(docs.filter(~F.col("is_poisoned")), 500, 99).unionByName(docs.filter("is_poisoned"))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.quality_gate(N.pair_similarity(IO.vectors(spark, sf_dir)), query_sample_similarity(spark, sf_dir)), 5)


def quality_gate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on 50 documents, drawn once, against the 25 fixed queries."""
    drawn = S.sample(IO.vectors(spark, sf_dir), 50, 0, "id")
    return rounded(G.quality_gate(N.pair_similarity(drawn), _similarity_to_queries(spark, sf_dir, drawn)), 5)


# -- reports -----------------------------------------------------------------


def _of_runs(make: Callable[[DataFrame], DataFrame], whole: bool = False) -> Query:
    return lambda spark, sf_dir: rounded(make(_runs(spark, sf_dir, whole=whole)), 5)


def signal_tier_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratios of each signal at each tier."""
    stats = [S.class_stats(_long(spark, sf_dir, t)).select("signal", F.lit(t).alias("tier"), "snr") for t in TIERS]
    return rounded(R.tier_pivot(reduce(DataFrame.unionByName, stats), list(TIERS)), 5)


def golden_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights from the ratios at the middle tier, with the gate. A test holds the published ratios to their weights."""
    return _weights(_long(spark, sf_dir, MIDDLE), S.LEAST_SNR)


def adaptive_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle tier against itself with words dropped from the poisoned documents."""
    return rounded(R.compare_runs(_runs(spark, sf_dir, [MIDDLE], whole=True), _runs(spark, sf_dir, [MIDDLE], True, whole=True)), 5)


def latency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values stand for milliseconds."""
    return rounded(R.latency_profile(IO.table(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms")), "event_type"))


def smoke_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.smoke_gate(confusion_by_layer(spark, sf_dir), attempts=0)


def smoke_gate_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the number of attempts asked for in published runs."""
    return R.smoke_gate(_confusion(spark, sf_dir, whole=True))


def against_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.against_constants(_runs(spark, sf_dir, whole=True), golden.ELSEWHERE)


def queries() -> dict[str, Query]:
    plain = [
        corpus_scan, text_tokens_sentences, text_signals, norm_config, class_signal_stats, snr_unpivot, layer_weights,
        composite_scores, calibrate_tau, doc_sha_registry, tamper_flags, benign_query_text, word_entropy,
        compression_ratio, split_md5, poison_tier_tag, corpus_centroid, topic_drift, knn_topk, overfetch_rerank,
        cluster_coherence, coherence_distribution, label_only_knn_coherence, intra_inter_similarity,
        query_sample_similarity, retrieved_deviation, second_vector_delta, retrieved_class_counts, encounter_flags,
        confusion_by_layer, registry_versions, relative_threshold_flags, absolute_threshold_flags, threshold_sweep, youden_best, hybrid_grid,
        best_candidates, midpoint_eval, quantile_profile, injection_overwrite, template_fallback, variant_cross_product,
        framed_documents, topic_histogram, cyclic_queries, snr_sample, quality_gate, quality_gate_sample, latency_profile, smoke_gate,
        seed_tier_runs, seed_tier_summary, hard_stops, older_gate, calibration_checkpoint, calibration_ids, result_document,
        benign_query_sample, encoded_queries, layer_weights_gated, calibrate_tau_strict, smoke_gate_strict, against_constants, perturb_until_apart, signal_tier_pivot, golden_weights, adaptive_vs_baseline,
    ]
    found: dict[str, Query] = {f.__name__: f for f in plain}
    found |= {
        "token_dropout": _perturbed(G.drop_tokens),
        "sentence_shuffle": _perturbed(G.shuffle_sentences),
        "synonym_swap": _perturbed(G.swap_synonyms),
        "multi_seed_aggregate": _of_runs(R.multi_seed, whole=True),
        "worst_case": _of_runs(R.worst_by_seed),
        "grand_mean": _of_runs(R.grand_mean),
        "gate_verdicts": _of_runs(R.gate_verdicts, whole=True),
        "stability": _of_runs(R.stability, whole=True),
        "monotonicity": _of_runs(R.monotonicity),
    }
    return found
