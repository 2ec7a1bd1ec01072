"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import Written, chance, free_name, spread, text_slices
from tessaline.llm.language import fold

_WORD = re.compile(r"[^\W\d_]+")
_CHUNK = re.compile(r"\S+")
_STOP = (".", "!", "?")
#: Resolved chunks that a Python worker remembers; the memory is emptied when full.
_REMEMBERED = 300_000
PREFIXES = range(3, 8)


def features(word: str) -> list[str]:
    """The word, and its first 3 to 7 letters (marked by a leading `^`) where it is longer."""
    return [word, *(f"^{word[:n]}" for n in PREFIXES if n < len(word))]


@dataclass
class Model:
    """A sentence is toxic with probability sigmoid(bias + the sum of its words' weights)."""

    bias: float = -50.0
    weights: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence: white-space chunks up to one that ends in `.!?`, or to the line's end."""
    line_start = 0
    for line in text.split("\n"):
        first = last = None
        for m in _CHUNK.finditer(line):
            first, last = m.start() if first is None else first, m.end()
            if m[0].endswith(_STOP):
                yield line_start + first, line_start + last
                first = None
        if first is not None:
            yield line_start + first, line_start + last
        line_start += len(line) + 1


class Scorer:
    """Scores texts; what a chunk between white space adds is worked out once and remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {"\n": 0}  # a line's end: no weight, ends a sentence
        self.value = np.zeros(_REMEMBERED)
        self.stop = np.zeros(_REMEMBERED, dtype=bool)
        self.stop[0] = True

    def _add(self, chunk: str) -> int:
        at = self.at[chunk] = len(self.at)
        self.value[at] = sum(map(self.model.word, _WORD.findall(chunk.lower())))
        self.stop[at] = chunk.endswith(_STOP)
        return at

    def logits(self, text: str) -> np.ndarray:
        """The logit of each sentence that has a chunk."""
        values, stops, real = [], [], []
        chunks: list[str] = []
        for line in text.split("\n"):
            chunks += line.split()
            chunks.append("\n")
        for begin in range(0, len(chunks), _REMEMBERED // 2):
            part = chunks[begin : begin + _REMEMBERED // 2]
            if len(self.at) + len(part) > _REMEMBERED:
                self.clear()
            get = self.at.get
            found = [get(c) for c in part]
            if None in found:
                found = [self.at[c] if c in self.at else self._add(c) for c in part]
            index = np.array(found)
            values.append(self.value[index])
            stops.append(self.stop[index])
            real.append(index > 0)
        if not values:
            return np.zeros(0)
        stop = np.concatenate(stops)
        of = np.cumsum(stop) - stop
        sums = np.bincount(of, np.concatenate(values))
        return sums[np.bincount(of, np.concatenate(real)) > 0] + self.model.bias

    def score(self, text: str | None) -> float:
        """1 minus the product over sentences of (1 - p): 0 without any sentence."""
        z = self.logits(text or "")
        return float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0


def occurrences(text: str) -> list[list[str]]:
    """The features of each sentence, repeats included."""
    return [[f for w in _WORD.findall(text[a:b].lower()) for f in features(w)] for a, b in sentences(text)]


def optimise(
    size: int, doc: np.ndarray, row: np.ndarray, col: np.ndarray, toxic: np.ndarray, rounds: int = 300
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the negative log likelihood of the labels under the noisy-or, plus a ridge.

    doc: the document of each sentence; row and col: sentence and feature of each
    occurrence; toxic: the label of each document. Adam over all documents at once; both
    labels weigh the same.
    """
    w, b = np.full(size, 0.5), -6.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    for step in range(1, rounds + 1):
        z = b + np.bincount(row, w[col], minlength=len(doc))
        total = np.bincount(doc, np.logaddexp(0, z), minlength=len(toxic))
        slope = np.where(toxic, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0) * weight
        dz = slope[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(col, dz[row], minlength=size) + 2e-5 * w, dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(sample: DataFrame, max_features: int = 20_000) -> Model:
    """Fit sentence weights to the labels of `sample` (text, toxic).

    Features are those that occur in 3 and 0.5 % of the toxic documents at least,
    relatively twice as often there as in others, the `max_features` clearest ones.
    Counting and extraction are distributed; the driver holds the chosen features, and
    for each document of the sample where they occur in which sentence.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                seen: Counter[tuple[str, bool]] = Counter()
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    seen.update((f, label == 1) for f in {f for sentence in occurrences(text) for f in sentence})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f for f, _ in seen], pa.string()),
                        pa.array([n if bad else 0 for (_, bad), n in seen.items()], pa.int64()),
                        pa.array([0 if bad else n for (_, bad), n in seen.items()], pa.int64()),
                    ],
                    names=["feature", "bad", "good"],
                )

    sizes = sample.agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")).first()
    if not sizes.bad or not sizes.good:
        return Model()
    p, q = F.col("bad") / sizes.bad, (F.col("good") + 0.5) / sizes.good
    clear = (p - q) / F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / sizes.bad + q / sizes.good)
    chosen = (
        sample.mapInArrow(count, "feature string, bad long, good long")
        .groupBy("feature")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter((F.col("bad") >= max(3, 0.005 * sizes.bad)) & (p >= 2 * q))
        .select("feature", clear.alias("z"))
        .filter("z > 3")
        .orderBy(F.desc("z"), "feature")
        .limit(max_features)
        .collect()
    )
    names = [r.feature for r in chosen]
    at = {f: i for i, f in enumerate(names)}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                bags = [occurrences(t) for t in part.column("text").to_pylist()]
                hits = [[(j, at[f]) for j, sentence in enumerate(bag) for f in sentence if f in at] for bag in bags]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("toxic"),
                        pa.array([len(bag) for bag in bags], pa.int32()),
                        pa.array([[j for j, _ in h] for h in hits], pa.list_(pa.int32())),
                        pa.array([[f for _, f in h] for h in hits], pa.list_(pa.int32())),
                    ],
                    names=["toxic", "sentences", "row", "col"],
                )

    found = sample.mapInArrow(extract, "toxic int, sentences int, row array<int>, col array<int>").toArrow()
    found = found.sort_by([("toxic", "ascending"), ("sentences", "ascending")])
    sentence_counts = found.column("sentences").to_numpy()
    first = np.cumsum(sentence_counts) - sentence_counts
    hits = pc.list_value_length(found.column("row")).to_numpy()
    row = pc.list_flatten(found.column("row")).to_numpy() + np.repeat(first, hits)
    col = pc.list_flatten(found.column("col")).to_numpy()
    doc = np.repeat(np.arange(len(sentence_counts)), sentence_counts)
    w, b = optimise(len(names), doc, row, col, found.column("toxic").to_numpy() == 1)
    return Model(b, {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 0.01})


def _room(facts: list, most: int, longest: int) -> list:
    """Of rows (doc_id, toxic, chars, print, h) those that the sample takes.

    Each label has half of `most` characters and is filled by itself, in the order of h; texts over `longest` come
    after all others. It ends at the first text that doesn't fit into what is left, as short texts behind it must not take its
    place; its first text is always taken, so that no label is lost to a long text.
    """
    used = []
    for label in (0, 1):
        left = most // 2
        mine = sorted((r for r in facts if r.toxic == label and r.chars <= most), key=lambda r: (r.chars > longest, r.h, r.doc_id))
        for i, r in enumerate(mine):
            if i and r.chars > left:
                break
            used.append(r)
            left -= r.chars
    return used


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 3_000, max_chars: int = 24_000_000, long_text: int = 200_000) -> Model:
    """Learn from `labels` (doc_id, toxic 0 or 1) and the texts of `docs`.

    The classifier is fitted on a sample of about `sample_docs` documents of each label,
    picked by a hash of the id, and of these on at most `max_chars` characters, half of them
    for each label (whole documents, see `_room`: those over `long_text` come last, so that they hardly ever count, which leaves
    the weights to documents of common length; one over `max_chars` never does). Of several labels for an id
    the greatest counts, of several texts the shortest. Without both labels nothing is learned and every score is close to 0.
    """
    marked = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    near = chance("doc_id", F.lit("toxicity"))
    picked = None
    for label, n in sizes.items():
        part = marked.filter((F.col("toxic") == label) & (near < sample_docs / n))
        picked = part if picked is None else picked.unionAll(part)
    if picked is None:
        return Model()
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.doc_id, r.toxic) for r in picked.collect()], "doc_id long, toxic int")  # about 2 * sample_docs
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    mark = F.struct(F.length("text").alias("chars"), F.xxhash64("text").alias("print"))
    facts = rows.groupBy("doc_id", "toxic").agg(F.min(mark).alias("m")).select("doc_id", "toxic", "m.*", near.alias("h")).collect()  # a row an id
    use = [(r.doc_id, r.chars, r.print) for r in _room(facts, max_chars, long_text)]
    if not use:
        return Model()
    wanted = spark.createDataFrame(use, "doc_id long, chars int, print long")
    keyed = rows.withColumn("chars", F.length("text")).withColumn("print", F.xxhash64("text"))
    kept = keyed.join(F.broadcast(wanted), ["doc_id", "chars", "print"]).dropDuplicates(["doc_id"]).select("text", "toxic")
    return train(spread(Written(kept, "sample").df))


def offending(scorer: Scorer, text: str | None, least: float) -> list[tuple[int, int, float]]:
    """Start, end (code points) and score of each sentence that alone scores `least` or more."""
    if not text:
        return []
    p = 1 / (1 + np.exp(-scorer.logits(text)))
    return [(a, b, float(x)) for (a, b), x in zip(sentences(text), p, strict=True) if x >= least]


def score(
    docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "toxicity", spans: str | None = None, least: float = 0.5
) -> DataFrame:
    """Add `name` (0 to 1) to each row of `docs`; whole texts, 0 for a null text or one without words.

    `spans`: the name of a column for the sentences that score `least` or more, of texts
    that do so as a whole: structs of first, end and score. Where a kept column has one of
    the names, the new column gets a `_` more.
    """
    names = list(docs.columns if keep is None else keep)
    made = [free_name(x, names) for x in (name, spans) if x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").to_pylist()
                found = [scorer.score(t) for t in texts]
                columns = [*(part.column(c) for c in names), pa.array(found, pa.float64())]
                if spans:
                    lists = [offending(scorer, t, least) if x >= least else [] for t, x in zip(texts, found, strict=True)]
                    columns.append(pa.array([[dict(zip(("first", "end", "score"), s, strict=True)) for s in x] for x in lists], kind))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema] + [f"`{made[0]}` double"]
    if spans:
        fields.append(f"`{made[1]}` array<struct<first: long, end: long, score: double>>")
    return spread(docs.select(*dict.fromkeys([*names, "text"]))).mapInArrow(run, ", ".join(fields))


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, first, end (code points), score of the sentence, its text."""
    used = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = score(used, model, spans="found", least=least).select("doc_id", "text", F.explode("found").alias("x"))
    sentence = F.substring("text", (F.col("x.first") + 1).cast("int"), (F.col("x.end") - F.col("x.first")).cast("int"))
    return found.select("doc_id", "x.first", "x.end", "x.score", sentence.alias("sentence"))


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the sentences that alone score 0.5 or more
    where the document does (`first:end` in code points, comma-joined). Learns outside the held-out third only.
    """
    third = fold("doc_id", 3)
    model = fit(docs.select("doc_id", "text"), labels.filter(third != 1).select("doc_id", "toxic"))
    found = score(docs.select("doc_id", "text"), model, keep=["doc_id"], spans="spans")
    sentence = F.transform("spans", lambda x: F.concat_ws(":", x.first.cast("string"), x.end.cast("string")))
    return found.select(
        "doc_id",
        F.coalesce(third == 1, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"),
        F.concat_ws(",", sentence).alias("sentences"),
    )
