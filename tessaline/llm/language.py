"""Language identification: known words first, shorter and shorter character n-grams for the rest."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaline.llm.common import chance, free_name, spread, text_slices

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Resolved chunks that a Python worker remembers; the memory is emptied when full.
_REMEMBERED = 200_000
#: Languages whose sampling shares are broadcast; those of more are joined by a shuffle.
_MOST_SENT = 5_000


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def words_in(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if any(map(str.isalpha, w))]


class Model:
    """Log frequencies by language of words (level 0) and of n-grams within `_word_` (level n).

    A language's log frequency is the level's base, that of something never seen in it,
    and a gain where it was seen; only gains are stored, by row of words and grams.
    """

    def __init__(self, counts: dict[str, dict[str, int]], longest: int = 5, alpha: float = 0.5):
        """counts: word to (language to count)."""
        self.languages = sorted({lang for by in counts.values() for lang in by})
        self.longest = longest
        at = {lang: i for i, lang in enumerate(self.languages)}
        size = len(at)
        total = np.zeros(size)
        for by in counts.values():
            for lang, n in by.items():
                total[at[lang]] += n
        self.prior = np.log((total + 1) / (total + 1).sum()) if size else total
        self.levels: list[dict[str, int]] = []
        self.base = np.zeros((longest + 1, size))
        lengths, langs, gains = [], [], []
        for level in range(longest + 1):
            sums = counts
            if level:
                sums = defaultdict(lambda: defaultdict(int))
                for word, by in counts.items():
                    for gram in self.split(word, level):
                        row = sums[gram]
                        for lang, n in by.items():
                            row[lang] += n
            self.levels.append({x: len(lengths) + i for i, x in enumerate(sums)})
            seen = np.zeros(size)
            for by in sums.values():
                lengths.append(len(by))
                for lang, n in by.items():
                    langs.append(at[lang])
                    gains.append(np.log1p(n / alpha))
                    seen[at[lang]] += n
            self.base[level] = np.log(alpha / (seen + alpha * max(1, len(sums)))) if size else 0
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.langs, self.gains = np.array(langs, dtype=np.int32), np.array(gains)

    @staticmethod
    def split(word: str, n: int) -> list[str]:
        framed = f"_{word}_" if n > 1 else word  # a frame alone tells nothing
        return [framed[i : i + n] for i in range(len(framed) - n + 1)]

    def find(self, word: str) -> tuple[list[int], int]:
        """The row of a known word; of an unseen one the rows of its longest known n-grams; and their level (-1: none)."""
        row = self.levels[0].get(word)
        if row is not None:
            return [row], 0
        for n in range(self.longest, 0, -1):
            table = self.levels[n]
            if found := [table[g] for g in self.split(word, n) if g in table]:
                return found, n
        return [], -1

    def scores(self, words: list[str], owner: np.ndarray, size: int) -> np.ndarray:
        """The sums (`size` by languages) over the words of each owner: a word's log frequencies, or its grams' mean."""
        found = [self.find(w) for w in words]
        out = np.zeros((size, len(self.languages)))
        level = np.array([n for _, n in found], dtype=np.int64)
        told = level >= 0
        np.add.at(out, owner[told], self.base[level[told]])
        counts = np.array([len(ids) for ids, _ in found], dtype=np.int64)
        rows = np.fromiter((i for ids, _ in found for i in ids), dtype=np.int64, count=int(counts.sum()))
        sizes = self.starts[rows + 1] - self.starts[rows]
        flat = np.arange(int(sizes.sum())) + np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes)
        place = np.repeat(np.repeat(owner, counts) * len(self.languages), sizes) + self.langs[flat]
        weight = self.gains[flat] / np.repeat(np.repeat(np.maximum(counts, 1), counts), sizes)
        return out + np.bincount(place, weight, minlength=out.size).reshape(out.shape)

    def word(self, word: str) -> np.ndarray | None:
        """Log frequencies of a word; none if nothing of it is known."""
        return self.scores([word], np.zeros(1, dtype=np.int64), 1)[0] if self.find(word)[0] else None


class Scorer:
    """Scores texts; what a chunk between white space adds is worked out once and remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.room = min(_REMEMBERED, (32 << 20) // (4 * max(1, len(model.languages))))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((self.room, len(self.model.languages)), dtype=np.float32)
        self.letters = np.zeros(self.room, dtype=bool)

    def _add(self, chunks: list[str]) -> None:
        first = len(self.at)
        self.at.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        words, owner = [], []
        for i, chunk in enumerate(chunks):
            if found := words_in(chunk):
                words += found
                owner += [i] * len(found)
        of = np.array(owner, dtype=np.int64)
        self.letters[first + of] = True
        self.rows[first : first + len(chunks)] = self.model.scores(words, of, len(chunks))

    def learn(self, texts: list[str | None]) -> None:
        """Work out the chunks of several texts together."""
        new = set()
        for text in texts:
            if text:
                new.update(text.split())
        new.difference_update(self.at)
        if len(self.at) + len(new) <= self.room:
            self._add(list(new))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.languages:
            return UNKNOWN, 0.0
        total, letters = self.model.prior.copy(), False
        chunks = text.split()
        for begin in range(0, len(chunks), self.room // 2):
            part = chunks[begin : begin + self.room // 2]
            if len(self.at) + len(part) > self.room:
                self.clear()
            get = self.at.get
            found = [get(c) for c in part]
            if None in found:
                self._add(list({c for c, i in zip(part, found, strict=True) if i is None}))
                found = [self.at[c] for c in part]
            index = np.array(found)
            letters = letters or bool(self.letters[index].any())
            total += self.rows[index].sum(axis=0, dtype=np.float64)
        if not letters:
            return UNKNOWN, 0.0
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def fit(
    docs: DataFrame,
    sample_docs: int = 20_000,
    least_docs: int = 200,
    max_words: int = 60_000,
    least_words: int = 1_000,
    id_column: str = "doc_id",
    lang_column: str = "lang",
) -> Model:
    """Learn from the rows of `docs` that have a text and a language.

    Every language is learned, however rare. The classifier is fitted on a sample, picked
    by a hash of the id: about `sample_docs` rows in all, dealt evenly over the
    languages (a language's rows all, if there are fewer), but at least about
    `least_docs` of each. Of each language's words in it, the most frequent are kept that
    occur twice or more in the sample: `max_words` dealt evenly, but at least
    `least_words` of each. What the driver holds is bounded by these and the number of
    languages.
    """
    own = F.when(F.col(id_column).isNull(), F.col("text").cast("string"))  # rows without an id must not be picked as one
    rows = docs.select(
        F.col(lang_column).cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
        chance(F.col(id_column), own, F.lit("language")).alias("chance"),
    ).filter("lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = max(1, sizes.count())
    share = F.lit(float(max(least_docs, sample_docs // languages))) / F.col("n")
    shares = sizes.select("lang", share.alias("share"))
    if languages <= _MOST_SENT:  # a few thousand names
        shares = F.broadcast(shares)
    picked = rows.join(shares, "lang").filter("chance < share AND text IS NOT NULL").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sums: Counter[tuple[str, str]] = Counter()
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    words = words_in(text or "")
                    sums.update(zip([lang] * len(words), words, strict=True))
                langs, words = zip(*sums, strict=True) if sums else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(sums.values()), pa.int64())],
                    names=["lang", "word", "n"],
                )

    counted = picked.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    often = counted.withColumn("all", F.sum("n").over(W.partitionBy("word"))).filter("all > 1")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))  # over the words of a bounded sample
    kept = often.withColumn("place", place).filter(F.col("place") <= max(least_words, max_words // languages)).select("lang", "word", "n").toArrow()
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, word, n in sorted(zip(*(kept.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)):
        counts[word][lang] = n
    return Model(dict(counts))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Add `lang` (a learned language, or `und`) and `score` (0 to 1) to each row of `docs`.

    Whole texts. `und` with score 0 where the text is null or has no letter, and
    everywhere if nothing was learned. `keep`: the columns to return besides (all). Where
    a kept column has one of the two names, the new column gets a `_` more.
    """
    names = list(docs.columns if keep is None else keep)
    lang, score = free_name(lang, names), free_name(score, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").to_pylist()
                scorer.learn(texts)
                found = [scorer.predict(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names]
                    + [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                    names=[*names, lang, score],
                )

    used = docs.select(*dict.fromkeys([*names, "text"]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema]
    return spread(used).mapInArrow(run, ", ".join([*fields, f"`{lang}` string, `{score}` double"]))


def op10(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learns outside the held-out fifth only."""
    fifth = fold("doc_id", 5)
    model = fit(docs.filter(fifth != 0).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select(
        "doc_id", F.coalesce(fifth == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
