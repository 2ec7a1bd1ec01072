"""Per-document text signals as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words.
SPACE = r"[ \t\n\x0B\f\r]+"
# Normalisation constants where no corpus statistics are given.
DEFAULT_NORM = {"doc_length": 300.0, "sent_length": 30.0, "punct_density": 0.12}
# Fixed value: words at the start of a text that variety and repetition are measured on.
SAMPLE_WORDS = 60
# The access-control terms that the keyword signal looks for.
KEYWORDS = [
    "authentication", "token", "credential", "access control", "privilege", "rbac", "provisioning", "secrets",
    "vault", "principal", "permission", "authorization", "endpoint", "registry", "certificate", "oauth", "saml",
    "ldap", "active directory", "identity", "rotate", "expiry",
]
# Words that don't count as content.
STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "of", "in", "on", "at", "to", "for", "with", "by", "from", "and",
    "or", "but", "not", "it", "its", "this", "that", "these", "those", "which", "who", "their", "they", "them", "we",
    "our", "you", "your", "as", "if",
]
# The punctuation that the density signal counts.
PUNCTUATION = ",:;()[]—–-"
#: The text signals, in the order in which they are reported.
SIGNALS = [
    "sent_unif", "ttr_signal", "repeat_rate", "kw_density", "doc_length_signal", "avg_sent_len_signal", "punct_signal",
    "content_ttr_signal",
]
#: The signals of a document's vector, where it has one.
VECTOR_SIGNALS = ["topic_drift", "cluster_coh"]


def words(text: Column) -> Column:
    """Lower-cased words between white space; punctuation stays."""
    return F.filter(F.split(F.lower(text), SPACE), lambda x: x != "")


def strip(text: Column) -> Column:
    """Without white space at both ends, line breaks and tabs included."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def sentences(text: Column) -> Column:
    """What lies between runs of `.!?`, stripped, if over 10 characters."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), strip), lambda s: F.length(s) > 10)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def stddev_pop(values: Column, average: Column) -> Column:
    squares = F.transform(values, lambda x: (x - average) * (x - average))
    return F.sqrt(F.try_divide(total(squares), F.size(values)))


def base_columns(text: Column) -> list[Column]:
    """Word list, sentence lengths and the first words; what the signals build on."""
    return [
        words(text).alias("words"),
        F.transform(sentences(text), lambda s: F.size(words(s)).cast("double")).alias("sent_words"),
    ]


def with_base(docs: DataFrame) -> DataFrame:
    """`docs` (text) with what the signals build on.

    `sent_mean`, `grams` and `content` are columns of their own, as lambdas would work out an
    expression anew for every element, and several uses each for itself.
    """
    based = docs.select("*", *base_columns(F.col("text")))
    content = F.filter("words", lambda w: ~w.isin(STOPWORDS))
    return based.select("*", mean(F.col("sent_words")).alias("sent_mean"), F.array_sort(grams()).alias("grams"), content.alias("content"))


def raw_columns(text: Column) -> list[Column]:
    """From `words` and `sent_words`: counts and densities before normalisation."""
    n = F.size("words")
    return [
        n.cast("long").alias("n_words"),
        F.size("sent_words").cast("long").alias("n_sentences"),
        F.coalesce("sent_mean", F.greatest(n, F.lit(1)).cast("double")).alias("mean_sent_words"),
        (F.length(text) - F.length(F.translate(text, PUNCTUATION, ""))).cast("long").alias("punct_count"),
    ]


def sentence_uniformity() -> Column:
    """1 / (1 + deviation of the sentence lengths); 0.5 with fewer than two sentences."""
    spread = stddev_pop(F.col("sent_words"), F.col("sent_mean"))
    return F.when(F.size("sent_words") >= 2, 1 / (1 + spread)).otherwise(0.5)


def variety_loss() -> Column:
    """1 - distinct share among the first words."""
    sample = F.slice("words", 1, SAMPLE_WORDS)
    return 1 - F.size(F.array_distinct(sample)) / F.greatest(F.size(sample), F.lit(1))


def grams() -> Column:
    """The trigrams of the first words."""
    n = F.least(F.size("words"), F.lit(SAMPLE_WORDS))
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("words", i, 3)))


def repeat_rate() -> Column:
    """Distinct repeated trigrams over all trigrams among the first words; 0 with fewer than three.

    `grams` are sorted: a repeated one counts where it stands for the second time.
    """
    places = F.sequence(F.lit(1), F.greatest(F.size("grams") - 1, F.lit(1)))
    gram = lambda i: F.get("grams", i)
    again = F.filter(places, lambda i: (gram(i) == gram(i - 1)) & ((i < 2) | (gram(i - 2) != gram(i))))
    return F.when(F.size("words") >= 3, F.size(again) / F.size("grams")).otherwise(0.0)


def keyword_density(text: Column, keywords: list[str] = KEYWORDS) -> Column:
    """Keywords that occur as substrings, over 10, at most 1."""
    low = F.lower(text)
    hits = reduce(lambda a, b: a + b, [F.contains(low, F.lit(k)).cast("int") for k in keywords])
    return F.least(hits / 10, F.lit(1.0))


def content_variety_loss() -> Column:
    """1 - distinct share of the content words; 0.5 with fewer than 20."""
    return F.when(F.size("content") >= 20, 1 - F.size(F.array_distinct("content")) / F.size("content")).otherwise(0.5)


def shortfall(value: Column, scale: Column) -> Column:
    """1 - value / scale, 0 from the scale on; a scale of zero counts as reached."""
    return 1 - F.least(F.coalesce(F.try_divide(value, scale), F.lit(1.0)), F.lit(1.0))


def normalised_columns(norm: dict[str, Column]) -> list[Column]:
    """The three signals that a corpus's 90th percentiles scale; from the raw columns."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        shortfall(n.cast("double"), norm["doc_length"]).alias("doc_length_signal"),
        shortfall(F.col("mean_sent_words"), norm["sent_length"]).alias("avg_sent_len_signal"),
        shortfall(F.col("punct_count") / n, norm["punct_density"]).alias("punct_signal"),
    ]


def query_text(text: Column) -> Column:
    """The first piece before a full stop of over 40 characters, with its stop; else the first 100 characters."""
    piece = F.get(F.filter(F.transform(F.split(text, "[.]"), strip), lambda s: F.length(s) > 40), F.lit(0))
    return F.coalesce(F.concat(piece, F.lit(".")), F.substring(text, 1, 100))


def tier_tag(ratio: Column) -> Column:
    """`p` and the ratio in thousandths, three digits."""
    return F.format_string("p%03d", F.floor(ratio * 1000).cast("int"))
