"""Secret scans over content-addressed blobs, with a ledger of what each rule version has seen.

Only DataFrame and SQL functions are used here.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaline.llm.common import free_name
from tessaline.sources.shared import shared_folder

#: Names that no input column is expected to have.
_BLOB, _SALT, _FOUND, _CHUNKS = "__tessaline_blob", "__tessaline_salt", "__tessaline_found", "__tessaline_chunks"
#: Characters of the chunks that a text with secrets is put together from again.
_CHUNK = 4096
#: Parts into which the paths of one blob are dealt when findings are joined back.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if `group` has `least` characters or more.

    `quick`: a pattern that finds just these, if one does; it spares the scan the short ones.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    quick: str | None = None


RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, quick=r"AKIA[A-Z0-9]{16,}"),  # both take whole runs of letters
    Rule("hex", r"[0-9a-f]+", least=24, quick=r"[0-9a-f]{24,}"),
)

SPAN = "struct<start: long, ord: int, kind: string, end: long>"
#: A span with the place up to which the spans before it reach.
FOUND = "struct<start: long, ord: int, kind: string, end: long, reach: long>"
LEDGER = f"blob binary, kind string, version int, spans array<{SPAN}>"


def matches(text: Column, rule: Rule) -> Column:
    """The matches of a rule, leftmost and without overlaps: the lengths of what lies before each, of it, and of its group.

    A text without a match gives null.
    """
    pattern = F.lit(rule.quick or rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    steps = F.arrays_zip(
        F.transform(F.split(text, rule.quick or rule.pattern, -1), F.length).alias("b"),
        F.transform(found, F.length).alias("m"),
        F.transform(judged, F.length).alias("g"),
    )
    return F.when(text.rlike(rule.quick or rule.pattern), F.filter(steps, lambda x: x.m.isNotNull()))


def _address(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan_unseen(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Scan each distinct text of `versions` (text) by the rule versions that `ledger` doesn't have for it.

    Returns new ledger rows: blob (the text's SHA-256), kind, version, spans, one for
    every pair scanned, with or without a finding. A blob with nothing to scan isn't
    read further. Null texts are empty ones.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blobs = versions.select(_address(text).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
        blobs = (
            blobs.join(done, "blob", "left")
            .withColumn("missing", F.array_except(wanted, F.coalesce("done", F.array().cast("array<struct<kind: string, version: int>>"))))
            .filter(F.size("missing") > 0)
        )
    else:
        blobs = blobs.withColumn("missing", wanted)

    def row(order: int, rule: Rule) -> Column:
        asked = F.exists("missing", lambda x: (x.kind == rule.kind) & (x.version == rule.version))
        return F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(order).alias("ord"), F.lit(rule.least).alias("least"),
            asked.alias("asked"), F.when(asked, matches(F.col("text"), rule)).alias("found"),
        )

    rows = F.array(*[row(i, r) for i, r in enumerate(rules)])
    pairs = blobs.select("blob", F.explode(rows).alias("x")).select("blob", "x.*").filter("asked")
    each = pairs.select("blob", "kind", "version", "ord", "least", F.posexplode_outer("found").alias("i", "y"))
    # a match's place follows from the lengths of all before it; the blobs' shuffle serves the window and the groups
    upto = F.sum(F.col("y.b") + F.col("y.m")).over(W.partitionBy("blob", "kind", "version").orderBy("i"))
    placed = each.withColumn("end", upto.cast("long"))
    span = F.struct((F.col("end") - F.col("y.m")).cast("long").alias("start"), "ord", "kind", "end")
    good = F.when(F.col("y.g") >= F.col("least"), span)
    return placed.groupBy("blob", "kind", "version").agg(F.array_sort(F.collect_list(good)).cast(f"array<{SPAN}>").alias("spans"))


def findings(
    versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, name: str = "found", path: str | None = None
) -> DataFrame:
    """`versions` (text and any columns) with `name`: the spans of all rules, in order of start, then rule.

    Each distinct text is scanned once, whatever its number of paths; what the ledger
    (rows of earlier scans) has is taken from there, what is scanned is written to the
    ledger at `path` (without one, to a new one in the shared folder) and read back. Then
    findings are joined to every row by the text's address. An address can have a third
    of all rows, so paths carry a salt as well, a hash of their other columns, and the
    findings (few blobs have any) come once for each salt. Where `versions` has a column
    `name`, the new one gets a `_` more. An empty table gives none.
    """
    spark = versions.sparkSession
    place = path or f"{shared_folder(spark)}/tessaline-{uuid.uuid4().hex}/ledger"
    known = update_ledger(versions, place, rules, batch=uuid.uuid4().hex, before=ledger)
    if ledger is not None:
        known = known.unionByName(ledger.select(*known.columns))
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    before = W.partitionBy("blob").orderBy("x.start", "x.ord").rowsBetween(W.unboundedPreceding, -1)  # a text's matches
    hits = (
        known.filter((F.size("spans") > 0) & F.array_contains(current, F.struct("kind", "version")))
        .dropDuplicates(["blob", "kind", "version"])
        .select("blob", F.explode("spans").alias("x"))
        .withColumn("reach", F.coalesce(F.max("x.end").over(before), F.lit(0).cast("long")))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct("x.start", "x.ord", "x.kind", "x.end", "reach"))).alias(_FOUND))
        .withColumnRenamed("blob", _BLOB)
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast(f"array<{FOUND}>")
    others = [F.col(f"`{c}`") for c in versions.columns if c != "text"]
    salt = F.pmod(F.xxhash64(F.to_json(F.struct(*others))), F.lit(SALTS)).cast("int") if others else F.lit(0)
    return (
        versions.withColumn(_BLOB, _address(text))
        .withColumn(_SALT, salt)
        .join(hits, [_BLOB, _SALT], "left")
        .withColumn(free_name(name, versions.columns), F.coalesce(_FOUND, none))
        .drop(_BLOB, _SALT, _FOUND)
    )


def update_ledger(
    versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, batch: str = "0", before: DataFrame | None = None
) -> DataFrame:
    """Scan what neither the ledger at `path` nor `before` has seen, add it at `path` as `batch`, and return what is there.

    A batch that runs again replaces its own rows only, so that a broken run can be repeated.
    """
    spark = versions.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    others = [
        s.getPath().toString() for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName() != f"batch={batch}"
    ]
    ledger = spark.read.schema(LEDGER).parquet(*others) if others else None
    if before is not None:
        rows = before.select("blob", "kind", "version", "spans")
        ledger = rows if ledger is None else ledger.unionByName(rows)
    scan_unseen(versions, rules, ledger).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return spark.read.schema(LEDGER).parquet(*others, f"{path}/batch={batch}")


def redact(versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `versions` with each secret in text replaced by its kind in brackets; a null text stays null.

    Where spans overlap, the first one's kind stands for all they cover. A text is cut
    into chunks once, and each piece is taken from its chunks, so that the work grows
    with the text and the number of its secrets. Other columns stay, whatever their names.
    """
    text, c = F.col("text"), F.col(_CHUNKS)

    def between(a: Column, b: Column) -> Column:
        """The characters from `a` up to `b`."""
        i, j = F.floor(a / _CHUNK).cast("int"), F.floor(b / _CHUNK).cast("int")
        own = F.substring(F.get(c, i), (a % _CHUNK + 1).cast("int"), (b - a).cast("int"))
        head = F.substring(F.get(c, i), (a % _CHUNK + 1).cast("int"), F.lit(_CHUNK))
        middle = F.array_join(F.slice(c, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        tail = F.substring(F.coalesce(F.get(c, j), F.lit("")), F.lit(1), (b % _CHUNK).cast("int"))
        return F.when(b <= a, "").when(i == j, own).otherwise(F.concat(head, middle, tail))

    found = findings(versions.withColumn(_CHUNKS, F.lit(None).cast("array<string>")), rules, name=_FOUND + "s")
    spans = F.col(_FOUND + "s")
    cut = found.withColumn(_CHUNKS, F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))))
    pieces = F.transform(
        spans,
        lambda x: F.when(x.start >= x.reach, F.concat(between(x.reach, x.start), F.lit("["), x.kind, F.lit("]"))).otherwise(F.lit("")),
    )
    end = F.element_at(spans, -1)
    last = between(F.greatest(end.reach, end.end), F.length(text).cast("long"))
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), last)).otherwise(text)
    return cut.withColumn("text", clean).select(*[F.col(f"`{name}`") for name in versions.columns])


def op6(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = findings(docs.select("doc_id", "text"))
    joined = F.concat_ws(",", F.transform("found", lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))))
    count = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(rule.kind) for rule in RULES]
    return found.select("doc_id", *counts, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))
