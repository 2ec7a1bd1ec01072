"""A Merkle manifest of a table: levels built bottom up and stored, proofs pushed top down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import Written, ranked

FANOUT = 16
#: The columns of a document that its leaf covers, in their order.
COVERED = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left: string, right: string>>"


def digest(*values: Column) -> Column:
    """SHA-256 of the strings, one behind the other, in lowercase hex."""
    return F.sha2(F.concat(*values), 256)


def field(value: Column) -> Column:
    """`-` for a null; else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def joined(hashes: Column) -> Column:
    return F.concat_ws("", hashes)


def fold(leaf: Column, path: Column) -> Column:
    """The root that `leaf` leads to with the siblings of `path`."""
    return F.aggregate(path, leaf, lambda h, step: digest(step.left, h, step.right))


def proof_text(path: Column) -> Column:
    """The siblings of `path`, level by level, left to right."""
    return joined(F.transform(path, lambda step: F.concat(step.left, step.right)))


def _up(nodes: DataFrame, fanout: int) -> DataFrame:
    """The parents of `nodes` (tree, i, n, h and what a node carries): tree, i, n, h, alone, kids.

    A tree of one node has it again as its parent, marked `alone`: it is its root.
    """
    carried = [c for c in nodes.columns if c not in ("tree", "i", "n")]
    groups = nodes.groupBy("tree", F.floor(F.col("i") / fanout).alias("up"), "n").agg(
        F.sort_array(F.collect_list(F.struct("i", *carried))).alias("kids")  # `fanout` at most
    )
    alone = F.col("n") == 1
    h = F.when(alone, F.col("kids")[0].h).otherwise(F.sha2(joined(F.transform("kids", lambda k: k.h)), 256))
    n = F.ceil(F.col("n") / fanout)
    return groups.select("tree", F.col("up").alias("i"), n.alias("n"), h.alias("h"), alone.alias("alone"), "kids")


def _down(level: DataFrame, above: DataFrame) -> DataFrame:
    """The children in `level` with their paths: each puts its siblings before what its parent in `above` has.

    `above`: tree, i, path and what goes to all below. Gives these and the child's own fields.
    """
    hashes = F.transform("kids", lambda k: k.h)
    kids = level.drop("n", "h").join(above, ["tree", "i"]).withColumn("hashes", hashes)
    each = kids.select(*[c for c in kids.columns if c not in ("i", "kids")], F.posexplode("kids").alias("at", "kid"))
    at = F.col("at")
    step = F.struct(joined(F.slice("hashes", F.lit(1), at)).alias("left"), joined(F.slice("hashes", at + 2, F.size("hashes"))).alias("right"))
    path = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))
    passed = [c for c in above.columns if c not in ("tree", "i", "path")]
    return each.select("tree", *passed, path.alias("path"), "kid.*")


class Forest:
    """The stored levels of all trees of `nodes` (tree, i, n, h and what a node carries), bottom first."""

    def __init__(self, nodes: DataFrame, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("a fanout under 2 never ends")
        self.levels: list[DataFrame] = []
        longest = nodes.agg(F.max("n")).first()[0] or 0
        while longest and (longest > 1 or not self.levels):
            self.levels.append(Written(_up(nodes, fanout), f"level{len(self.levels)}").df)
            nodes, longest = self.levels[-1].select("tree", "i", "n", "h"), -(-longest // fanout)

    def roots(self) -> DataFrame:
        """(tree, h)."""
        return self.levels[-1].select("tree", "h")

    def paths(self, above: DataFrame) -> DataFrame:
        """The bottom's nodes with their paths; `above`: tree, path and what goes to all below, for each root."""
        found = above.withColumn("i", F.lit(0).cast("long"))
        for k, level in enumerate(reversed(self.levels)):
            found = _down(level, found if not k else found.drop("h"))
        return found


@dataclass
class Manifest:
    """A root over trees; a tree's leaves in the order of their ids, `fanout` nodes to a parent."""

    root: str | None
    trees: Forest | None
    top: Forest | None

    def proofs(self, empty: DataFrame) -> DataFrame:
        """Each leaf: what it carries, h, subroot, path. `empty` has the columns of a manifest without a leaf."""
        if self.trees is None or self.top is None:
            return empty
        spark = self.trees.levels[0].sparkSession
        start = spark.createDataFrame([("", [])], f"tree string, path {_PATH}")
        subroots = self.top.paths(start).select(F.col("name").alias("tree"), F.col("h").alias("subroot"), "path")
        return self.trees.paths(subroots)


def manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> Manifest:
    """The manifest of `leaves`: tree (a string, never null), h, the columns of `order` and any that leaves carry.

    Within a tree leaves ascend by `order` (nulls first), trees by their UTF-8 bytes.
    Every level is a table in the shared folder, whose parents are made by one grouping
    of at most `fanout` children each, and so is the rank of the leaves.
    """
    trees = Forest(ranked(leaves, order), fanout)
    if not trees.levels:
        return Manifest(None, None, None)
    named = trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h")
    top = Forest(ranked(named, ["name"]), fanout)
    return Manifest(top.roots().first().h, trees, top)


def op11(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of `docs`.

    A row is a leaf over doc_id, source, lang, n_chars and text, in the tree of its
    source (null: a tree of its own, the first). Rows whose crc32(doc_id) is divisible by 5
    are checked with their text's A-Z lower-cased; rows without an id are not tampered
    with. Rows that share an id are leaves each, in the order of their hashes. An empty
    table gives no row, other columns are left alone.
    """
    leaf = lambda text: digest(*[field(text if c == "text" else F.col(c)) for c in COVERED])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", _UPPER, _LOWER)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("h"), F.when(tampered, leaf(lower)).alias("changed"),
    )
    leaves = Written(rows, "leaves").df
    made = manifest(leaves, ["doc_id", "h"])
    found = made.proofs(leaves.select("doc_id", "h", "changed", F.lit("").alias("subroot"), F.lit(None).cast(_PATH).alias("path")))
    root = F.lit(made.root)
    return found.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", root.alias("root"), F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        fold(F.coalesce("changed", "h"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.coalesce(F.col("folded_root") == root, F.lit(False)))
