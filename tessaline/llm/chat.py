"""Reply trees as training conversations: paths by self-joins, branches by score, one text and loss mask for each."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaline.llm.common import NULL_ID, Written, id_back, id_key, ranked


@dataclass(frozen=True)
class Template:
    """How a turn is written: `begin`, role, `says` (`learns`, where the turn is under the loss), text, `end`.

    Inside roles and texts a mark gets one more `escape` behind its first character, and
    so does a mark that already has some, so that no mark is left and taking one away
    gives the text back.
    """

    begin: str = "<s>"
    says: str = "[INST]"
    learns: str = "[/INST]"
    end: str = "</s>"
    escape: str = "\\"
    #: Roles whose texts are under the loss.
    learned: tuple[str, ...] = ("assistant",)
    marks: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = (self.begin, self.says, self.learns, self.end)
        heads = {m[:1] for m in marks}
        if len(set(marks)) < 4 or len(self.escape) != 1 or any(len(m) < 2 for m in marks):
            raise ValueError("four different marks of two characters at least and an escape of one are needed")
        if self.escape in "".join(marks) or any(h in m[1:] for m in marks for h in heads):
            raise ValueError("no mark may hold the escape, or the first character of a mark anywhere but at its start")
        if any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError("no mark may begin another")
        object.__setattr__(self, "marks", marks)

    def _pattern(self, escapes: str) -> str:
        quote = lambda x: re.sub(r"([^A-Za-z0-9])", r"\\\1", x)
        tails = [f"(?<={quote(m[0])}){escapes}(?={quote(self.escape)}*{quote(m[1:])})" for m in self.marks]
        return "|".join(tails)

    def hide(self, text: Column) -> Column:
        """`text` without a mark."""
        return F.regexp_replace(text, F.lit(self._pattern("")), F.lit(re.escape(self.escape)))

    def show(self, text: Column) -> Column:
        """The text behind `hide`."""
        return F.regexp_replace(text, F.lit(self._pattern(re.sub(r"([^A-Za-z0-9])", r"\\\1", self.escape))), F.lit(""))

    def turn(self, role: Column, text: Column) -> Column:
        """One turn: its text as written, and how many code points of it come before the loss, under it and behind."""
        role, learned = F.coalesce(role, F.lit("")), F.coalesce(role.isin(*self.learned), F.lit(False))
        head = F.concat(F.lit(self.begin), self.hide(role), F.when(learned, self.learns).otherwise(self.says))
        body = self.hide(F.coalesce(text, F.lit("")))
        return F.struct(
            F.concat(head, body, F.lit(self.end)).alias("written"),
            (F.length(head) + F.when(learned, 0).otherwise(F.length(body))).alias("lead"),
            F.when(learned, F.length(body)).otherwise(0).alias("loss"), F.lit(len(self.end)).alias("tail"),
        )

    def turns(self, formatted: Column) -> Column:
        """The turns as they stand in a formatted text: an array of strings."""
        return F.transform(F.filter(F.split(formatted, re.escape(self.end)), lambda t: t != ""), lambda t: F.concat(t, F.lit(self.end)))

    def read(self, turn: Column) -> Column:
        """Role and text of a turn as it stands in a formatted text."""
        inner = F.substring(turn, F.lit(len(self.begin) + 1), F.length(turn) - len(self.begin) - len(self.end))
        parts = F.split(inner, f"{re.escape(self.says)}|{re.escape(self.learns)}", 2)
        return F.struct(self.show(parts[0]).alias("role"), self.show(parts[1]).alias("text"))


def _lifted(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Stored tables (tree, id, up): the ancestor 1, 2, 4, ... above; and (tree, id, depth, score) down from the root.

    Each round joins a table to itself. A message that leads to no root (a circle of
    replies) is left out.
    """
    steps: list[DataFrame] = []
    now = Written(nodes.select("tree", "id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), "score"), "up")
    left = now.df.filter("up IS NOT NULL").count()
    limit = left
    while left and 1 << len(steps) <= limit:
        steps.append(now.df.filter("up IS NOT NULL").select("tree", "id", "up"))
        above = now.df.select("tree", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("score").alias("_score"))
        further = now.df.filter("up IS NOT NULL").join(above, ["tree", "up"])
        summed = further.select(
            "tree", "id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("score") + F.col("_score")).alias("score")
        )
        now = Written(summed.unionByName(now.df.filter("up IS NULL")), "up")
        left = now.df.filter("up IS NOT NULL").count()
    return steps, now.df.filter("up IS NULL").drop("up")


def branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, branch, pos, id): the messages, root first (pos 0), of the `best` branches of each tree.

    `messages`: tree, id, parent (all long, tree and id never null), score. A parent that isn't there makes a root.
    A branch goes from a root to a leaf; branches are ranked by their mean score (null: 0),
    then the longer, then by the smaller id of the leaf; `branch` is the rank, from 1. A
    tree's best branches are found by partial maxima, so that no task sees all leaves of
    a tree; only ids go through the joins. Of rows that repeat an id, that of the
    greatest score, then the smallest parent, counts. An empty table gives none.
    """
    first = F.struct(-F.coalesce("score", F.lit(0.0)), F.coalesce("parent", F.lit(NULL_ID)))
    once = messages.groupBy("tree", "id").agg(
        F.min_by(F.col("parent"), first).alias("parent"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score")
    )
    there = once.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    known = Written(
        once.join(there, ["tree", "parent"], "left").select(
            "tree", "id", F.when(F.col("there") & (F.col("parent") != F.col("id")), F.col("parent")).alias("parent"), "score"
        ),
        "messages",
    )
    steps, reached = _lifted(known.df)
    answered = known.df.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("id")).distinct()
    leaves = reached.join(answered, ["tree", "id"], "left_anti")
    order = W.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("depth")), F.desc("depth"), "id")
    ranked = leaves.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= best)
    rows = ranked.select("tree", "branch", (F.col("depth") - 1).alias("pos"), "id")
    for k in reversed(range(len(steps))):  # each row stands for the 2^k messages down to it, until all are there
        further = F.struct((F.col("pos") - (1 << k)).alias("pos"), F.col("up").alias("id"))
        both = F.when(F.col("up").isNull(), F.array(F.struct("pos", "id"))).otherwise(F.array(F.struct("pos", "id"), further))
        rows = rows.join(steps[k], ["tree", "id"], "left").select("tree", "branch", F.inline(both))
    return rows


def formatted(paths: DataFrame, messages: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """(tree, branch, formatted, mask): the text of each branch of `paths` and its loss mask.

    `messages`: tree, id, role, text. `mask` has an entry a turn: the numbers of code points
    before the loss, under it and behind. Only turns that are already written go to the
    grouping; a conversation is one row, as its text is one string.
    """
    turn = template.turn(F.col("role"), F.col("text"))
    placed = paths.join(messages.select("tree", "id", "role", "text"), ["tree", "id"]).select("tree", "branch", F.struct("pos", turn.alias("turn")).alias("at"))
    whole = placed.groupBy("tree", "branch").agg(F.transform(F.sort_array(F.collect_list("at")), lambda a: a.turn).alias("turns"))
    return whole.select(
        "tree", "branch", F.concat_ws("", F.transform("turns", lambda t: t.written)).alias("formatted"),
        F.transform("turns", lambda t: t.dropFields("written")).alias("mask"),
    )


def learned(turns: Column, mask: Column, template: Template) -> Column:
    """The text under the loss mask, unescaped, turn by turn: an array of strings."""
    under = F.filter(F.zip_with(turns, mask, lambda t, m: F.struct(t.alias("t"), m.alias("m"))), lambda x: x.m.loss > 0)
    return F.transform(under, lambda x: template.show(F.substring(x.t, x.m.lead + 1, x.m.loss)))


def threads(conversations: DataFrame) -> DataFrame:
    """(tree, id, parent, role, text): each row of (conv_id, turn, role, text) replies to the one before it.

    Rows go by turn (null first), then role and text, so that repeated turns stay; rows
    without a conv_id are one conversation. They are numbered by ranges, so that a
    conversation with most of the rows isn't sorted in one task.
    """
    rows = conversations.select(id_key("conv_id").alias("tree"), "turn", "role", "text")
    placed = ranked(rows, ["turn", "role", "text"])
    return placed.select("tree", F.col("i").alias("id"), F.when(F.col("i") > 0, F.col("i") - 1).alias("parent"), "role", "text")


#: A conversation that says what could be taken for marks.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13(spark: SparkSession, conversations: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation and of `PROBE`.

    All but conv_id are read back from the formatted text and its mask. Null roles and
    texts are empty ones; an empty table gives the probe alone.
    """
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    messages = threads(conversations.select(*columns).unionByName(probe))
    found = formatted(branches(messages.select("tree", "id", "parent", F.lit(0.0).alias("score"))), messages, template)
    turns = template.turns(F.col("formatted"))
    read = found.select("tree", F.length("formatted").alias("chars"), "mask", turns.alias("turns"))
    read = read.select("tree", "chars", F.transform("turns", template.read).alias("read"), F.concat_ws("", learned(F.col("turns"), F.col("mask"), template)).alias("loss"))
    lines = F.concat_ws("", F.transform("read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return read.select(
        id_back(F.col("tree")).alias("conv_id"), F.size("read").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("chars").cast("long").alias("formatted_chars"),
    )
