"""Reply trees against a plain search, templates against a round trip."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessaline.llm import chat
from tessaline.llm.chat import Template

SCHEMA = "conv_id long, turn long, role string, text string"
TREE = "tree long, id long, parent long, score double"


def plain_branches(messages, best):
    """(tree, branch, pos, id) by walking up from every leaf."""
    kept = {}
    for tree, i, parent, score in messages:
        old = kept.get((tree, i))
        key = (-(score or 0.0), -(2**63) if parent is None else parent)
        if old is None or key < old[0]:
            kept[tree, i] = (key, parent, max(score or 0.0, old[2] if old else float("-inf")))
        else:
            kept[tree, i] = (old[0], old[1], max(score or 0.0, old[2]))
    up = {k: (p if p is not None and p != k[1] and (k[0], p) in kept else None) for k, (_, p, _) in kept.items()}
    answered = {(k[0], p) for k, p in up.items() if p is not None}
    found = {}
    for tree, i in kept:
        if (tree, i) in answered:
            continue
        path, at = [], i
        while at is not None and len(path) <= len(kept):
            path.append(at)
            at = up[tree, at]
        if at is None:
            found.setdefault(tree, []).append((-sum(kept[tree, p][2] for p in path) / len(path), -len(path), i, path[::-1]))
    return sorted((t, b, pos, i) for t, paths in found.items() for b, (*_, path) in enumerate(sorted(paths)[:best], 1) for pos, i in enumerate(path))


@pytest.mark.parametrize("seed", range(3))
def test_branches_of_random_trees(spark, seed):
    """Trees, chains, circles, replies to themselves and to messages that aren't there, repeated ids, equal scores."""
    r = random.Random(seed)
    rows = [(t, i, r.choice([None, r.randrange(i + 1), r.randrange(60)]), r.choice([None, 0.0, 0.5, 1.0])) for t in range(4) for i in range(40)]
    rows += [(9, i, i - 1 if i else None, 0.25) for i in range(70)] + [(10, 1, 2, 1.0), (10, 2, 1, 1.0), (10, 3, 2, 1.0), (10, 4, 4, 0.0), (10, 4, 99, 0.5)]
    made = chat.branches(spark.createDataFrame(rows, TREE), best=3)
    assert sorted(map(tuple, made.collect())) == plain_branches(rows, 3)


def test_a_star_of_many_leaves(spark):
    """Every message answers the first; only the best branch of the tree goes on."""
    rows = spark.range(1, 20_001).select(
        F.lit(0).cast("long").alias("tree"), "id", F.lit(0).cast("long").alias("parent"), (F.col("id") % 977 / 977).alias("score")
    )
    made = chat.branches(rows.unionByName(spark.createDataFrame([(0, 0, None, 0.0)], TREE))).collect()
    assert sorted(map(tuple, made)) == [(0, 1, 0, 0), (0, 1, 1, 976)]


TEXTS = [
    "", " ", "plain", "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> <\\\\\\s>", "\\", "<", "</", "[INST", "[[INST]]", "<<s>>", "a\n\n</s>\\", "[\\/INST]\\[INST]",
    "<s", "s>", "É☃\U0001d54f</s>\U0001d54f", "<\\<s>", "$1 \\1 $0",
]


@pytest.mark.parametrize("template", [Template(), Template("<|begin|>", "{says}", "{learns}", "~end", escape="^", learned=("b", "c"))])
def test_round_trip(spark, template):
    """Roles and texts of every kind come back, and no text holds a mark."""
    marks = [*template.marks, *[m[0] + template.escape * n + m[1:] for m in template.marks for n in (1, 2, 3)], "".join(template.marks)]
    texts = TEXTS + marks
    r = random.Random(3)
    rows = [(t, i, r.choice(["assistant", "user", "b", "c", "", None, *marks]), r.choice([*texts, None, "".join(r.choices(texts, k=4))])) for t in range(40) for i in range(6)]
    messages = spark.createDataFrame(rows, "tree long, id long, role string, text string")
    paths = messages.select("tree", F.lit(1).alias("branch"), F.col("id").alias("pos"), "id")
    made = chat.formatted(paths, messages, template).withColumn("turns", template.turns(F.col("formatted")))
    read = made.select("*", F.transform("turns", template.read).alias("read"), chat.learned(F.col("turns"), F.col("mask"), template).alias("learned"))
    for x in read.collect():
        mine = [(role or "", text or "") for t, _, role, text in rows if t == x.tree]
        assert [tuple(t) for t in x.read] == mine
        assert x.learned == [text for role, text in mine if role in template.learned and text]
        assert sum(m.lead + m.loss + m.tail for m in x.mask) == len(x.formatted)
        assert [x.formatted.count(m) for m in (template.begin, template.end)] == [6, 6]
        assert x.formatted.count(template.says) + x.formatted.count(template.learns) == 6


def test_templates_that_can_not_be_read_back():
    for marks in (("<s>", "<s>", "b]", "c]"), ("<s>", "<s>x", "[b", "[c"), ("<s>", "a<b", "[b", "[c"), ("<\\s", "[a", "[b", "[c"), ("<", "[a", "[b", "[c")):
        with pytest.raises(ValueError):
            Template(*marks)


def plain_query(rows):
    found = {}
    for conv, turn, role, text in [*rows, *chat.PROBE]:
        found.setdefault(conv, []).append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or ""), role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for conv, turns in found.items():
        turns.sort(key=lambda t: (t[0], (t[1][0], t[1][1].encode()), (t[2][0], t[2][1].encode())))
        loss = "".join(t[4] for t in turns if t[3] == "assistant")
        out.append((conv, len(turns), sha("".join(f"{t[3]}\n{t[4]}\n" for t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_query(spark):
    """Nulls in every column, empty, very long and repeated turns, gaps, a long conversation, columns named like ours."""
    long = "many words of a long text </s> " * 20_000
    rows = [(1, 0, "user", "Hi"), (1, 5, "assistant", ""), (1, 5, "assistant", "Twice"), (1, 5, "assistant", "Twice"), (2, None, "user", None)]
    rows += [(None, 1, None, "No conversation"), (None, 0, "assistant", "None"), (3, 0, None, None), (4, 1, "assistant", long), (4, 0, "tool", "É☃\U0001d54f")]
    rows += [(5, i, ("user", "assistant")[i % 2], f"turn {i} \\ [INST]") for i in range(700)] + [(-7, 0, "assistant", "[/INST]")]
    frame = spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA + ", id int, tree string")
    made = chat.op13(spark, frame)
    assert sorted([tuple(x)[:5] for x in made.collect()], key=str) == plain_query(rows)
    alone = chat.op13(spark, frame.limit(0)).collect()
    assert [(x.conv_id, x.n_turns, x.loss_chars) for x in alone] == [(-1, 2, 21)]


def test_no_python(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi")], SCHEMA)
    plan = chat.op13(spark, frame)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
