"""Encoding by fragments, rare ones and long texts included, against the fold of whole words."""

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessaline.llm import pieces
from tessaline.llm.common import NULL_ID

SCHEMA = "doc_id long, text string"


def plain(text):
    table = pieces.load()
    return [x for w in re.findall(pieces.WORD, pieces.normal(text)) for x in pieces.fold(w, table)]


@given(st.text(alphabet="aethinr.,\n ▁é0日本☃", max_size=90))
@settings(max_examples=150, deadline=None)
def test_fragments_fold_to_the_word(text):
    table = pieces.load()
    found, starts = pieces.fragments([pieces.normal(t) for t in (text, None, text)], table)
    assert "".join(found[: starts[1]]) == pieces.normal(text) and starts[1] == starts[2] and starts[3] == len(found)
    assert [x for f in found[: starts[1]] for x in pieces.fold(f, table)] == plain(text)


@given(st.text(alphabet="aethx.=日本語", min_size=60, max_size=200))
@settings(max_examples=60, deadline=None)
def test_long_fragments_are_cut_where_no_edge_lies_over(text):
    table = pieces.load()
    parts = pieces.cut_long(text, table)
    assert "".join(parts) == text and [x for p in parts for x in pieces.fold(p, table)] == pieces.fold(text, table)


@pytest.mark.parametrize("held", [1 << 18, 40, 0])
def test_every_fragment_is_found_whatever_tasks_hold(spark, held):
    texts = [f"word{i % 7} other{i}, the thing. \U0001d54f é\n" * (i % 5) for i in range(60)] + [None, "", " ", "a" * 300, "日本語テキスト" * 90]
    rows = [(i // 2 if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, "again"), (5, "again")]
    out = pieces.encode(spark.createDataFrame(rows, SCHEMA), held=held, block_bytes=300)
    theirs = sorted((k if k is not None else NULL_ID, plain(t)) for k, t in rows)
    assert sorted((r.key, r.ids) for r in out.collect()) == theirs
    back = {r.text for r in pieces.decode(out).collect()}
    assert back == {t or "" for _, t in rows} == {r.text for r in pieces.encode(spark.createDataFrame(rows, SCHEMA), held=held, decoded=True).collect()}


def test_a_long_text_without_spaces(spark):
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(1 << 20))
    row = pieces.encode(spark.createDataFrame([(1, text)], SCHEMA)).first()
    table = pieces.load()
    assert b"".join(table.texts[i] for i in row.ids) == b" " + text.encode()
    assert row.ids == pieces.fold("▁" + text, table)


def test_a_fragment_without_ids_is_an_error():
    none = pieces._WORDS.empty_table()
    with pytest.raises(KeyError):
        pieces.known_ids(pa.array(["missing"]), pieces.load(), none, none)
