"""Byte-level BPE against the tiktoken library."""

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxfield.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "Hello world's", "a" * 5000, " " * 700 + "x", "日本語テスト" * 90, "  \n\t x", "\x1c a\x1f\x85 b\xa0  c \x1d", "x² ½a1b٣", "é" * 300, "ab" * 400 + "!!??" * 200, "<|endoftext|> you'll", "😀👍🏽"]


@pytest.fixture(scope="module")
def both():
    raw = open(PATH, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.ByteBPE.parse(raw, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_tiktoken(both):
    mine, theirs = both
    for x in TEXTS:
        assert mine.encode([x or ""])[0] == theirs.encode_ordinary(x or "")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    ids = both[0].encode([text])[0]
    assert ids == both[1].encode_ordinary(text) and both[0].decode(ids) == text.encode()


def test_long_rule_is_the_row_rule(both):
    for x in ("the the there " * 5, "zzzyx" * 11):
        assert both[0].merge_long(x.encode()) == both[0].merge_rows(both[0].byte[list(x.encode())][None, :])[0]


def test_operator(spark, both):
    rows = [(i, x, "clash", 1) for i, x in enumerate(TEXTS)] + [(None, "same", "c", 1), (None, "same", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, id long").repartition(3)
    out = bpe.bpe_encode(df, PATH, P.PATTERN, decode=True, verify=True)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    for i, x in enumerate(TEXTS):
        assert got[i]["ids"] == both[1].encode_ordinary(x or "") and got[i]["decoded"] == (x or "").encode() and got[i]["exact"]
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.bpe_decode(out, PATH, P.PATTERN).collect()}
    assert all(back[i] == (x or "").encode() for i, x in enumerate(TEXTS))
    assert bpe.bpe_encode(df.limit(0), PATH, P.PATTERN).count() == 0
