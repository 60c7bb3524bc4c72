"""Chunking: the reference's vectors, a straight-line implementation as oracle,
and properties (round trip, length bound)."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableguard.operators.chunks import COL_SEP, ROW_SEP, chunk_roundtrip, chunk_text

R, C = ROW_SEP, COL_SEP
VECTORS = [
    ("Short text", 100, ["Short text"]),
    ("First_Part" + R + "SecondPart", 26, ["First_Part" + R, "SecondPart"]),
    ("Col1" + C + "Col2", 16, ["Col1" + C, "Col2"]),
    ("Hello World Again", 8, ["Hello ", "World ", "Again"]),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 10, ["ABCDEFGHIJ", "KLMNOPQRST", "UVWXYZ"]),
    ("Data" + R + "Mid" + C + "End", 35, ["Data" + R, "Mid" + C + "End"]),
    ("Date: 2021-01-01 12:00:00", 20, ["Date: ", "2021-01-01 12:00:00"]),
    ("Start\U0001F60AEnd", 6, ["Start\U0001F60A", "End"]),
]


def straight_line(text, m, row=R, col=C):
    """Plain loop over the rules, for comparison only."""
    out, start, n = [], 0, len(text)
    while start < n:
        if n - start <= m:
            out.append(text[start:])
            break
        target = start + m
        ss = max(start, target - 100)
        window = text[ss:target]
        cut = None
        for sep in (row, col, ": "):
            p = window.rfind(sep)
            if p != -1:
                cut = ss + p + len(sep)
                break
        if cut is None:
            p = max(window.rfind(ch) for ch in " \n\t\r")
            if p != -1:
                cut = ss + p + 1
        if cut is None:
            cut = start + m
        out.append(text[start:cut])
        start = cut
    return out


def _chunks(spark, texts, m):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in chunk_text(df, "id", "text", m).collect():
        got.setdefault(r.id, []).append((r.chunk_no, r.start, r.chunk))
    return {i: [c for _, _, c in sorted(v)] for i, v in got.items()}


@pytest.mark.parametrize("text,m,want", VECTORS)
def test_reference_vectors(spark, text, m, want):
    assert _chunks(spark, [text], m)[0] == want


def test_long_multiline_joins_back(spark):
    text = "\n".join(f"line {i}: some value, more words here" for i in range(40))
    got = _chunks(spark, [text], 20)[0]
    assert "".join(got) == text and all(len(c) <= 20 for c in got)


def test_documents_match_straight_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for m in (1800, 500, 26):
        got = {}
        for r in chunk_text(docs, "doc_id", "text", m).collect():
            got.setdefault(r.doc_id, []).append((r.chunk_no, r.start, r.chunk))
        for i, t in texts.items():
            parts = sorted(got.get(i, []))
            assert [c for _, _, c in parts] == straight_line(t, m), (i, m)
            assert [s for _, s, _ in parts] == [sum(len(c) for _, _, c in parts[:k]) for k in range(len(parts))]


def test_roundtrip_operator(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    res = chunk_roundtrip(chunk_text(docs, "doc_id", "text", 300), docs, "doc_id", "text")
    assert res.where("NOT equal").count() == 0


alphabet = st.sampled_from(list("ab :\n\t\r;") + [R, C, "\U0001F60A", "é"])


@settings(max_examples=25, deadline=None)
@given(st.lists(alphabet, max_size=60).map("".join), st.integers(min_value=1, max_value=40))
def test_property_matches_straight_line(spark, text, m):
    got = _chunks(spark, [text], m).get(0, [])
    assert got == straight_line(text, m)
    assert "".join(got) == text
    assert all(1 <= len(c) <= m for c in got)
