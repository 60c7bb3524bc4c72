import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tableguard.llm import bottom_k, queries
from tests.llm.helpers import documents, empty_documents, prose, write_tables


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def all_hashes(text, width=5):
    words = [w for w in re.split(r"[ \t\n\v\f\r]+", (text or "").lower()) if w]
    hashed = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    out = set()
    for i in range(max(1, len(words) - width + 1) if words else 0):
        h = 42
        for x in hashed[i:i + width]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        out.add(signed(h))
    return out


def hand_sketch(text, size=bottom_k.SIZE):
    return sorted(all_hashes(text))[:size]


def hand_likeness(a, b, size=bottom_k.SIZE):
    both = sorted(set(a) | set(b))[:size]
    return sum(h in a and h in b for h in both) / len(both) if both else 1.0


def hex_of(s):
    return "".join(f"{h & (2**64 - 1):016x}" for h in s)


def by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    out = []
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        s, e = hand_sketch(text), hand_sketch(edited)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), hex_of(s), hex_of(e), round(hand_likeness(s, e), 9),
                    round(hand_likeness(s, hand_sketch(after)), 9)))
    return out


def fixture_rows():
    rng = random.Random(8)
    texts = [None, "", "  \n", "one", "One Two three\tfour", "a b c d e", "É ß \U0001f600 x y z", prose(rng, 30_000)]
    texts += [prose(rng, rng.randint(1, 500)) for _ in range(40)]
    texts += [texts[12]] * 3 + [texts[12] + " tail", texts[-1].upper()]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    return rows


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) if v is not None else (False, 0) for v in r))


@pytest.mark.parametrize("blocks", [1, 2, 7, 300])
def test_rows_match_by_hand_for_any_blocks(spark, blocks):
    rows = fixture_rows() + [(None, "null id text here now and then"), (None, None), (6, "repeated id " * 9), (6, "repeated id " * 9)]
    df = documents(spark, rows).selectExpr("*", "1 AS id", "2 AS hash", "3 AS block", "4 AS sketch", "5 AS extra")
    got = bottom_k.compare_with_next(df, blocks=blocks)
    got = got.select("doc_id", "n_chars", "edited_sha256", bottom_k.as_text(F.col("sketch")), bottom_k.as_text(F.col("edited_sketch")),
                     F.round("near_edited", 9), F.round("near_next", 9)).collect()
    assert order(map(tuple, got)) == order(by_hand(rows))


def test_query_on_a_fixture(spark, tmp_path):
    rows = fixture_rows()
    got = queries.QUERIES["op3_bottom_k"](spark, write_tables({"documents": documents(spark, rows)}, tmp_path)).collect()
    assert order(tuple(r[:5]) + (round(r[5], 9), round(r[6], 9)) for r in got) == order(by_hand(rows))


def test_one_document_follows_itself_and_no_document_gives_no_row(spark):
    r = bottom_k.compare_with_next(documents(spark, ["one two three four five six"])).collect()[0]
    assert r.near_next == 1.0
    assert bottom_k.compare_with_next(empty_documents(spark)).count() == 0


def test_text_form_round_trips(spark):
    df = documents(spark, [t for _, t in fixture_rows()]).select(bottom_k.sketch(F.col("text")).alias("s"))
    assert df.filter(~F.col("s").eqNullSafe(bottom_k.from_text(bottom_k.as_text(F.col("s"))))).count() == 0


def test_merged_parts_are_the_sketch_of_the_whole(spark):
    rng = random.Random(3)
    texts = {k: [prose(rng, rng.randint(1, 400)) for _ in range(30)] for k in ("a", "b", None)}
    rows = [(k, t) for k, ts in texts.items() for t in ts] + [("empty", ""), ("empty", None)]
    df = spark.createDataFrame(rows, "part string, text string").withColumn("sketch", bottom_k.sketch(F.col("text")))
    got = {r.part: list(r.sketch) for r in bottom_k.merge_sketches(df, ["part"]).collect()}
    want = {k: sorted(set().union(*map(all_hashes, ts)))[:bottom_k.SIZE] for k, ts in texts.items()}
    assert got == {**want, "empty": []}


def test_estimates_are_near_the_truth(spark):
    rng = random.Random(4)
    a = prose(rng, 6000)
    b = a + " " + prose(rng, 6000)
    ha, hb = all_hashes(a), all_hashes(b)
    df = spark.createDataFrame([(a, b)], "a string, b string").select(bottom_k.sketch(F.col("a")).alias("a"), bottom_k.sketch(F.col("b")).alias("b"))
    r = df.select(bottom_k.resemblance(F.col("a"), F.col("b")).alias("r"), bottom_k.containment(F.col("a"), F.col("b")).alias("ab"),
                  bottom_k.containment(F.col("b"), F.col("a")).alias("ba"), bottom_k.distinct_shingles(F.col("b")).alias("n")).first()
    assert abs(r.r - len(ha & hb) / len(ha | hb)) < 0.15
    assert abs(r.ab - 1) < 0.2 and abs(r.ba - len(ha & hb) / len(hb)) < 0.2
    assert abs(r.n / len(hb) - 1) < 0.3


def test_no_python_in_the_plan(spark):
    plan = bottom_k.compare_with_next(documents(spark, ["a b", "c"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_containment_and_shingle_counts_of_the_query(spark, tmp_path):
    rng = random.Random(21)
    long = prose(rng, 4000)
    texts = ["a b c d e f g", "a b c d e f g h i", None, "", long, " ".join(long.split()[:2000]), long + " " + prose(rng, 4000)]
    rows = queries.QUERIES["op3_bottom_k"](spark, write_tables({"documents": documents(spark, texts)}, tmp_path)).collect()
    got = {r.doc_id - 1: r for r in rows}
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        own, others = all_hashes(text), (all_hashes(edited), all_hashes(after))
        few = len(own) < bottom_k.SIZE
        assert abs(got[i].shingles - len(own)) <= (0 if few else 0.3 * len(own))
        for value, other in zip((got[i].kept_in_edited, got[i].kept_in_next), others):
            exact = len(own & other) / len(own) if own else 1.0
            assert 0 <= value <= 1 and abs(value - exact) <= (1e-9 if few and len(own | other) < bottom_k.SIZE else 0.2), (i, value, exact)
