import hashlib
import random
import re

import pytest

from tableguard.llm import perspectives, queries
from tests.llm.helpers import prose, write_tables
from tests.oracle_harness import _rows

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def fixture():
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["ann", "bob", "cy d", "system"]), prose(rng, rng.randint(0, 20))) for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(50, 0, "system", "only context")]
    rows += [(51, None, "ann", "late"), (51, 1, None, None), (51, 1, "bob", "tie"), (51, 1, "bob", "other tie"), (51, 1, "bob", "tie"), (51, 2, "x<|y\n", "a<|im_end|>\n<|b é\U0001f600")]
    rows += [(None, 1, "ann", "no id"), (None, 2, "bob", "")]
    rows += [(60, t, f"p{t % 3}", prose(rng, 200)) for t in range(400)]
    return rows


def by_hand(rows, part_chars):
    out = []
    for conv in {r[0] for r in rows}:
        talk = sorted({(t is None, t or 0, s or "unknown", hashlib.sha256((x or "").encode()).hexdigest(), x or "") for c, t, s, x in rows if c == conv})
        for who in {s for _, _, s, _, _ in talk if s != "system"}:
            at, place, parts = 0, 0, {}
            for _, _, s, _, x in talk:
                name = re.sub(r"[\x00-\x20<|>]", "_", s)
                head = "<|im_start|>" + (name if s == "system" else "assistant" if s == who else "user name=" + name) + "\n"
                seg = head + x.replace("<|", "< |") + "<|im_end|>\n"
                p = parts.setdefault(place // part_chars, [at, 0, "", []])
                if s == who:
                    p[3].append((len(p[2]) + len(head), len(p[2]) + len(seg) - 1))
                p[1] += 1
                p[2] += seg
                at += len(seg)
                place += len(seg) + (len("user name=" + name) - len("assistant") if s == who else 0)
            out += [(conv, who, k, *p) for k, p in parts.items()]
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2])


@pytest.mark.parametrize("part_chars", [200, 1 << 16])
def test_renderings_match_by_hand(spark, part_chars):
    df = spark.createDataFrame(fixture(), SCHEMA).repartition(5).selectExpr("*", "1 AS conv", "2 AS range", "3 AS speaker", "4 AS key", "5 AS part", "6 AS place")
    got = [(r.conv_id, r.perspective, r.part, r.start, r.n_messages, r.text, [(m.start, m.end) for m in r["mask"]]) for r in perspectives.render(df, part_chars=part_chars).collect()]
    assert sorted(got, key=key) == sorted(by_hand(fixture(), part_chars), key=key)


def test_masks_cover_the_assistants_words_and_end_marks(spark):
    df = spark.createDataFrame([(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 2, "ann", "bye")], SCHEMA)
    r = perspectives.render(df).filter("perspective = 'ann'").first()
    assert r.text == "<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    assert [r.text[m.start:m.end] for m in r["mask"]] == ["hi<|im_end|>", "bye<|im_end|>"]


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [r for r in fixture() if r[0] is not None]
    folder = write_tables({"conversations": spark.createDataFrame(rows, SCHEMA)}, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    want = con.sql(queries.ORACLE_SQL["op1_perspective_chat"])
    got = queries.QUERIES["op1_perspective_chat"](spark, folder)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


def test_empty_table_and_no_python(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert perspectives.render(empty).count() == 0
    plan = perspectives.render(spark.createDataFrame(fixture(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
