import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tableguard.llm import language, queries
from tests.llm.helpers import documents, empty_documents, prose, write_tables

STEMS = {"aa": "ta re mi no lu ka".split(), "bb": "sch ung keit ver ß ö".split(), "cc": "qué llo ción ñ os ar".split(), "dd": "яв ст но пр ки ло".split()}


def corpus(spark, n=240, seed=1):
    rng = random.Random(seed)
    langs = sorted(STEMS)
    texts = [prose(rng, rng.randint(3, 80), STEMS[langs[i % 4]]) for i in range(n)]
    return documents(spark, texts, langs=langs)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 6, 7, 12, 40])
def test_codewords_differ_and_no_column_is_constant(n):
    code = language.codewords(n)
    assert code.shape[0] == n
    if n > 1:
        assert all(abs(int(c.sum())) < n for c in code.T)
        assert len({tuple(c) for c in code.T}) == code.shape[1]
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert least >= (1 if n == 2 else 2) and (n < 7 or least >= code.shape[1] // 5)


def test_codes_correct_single_wrong_bits():
    code = language.codewords(4)
    model = language.Model(list("abcd"), code, np.zeros((language.BUCKETS, 7), np.float32), np.ones(7), np.full((4, 7), 1 / 7))
    for i in range(4):
        for wrong in range(7):
            margins = code[i].astype(float).copy()
            margins[wrong] *= -1
            assert model.decode(margins)[0] == "abcd"[i]
    assert model.decode(np.zeros(7))[1] == 0.0


def test_margins_equal_summing_every_gram():
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b"], language.codewords(2), rng.normal(size=(language.BUCKETS, 1)).astype(np.float32), np.ones(1), np.ones((2, 1)))
    text = "Ab, ç\U00010400 9 xyz" * 10
    codes = language._codes(text)
    all_b = np.concatenate([language._buckets(codes, o) for o in language.ORDERS])
    assert np.allclose(model.margins(codes), model.weights[all_b].astype(np.float64).mean(axis=0))
    whole = language._SLICE
    language._SLICE = 7
    try:
        assert np.allclose(model.margins(codes), model.weights[all_b].astype(np.float64).mean(axis=0))
    finally:
        language._SLICE = whole


def test_held_out_rows_are_recognised(spark, tmp_path):
    df = corpus(spark)
    got = queries.QUERIES["op6_ecoc_language"](spark, write_tables({"documents": df}, tmp_path)).collect()
    truth = {r.doc_id: r.lang for r in df.collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == 240 and 30 < len(held) < 100
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.ambiguous == (r.score < language.AMBIGUOUS) for r in got)


def test_nulls_letterless_texts_repeats_and_other_columns(spark):
    df = corpus(spark)
    model = language.train(df)
    odd = documents(spark, [None, "", "12 :-) 34", "ta re mi", "ta re mi", "x" * 300_000, "中文", (None, "schung keit")]).selectExpr(
        "*", "1 AS row", "'zz' AS lang_pred", "2 AS score")
    rows = language.identify(odd, model).collect()
    by_text = {r.row.text: r for r in rows}
    assert len(rows) == 8 and rows[0].row.asDict().keys() == set(odd.columns)
    assert [by_text[t].lang_pred for t in (None, "", "12 :-) 34")] == ["und"] * 3
    assert by_text["ta re mi"].lang_pred == "aa" and by_text["schung keit"].lang_pred == "bb"
    assert by_text["中文"].lang_pred in STEMS and by_text["中文"].ambiguous


def test_few_or_no_languages(spark):
    none = language.train(empty_documents(spark))
    assert {r.lang_pred for r in language.identify(documents(spark, ["some text", None]), none).collect()} == {"und"}
    one = language.train(documents(spark, ["some text", None], langs=["en"]))
    assert {(r.lang_pred, r.score) for r in language.identify(documents(spark, ["other", "5"]), one).collect()} == {("en", 1.0), ("und", 0.0)}
    nulls = language.train(documents(spark, ["some text"], langs=[None]))
    assert nulls.languages == []
    assert language.identify(empty_documents(spark), one).count() == 0


def test_sample_is_bounded_per_language(spark):
    df = corpus(spark, 400)
    counts = {r.lang: r["count"] for r in language.training_sample(df, "lang", "text", 20).groupBy("lang").count().collect()}
    assert counts.keys() == STEMS.keys() and all(3 <= c <= 50 for c in counts.values())


def test_unlearned_scripts_and_random_letters_have_no_evidence(spark):
    rng = random.Random(4)
    clean = [prose(rng, rng.choice([1, 2, 5, 40, 400]), STEMS[lang]) for lang in STEMS for _ in range(25)]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (30, 100, 5000)] + ["中文文本", "中文 文本 " * 500, "ελληνικά κείμενα", "עברית"]
    model = language.train(corpus(spark, 800))
    got = {r.row.text: r for r in language.identify(documents(spark, clean + junk + ["12 34", None]), model).select("row", "evidence", language.rejected(F.col("evidence")).alias("gone")).collect()}
    assert [t for t in clean if got[t].gone] == []
    assert [t for t in junk if not got[t].gone] == []
    assert got["12 34"].gone and got[None].gone and got[None].evidence is None
    # with a single learned text nothing is known of what others look like
    one = language.train(documents(spark, ["some text"], langs=["en"]))
    assert not language.identify(documents(spark, ["other"]), one).select(language.rejected(F.col("evidence"))).first()[0]


def test_stage_drops_texts_in_no_learned_language(spark):
    rng = random.Random(5)
    stage = corpus_pipeline.STAGES[0][1]
    odd = documents(spark, ["中文 文本 没有", "xq zvkwj qqpfh wzx jvkqz hgfwq bvxc", "ta re mi"], first_id=9001, langs=[None])
    kept = {r.doc_id for r in stage(spark, corpus(spark, 800).union(odd), "").collect()}
    assert kept == {*range(1, 801), 9003}


def test_copies_are_sampled_one_by_one_and_no_language_is_left_out(spark, tmp_path, monkeypatch):
    df = documents(spark, ["ta re mi"] * 2000 + ["sch ung keit"] * 2000, langs=["aa"] * 2000 + ["bb"] * 2000)
    counts = {r.lang: r["count"] for r in language.training_sample(df, "lang", "text", 100).groupBy("lang").count().collect()}
    assert counts.keys() == {"aa", "bb"} and all(50 <= c <= 200 for c in counts.values())
    fewest = {r.lang: r["count"] for r in language.training_sample(df, "lang", "text", 0).groupBy("lang").count().collect()}
    assert fewest.keys() == {"aa", "bb"} and all(1 <= c <= 3 for c in fewest.values())
    # the query and the stage give the id along
    given, train = [], language.train
    monkeypatch.setattr(language, "train", lambda rows, *a, **b: given.append(rows.columns) or train(rows, *a, **b))
    queries.QUERIES["op6_ecoc_language"](spark, write_tables({"documents": df}, tmp_path))
    corpus_pipeline.STAGES[0][1](spark, df, "")
    assert len(given) == 2 and all("doc_id" in columns for columns in given)


def test_stage_keeps_texts_when_no_language_is_learned(spark):
    df = documents(spark, ["some text", "中文", "12 34", None, "", "x"], langs=[None])
    assert sorted(r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, df, "").collect()) == [1, 2, 6]
