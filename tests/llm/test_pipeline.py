import random
import re

import pytest

import corpus_pipeline
from tests.llm import test_bpe, test_phrase_index, test_secrets, test_simhash
from tests.llm.helpers import DOC_SCHEMA, empty_documents, prose, write_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    item = prose(rng, 25)
    texts = [None, "", "12 34", "..."]
    texts += [prose(rng, rng.randint(5, 200)) for _ in range(60)]
    texts += [texts[10], texts[10], texts[11] + "!", item, "before " + item + " after", " ".join(item.split()[:9])]
    texts += ["password = aB3dE6gH9jK2 " + prose(rng, 30), *["token=WidelyCopied77 " + prose(rng, 30 + i) for i in range(6)]]
    rows = [(i + 1, t, "xx", f"s{i % 5}", 0) for i, t in enumerate(texts)]
    rows += [(9, texts[8], "xx", "s3", 0), (None, prose(rng, 40), "xx", None, None)]
    folder = tmp_path_factory.mktemp("pipeline")
    write_tables({"documents": spark.createDataFrame(rows, DOC_SCHEMA), "benchmark": spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string")}, folder)
    return str(folder), rows, [(1, item), (2, None)]


def by_hand(rows, items):
    rows = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    prints = [(k, test_simhash.plain_fingerprint(r[1])) for k, r in enumerate(rows)]
    best = {}
    for k, _, group in test_simhash.groups_by_hand(prints):
        here = (rows[k][0] is None, rows[k][0] or 0, k)
        best[group] = min(here, best.get(group, here))
    rows = [rows[k] for _, _, k in sorted(best.values())]
    rows = [r for r in rows if not test_phrase_index.by_hand([r[:2]], items)[0][-1]]
    owners = {}
    for r in rows:
        for s in test_secrets.base_by_hand(r[1]):
            owners.setdefault(s[4], set()).add(r[3])
    out = []
    for doc, text, *_ in rows:
        for s in reversed(test_secrets.base_by_hand(text)):
            if len(owners[s[4]]) <= 2 and len(set(s[4])) >= 6:
                text = text[:s[5]] + "[SECRET]" + text[s[5] + len(s[4]):]
        ids, _ = test_bpe.by_library(text)
        out.append((doc or -1, len(ids), ids))
    return sorted(out)


def test_run_matches_the_stages_by_hand(spark, tables):
    folder, rows, items = tables
    got = sorted((r.doc_id or -1, r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == by_hand(rows, items)


def test_all_but_the_last_stage_return_the_columns_of_documents(spark, tables):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS


def test_empty_documents(spark, tmp_path):
    write_tables({"documents": empty_documents(spark), "benchmark": spark.createDataFrame([], "item_id bigint, text string")}, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
