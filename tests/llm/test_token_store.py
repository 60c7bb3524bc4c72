import glob
import random
import struct
import zlib

import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tableguard.llm import queries, token_store
from tests.llm.helpers import documents, empty_documents, prose, write_tables

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def by_library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def by_hand(rows):
    """{id: (start, n_tokens, crc)} for (id, text) rows in ascending order."""
    out, start = {}, 0
    for i, text in rows:
        ids = [*by_library(text), 1]
        out[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out


def texts():
    rng = random.Random(5)
    return [prose(rng, 300), None, "", " \t\n\x0b\x0c\r ", "it's\x1cthe\x85end\xa0of　all", prose(rng, 20_000), "x" * 50_000,
            "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "é ́e  İI", "same", "same", "日本語 テキスト 12345 !!??", prose(rng, 3)]


def test_query_equals_the_library(spark, tmp_path):
    docs = documents(spark, [(i * 7 % 13, t) for i, t in enumerate(texts())]).withColumn("ids", F.lit(1)).withColumn("part", F.lit("x"))
    rows = queries.op12_token_store(spark, write_tables({"documents": docs}, tmp_path)).collect()
    expected = by_hand(sorted((i * 7 % 13, t) for i, t in enumerate(texts())))
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == expected and len(rows) == len(texts())


def test_pieces_of_any_batch_equal_the_library():
    import pyarrow as pa

    with open(PATH, encoding="utf-8") as file:
        data = file.read()
    encoder = token_store.PieceEncoder(data, memo_pieces=3)
    rng = random.Random(8)
    alphabet = "AEHhK\u212aİ\u0331\u0301abeinorst'SIΣσ.,;:!?-7ÀÿŸ\t\n\x85\x1c<|>0é̈ßſ"
    for _ in range(40):
        some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 9))]
        ids, n = encoder.encode(pa.array([None, *some, "skipped"], pa.string()).slice(1, len(some)))
        assert ids.tolist() == [i for t in some for i in by_library(t)] and n.tolist() == [len(by_library(t)) for t in some]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s")
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randint(0, 40))) for k in range(3000)]
    token_store.write_store(documents(spark, rows).repartition(5), path, PATH, row_group_bytes=1 << 14, page_rows=50, files=4)
    return path, rows


def test_files_have_the_layout(store):
    path, rows = store
    first = 0
    for name in sorted(glob.glob(f"{path}/data/*.parquet")):
        file = pq.ParquetFile(name)
        ids = file.read(columns=["id"]).column("id").to_pylist()
        assert ids == list(range(first, first + len(ids)))
        first += len(ids)
        by_name = {file.metadata.row_group(0).column(k).path_in_schema: file.metadata.row_group(0).column(k) for k in range(file.metadata.num_columns)}
        assert "RLE_DICTIONARY" in by_name["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in by_name["id"].encodings
        assert all(c.has_column_index and c.has_offset_index for c in by_name.values())
        assert file.metadata.num_row_groups > 1
    assert first == len(rows)


def test_delta_encoding(spark, tmp_path):
    token_store.write_store(documents(spark, ["a b c", "d e"]), str(tmp_path / "s"), PATH, end_id=None, encoding="delta")
    file = pq.ParquetFile(glob.glob(f"{tmp_path}/s/data/*.parquet")[0])
    columns = [file.metadata.row_group(0).column(k) for k in range(file.metadata.num_columns)]
    assert "DELTA_BINARY_PACKED" in next(c for c in columns if c.path_in_schema == "ids.list.element").encodings
    got = {r.id: r.ids for r in token_store.read_tokens(spark, str(tmp_path / "s")).collect()}
    assert got == {1: by_library("a b c"), 2: by_library("d e")}
    with pytest.raises(ValueError):
        token_store.write_store(documents(spark, ["a"]), str(tmp_path / "t"), PATH, encoding="plain")


def test_selective_reads(spark, store):
    path, rows = store
    corpus = [i for _, t in rows for i in [*by_library(t), 1]]
    meta = token_store.read_metadata(spark, path)
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    places = {r.id: (r.start, r.n_tokens) for r in meta.collect()}
    at = 0
    for k, text in rows:
        assert places[k] == (at, len(by_library(text)) + 1)
        at += places[k][1]
    for start, stop in [(0, 10), (17, 18), (len(corpus) // 3, len(corpus) // 3 + 2500), (len(corpus) - 5, len(corpus) + 50), (5, 5), (0, len(corpus))]:
        found = sorted((r.start, r.ids) for r in token_store.read_span(spark, path, start, stop).collect())
        assert [i for _, ids in found for i in ids] == corpus[start:stop]
        assert not found or found[0][0] == start
    one = token_store.read_tokens(spark, path).filter("id = 1234")
    assert one.first().ids == [*by_library(rows[1234][1]), 1]
    assert "EqualTo(id,1234)" in one._jdf.queryExecution().executedPlan().toString()


def test_null_and_repeated_ids_and_strings(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b"), ("k", "a a"), (None, None), ("k", "a a"), ("a", "c")], "name string, body string")
    path = str(tmp_path / "s")
    token_store.write_store(docs, path, PATH, id_col="name", text_col="body")
    rows = sorted(token_store.with_checksums(token_store.read_tokens(spark, path)).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == [None, None, "a", "k", "k"]
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(5)]
    assert sorted(r.n_tokens for r in rows) == [1, 2, 2, 3, 3]


def test_empty_table(spark, tmp_path):
    got = queries.op12_token_store(spark, write_tables({"documents": empty_documents(spark)}, tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0
    token_store.write_store(empty_documents(spark), str(tmp_path / "s"), PATH)
    assert token_store.read_span(spark, str(tmp_path / "s"), 0, 10).count() == 0


def test_other_kinds_of_tokenizers_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        token_store.PieceEncoder(file.read())
