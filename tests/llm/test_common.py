import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tableguard.llm.common as common
from tableguard.llm import phrase_index, secrets, simhash
from tests.llm.helpers import documents


@pytest.fixture
def many_partitions(spark):
    """64 shuffle partitions that stay as they are."""
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_batches_of_wide_rows_are_small(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    rows = spark.range(300).coalesce(1).select(F.expr("repeat('x', 100000)").alias("text"))
    got = common.map_batches(rows, run, "n bigint, size bigint").collect()
    assert sum(r.n for r in got) == 300
    assert max(r.size for r in got) <= common.BATCH_BYTES + 200_000


def test_a_longer_row_is_a_batch_of_its_own(spark):
    rows = spark.range(3).coalesce(1).select(F.expr(f"repeat('x', {2 * common.BATCH_BYTES})").alias("text"))
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    assert [r.n for r in common.map_batches(rows, run, "n bigint").collect()] == [1, 1, 1]


def test_written_of_no_rows(spark):
    assert common.written(spark.range(0).groupBy("id").count(), "nothing", rows=0).count() == 0


def test_short_tables_get_few_files(spark, many_partitions, monkeypatch):
    files = {}

    def written(df, name, *args, **kwargs):
        out = common.written(df, name, *args, **kwargs)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    for module in (simhash, phrase_index, secrets):
        monkeypatch.setattr(module, "written", written)
    texts = [f"token=aB3dE6gH9jK{i:03} " + " ".join(f"w{i * k}" for k in range(20)) for i in range(300)]
    docs = documents(spark, texts)
    items = spark.createDataFrame([(1, " ".join(texts[7].split()[1:]))], "item_id bigint, text string")
    assert simhash.keep_one(docs).count() <= 300
    assert phrase_index.keep_clean(spark, docs, items).count() == 299
    assert secrets.redact(docs).filter("text LIKE '[SECRET]%' OR text LIKE 'token=[SECRET]%'").count() == 300
    for name in ("simhash-distinct", "simhash-loads", "phrase-hits", "secret-classes", "secret-live"):
        assert files[name] == 1, (name, files)
