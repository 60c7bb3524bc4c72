"""Token ids in Parquet files: list columns, controlled row groups and page indexes.

A store is a folder with

* ``data``: one row per document in ascending id order, ``part`` (the file's number),
  ``first`` (tokens before it in its file), ``n_tokens`` and the list ``ids``.  The
  list is dictionary encoded (a vocabulary fits one dictionary page) or, with
  ``encoding="delta"``, delta encoded; ids, places and counts are delta encoded.
  Row groups end at ``row_group_bytes`` and pages at ``page_rows`` rows, and every
  column has a page index, so a filter on ids or places reads few pages.
* ``parts``: one row per file with its range of ids, its size and ``base``, the tokens
  before the file.  ``start = base + first`` is a document's place in the whole corpus.

Metadata reads (:func:`read_metadata`) never touch the list column.

Writing: documents are range-partitioned and sorted by id, encoded where they lie and
written by Spark's own Parquet writer, whose commit protocol survives lost executors.
Nothing is numbered on the driver; ``parts`` comes from the written metadata columns.

Encoding uses the ``tokenizers`` library.  White space separates words in every
vocabulary taken here, so a text's ids are those of its ASCII-blank-separated pieces
in order (and, under the usual word pattern, also a letter and a full stop or comma
behind it are never one word).  A batch's distinct pieces are found with Arrow; each
piece that a worker has not met goes through the library once, pieces of letters alone
many to a call.  The memory holds about ``MEMO_PIECES`` pieces and is emptied when
full, so results never depend on it.

Defined results
* A null text is empty: it has the end id alone.  A null document id sorts first.
* Order of equal ids: by the text's hash; repeated rows are all kept.
* Very long texts are one row each (a list cell); batches are cut by bytes.
* An empty table gives a store without rows, which all readers accept.
* Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableguard.llm.common import batches_by_bytes
from tableguard.plans.joins import checked_broadcast

MEMO_PIECES = 500_000
MEMO_LENGTH = 64
BATCH_BYTES = 8 << 20
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 2_000
DICTIONARY_BYTES = 4 << 20
ENCODINGS = ("dictionary", "delta")
TOGETHER = 5_000
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
STOPS = ".,;:!?"
SIMPLE = re.compile(f"[{LETTERS}]+")
# fixed value: the word pattern under which letters, digits and stops are never one word
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class PieceEncoder:
    """Ids of whole Arrow string arrays, by the library, piece by piece.

    What was encoded lies in one flat array; a piece has a slot with its place and size.
    """

    def __init__(self, data: str, memo_pieces: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        spec = json.loads(data)
        self.plain = cut_rules(spec)
        # lower case can go before the other steps where no mark may join a letter and no added token is near
        steps = spec.get("normalizer") or {}
        self.lower = [s["type"] for s in steps.get("normalizers", [steps] if steps else [])] == ["NFC", "Replace", "Lowercase"]
        self.keep_case = "(?i)" + "|".join(["[\u0300-\u036F]", *(re.escape(t["content"]) for t in spec.get("added_tokens") or [])])
        self.library = Tokenizer.from_str(data)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo_pieces = memo_pieces
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        if suffix:
            self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.begin, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text); a null text has none."""
        texts = pc.fill_null(texts, "")
        if self.lower:
            texts = pc.if_else(pc.match_substring_regex(texts, self.keep_case), texts, pc.ascii_lower(texts))
        if self.plain:
            texts = pc.replace_substring_regex(texts, f"([{LETTERS}0-9])([{STOPS}])", r"\1 \2")
        pieces = pc.ascii_split_whitespace(texts)
        first, last = pieces.offsets[0].as_py(), pieces.offsets[-1].as_py()
        words = pieces.values.slice(first, last - first).dictionary_encode()
        distinct, place = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
        if len(self.memo) > self.memo_pieces:
            self._forget()
        self._learn([w for w in distinct if w not in self.memo])
        slot = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))[place]
        n = self.size[slot]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[slot] - (ends - n), n) + np.arange(total)]
        for word in [w for w in distinct if len(w) > MEMO_LENGTH]:
            del self.memo[word]
        return ids, np.diff(np.concatenate(([0], ends))[pieces.offsets.to_numpy() - first])

    def _learn(self, fresh: list[str]) -> None:
        """Encode pieces: those of letters alone many at a time (each ends with an end-of-word token), others one by one."""
        simple = [w for w in fresh if SIMPLE.fullmatch(w)] if self.plain and self.ends.any() else []
        found: list[tuple[list[str], np.ndarray, np.ndarray]] = []
        for at in range(0, len(simple), TOGETHER):
            some = simple[at:at + TOGETHER]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and len(ids) == stops[-1]:
                found.append((some, ids, np.diff(stops, prepend=0)))
        done = {w for some, _, _ in found for w in some}
        rest = [w for w in fresh if w not in done]
        for at in range(0, len(rest), TOGETHER):
            some = rest[at:at + TOGETHER]
            lists = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
            found.append((some, np.array([i for ids in lists for i in ids], np.int32), np.array([len(ids) for ids in lists], np.int64)))
        if not found:
            return
        slots = len(self.begin)
        for some, _, _ in found:
            self.memo.update(zip(some, range(slots, slots + len(some))))
            slots += len(some)
        sizes = np.concatenate([n for _, _, n in found])
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.flat = np.concatenate([self.flat, *[ids for _, ids, _ in found]])


def cut_rules(spec: dict) -> bool:
    """May texts also be cut where a letter or digit meets a stop?  Raises if not even at ASCII blanks.

    At blanks: white space is dropped by the splitting step, and no added token holds
    white space or takes some of it.  At stops: the splitting step is ``WORDS``, and no
    added token holds a stop or consists of letters alone.
    """
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    removing = [s for s in steps if s.get("type") == "Split" and s.get("behavior") == "Removed"]
    added = spec.get("added_tokens") or []
    odd = [t for t in added if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"])]
    if odd or not (removing or any(s.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") for s in steps)):
        raise ValueError("the tokenizer's words do not end at blanks")
    known = any((s.get("pattern") or {}).get("Regex") == WORDS and s.get("invert") for s in removing)
    return known and not any(set(t["content"]) & set(STOPS) or SIMPLE.fullmatch(t["content"]) for t in added)


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(data: str) -> PieceEncoder:
    """One encoder per tokenizer file and Python worker."""
    key = hashlib.sha256(data.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(data)
    return _ENCODERS[key]


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text",
                encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS,
                files: int | None = None) -> None:
    """Write ``docs`` as a token store; ``end_id`` is appended to each document (None: nothing).

    ``files``: number of files; by default that of the shuffle's partitions, which AQE
    joins up to its advisory size.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())
    ending = np.array([] if end_id is None else [end_id], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, first = _encoder(sent.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in batches_by_bytes(batch, "text", BATCH_BYTES):
                ids, n = encoder.encode(rows.column("text"))
                stop = np.cumsum(n)
                ids = np.insert(ids, np.repeat(stop, len(ending)), np.tile(ending, len(n)))
                n = n + len(ending)
                upto = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), pa.array(np.full(len(n), part, np.int32)), pa.array(first + upto[:-1]), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))], ["id", "part", "first", "n_tokens", "ids"])
                first += int(upto[-1])

    order = ["id", "hash"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumn("hash", F.xxhash64("text"))
    laid = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    tokens = (laid.sortWithinPartitions(*order).select("id", "text")
              .mapInArrow(run, f"id {kind}, part int, first bigint, n_tokens bigint, ids array<int>"))
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows, "parquet.dictionary.page.size": DICTIONARY_BYTES,
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
    }
    tokens.write.options(**options).parquet(f"{path}/data")
    meta = spark.read.parquet(f"{path}/data").groupBy("part").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    # one row per file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    meta.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).write.parquet(f"{path}/parts")


def _placed(spark: SparkSession, path: str, columns: list[str], parts: DataFrame | None = None) -> DataFrame:
    parts = spark.read.parquet(f"{path}/parts") if parts is None else parts
    data = spark.read.parquet(f"{path}/data")
    bases = checked_broadcast(parts.select(F.col("part").alias("_part"), "base"))
    return data.join(bases, F.col("part") == F.col("_part")).select(
        "id", (F.col("base") + F.col("first")).alias("start"), *columns)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens) of every document; the ids are not read."""
    return _placed(spark, path, ["n_tokens"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document.  A filter on ``id`` reads matching pages alone."""
    return _placed(spark, path, ["n_tokens", "ids"])


def read_span(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The corpus's tokens from ``start`` up to ``stop``: (id, start, ids), a row per document touched.

    Files outside the span are dropped by ``parts``, pages inside a file by the places' page index.
    """
    parts = spark.read.parquet(f"{path}/parts").filter((F.col("base") < stop) & (F.col("base") + F.col("n_tokens") > start))
    near = parts.agg(F.min("part"), F.max("part"), F.min("base"), F.max("base")).first()
    rows = _placed(spark, path, ["n_tokens", "ids", "part", "first"], parts)
    if near[0] is not None:
        rows = rows.filter(F.col("part").between(near[0], near[1]) & (F.col("first") < stop - near[2]))
    rows = rows.filter((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    keep = F.least(F.lit(stop) - F.col("start"), F.col("n_tokens")) - skip
    return rows.select("id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), keep.cast("int")).alias("ids"))


def with_checksums(tokens: DataFrame, out_col: str = "ids_crc32") -> DataFrame:
    """``(id, start, n_tokens)`` of read tokens with the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            cuts = ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"), pa.array(np.diff(cuts).astype(np.int64)),
                                              pa.array(sums, pa.int64())], ["id", "start", "n_tokens", out_col])

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "start", "ids").mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, {out_col} bigint")
