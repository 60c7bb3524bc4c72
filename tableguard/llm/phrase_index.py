"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns documents into index segments, as search engines do: each row
is one segment with the postings of a bounded run of documents -- every distinct
term with the sorted positions where it stands.  Segments are independent, so the
index is as distributed as the documents and a lost executor costs its segments
only.  ``search`` sends the test phrases to every segment; there each phrase starts
from the postings of its rarest term and intersects the others' offset-adjusted
lists in order of rarity.

Terms are kept as XXH64 hashes of the word's bytes.  Words: after lower-casing A-Z,
maximal runs of digits, ASCII letters and non-ASCII characters.

The phrase table goes to the segments in blocks of at most ``BLOCK_TERMS`` terms,
so what is broadcast stays bounded however large the benchmark is; every block is
held against all segments.

Defined results
* Null and wordless texts have no postings; such documents are never hit, such
  items never occur.
* An item shorter than a window, but not empty, is one window.
* Repeated documents are hit alike; repeated items with one id are one item, and a
  null item id is the text ``null``.
* Empty tables give an empty index, or documents that are all clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableguard.llm.common import map_batches, shared_path, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEGMENT_TOKENS = 1 << 18
BLOCK_TERMS = 1 << 20
_PAIRS = 1 << 20

def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


class _Hashes(dict):
    """Hash of each word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 1 << 18:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


# ----------------------------------------------------------------------- index

def _segment(tokens: np.ndarray, starts: np.ndarray) -> tuple[bytes, ...]:
    """Postings of one segment: distinct terms, where each list begins, sorted positions."""
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else order
    return starts.astype("<i8").tobytes(), ordered[heads].astype("<u8").tobytes(), heads.astype("<i4").tobytes(), order.astype("<i4").tobytes()


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Write the index of ``docs`` as Parquet: one row per segment.

    A segment closes once it holds ``segment_tokens`` words; one longer document is
    a segment of its own.  ``ids`` holds the documents' ids in segment order.
    """
    kind = docs.schema[id_col].dataType
    arrow = pa.int64() if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) else pa.string()
    schema = pa.schema([("segment", pa.int64()), ("ids", pa.list_(arrow)), ("starts", pa.binary()), ("terms", pa.binary()),
                        ("heads", pa.binary()), ("positions", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo = _Hashes()
        segment = TaskContext.get().partitionId() << 32
        ids, tokens, starts, size = [], [], [0], 0

        def close():
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
            packed = _segment(flat, np.array(starts))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (segment, ids, *packed)))], schema)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = words_of(text.as_py())
                if ids and size + len(found) > segment_tokens:
                    yield close()
                    segment += 1
                    ids, tokens, starts, size = [], [], [0], 0
                ids.append(doc.as_py())
                tokens.append(memo.of(found))
                size += len(found)
                starts.append(size)
        if ids:
            yield close()

    to = "bigint" if arrow == pa.int64() else "string"
    rows = docs.select(F.col(id_col).cast(to), F.col(text_col).cast("string"))
    map_batches(rows, run, f"segment bigint, ids array<{to}>, starts binary, terms binary, heads binary, positions binary").write.parquet(path)


# ---------------------------------------------------------------------- phrases

class Phrases:
    """Phrases of hashed terms: ``terms[heads[i]:heads[i + 1]]`` is phrase i."""

    def __init__(self, phrases: list[np.ndarray], items: list[list]):
        self.heads = np.concatenate(([0], np.cumsum([len(p) for p in phrases]))).astype(np.int64)
        self.terms = np.concatenate(phrases) if phrases else np.empty(0, np.uint64)
        self.items = items


def windows(terms: np.ndarray, size: int) -> list[np.ndarray]:
    if not len(terms):
        return []
    return [terms[i:i + size] for i in range(max(1, len(terms) - size + 1))]


def phrase_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10,
                  block_terms: int = BLOCK_TERMS) -> Iterator[Phrases]:
    """The distinct windows of all items, in blocks of at most ``block_terms`` terms."""
    memo, seen, phrases, owners, total = _Hashes(), {}, [], [], 0
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").alias("t"))
    for row in rows.toLocalIterator():
        for window in windows(memo.of(words_of(row.t)), size):
            at = seen.setdefault(window.tobytes(), len(phrases))
            if at == len(phrases):
                phrases.append(window)
                owners.append(set())
                total += len(window)
            owners[at].add(row.i)
            if total >= block_terms:
                yield Phrases(phrases, [sorted(o) for o in owners])
                seen, phrases, owners, total = {}, [], [], 0
    if phrases:
        yield Phrases(phrases, [sorted(o) for o in owners])


# ----------------------------------------------------------------------- search

class Segment:
    """One index row, ready for look-ups."""

    def __init__(self, starts: bytes, terms: bytes, heads: bytes, positions: bytes):
        self.starts = np.frombuffer(starts, "<i8")
        self.terms = np.frombuffer(terms, "<u8")
        self.positions = np.frombuffer(positions, "<i4")
        self.heads = np.append(np.frombuffer(heads, "<i4").astype(np.int64), len(self.positions))

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each term's postings (length 0: the term is not here)."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        found = self.terms[at] == terms
        return self.heads[at], np.where(found, self.heads[at + 1] - self.heads[at], 0)


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner index, list index) of every element of the lists at ``first`` with ``count`` entries."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def _pieces(count: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of the lists with at most ``limit`` entries together (one list at least)."""
    total, start = np.cumsum(count), 0
    while start < len(count):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield slice(start, stop)
        start = stop


def exact_matches(seg: Segment, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start position) of every occurrence of every phrase in the segment."""
    head, size = seg.lists(phrases.terms)
    length = np.diff(phrases.heads)
    if not len(length):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole = np.flatnonzero(np.minimum.reduceat(size, phrases.heads[:-1]) > 0)
    if not len(whole):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # a posting as (term's list, position): one sorted array of all lists
    keys = np.repeat(np.arange(len(seg.terms)), np.diff(seg.heads)) * (int(seg.starts[-1]) + 1) + seg.positions
    step = int(seg.starts[-1]) + 1
    owner, at = _expand(phrases.heads[whole], length[whole])
    rank = np.lexsort((size[at], owner))
    term_at, offset = at[rank], at[rank] - phrases.heads[whole][owner[rank]]
    first = np.cumsum(length[whole]) - length[whole]
    rarest = term_at[first]
    out_p, out_s = [], []
    for part in _pieces(size[rarest], _PAIRS):
        row, post = _expand(head[rarest[part]], size[rarest[part]])
        row = row + part.start
        start = seg.positions[post].astype(np.int64) - offset[first[row]]
        keep = start >= 0
        row, start = row[keep], start[keep]
        for k in range(1, int(length[whole].max())):
            more = length[whole][row] > k
            which = first[row] + np.where(more, k, 0)
            term = np.searchsorted(seg.terms, phrases.terms[term_at[which]])
            key = term * step + start + offset[which]
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            keep = ~more | ((keys[spot] == key) & (start + offset[which] < step - 1))
            row, start = row[keep], start[keep]
            if not len(row):
                break
        doc = np.searchsorted(seg.starts, start, side="right") - 1
        keep = start + length[whole][row] <= seg.starts[np.minimum(doc + 1, len(seg.starts) - 1)]
        out_p.append(whole[row[keep]])
        out_s.append(start[keep])
    return np.concatenate(out_p), np.concatenate(out_s)


def proximity_matches(seg: Segment, phrases: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position of its rarest term) where every term of the phrase stands, in any
    order, at most ``len(phrase) - 1 + slop`` words from that position in the same document."""
    out_p, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for p in range(len(phrases.heads) - 1):
        terms = np.unique(phrases.terms[phrases.heads[p]:phrases.heads[p + 1]])
        head, size = seg.lists(terms)
        if not size.min():
            continue
        order = np.argsort(size, kind="stable")
        reach = int(phrases.heads[p + 1] - phrases.heads[p]) - 1 + slop
        at = seg.positions[head[order[0]]:head[order[0]] + size[order[0]]].astype(np.int64)
        doc = np.searchsorted(seg.starts, at, side="right") - 1
        low, high = np.maximum(at - reach, seg.starts[doc]), np.minimum(at + reach, seg.starts[doc + 1] - 1)
        for t in order[1:]:
            posts = seg.positions[head[t]:head[t] + size[t]]
            spot = np.searchsorted(posts, low)
            keep = (spot < len(posts)) & (posts[np.minimum(spot, len(posts) - 1)] <= high)
            at, low, high = at[keep], low[keep], high[keep]
        out_p.append(np.full(len(at), p))
        out_s.append(at)
    return np.concatenate(out_p), np.concatenate(out_s)


def _document_hits(seg: Segment, phrases: Phrases, phrase: np.ndarray, start: np.ndarray):
    """Per hit document of the segment: (ordinal, merged spans, item ids)."""
    if not len(phrase):
        return
    length = np.diff(phrases.heads)
    doc = np.searchsorted(seg.starts, start, side="right") - 1
    order = np.lexsort((start, doc))
    phrase, start, doc = phrase[order], start[order], doc[order]
    for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]))):
        d = int(doc[lo])
        a, b = start[lo:hi] - seg.starts[d], start[lo:hi] + length[phrase[lo:hi]] - seg.starts[d]
        reach = np.maximum.accumulate(b)
        cut = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
        spans = zip(a[cut].tolist(), reach[np.r_[cut[1:] - 1, len(a) - 1]].tolist())
        yield d, [{"start": x, "end": y} for x, y in spans], sorted({i for p in np.unique(phrase[lo:hi]) for i in phrases.items[p]})


def search(spark: SparkSession, index_path: str, items: DataFrame, id_col: str = "item_id", text_col: str = "text",
           size: int = 10, slop: int | None = None, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """One row per indexed document: segment, ordinal, doc_id, n_words, spans, items.

    ``spans`` are the merged word ranges [start, end) hit by a window; ``items`` the ids
    (as text, sorted) of the items with a window there.  With ``slop`` the windows
    match by proximity instead, and spans are the rarest term's positions.
    """
    index = spark.read.parquet(index_path)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    shape = f"segment bigint, ordinal int, doc_id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    schema = pa.schema([("segment", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.int64() if kind == "bigint" else pa.string()),
                        ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def against(sent, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    seg = Segment(row["starts"], row["terms"], row["heads"], row["positions"])
                    if slop is None:
                        found = exact_matches(seg, phrases)
                    else:
                        found = proximity_matches(seg, phrases, slop)
                    hits = {d: (s, i) for d, s, i in _document_hits(seg, phrases, *found)}
                    shown = range(len(row["ids"])) if first else sorted(hits)
                    rows = [(row["segment"], d, row["ids"][d], int(seg.starts[d + 1] - seg.starts[d]), *hits.get(d, ([], []))) for d in shown]
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
        return run

    columns = index.select("segment", "ids", "starts", "terms", "heads", "positions")
    parts = []
    for phrases in phrase_blocks(items, id_col, text_col, size, block_terms):
        parts.append(map_batches(columns, against(spark.sparkContext.broadcast(phrases), not parts), shape))
    if not parts:
        parts = [map_batches(columns, against(spark.sparkContext.broadcast(Phrases([], [])), True), shape)]
    found = parts[0]
    if len(parts) == 1:
        return found
    for part in parts[1:]:
        found = found.unionByName(part)
    # several blocks: a document's hits meet again by its place in the index
    merged = found.groupBy("segment", "ordinal", "doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.withColumn("spans", F.expr(_MERGED))


# sorted spans joined where they overlap or touch
_MERGED = """aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (done, x) ->
    CASE WHEN size(done) > 0 AND x.start <= done[size(done) - 1].end
         THEN concat(slice(done, 1, size(done) - 1),
                     array(named_struct('start', done[size(done) - 1].start, 'end', greatest(done[size(done) - 1].end, x.end))))
         ELSE concat(done, array(x)) END)"""


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted texts), spans."""
    path = shared_path(spark, "phrase-index")
    write_index(docs, path, id_col, text_col)
    found = search(spark, path, items, size=size)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("doc_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def keep_clean(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a window of an item.

    A row goes if its id and text are those of a hit row, so a clean row that shares
    a hit row's id stays.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.to_json(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")))
    hit = decontaminate(spark, docs.select(key.alias("key"), F.col(text_col).alias("text")), items, size, "key", "text")
    hit = hit.filter("n_hit > 0").select(F.from_json("key", f"i {kind}, h bigint").alias("k")).select("k.*").distinct()
    hit = written(hit, "phrase-hits", rows=docs.count())
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    return rows.join(hit, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left_anti").select("row.*")
