"""SimHash near-duplicate groups by pivot distance tables.

A text's fingerprint is the 64-bit majority vote of the XXH64 hashes of its word
shingles.  Two documents are linked when their fingerprints differ in at most
``max_bits`` bits; a group is a connected component of links.

How pairs are found
* Equal fingerprints collapse first (a partial aggregate), so copies cost nothing.
* The pivot table holds each distinct fingerprint's Hamming distances to
  ``PIVOTS`` fixed reference fingerprints, a byte per pivot, eight to a long.
* Candidates meet on blocks: the 64 bits are cut into m + ``max_bits`` blocks, so a
  linked pair agrees on at least m whole blocks.  Each choice of m blocks is one
  join key.  m grows with the number of fingerprints so that keys stay selective.
  A pair is looked at under the first key it shares, and under no other.
* Of the candidates, a pair whose distances to some pivot differ by more than
  ``max_bits`` is discarded (triangle inequality); the survivors' own distance is
  verified.
* Keys with more than ``BUCKET`` fingerprints are hashed into chunks; one task per
  chunk pair joins the two chunks with the same table, filter and check and returns
  a spanning forest of their links.  So no bucket is capped, and no task holds more
  than two chunks.

Components are found by rounds of large-star and small-star steps over the links
(Kiveris et al., 2014), each round written to the shared folder.

Defined results
* Null and blank texts have fingerprint zero and link to each other.
* Fewer words than a shingle: the whole word sequence is the one shingle.
* Rows with a null id keep their fingerprint; ``component_id`` is the smallest
  non-null id of the group (null if there is none).
* Repeated rows come back as often as they are given; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableguard.llm.common import map_batches, written

PIVOTS = 32
BUCKET = 512
_SLICE = 1 << 15
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_RUN = re.compile(rb" {2,}")


def reference_fingerprints(n: int = PIVOTS) -> list[int]:
    """Fixed pseudo-random 64-bit pivots: XXH64 of their ordinal."""
    return [xxhash.xxh64_intdigest(str(i).encode(), 0) for i in range(n)]


# ---------------------------------------------------------------- fingerprints

def simhash(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Fingerprint of one text as an unsigned integer."""
    joined = (text or "").encode("utf-8", "replace").lower().translate(_SPACES).strip(b" ")
    if not joined:
        return 0
    if b"  " in joined:
        joined = _RUN.sub(b" ", joined)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    width = min(width, len(starts))
    n, votes, digest = len(starts) - width + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        stop = min(n, at + _SLICE)
        spans = zip(starts[at:stop].tolist(), ends[at + width - 1:stop + width - 1].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                 seed: int = 42) -> DataFrame:
    """(id, text_hash, fp) for every row; ``fp`` is the fingerprint as a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), width, seed) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], ["_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return map_batches(rows, run, f"_id {kind}, text_hash bigint, fp bigint").withColumnRenamed("_id", id_col)


# ----------------------------------------------------------------- pivot table

def pivot_table(fps: DataFrame, fp_col: str = "fp") -> DataFrame:
    """Add the table's packed columns ``d0, d1, ...``: eight one-byte distances each."""
    def pack(group: list[int]) -> Column:
        packed = F.lit(0).cast("long")
        for k, pivot in enumerate(group):
            signed = pivot - (1 << 64) if pivot >> 63 else pivot
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(F.col(fp_col).bitwiseXOR(F.lit(signed))).cast("long"), 8 * k))
        return packed

    pivots = reference_fingerprints()
    return fps.withColumns({f"d{i}": pack(pivots[8 * i:8 * i + 8]) for i in range(PIVOTS // 8)})


def _near_on_table(max_bits: int) -> str:
    """SQL: no coordinate of the two table rows ``a`` and ``b`` differs by more than ``max_bits``."""
    def byte(side: str, i: int) -> str:
        return f"((shiftright({side}.d{i // 8}, {8 * (i % 8)})) & 255)"

    return " AND ".join(f"abs({byte('a', i)} - {byte('b', i)}) <= {max_bits}" for i in range(PIVOTS))


def block_masks(n_fps: int, max_bits: int = 4, load: int = 4) -> list[tuple[int, list[int]]]:
    """Join keys as (mask, the blocks before it that must differ).

    The smallest m whose keys of m blocks out of m + ``max_bits`` hold about
    ``load`` random fingerprints each at this table size.
    """
    for m in range(1, 9):
        blocks = m + max_bits
        if n_fps <= load * 2 ** (64 * m / blocks):
            break
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(cuts)]
    return [(sum(bits[i] for i in pick), [bits[i] for i in range(pick[-1]) if i not in pick])
            for pick in itertools.combinations(range(blocks), m)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, max_bits: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between the distinct fingerprints of ``fps`` (column ``fp``).

    Every component of the full link graph is a component of the returned links:
    in buckets up to ``bucket`` all links come back, in larger ones a spanning set.
    """
    n_fps = fps.count()
    masks = block_masks(n_fps, max_bits)
    keyed = fps.select("fp", F.posexplode(F.array(*[
        F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, (m, _) in enumerate(masks)
    ])).alias("k", "key"))
    loads = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-loads", rows=n_fps * len(masks))
    cold = pivot_table(keyed.join(loads.filter(F.col("n") <= bucket).select("key"), "key", "left_semi"))
    first = "CASE a.k " + " ".join(
        f"WHEN {k} THEN " + (" AND ".join(f"((a.fp ^ b.fp) & {_signed(b)}L) <> 0" for b in before) or "true")
        for k, (_, before) in enumerate(masks)) + " END"
    pairs = cold.alias("a").join(cold.alias("b"), F.expr(
        f"a.key = b.key AND a.k = b.k AND a.fp < b.fp AND {first} AND {_near_on_table(max_bits)}"
        f" AND bit_count(a.fp ^ b.fp) <= {max_bits}"))
    links = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    return links.unionByName(_hot_links(keyed, loads.filter(F.col("n") > bucket), max_bits, bucket))


def _hot_links(keyed: DataFrame, hot: DataFrame, max_bits: int, chunk: int) -> DataFrame:
    """Spanning links of the buckets listed in ``hot``, chunk pair by chunk pair."""
    rows = keyed.join(hot, "key")
    spread = F.ceil(F.col("n") / chunk)
    # chunks by hash: each holds about ``chunk`` fingerprints, whatever their distances
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(1)), spread).cast("int"))
    sent = rows.select("key", "fp", F.col("chunk"), F.explode(F.sequence(F.lit(0), (spread - 1).cast("int"))).alias("other"))
    sent = sent.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fp")

    def span(group: pa.Table) -> pa.Table:
        fps = np.unique(group.column("fp").to_numpy()).view(np.uint64)
        return pa.table(dict(zip(("u", "v"), spanning_links(fps, max_bits))))

    return sent.groupBy("key", "i", "j").applyInArrow(span, "u bigint, v bigint")


def spanning_links(fps, max_bits: int):
    """Spanning forest of the links among ``fps`` (numpy), by table, filter and check."""
    pivots = np.array(reference_fingerprints(), dtype=np.uint64)
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    # the first coordinate is sorted: partners lie in a band after each row
    stop = np.searchsorted(table[:, 0], table[:, 0] + max_bits, side="right")
    root = np.arange(len(fps))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    u, v = [], []
    for a in range(len(fps)):
        b = np.arange(a + 1, stop[a])
        for p in range(1, PIVOTS):
            if not len(b):
                break
            b = b[np.abs(table[b, p] - table[a, p]) <= max_bits]
        b = b[np.bitwise_count(fps[b] ^ fps[a]) <= max_bits]
        for c in b.tolist():
            x, y = find(a), find(c)
            if x != y:
                root[max(x, y)] = min(x, y)
                u.append(fps[a])
                v.append(fps[c])
    return np.array(u, np.uint64).view(np.int64), np.array(v, np.uint64).view(np.int64)


# ------------------------------------------------------------------ components

def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); the root is the component's smallest node."""
    pairs = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                    "components")
    n, seen = pairs.count(), None
    for _ in range(rounds):
        if not n:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("m", "u").alias("m"))
        # large star: a node's larger neighbours point to its smallest neighbour
        large = (both.join(low, both.u == low.node).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node")
        # small star: a node's smaller neighbours, and the node, point to the smallest of them
        small = large.join(low, large.u == low.node)
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        pairs = written(small, "components", rows=2 * n)    # two for each pair of ``large``, which are as many as ``pairs``
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        n = state[0]
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return (pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())


# ------------------------------------------------------------------- operators

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                    max_bits: int = 4, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: id, text_hash, fp, fingerprint (hex), root and component_id.

    ``root`` is the group's smallest fingerprint (signed) and tells groups apart that
    hold only null ids.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    least = written(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")), "simhash-distinct", rows=prints.count())
    roots = components(near_links(least.select("fp"), max_bits, bucket))
    grouped = least.join(roots, least.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    table = grouped.join(names, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return prints.join(table, F.col("fp") == F.col("_fp")).select(
        id_col, "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
             max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id.

    Null ids come last; of rows with the same id, the one with the least text hash
    stays, and exact repeats of that row (same id and text) stay once.
    """
    groups = near_duplicates(docs, id_col, text_col, width, max_bits)
    counted = groups.groupBy("root", id_col, "text_hash").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("root").agg(F.min(F.struct(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "text_hash", "n")).alias("best"))
    best = best.select(F.col("best.id").alias("_keep_id"), F.col("best.text_hash").alias("_keep_hash"), F.col("best.n").alias("_keep_n"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    rows = rows.join(best, F.col("id").eqNullSafe(F.col("_keep_id")) & (F.col("hash") == F.col("_keep_hash")))
    again = rows.filter("_keep_n > 1").dropDuplicates(["id", "hash"])
    return rows.filter("_keep_n = 1").select("row.*").unionByName(again.select("row.*"))
