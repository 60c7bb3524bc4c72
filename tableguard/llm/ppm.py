"""Language-model scoring by prediction by partial matching (PPM).

The model is a trie of byte contexts.  A symbol is first looked for in the longest
context; if it never followed there, an escape is paid and the next shorter context
is asked, without the symbols already ruled out (exclusion), down to a uniform choice
among the symbols never seen.  Escapes are estimated as in PPM method C: with N
symbols seen in a context, T of them different, an escape has probability T / (N + T).
Where nothing is left to escape to, no escape is reserved, so the probabilities of all
symbols sum to one in every context.  Every text ends with an end symbol.

Two ways to use it
* ``score_documents``: the trie with contexts of ``depth`` bytes (``DEPTH`` in production,
  6 at most), pretrained on all training texts; its tables grow with the corpus.
* ``adaptive_bits``: a trie of any depth that starts empty for every document and
  learns as it reads; the code length tells how much a text repeats itself.

How the pretrained trie runs on Spark
* Documents are dealt into blocks of about ``BLOCK_BYTES`` (written once).  A block's
  distinct runs of ``depth + 1`` symbols, with their training counts, are cut into parts
  by the last two bytes of the context and travel as one compressed row per (block, part).
* All contexts of two and more bytes are complete inside their part, so a part works out
  every level of its runs from one shuffle, with escapes and exclusions, in numpy.  The
  contexts of one and no byte span parts; they are one table of at most ``SYMBOLS ** 2``
  pair counts, which every task gets.
* The probabilities go back to their blocks, a compressed row per (block, part), and meet
  the block's texts.

``score_documents`` also gives a unigram word score to compare with (``base_score``).
Word counts are aggregated over all training texts.  The words above a count that at
most ``HOT_WORDS`` words reach are broadcast; all others are joined by shuffle.

Defined results
* Null texts are empty: one token, the end.
* A null id counts as the empty text for the split into training and held-out rows.
* Repeated rows count and come back as often as given; an empty table gives no rows;
  with no training text N and V are 0 and the model is uniform; extra columns are not
  read.
* A text is never cut: one above ``BLOCK_BYTES`` is a block of its own, and its distinct
  runs are counted in pieces.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableguard.llm.common import shuffle_width, written

SYMBOLS = 257
END = 256
HOT_WORDS = 200_000
_FLUSH_WORDS = 400_000
DEPTH = 5
BLOCK_BYTES = 16 << 20
PARTS_PER_TASK = 2
_SLICE = 1 << 20
_MERGE = 4 << 20


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


# ------------------------------------------------------------------ pretrained trie

def _runs(text: str | None, depth: int) -> Iterator[np.ndarray]:
    """Codes of the runs of ``depth + 1`` symbols, each run once, in pieces."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(data) + 1, _SLICE):
        # from ``depth`` symbols before ``at`` on, with the starts and the end where they lie inside
        piece = data[max(at - depth, 0):at + _SLICE].astype(np.int64)
        starts, ends = max(depth - at, 0), int(at + _SLICE > len(data))
        symbols = np.concatenate([np.full(starts, END, np.int64), piece, np.full(ends, END, np.int64)])
        n = len(symbols) - depth
        codes = np.zeros(n, np.int64)
        for k in range(depth + 1):
            codes = codes * SYMBOLS + symbols[k:k + n]
        yield codes


def deal(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` (with ``text``) written with a ``key`` of their own and a ``block``."""
    from pyspark import TaskContext

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, size, block = TaskContext.get().partitionId() << 40, 0, 0, 0
        for batch in batches:
            blocks = []
            for length in batch.column(batch.num_columns - 1).to_pylist():
                if size and size + length > block_bytes:
                    size, block = 0, block + 1
                size += length + 1
                blocks.append(first + block)
            keys = pa.array(np.arange(first + n, first + n + len(blocks), dtype=np.int64))
            n += len(blocks)
            yield pa.RecordBatch.from_arrays([keys, pa.array(blocks, pa.int64()), *batch.columns[:-1]], ["key", "block", *names])

    names = rows.columns
    sized = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    return written(sized.mapInArrow(number, T.StructType([T.StructField("key", T.LongType()), T.StructField("block", T.LongType()), *rows.schema.fields])), "ppm-dealt", "zstd")


def part_of(codes: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """The part of each run: by the last two symbols of its context, so that a part holds whole contexts."""
    context = (codes // SYMBOLS) % SYMBOLS ** 2 if depth >= 2 else codes
    return ((context * 2654435761) >> 11) % parts


def block_runs(dealt: DataFrame, depth: int, parts: int) -> DataFrame:
    """(part, block, runs, counts): the distinct runs of a block that belong to a part, and how often training texts hold them."""
    def merged(kept, pending):
        found = list(kept)
        for learn in (True, False):
            if some := [codes for codes, of in pending if of == learn]:
                codes, n = np.unique(np.concatenate(some), return_counts=True)
                found.append((codes, n * int(learn)))
        codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        return codes, np.bincount(place, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)

    def out(block, codes, n):
        part = part_of(codes, depth, parts)
        order = np.argsort(part, kind="stable")
        part, codes, n = part[order], codes[order], n[order]
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        rows = [(int(part[i]), _packed(np.diff(codes[i:j], prepend=0)), _packed(n[i:j])) for i, j in zip(cuts, cuts[1:]) if j > i]
        of, runs, counts = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array(runs, pa.binary()), pa.array(counts, pa.binary())],
                                          ["part", "block", "runs", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, pending, size = None, [], [], 0
        for batch in batches:
            for of, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if block is not None and of != block:
                    yield out(block, *merged(kept, pending))
                    kept, pending, size = [], [], 0
                block = of
                for codes in _runs(text.as_py(), depth):
                    pending.append((codes, learn))
                    size += len(codes)
                    if size >= _MERGE:
                        kept, pending, size = [merged(kept, pending)], [], 0
        if block is not None:
            yield out(block, *merged(kept, pending))

    rows = dealt.select("block", F.coalesce("training", F.lit(False)).alias("training"), "text")
    return rows.mapInArrow(count, "part int, block bigint, runs binary, counts binary")


def _level(c: np.ndarray, starts: np.ndarray, shorter: tuple) -> tuple:
    """(c, all, kinds, below) of a level's entries, sorted so that a context's entries begin at ``starts``.

    ``shorter`` has the same of each entry in the next shorter context.  ``below`` is the
    symbol's probability once all the context's followers are ruled out.  Whatever follows
    a context follows its shorter ones too, so what an escape rules out there are the
    longer context's followers.
    """
    c1, all1, kinds1, below1 = shorter
    seen = c > 0
    size = np.diff(np.append(starts, len(c)))
    total = [np.repeat(np.add.reduceat(x, starts), size) for x in (c, seen.astype(np.float64), np.where(seen, c1, 0))]
    n, t = all1 - total[2], kinds1 - total[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        found = c1 / (n + np.where(kinds1 < SYMBOLS, t, 0))
        escaped = np.where(t > 0, t / (n + t), 1.0) * below1
    return c, total[0], total[1], np.where(c1 > 0, found, escaped)


def _log_probabilities(c: np.ndarray, all_: np.ndarray, kinds: np.ndarray, below: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        found = c / (all_ + np.where(kinds < SYMBOLS, kinds, 0))
        escaped = np.where(kinds > 0, kinds / (all_ + kinds), 1.0) * below
        return np.log10(np.where(c > 0, found, escaped))


def short_levels(pairs: np.ndarray) -> tuple[tuple, tuple]:
    """The levels of no and of one byte of context, for every pair of symbols (flat), from the pair counts."""
    alone = pairs.reshape(SYMBOLS, SYMBOLS).sum(axis=0)
    kinds = float((alone > 0).sum())
    below = np.full(SYMBOLS, 1 / (SYMBOLS - kinds) if kinds < SYMBOLS else 0.0)
    none = (alone, np.full(SYMBOLS, alone.sum()), np.full(SYMBOLS, kinds), below)
    return none, _level(pairs, np.arange(SYMBOLS) * SYMBOLS, tuple(np.tile(x, SYMBOLS) for x in none))


def run_probabilities(codes: np.ndarray, counts: np.ndarray, depth: int, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last symbol of each run (sorted, distinct) after the others."""
    none, one = short_levels(pairs)
    if depth < 2:
        return _log_probabilities(*(x[codes] for x in (none, one)[depth]))
    levels = [(codes, counts.astype(np.float64), None)]
    for k in range(depth - 1, 1, -1):
        longer, c, _ = levels[-1]
        shorter, place = np.unique(longer % SYMBOLS ** (k + 1), return_inverse=True)
        levels[-1] = (longer, c, place)
        levels.append((shorter, np.bincount(place, c, len(shorter)), None))
    here = None
    for level, c, place in reversed(levels):
        shorter = tuple(x[level % SYMBOLS ** 2] for x in one) if here is None else tuple(x[place] for x in here)
        starts = np.flatnonzero(np.diff(level // SYMBOLS, prepend=-1))
        here = _level(c, starts, shorter)
    return _log_probabilities(*here)


def part_probabilities(runs: DataFrame, depth: int, pairs: np.ndarray) -> DataFrame:
    """(block, runs, lp): each row's runs with their probabilities, a part at a time."""
    sent = runs.sparkSession.sparkContext.broadcast(pairs)  # SYMBOLS ** 2 numbers

    def work_out(rows: pa.Table) -> pa.Table:
        each = [(np.cumsum(_unpacked(r, np.int64)), _unpacked(n, np.int64)) for r, n in zip(rows.column("runs").to_pylist(), rows.column("counts").to_pylist())]
        codes, place = np.unique(np.concatenate([r for r, _ in each]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([n for _, n in each]), len(codes))
        lp = run_probabilities(codes, counts, depth, sent.value)[place]
        ends = np.cumsum([len(r) for r, _ in each])
        packed = [_packed(x) for x in np.split(lp, ends[:-1])]
        return pa.table({"block": rows.column("block"), "runs": rows.column("runs"), "lp": pa.array(packed, pa.binary())})

    return runs.groupBy("part").applyInArrow(work_out, "block bigint, runs binary, lp binary")


def model_scores(dealt: DataFrame, pairs: np.ndarray, depth: int = DEPTH) -> DataFrame:
    """(key, score): log10 probability of each dealt text with ``depth`` bytes of context."""
    if not 0 <= depth <= 6:
        raise ValueError("depth must be from 0 to 6: runs are numbers of 63 bits")
    parts = PARTS_PER_TASK * shuffle_width(dealt.sparkSession)
    known = part_probabilities(block_runs(dealt, depth, parts), depth, pairs)

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        codes = np.concatenate([np.cumsum(_unpacked(r, np.int64)) for r in known.column("runs").to_pylist()])
        lp = np.concatenate([_unpacked(x, np.float64) for x in known.column("lp").to_pylist()])
        order = np.argsort(codes)
        codes, lp = codes[order], lp[order]
        # runs are looked up in rising order: neighbours then read the same part of the table
        sums = [float(sum(lp[np.searchsorted(codes, np.sort(c))].sum() for c in _runs(t.as_py(), depth))) for t in texts.column("text")]
        return pa.table({"key": texts.column("key"), "score": pa.array(sums, pa.float64())})

    return (dealt.select("block", "key", "text").groupBy("block").cogroup(known.groupBy("block"))
            .applyInArrow(score, "key bigint, score double"))


# -------------------------------------------------------------------- adaptive trie

class AdaptiveTrie:
    """PPM that learns while it reads, with contexts of up to ``depth`` bytes."""

    def __init__(self, depth: int = 4):
        self.depth = depth
        self.follow: dict[tuple, dict[int, int]] = defaultdict(dict)

    def cost(self, context: tuple, symbol: int) -> float:
        """log10 probability of ``symbol`` after ``context``."""
        p, out = 1.0, set()
        for k in range(min(self.depth, len(context)), -1, -1):
            seen = {s: n for s, n in self.follow.get(context[len(context) - k:], {}).items() if s not in out}
            if not seen:
                continue
            n, t = sum(seen.values()), len(seen)
            more = len(out) + t < SYMBOLS
            if symbol in seen:
                return math.log10(p * seen[symbol] / (n + t * more))
            p *= t / (n + t)
            out |= seen.keys()
        return math.log10(p / (SYMBOLS - len(out)))

    def learn(self, context: tuple, symbol: int) -> None:
        for k in range(min(self.depth, len(context)) + 1):
            here = self.follow[context[len(context) - k:]]
            here[symbol] = here.get(symbol, 0) + 1

    def read(self, text: str | None, update: bool = True) -> float:
        """log10 probability of the text and its end, learning on the way if ``update``."""
        total, context = 0.0, (END,) * 2
        for symbol in [*(text or "").encode("utf-8", "replace"), END]:
            total += self.cost(context, symbol)
            if update:
                self.learn(context, symbol)
            context = (*context, symbol)[-max(self.depth, 1):]
        return total


def adaptive_bits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 4) -> DataFrame:
    """(id, n_bytes, bits): code length of each text by a trie of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            bits = [-AdaptiveTrie(depth).read(t) / math.log10(2) for t in texts]
            sizes = [len((t or "").encode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(bits, pa.float64())], ["id", "n_bytes", "bits"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, bits double").withColumnRenamed("id", id_col)


# ------------------------------------------------------------------- unigram words

def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words, then the end (the empty word)."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), b""]


def corpus_counts(texts: DataFrame, text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """((word, c) over all texts as a written table, counts of every pair of neighbouring symbols).

    Tasks send sums of what they have read; one pass gives both.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        pairs, pending, size = np.zeros(SYMBOLS ** 2, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                for codes in _runs(text, 1):
                    pending.append(codes)
                    size += len(codes)
                if size >= _SLICE:
                    pairs += np.bincount(np.concatenate(pending), minlength=SYMBOLS ** 2)
                    pending, size = [], 0
                sums.update(tokens(text))
                if len(sums) >= _FLUSH_WORDS:
                    yield _counted(-1, sums)
                    sums = Counter()
        if pending:
            pairs += np.bincount(np.concatenate(pending), minlength=SYMBOLS ** 2)
        if sums:
            yield _counted(-1, sums)
        used = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([b""] * len(used), pa.binary()), pa.array(pairs[used])], ["pair", "word", "n"])

    rows = texts.select(F.col(text_col).cast("string")).mapInArrow(count, "pair int, word binary, n bigint")
    both = written(rows.groupBy("pair", "word").agg(F.sum("n").alias("c")), "ppm-counts")
    found = both.filter("pair >= 0").select("pair", "c").toArrow()  # at most SYMBOLS ** 2 rows
    pairs = np.zeros(SYMBOLS ** 2, np.float64)
    pairs[found.column("pair").to_numpy()] = found.column("c").to_numpy()
    return both.filter("pair < 0").select("word", "c"), pairs


def _counted(pair: int, sums: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), pair, np.int32)), pa.array(list(sums.keys()), pa.binary()), pa.array(list(sums.values()), pa.int64())],
                                      ["pair", "word", "n"])


def hot_level(counts: DataFrame, most: int = HOT_WORDS) -> int:
    """The least count that at most ``most`` words reach.

    Words are counted per power of two, then by count inside the one power that the
    limit falls into; only those few sums reach the driver.
    """
    power = F.length(F.bin("c"))
    total = 0
    for r in counts.groupBy(power.alias("p")).count().orderBy(F.desc("p")).collect():
        if total + r["count"] > most:
            inside = counts.filter(power == r.p).groupBy("c").count().orderBy(F.desc("c")).limit(most + 1)
            for s in inside.toLocalIterator():
                if total + s["count"] > most:
                    return s.c + 1
                total += s["count"]
            return 1 << (r.p - 1)
        total += r["count"]
    return 0


# ------------------------------------------------------------------------- scoring

def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
                    hot_words: int = HOT_WORDS, depth: int = DEPTH) -> DataFrame:
    """One row per input row: id, training, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` says which rows the model and the counts learn from.  ``score`` is by
    contexts of ``depth`` bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), training.alias("training"), F.col(text_col).cast("string").alias("text"))
    rows = deal(rows)
    counts, pairs = corpus_counts(rows.filter("training").select("text"))
    all_tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    floor = 0.5 * (distinct + 1) + all_tokens
    level = hot_level(counts, hot_words)
    hot = {bytes(r.word): math.log10((r.c + 0.5) / floor) for r in counts.filter(F.col("c") >= level).toLocalIterator()}
    hot_sent = spark.sparkContext.broadcast(hot)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["key", "id", "training", "n_tokens", "known", "base", "words", "times"]
    types = [pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot_sent.value
        for batch in batches:
            out = [[] for _ in names]
            for text in batch.column(3):
                words = Counter(tokens(text.as_py()))
                n = here = 0
                base, rare, times = 0.0, [], []
                for w, k in words.items():
                    n += k
                    lp = known.get(w)
                    if lp is None:
                        rare.append(w)
                        times.append(k)
                    else:
                        here += k
                        base += k * lp
                for column, value in zip(out, (None, None, None, n, here, base, rare, times)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(i) if i < 3 else pa.array(v, t) for i, (v, t) in enumerate(zip(out, types))], names)

    first = written(rows.select("key", "id", "training", "text").mapInArrow(score, f"key bigint, id {kind}, training boolean, n_tokens bigint, known bigint, base double, words array<binary>, times array<bigint>"), "ppm-scores")
    # the words that were not broadcast meet their counts by shuffle
    rest = first.select("key", F.explode(F.arrays_zip("words", "times")).alias("w")).select("key", F.col("w.words").alias("word"), F.col("w.times").alias("k"))
    rest = rest.join(counts.filter(F.col("c") < level), "word", "left").groupBy("key").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("more"),
        F.sum(F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(floor))).alias("more_base"))
    rest = rest.withColumnRenamed("key", "rest_key")
    joined = first.drop("words", "times").join(rest, F.col("key") == F.col("rest_key"), "left")
    joined = joined.join(model_scores(rows, pairs, depth).withColumnRenamed("key", "deep_key"), F.col("key") == F.col("deep_key"))
    return joined.select(F.col("id").alias(id_col), "training", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                         F.lit(all_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score")
