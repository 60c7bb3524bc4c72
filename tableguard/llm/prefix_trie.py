"""Conversation prefix trie by union-find over sorted-neighbour LCP edges.

Every distinct sequence of a conversation's first d turns is a node.  Conversations are
sorted by their turns; neighbours share a longest common prefix (LCP), and edges between
neighbours, taken in descending depth, merge components: each merge makes, or joins, the
branching node of that depth.  Nodes with one child lie between two branching nodes and
come from the turns of the node's smallest member.

How it runs on Spark
* A turn is reduced to a 16-byte digest and its word count where it is read; texts never
  travel.  Turns are numbered by ranges of (conversation, turn) plus the sums of the
  ranges before them, so no task holds a whole conversation.
* Equal conversations collapse first, by length and two commutative sums of 64-bit
  hashes.  Their ids stream in order through SHA-256, a batch at a time.
* A sort key is the digests of the first ``KEY_TURNS`` turns; only conversations that
  share a whole key with another one get keys ``KEY_GROWTH`` times as long, as often as
  needed.
* The distinct conversations are laid out by key ranges.  Each partition builds its own
  forest and contracts it: what can no longer meet a neighbour partition is closed and
  leaves as node records, the two boundary spines stay (a few components for each depth
  on the spine, however many rows).  Contracted forests of ``FAN`` neighbours are joined
  by the LCP edges across their boundaries and contracted again, up to one forest.

A component carries sums only (members, leaves, children, words shared along its edges);
with A the words of the first turns, the words saved below a node of depth d are
``sum of A(LCP) over its edges - (n - 1) * A(d - 1)``.

Defined results
* A null role or text is empty.  Rows with a null conversation id belong to no
  conversation and are left out.
* Order of turns: turn (nulls first), then the digest of role and text; repeated rows
  are repeated turns.
* Conversation ids are whole numbers; ``%`` takes the sign of the id, as in SQL.
* A conversation of any length is spread over tasks; one that shares its first k turns
  with another has a key of 16 bytes for each of about k turns.
* An empty table has no node, not even the root.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableguard.llm.common import crc_mod, text_or_empty, written

KEY_TURNS = 64
KEY_GROWTH = 16
FAN = 64
DIGEST = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------ turns

def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(c, idx from 1, digest, words, upto): every turn with its place and the words of the turns up to it."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "utf-8"))).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest").asc(), F.col("spread").asc()]
    laid = rows.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(F.col("c").asc(), *order)
    laid = written(laid.withColumn("range", F.spark_partition_id()), "trie-layout")  # the ranges are fixed from here on
    sums = laid.groupBy("c", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    earlier = Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("c", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
                       F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w_before"))
    inside = Window.partitionBy("c", "range").orderBy(*order)
    here = laid.withColumns({"i": F.row_number().over(inside), "w": F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    return here.join(sums, ["c", "range"]).select(
        "c", (F.col("n_before") + F.col("i")).alias("idx"), "digest", "words", (F.col("w_before") + F.col("w")).alias("upto"))


def rebuilt_turns(own: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the beginning of the one ``every`` ids share: (turns, conversations).

    Conversation c gets the first h turns of c - c % ``every``, then its own after its
    first h; h = crc32(c) % (``most`` + 1).  Turns: (c, d from 1, digest, words, upto);
    conversations: (c, len, total).
    """
    base = F.col("c") - F.col("c") % every
    heads = (own.filter((F.col("c") % every == 0) & (F.col("idx") <= most)).groupBy(F.col("c").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("idx", "digest", "words", "upto"))).alias("head")))
    rows = own.withColumn("h", crc_mod(F.col("c"), most + 1))
    skipped = F.col("idx") <= F.col("h")
    convs = rows.groupBy("c", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"), F.count_if(skipped).alias("skip"),
                                       F.coalesce(F.sum(F.when(skipped, F.col("words"))), F.lit(0)).alias("skip_words"))
    convs = convs.join(heads, base == F.col("base"), "left")
    head = F.when(F.col("head").isNull() | (F.col("h") == 0), F.lit(None)).otherwise(F.slice("head", 1, F.col("h")))
    convs = convs.withColumn("head", head).withColumns({
        "nb": F.coalesce(F.when(F.col("head").isNotNull(), F.size("head")), F.lit(0)).cast("long"),
        "head_words": F.coalesce(F.element_at("head", -1)["upto"], F.lit(0))})
    convs = written(convs.select("c", "h", "head", "nb", "head_words", "skip_words", (F.col("nb") + F.col("n") - F.col("skip")).alias("len"),
                                 (F.col("head_words") + F.col("w") - F.col("skip_words")).alias("total")), "trie-conversations")
    mine = rows.filter(~skipped).drop("h").join(convs.select("c", "h", "nb", "head_words", "skip_words"), "c").select(
        "c", (F.col("nb") + F.col("idx") - F.col("h")).alias("d"), "digest", "words", (F.col("head_words") + F.col("upto") - F.col("skip_words")).alias("upto"))
    taken = convs.filter("nb > 0").select("c", F.explode("head").alias("t")).select(
        "c", F.col("t.idx").alias("d"), "t.digest", "t.words", "t.upto")
    return written(taken.unionByName(mine), "trie-turns"), convs.select("c", "len", "total")


# --------------------------------------------------------- distinct conversations

def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal ``ident``: its smallest id, size and the hash of its ids, streamed."""
    names = ["rep", "len", "total", "m", "sha"]
    now, rep, size, total, m, sha = None, 0, 0, 0, 0, hashlib.sha256()
    for batch in batches:
        out = []
        for ident, c, n, w in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if ident == now:
                sha.update(b",%d" % c)
                m += 1
                continue
            if now is not None:
                out.append((rep, size, total, m, sha.hexdigest()))
            now, rep, size, total, m, sha = ident, c, n, w, 1, hashlib.sha256(b"%d" % c)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, _ENDS_TYPES)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((rep, size, total, m, sha.hexdigest()), _ENDS_TYPES)], names)


_ENDS_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def distinct_conversations(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(rep, len, total, m, sha): each distinct sequence's smallest id, turns, words, copies and the hash of their ids."""
    def side(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), "d", "digest").cast("decimal(20,0)")).alias(f"s{seed}")

    idents = turns.groupBy("c").agg(side(1), side(2))
    rows = convs.join(idents, "c", "left").select(F.concat_ws(":", "len", "s1", "s2").alias("ident"), "c", "len", "total")
    return rows.repartition("ident").sortWithinPartitions("ident", "c").mapInArrow(_ends, "rep bigint, len bigint, total bigint, m bigint, sha string")


def sort_keys(turns: DataFrame, reps: DataFrame, key_turns: int = KEY_TURNS) -> DataFrame:
    """(key, len, rep, m, total, sums): ``key`` tells each conversation from all others, or is complete.

    ``sums`` holds the words up to each turn of the key.
    """
    done, todo, k = [], reps, key_turns
    while True:
        some = (turns.filter(F.col("d") <= k).join(todo.select(F.col("rep").alias("c")), "c", "left_semi").groupBy("c")
                .agg(F.array_sort(F.collect_list(F.struct("d", "digest", "upto"))).alias("t")))
        some = some.select(F.col("c").alias("rep"), F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["digest"])), "")).alias("key"),
                           F.transform("t", lambda t: t["upto"]).alias("sums"))
        some = todo.join(some, "rep", "left").select(F.coalesce("key", F.lit(b"")).alias("key"), "len", "rep", "m", "total",
                                                     F.coalesce("sums", F.array().cast("array<bigint>")).alias("sums"))
        some = written(some, "trie-keys")
        cut = some.filter(F.col("len") > k)
        shared = cut.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
        again = written(cut.join(shared, "key", "left_semi").select("rep", "len", "total", "m"), "trie-longer")
        if again.isEmpty():
            done.append(some)
            break
        done.append(some.join(again.select("rep"), "rep", "left_anti"))
        todo, k = again, k * KEY_GROWTH
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# ------------------------------------------------------------------ the forest

@dataclass(slots=True)
class Part:
    """A component: members that share their first ``depth`` turns, with sums over them."""

    depth: int
    least: int          # smallest member
    n: int              # members
    children: int
    leaves: int
    shared: int         # sum of A(LCP) over the edges inside, copies included
    end: int | None     # representative of the members that end at this depth
    key: bytes          # digests of the first member (as far as they are needed)
    sums: list[int]     # words up to each turn of ``key``
    last: bytes         # digests of the last member (only of a forest's last component)


NODE_FIELDS = [("id", pa.binary()), ("parent", pa.binary()), ("top", pa.int64()), ("bottom", pa.int64()), ("least", pa.int64()),
               ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("shared", pa.int64()), ("end", pa.int64())]
FOREST_FIELDS = [("part", pa.int32()), ("place", pa.int32()), ("edge", pa.int64()), ("edge_words", pa.int64()), ("key", pa.binary()),
                 ("sums", pa.list_(pa.int64())), ("last", pa.binary())]
FOREST_SCHEMA = ("id binary, parent binary, top bigint, bottom bigint, least bigint, n bigint, children bigint, leaves bigint, shared bigint, end bigint, "
                 "part int, place int, edge bigint, edge_words bigint, key binary, sums array<bigint>, last binary")


def common_turns(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix of two keys, in turns."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[:high * DIGEST] == b[:high * DIGEST]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * DIGEST:mid * DIGEST] == b[low * DIGEST:mid * DIGEST]:
            low = mid
        else:
            high = mid
    return low


def node_id(key: bytes, depth: int) -> bytes | None:
    """Name of the node of that depth on a key's path; None below the key's end."""
    return hashlib.blake2b(key[:depth * DIGEST], digest_size=16, salt=depth.to_bytes(8, "little")).digest() if depth * DIGEST <= len(key) else None


def contract(parts: list[Part], edges: list[tuple[int, int]], whole: bool) -> tuple[list[tuple], list[Part], list[tuple[int, int]]]:
    """Merge neighbours along ``edges`` (depth, words up to it), deepest first: (closed nodes, parts left, edges left).

    A component may be closed, as a child of the edge's node, if the edges on both its
    sides are known and no deeper than this one; otherwise a neighbour forest may still
    hold members of it, and the edge stays.  In a ``whole`` forest nothing lies outside.
    """
    n = len(parts)
    root, low, high, comp = list(range(n)), list(range(n)), list(range(n)), list(parts)
    closed: list[tuple] = []
    kept: set[int] = set()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def close(p: Part, depth: int) -> None:
        closed.append((node_id(p.key, p.depth), node_id(p.key, depth), depth + 1, p.depth, p.least, p.n, p.children, p.leaves, p.shared, p.end))

    for i in sorted(range(n - 1), key=lambda i: -edges[i][0]):
        depth, words = edges[i]
        x, y = find(i), find(i + 1)
        a, b = comp[x], comp[y]
        if not whole and (a.depth != depth and not (low[x] > 0 and edges[low[x] - 1][0] <= depth)
                          or b.depth != depth and not (high[y] < n - 1 and edges[high[y]][0] <= depth)):
            kept.add(i)
            continue
        children = leaves = 0
        for p in (a, b):
            if p.depth != depth:
                close(p, depth)
                children, leaves = children + 1, leaves + p.leaves
            elif p.children:
                children, leaves = children + p.children, leaves + p.leaves
        end = a.end if a.depth == depth and a.end is not None else b.end if b.depth == depth else None
        comp[x] = Part(depth, min(a.least, b.least), a.n + b.n, children, leaves, a.shared + b.shared + words, end, a.key, a.sums, b.last)
        root[y], high[x] = x, high[y]
    left = [comp[k] for k in range(n) if root[k] == k]
    if not whole:
        return closed, left, [edges[i] for i in sorted(kept)]
    top = left[0]
    if top.depth:
        close(top, 0)
        top = replace(top, depth=0, children=1, end=None)
    closed.append((node_id(top.key, 0), None, 0, 0, top.least, top.n, top.children, top.leaves, top.shared, top.end))
    return closed, [], []


def _rows(part: int, closed: list[tuple], left: list[Part], edges: list[tuple[int, int]]) -> pa.RecordBatch:
    """Closed nodes, and the contracted forest of ``part``, as rows of one table."""
    rows = [(*node, None, None, None, None, None, None, None) for node in closed]
    for k, p in enumerate(left):
        first, final = k == 0, k == len(left) - 1
        edge = edges[k] if not final else (None, None)
        rows.append((None, None, None, p.depth, p.least, p.n, p.children, p.leaves, p.shared, p.end, part, k, *edge,
                     p.key if first else p.key[:p.depth * DIGEST], p.sums if first else [], p.last if final else b""))
    fields = NODE_FIELDS + FOREST_FIELDS
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [name for name, _ in fields])


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of one partition of sorted conversations, contracted."""
    parts, edges, before = [], [], None
    for batch in batches:
        for key, size, rep, m, total, sums in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if before is not None:
                depth = common_turns(before, key)
                edges.append((depth, sums[depth - 1] if depth else 0))
                parts[-1].last = b""
                parts[-1].sums = parts[-1].sums if len(parts) == 1 else []
            parts.append(Part(size, rep, m, 0, 1, (m - 1) * total, rep, key, sums, key))
            before = key
    if parts:
        yield _rows(TaskContext.get().partitionId(), *contract(parts, edges, whole=False))


def _joined_forest(group: pa.Table, fan: int, whole: bool) -> pa.Table:
    """Contracted forests of neighbour partitions, joined across their boundaries and contracted again."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["place"]))
    parts, edges, part = [], [], rows[0]["part"] // fan
    for k, r in enumerate(rows):
        parts.append(Part(r["bottom"], r["least"], r["n"], r["children"], r["leaves"], r["shared"], r["end"], r["key"], r["sums"], r["last"]))
        if k + 1 < len(rows):
            if r["edge"] is not None:
                edges.append((r["edge"], r["edge_words"]))
            else:
                depth = common_turns(r["last"], rows[k + 1]["key"])
                edges.append((depth, rows[k + 1]["sums"][depth - 1] if depth else 0))
    return pa.Table.from_batches([_rows(part, *contract(parts, edges, whole))])


def _joining(fan: int, whole: bool):
    def join(group: pa.Table) -> pa.Table:
        return _joined_forest(group, fan, whole)
    return join


def forest(keys: DataFrame) -> DataFrame:
    """Node records of the trie over ``keys``: one for each end or branching, with the chain above it.

    (id, parent, top, bottom, least, n, children, leaves, shared, end): the nodes of depth
    ``top`` to ``bottom`` have the same members; only the lowest one branches or has ends.
    """
    laid = keys.repartitionByRange("key", "len").sortWithinPartitions("key", "len")
    level = written(laid.select("key", "len", "rep", "m", "total", "sums").mapInArrow(_local_forest, FOREST_SCHEMA), "trie-forest")
    names = [name for name, _ in NODE_FIELDS]
    nodes = []
    while True:
        nodes.append(level.filter("part IS NULL").select(*names))
        open_parts = level.filter("part IS NOT NULL")
        most = open_parts.agg(F.max("part")).first()[0]
        if most is None:
            break
        level = written(open_parts.groupBy((F.col("part") / FAN).cast("int").alias("g")).applyInArrow(_joining(FAN, most < FAN), FOREST_SCHEMA), "trie-forest")
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out


# ------------------------------------------------------------------- operator

def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie over (c, d, digest, words, upto) turns of (c, len, total) conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256);
    a node is named by its smallest member and its depth.
    """
    reps = written(distinct_conversations(turns, convs), "trie-distinct")
    nodes = written(forest(sort_keys(turns, reps.drop("sha"))), "trie-nodes")
    above = nodes.filter("id IS NOT NULL").select(F.col("id").alias("_id"), F.col("least").alias("above"))
    ends = reps.select(F.col("rep").alias("_rep"), "sha")
    chains = nodes.join(above, F.col("parent") == F.col("_id"), "left").join(ends, F.col("end") == F.col("_rep"), "left")
    chains = chains.select("top", "bottom", "least", "above", "n", "children", "leaves", "shared", F.coalesce("sha", F.lit(NO_ENDS)).alias("sha"))
    inner = turns.join(chains, (F.col("c") == F.col("least")) & F.col("d").between(F.col("top"), F.col("bottom")))
    first = chains.filter("top = 0").select("*", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("upto"))
    rows = inner.select(*first.columns).unionByName(first)
    lowest = F.col("d") == F.col("bottom")
    return rows.select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("top"), F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(lowest, F.col("children")).otherwise(F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("shared") - (F.col("n") - 1) * (F.col("upto") - F.col("words"))).alias("saved_tokens"),
        F.when(lowest, F.col("sha")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))
