import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tableguard.llm import prefix_trie, queries
from tests.llm.helpers import prose, write_tables

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows):
    """The contract's nodes, from plain tuples."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1

    def words(text):
        return len(text.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")) - text.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ").count("")

    leaves, saved = defaultdict(int), defaultdict(int)
    for node, ids in members.items():
        gain = (len(ids) - 1) * words(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += gain
    return sorted((ids[0], len(node), members[node[:-1]][0] if node else -1, len(ids), kids[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(str(c) for c in ids if len(built[c]) == len(node)).encode()).hexdigest()) for node, ids in members.items())


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def nodes(spark, rows, **options):
    own = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(7))
    return found(prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(own)))


def shared_talks(rng, n, few=4):
    lines = [prose(rng, rng.randint(0, 4)) for _ in range(few)]
    return [(c, k, rng.choice(["user", "assistant"]), rng.choice(lines)) for c in range(n) for k in range(rng.randint(1, 7))]


def test_equals_brute_force_on_crowded_tries(spark):
    rng = random.Random(3)
    rows = shared_talks(rng, 400, few=2)
    assert nodes(spark, rows) == by_hand(rows)


def test_many_partitions_meet_at_their_boundaries(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(4)
        rows = [(c, k, "u", "same words here") for c in range(120) for k in range(3)] + shared_talks(rng, 300, few=3)[::-1]
        assert nodes(spark, rows) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("seed", range(30))
def test_contraction_gives_the_whole_forest(seed):
    """Any way of cutting sorted sequences into partitions gives the nodes of one forest."""
    rng = random.Random(seed)
    seqs = sorted({bytes(rng.choice([1, 2]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 60))})

    def leaf(k):
        key = b"".join(bytes([x]) * 16 for x in seqs[k])
        return prefix_trie.Part(len(seqs[k]), k, 1, 0, 1, 0, k, key, list(range(1, len(seqs[k]) + 1)), key)

    def edge(a, b):
        depth = prefix_trie.common_turns(a.last, b.key)
        return depth, depth

    parts = [leaf(k) for k in range(len(seqs))]
    whole = prefix_trie.contract(parts, [edge(a, b) for a, b in zip(parts, parts[1:])], True)[0]
    closed = []
    cuts = sorted(rng.sample(range(1, len(seqs)), min(len(seqs) - 1, rng.randint(0, 8))))
    pieces = []
    for i, j in zip([0, *cuts], [*cuts, len(seqs)]):
        some = parts[i:j]
        out, left, edges = prefix_trie.contract(some, [edge(a, b) for a, b in zip(some, some[1:])], False)
        closed += out
        pieces.append((left, edges))
        depths = [d for d, _ in edges]
        assert all(depths.count(d) <= 4 for d in depths)
    while len(pieces) > 1:
        (a, x), (b, y), *rest = pieces
        out, left, edges = prefix_trie.contract(a + b, [*x, edge(a[-1], b[0]), *y], False)
        closed += out
        pieces = [(left, edges), *rest]
    closed += prefix_trie.contract(*pieces[0], True)[0]
    assert sorted(closed, key=str) == sorted(whole, key=str)


def test_long_shared_beginnings_get_longer_keys(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "KEY_GROWTH", 2)
    monkeypatch.setattr(prefix_trie.sort_keys, "__defaults__", (2,))
    rng = random.Random(9)
    talk = [("u", prose(rng, 3)) for _ in range(20)]
    rows = [(c, k, *t) for c, n in [(20, 20), (40, 20), (60, 13), (80, 4), (100, 2)] for k, t in enumerate(talk[:n])]
    rows += [(120, k, *t) for k, t in enumerate(talk[:9] + [("u", "other")] * 3)]
    rows += [(c, k, "u", f"{c}") for c in (140, 160) for k in range(30)]
    assert nodes(spark, rows) == by_hand(rows)


def test_nulls_ties_repeats_and_odd_ids(spark, tmp_path):
    rows = [(None, 0, "u", "lost"), (0, None, "u", "first"), (0, 3, None, None), (0, 3, "", ""), (0, 1, "u", "a  b\tc\x0bd\x85e"),
            (0, 1, "u", "a  b\tc\x0bd\x85e"), (7, 0, "u", "z"), (-7, 1, "u", "z"), (-20, 1, "u", "q"), (-20, 2, "a", "r s"),
            (25, 2, "u", "no base"), (2, 0, "u", "only"), (4, 0, "u", "only"), (5, 9, "u" * 3, "x" * 100_000), (6, 1, "1:u", "v"), (8, 1, "1", ":uv")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("d", F.lit(1)).withColumn("upto", F.lit("x"))
    got = found(queries.op11_prefix_trie(spark, write_tables({"conversations": docs}, tmp_path)))
    assert got == by_hand(rows)


def test_one_conversation_and_copies_of_one(spark):
    for rows in ([(3, 1, "u", "a b")], [(c, k, "u", f"w w {k}") for c in range(0, 2000, 20) for k in range(5)]):
        assert nodes(spark, rows) == by_hand(rows)


def test_empty_table(spark):
    assert nodes(spark, []) == []
