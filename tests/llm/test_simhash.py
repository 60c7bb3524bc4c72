import random

import numpy as np
import pytest
import xxhash

from tableguard.llm import queries, simhash
from tests.llm.helpers import documents, empty_documents, prose, write_tables


def plain_fingerprint(text, width=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ")
             .replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints, max_bits=4):
    """prints: list of (id, fp); every pair is compared."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, f"{fp:016x}", least.get(find(i))) for i, (doc, fp) in enumerate(prints)]


def fixture_texts(seed=3):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one", "ONE", "two words", "É é É", "tab\tand\x0bother  gaps\r\n"]
    base = [prose(rng, n) for n in (3, 4, 5, 40, 300, 900)]
    texts += base + [base[3], base[3].upper()]
    for b in base[4:]:
        for k in range(12):
            w = b.split()
            w[rng.randrange(len(w))] = f"edit{k}"
            texts.append(" ".join(w))
    texts.append(prose(rng, 70_000))
    return texts


def test_fingerprint_follows_the_rule():
    for t in fixture_texts()[:-1]:
        assert simhash.simhash(t) == plain_fingerprint(t), t


def test_groups_match_comparing_every_pair(spark):
    texts = fixture_texts()
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (50, texts[10])]
    df = documents(spark, rows)
    got = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
    want = groups_by_hand([(i, plain_fingerprint(t)) for i, t in rows])
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("bucket", [2, 16, 512])
def test_links_join_the_same_groups_whatever_the_bucket_size(spark, bucket):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre}
    while len(fps) < 120:  # a ball: every fingerprint meets every other on many keys
        fps.add(int(rng.choice(list(fps))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 60)}
    fps = sorted(fps)
    df = spark.createDataFrame([(np.uint64(f).astype(np.int64).item(),) for f in fps], "fp bigint")
    links = simhash.near_links(df, bucket=bucket)
    pairs = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in links.collect()]
    assert all(0 < (u ^ v).bit_count() <= 4 for u, v in pairs)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    signed = [np.uint64(f).astype(np.int64).item() for f in fps]
    mine = {}
    for s in signed:
        mine.setdefault(roots.get(s, s), set()).add(s)
    hand = {}
    for (i, _, c) in groups_by_hand(list(zip(range(len(fps)), fps))):
        hand.setdefault(c, set()).add(signed[i])
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, hand.values()))


@pytest.mark.parametrize("n", [1, 1000, 10**7, 10**9, 10**12])
def test_every_close_pair_shares_exactly_one_first_key(n):
    rng = np.random.default_rng(n % 97)
    masks = simhash.block_masks(n)
    for _ in range(200):
        diff = 0
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            diff |= 1 << int(b)
        first = [m for m, before in masks if not diff & m and all(diff & b for b in before)]
        assert len(first) == 1


def test_table_filter_never_loses_a_close_pair():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    near = fps ^ np.uint64(0b1011)
    u, v = simhash.spanning_links(np.unique(np.concatenate([fps, near])), 4)
    assert len(u) == 50


def test_long_chains_are_one_component(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "u bigint, v bigint")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_keep_one_keeps_one_row_of_each_group(spark):
    texts = fixture_texts()
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (50, texts[10])]
    df = documents(spark, rows).selectExpr("*", "'x' AS fp", "'y' AS root", "'z' AS component_id", "1 AS _n", "2 AS text_hash")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    n_groups = len({tuple(sorted(g)) for g in _members(prints)})
    assert kept.count() == n_groups
    ids = [r.doc_id for r in kept.collect()]
    want = {c for _, _, c in groups_by_hand(prints) if c is not None}
    assert want <= set(ids)


def _members(prints):
    groups = []
    for i, (_, fp) in enumerate(prints):
        near = [g for g in groups if any((fp ^ prints[j][1]).bit_count() <= 4 for j in g)]
        groups = [g for g in groups if g not in near] + [sum(near, []) + [i]]
    return groups


def test_empty_table(spark):
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
    assert simhash.keep_one(empty_documents(spark)).count() == 0


def test_query_on_a_fixture(spark, tmp_path):
    texts = fixture_texts()
    folder = write_tables({"documents": documents(spark, texts)}, tmp_path)
    got = queries.QUERIES["op2_simhash_pivots"](spark, folder).collect()
    want = groups_by_hand([(i + 1, plain_fingerprint(t)) for i, t in enumerate(texts)])
    assert sorted(map(tuple, got)) == sorted(want)
