"""Name normalisation and matching, on the reference's fixture names."""

from pyspark.sql import functions as F

from tableguard.functions.names import normalize_name
from tableguard.operators.names import filter_with_children, match_names, near_names, no_match_report

NAMES = [("users", "table"), ("user_profiles", "table"), ("audit_logs", "table"), ("active_users", "view"),
         ("trg_users_insert", "trigger")]


def _names(spark):
    return spark.createDataFrame(NAMES, "name string, type string")


def _match(spark, flt, mode):
    return sorted(r.name for r in match_names(_names(spark), "name", flt, mode).collect())


def test_modes(spark):
    assert _match(spark, "user", "contains") == ["active_users", "trg_users_insert", "user_profiles", "users"]
    assert _match(spark, "users", "exact") == ["users"]
    assert _match(spark, "user*", "glob") == ["user_profiles", "users"]
    assert _match(spark, '"active_users"', "exact") == ["active_users"]
    assert _match(spark, "main.active_users", "exact") == ["active_users"]
    assert _match(spark, "active_userz", "exact") == []
    assert _match(spark, "  ", "exact") == sorted(n for n, _ in NAMES)


def test_normalize(spark):
    df = spark.createDataFrame([('"Main" . [Users]',), ("a.0",), ("``",)], "v string")
    got = [tuple(r.n) for r in df.select(normalize_name(F.col("v")).alias("n")).collect()]
    assert got == [("main.users", "users"), ("a.0", "a.0"), ("", "")]


def test_near_and_report(spark):
    near = [r.name for r in near_names(_names(spark), "name", "type", "active_userz").collect()]
    assert near[0] == "active_users"
    flt = spark.createDataFrame([("active_userz",), ("users",)], "f string")
    rep = no_match_report(_names(spark), "name", "type", flt, "f").collect()
    assert {r.filter for r in rep} == {"active_userz"} and len(rep) == 5
    assert [r.name for r in sorted(rep, key=lambda r: r.rank)][0] == "active_users"


def test_children(spark):
    parents = spark.createDataFrame([("users",), ("orders",)], "name string")
    children = spark.createDataFrame([("users", "trg_users_insert"), ("users", "trg_other"),
                                      ("orders", "trg_orders")], "parent string, name string")
    got = sorted(tuple(r) for r in filter_with_children(parents, "name", children, "parent", "name",
                                                         "trg_users_insert", "exact").collect())
    assert got == [("users", "trg_users_insert")]


def test_many_filters_equal_single_filter(spark):
    from tableguard.operators.names import match_names_join

    names = spark.createDataFrame(NAMES + [("main.users_old", "table"), ("[dbo].[Audit_Logs]", "table")],
                                  "name string, type string")
    flts = ["us", "user", "user*", "*log*", "act", "main.users", "  ", "x", "ers", "audit_logs", "a[bc*", "*[!a-m]", "*[^q]sers", "?*", "[u]ser?",
            "u\\\\sers", "[z-a]*", "*[]_]*", "&&", "*[&&a]*"]
    fdf = spark.createDataFrame([(f,) for f in flts], "f string")
    for mode in ("contains", "prefix", "glob", "exact"):
        got = sorted((r.name, r.f) for r in match_names_join(names, "name", fdf, "f", mode).collect())
        want = sorted((r.name, f) for f in flts if f.strip() for r in match_names(names, "name", f, mode).collect())
        assert got == want, mode


def test_globs_follow_fnmatch(spark):
    import fnmatch

    from tableguard.functions.names import glob_regex

    globs = ["a*", "?b", "[ab]c", "[!ab]c", "a.b", "a+(b)", "[a-c]?", "*", "", "a[", "[]]", "x[!]]", "$^{}|"]
    names = ["a", "ab", "bc", "cc", "a.b", "axb", "a+(b)", "b1", "", "a[", "]", "x]", "xy", "$^{}|", "a\\nb"]
    df = spark.createDataFrame([(g, n) for g in globs for n in names], "g string, n string")
    for r in df.select("g", "n", F.regexp_like("n", glob_regex(F.col("g"))).alias("m")).collect():
        assert r.m == fnmatch.fnmatchcase(r.n, r.g), (r.g, r.n)


def test_lookup_levels(spark):
    import pytest

    from tableguard.operators.checks import check_rows, key_check, schema_lookup

    frames = {"users": spark.createDataFrame([(1, None), (2, "b")], "id int, name string"), "logs": spark.range(3)}
    assert [tuple(r) for r in schema_lookup(frames, "user").collect()] == [("users", 2)]
    assert {tuple(r) for r in schema_lookup(frames, "", detail="columns").collect()} == {
        ("users", 2, "id", 1, "INT"), ("users", 2, "name", 2, "STRING"), ("logs", 3, "id", 1, "BIGINT")}
    assert {tuple(r) for r in schema_lookup(frames, "users", "exact", "full").collect()} == {
        ("users", 2, "id", 1, "INT", 0, 2, None), ("users", 2, "name", 2, "STRING", 1, 1, 1)}
    assert schema_lookup(frames, "nothing", detail="full").count() == 0
    with pytest.raises(ValueError, match="detail"):
        schema_lookup(frames, "", detail="all")
    empty = frames["users"].limit(0)
    assert tuple(key_check(empty, ["id"]).first()) == (0, 0, 0, True, True)
    assert check_rows(empty, {"c": "id > 0"}).first().violations == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def _strings(rng, n):
    out = set()
    while len(out) < n:
        out.add("".join(rng.choice("abcd0") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 7, 11, 16]))))
    return sorted(out)


def test_index_holds_every_near_pair_and_few_others(spark):
    """Names that all look alike do not meet all targets: candidates are little more than the near pairs."""
    import random

    from tableguard.operators.names import NearIndex

    rng = random.Random(1)
    names = _strings(rng, 200) + [f"customer#{k:06d}" for k in range(0, 30_000, 150)]
    targets = sorted({"".join(c for c in s if rng.random() > .1) + rng.choice(["", "a", "0b"]) for s in names[::2]})
    ndf = spark.createDataFrame([(s, "t") for s in names], "name string, type string")
    tdf = spark.createDataFrame([(s, (s, s)) for s in targets], "t string, __f struct<canonical:string,leaf:string>")
    for d in (1, 2):
        index = NearIndex(ndf, "name", "type", d)
        got = {(r.t, r.name) for r in index.pairs(tdf, 10**6).collect()}
        near = {(t, s) for t in targets for s in names if abs(len(t) - len(s)) <= d and _distance(t, s) <= d}
        assert got == near
        assert len(near) <= index.candidates(tdf).count() <= 6 * len(near) < len(names) * len(targets) / 3


def test_near_joins_equal_all_pairs(spark):
    """Every customer and part name as a target, and mistyped ones; copies of names, blank targets."""
    import random

    from tableguard.operators.names import near_names_join

    sf = "/root/testdata/sf0.001"
    names = [(f"[sales].[{r.c_name}]", "procedure") for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_name").collect()]
    names += [(r.p_name.replace(" ", "_"), "table") for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").collect()]
    names += names[:3] + [("main.x", "view"), ("x", "table"), ("", "table")]
    rng = random.Random(2)
    targets = sorted({n for n, _ in names})
    for n in targets[::5]:
        k = rng.randrange(len(n) + 1)
        targets.append(n[:k] + rng.choice("x7_") + n[k + rng.randint(0, 2):])
    targets = sorted(set(targets))
    schema = "name string, type string"
    got = {}
    df = spark.createDataFrame(names, schema)
    for r in near_names_join(df, "name", "type", spark.createDataFrame([(t,) for t in targets], "t string"), "t", 3, 2).collect():
        got.setdefault(r.target, []).append((r.rank, r.score, r.type, r.name))
    normal = {r.v: tuple(r.n) for r in spark.createDataFrame([(v,) for v in {*targets, *(n for n, _ in names)}], "v string").select(
        "v", normalize_name(F.col("v")).alias("n")).collect()}
    from collections import Counter

    copies = Counter(names)
    for t in rng.sample(targets, 60) + ["main.x", "x", ""]:
        scored = []
        for (name, kind), n in copies.items():
            d = min(_distance(a, b) for a, b in zip(normal[t], normal[name]) if abs(len(a) - len(b)) <= 2) if any(
                abs(len(a) - len(b)) <= 2 for a, b in zip(normal[t], normal[name])) else 9
            scored += [(d, kind, name)] * n if d <= 2 else []
        want = [(i + 1, *x) for i, x in enumerate(sorted(scored)[:3])]
        assert sorted(got.get(t, [])) == want, t


def test_report_for_far_and_near_filters(spark, monkeypatch):
    """Filters far from all names get their exact nearest names from the bounded scan, in blocks."""
    import random

    from tableguard.operators import names as module

    monkeypatch.setattr(module, "SCAN_BLOCK", 7)
    monkeypatch.setattr(module, "SCAN_SAMPLE", 5)
    rng = random.Random(3)
    names = [(s, rng.choice(["table", "view"])) for s in _strings(rng, 120)] + [("dbo.abc", "table"), ("dbo.abc", "table")]
    flts = ["zzzzzzzzzzzzzzz", "q", "dbo.zzz", "abcd0abcd0abcd0abcd0abcd0", "é"] + [s + "x" for s in _strings(rng, 30)]
    rep = module.no_match_report(spark.createDataFrame(names, "name string, type string"), "name", "type",
                                 spark.createDataFrame([(f,) for f in flts] * 2, "f string"), "f", 4)
    got = {}
    for r in rep.collect():
        got.setdefault(r.filter, []).append((r.rank, r.type, r.name))

    def parts(n):
        return (n, n.split(".")[-1])

    for f in flts:
        if f in got:
            scored = sorted((min(_distance(a, b) for a, b in zip(parts(f), parts(n))), t, n) for n, t in names)
            assert sorted(got[f]) == [(i + 1, t, n) for i, (_, t, n) in enumerate(scored[:4])], f
    exact = {p for n, _ in names for p in parts(n)}
    assert set(got) == {f for f in flts if not set(parts(f)) & exact}


def test_filters_meet_names_on_their_rarest_gram(spark):
    """Filters that begin alike do not meet all names that begin so."""
    from tableguard.operators.names import rarest_keys

    names = spark.range(500).select(F.struct(F.format_string("customer#%05d", "id").alias("canonical")).alias("n"))
    flts = spark.createDataFrame([(0, "customer#00499"), (1, "customer#0"), (2, "cu"), (3, "zebra#1")], "__fid long, f string")
    keys = {r["__fid"]: r["__k"].g for r in rarest_keys(names, F.col("n.canonical"), flts, F.col("f"), "contains").collect()}
    held = {k: names.where(F.col("n.canonical").contains(g)).count() for k, g in keys.items()}
    assert held[0] <= 20 and held[1] == 500 and keys[2] == "cu" and held[3] == 0
    placed = {r["__fid"]: (r["__k"].g, r["__k"].pos) for r in rarest_keys(names, F.col("n.canonical"), flts, F.col("f"), "prefix").collect()}
    assert placed[0][1] > 9 and placed[2] == ("cu", 1)


def test_copies_of_names_and_targets_are_looked_up_once(spark):
    """Equal names make one pair each with a target, whatever their number; no join sends the names to the driver."""
    from tableguard.operators.names import NearIndex, near_names_join

    names = spark.createDataFrame([("customer", "t")] * 300 + [("custmers", "t"), ("custom", "v")], "name string, type string")
    one = spark.createDataFrame([("custmer", ("custmer", "custmer"))], "t string, __f struct<canonical:string,leaf:string>")
    pairs = NearIndex(names, "name", "type", 2).pairs(one, 4)
    assert sorted((r.name, r.copies, r.score) for r in pairs.collect()) == [("custmers", 1, 1), ("customer", 300, 1)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    targets = spark.createDataFrame([("custmer",)] * 3, "f string")
    got = sorted((r["rank"], r.name, r.score) for r in near_names_join(names, "name", "type", targets, "f", 4).collect())
    assert got == sorted([(1, "custmers", 1), (2, "customer", 1), (3, "customer", 1), (4, "customer", 1)] * 3)
    rep = no_match_report(names, "name", "type", targets, "f", 4).collect()
    assert sorted((r["rank"], r.name) for r in rep) == [(1, "custmers"), (2, "customer"), (3, "customer"), (4, "customer")]


def test_filters_meet_names_on_their_longest_gram(spark):
    """A short gram is held by more names the more names there are; the longest that fits by hardly more than match."""
    from tableguard.operators.names import match_names_join, rarest_keys

    names = spark.range(5000).select(F.struct(F.format_string("customer#%05d", "id").alias("canonical")).alias("n"))
    flts = spark.createDataFrame([(0, "customer#04321"), (1, "*er#0432[0-4]")], "__fid long, f string")
    for mode, fid, most in (("contains", 0, 1), ("glob", 1, 10)):
        keys = {r["__fid"]: r["__k"].g for r in rarest_keys(names, F.col("n.canonical"), flts, F.col("f"), mode).collect()}
        assert names.where(F.col("n.canonical").contains(keys[fid])).count() <= most, mode
    rows = names.select(F.col("n.canonical").alias("name"))
    many = rows.where("name < 'customer#00010'").unionByName(rows.where("name < 'customer#00002'"))
    flt = spark.createDataFrame([("customer#0000",), ("customer#0000",), ("CUSTOMER#00001",)], "f string")
    for mode in ("contains", "prefix"):
        got = sorted((r.name, r.f) for r in match_names_join(many, "name", flt, "f", mode).collect())
        assert len(got) == 12 * 2 + 2 and got.count(("customer#00001", "customer#0000")) == 4


def test_targets_keep_k_names_however_many_are_as_near(spark):
    """Of hundreds of names two edits away only the first k by type and name make a pair, copies of a leaf alike."""
    from tableguard.operators.names import NearIndex, near_names_join

    names = spark.range(2000).select(F.format_string("[sales].[customer#%05d]", "id").alias("name"), F.lit("procedure").alias("type"))
    names = names.unionByName(spark.range(300).select(F.format_string("db%d.abcdefgh", "id").alias("name"), F.lit("table").alias("type")))
    targets = spark.createDataFrame([(f"sales.custmer#{n:05d}",) for n in range(0, 2000, 40)] + [("abcdexgh",)], "f string")
    normal = targets.select("f", normalize_name(F.col("f")).alias("__f"))
    assert NearIndex(names, "name", "type", 2).pairs(normal, 4).count() <= 51 * 2 * 4
    got = {}
    for r in near_names_join(names, "name", "type", targets, "f", 4).collect():
        got.setdefault(r.target, []).append((r.rank, r.score, r.name))
    assert sorted(got["abcdexgh"]) == [(i + 1, 1, f"db{n}.abcdefgh") for i, n in enumerate((0, 1, 10, 100))]
    for n in range(0, 2000, 40):
        two = [m for m in range(2000) if sum(a != b for a, b in zip(f"{n:05d}", f"{m:05d}")) == 1][:3]
        assert sorted(got[f"sales.custmer#{n:05d}"]) == [(i + 1, min(i + 1, 2), f"[sales].[customer#{m:05d}]") for i, m in enumerate([n, *two])], n


def test_a_leaf_near_to_a_canonical_name_is_no_near_name(spark):
    """Strings near in different parts do not count for the k nearest."""
    from tableguard.operators.names import near_names_join

    names = spark.createDataFrame([("abcdef.hijk", "table"), ("abcdefgh__k", "table")], "name string, type string")
    targets = spark.createDataFrame([("main.abcdefghijk",)], "f string")
    assert [(r.name, r.score) for r in near_names_join(names, "name", "type", targets, "f", 1).collect()] == [("abcdefgh__k", 2)]
    assert near_names_join(names, "name", "type", targets.limit(0), "f", 1).count() == 0
    assert near_names_join(names.limit(0), "name", "type", targets, "f", 1).count() == 0


def test_only_keys_that_targets_have_are_shuffled(spark):
    """Of a name's deletion keys few are a target's, also where all look alike; none of those is lost."""
    from tableguard.operators.names import deletion_index, met_keys

    def strings(n, form, step=1):
        return spark.range(0, n, step).select(F.format_string(form, "id").alias("s"))

    mine = deletion_index(strings(2000, "custmer#%09d", 7), {1: {17}})
    index = deletion_index(strings(2000, "customer#%09d"), {2: {18}})
    held = met_keys(index, mine)
    assert held.join(mine.select("v").distinct(), "v").count() == index.join(mine.select("v").distinct(), "v").count() > 2000
    assert held.count() < index.count() / 10
    keys = [r.v for r in deletion_index(spark.createDataFrame([("a.ba",), ("\u00e9",)], "s string"), {2: {4}, 0: {4}, 1: {1}}).collect()]
    want = ["a.ba", "a.", "ab", "aa", ".b", ".a", "ba", ""]
    assert sorted(keys) == sorted(r.v for r in spark.createDataFrame([(w,) for w in want], "w string").select(F.xxhash64("w").alias("v")).collect())
