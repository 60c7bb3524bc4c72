import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tableguard.llm import queries, secrets
from tests.llm.helpers import documents, empty_documents, prose, write_tables

PLAIN = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def base_by_hand(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(PLAIN.items()):
        out += [(m.start(), rank, kind, m.end(), m.group(group), m.start(group)) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)


def fixture():
    rng = random.Random(9)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (31, 32, 64, 40)]
    key = "AKIA" + "Q7Z2M9X4B6T1"
    return [
        None, "", "no secrets here", f"Password: hunter22xyz é {hexes[1]}", f"pässword=abcdefghi token = 'abc' token=\"Zx9.Yq_7+k/2=\"",
        "secret:secret:abcdefgh password=token=abcdefgh12 PASSWD:a API_KEY=Qw3rTy88zz apikey:Qw3rTy88zz api__key=Qw3rTy88zz",
        f"{key} AKIAshort {key}{key} AKIA", f"{hexes[0]} {hexes[2]}{hexes[3]}g{hexes[3]} \U0001f600\U0001f600 {hexes[1]}",
        "gh" + "p_" + "a1B2" * 10, "-----BEGIN RSA PRIVATE " + "KEY-----", "password=changeme12345", "tokEn=ſecret99 ſecret=abcdefgh toKen=abcdefgh",
        "password = aB3dE6gH9jK2 " * 300 + prose(rng, 20_000), f"password: {hexes[1]}", "x" * 50_000, "a" * 50_000,
    ] + [f"doc {i} token=WidelyCopied77" for i in range(12)] + [f"doc {i} secret=OwnedByOne4567" for i in range(3)]


def rows(spark):
    texts = fixture()
    return documents(spark, texts, sources=["s0", "s1", "s2", "s3", None])


def test_base_spans_match_the_plain_expressions(spark, tmp_path):
    df = rows(spark)
    got = {r.doc_id: r for r in queries.QUERIES["op9_secret_owners"](spark, write_tables({"documents": df}, tmp_path)).collect()}
    assert len(got) == df.count()
    for r in df.collect():
        want, g = base_by_hand(r.text), got[r.doc_id]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(s[2] == k for s in want) for k in PLAIN), r.text
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b, *_ in want)
        assert g.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        spans = g.spans.split(",") if g.spans else []
        assert [s for s in spans if s.split(":")[0] in PLAIN] == (listed.split(",") if listed else [])


def test_ownership_tells_copied_examples_from_live_values(spark):
    df = rows(spark)
    found = secrets.candidates(df)
    classes = {r.value_hash: r for r in secrets.classify(found).collect()}
    of = lambda v: classes[hashlib.sha256(v.encode()).hexdigest()]
    assert of("WidelyCopied77")["class"] == "example" and of("WidelyCopied77").owners == 5 and of("WidelyCopied77").repositories == 12
    assert of("changeme12345")["class"] == "plain"
    assert of("aB3dE6gH9jK2")["class"] == "live" and of("aB3dE6gH9jK2").repositories == 1
    live = {r.doc_id for r in secrets.digest(df).collect() if "live:" in r.spans}
    text = {r.doc_id: r.text or "" for r in df.collect()}
    assert not any("WidelyCopied77" in text[i] or "changeme" in text[i] for i in live)
    assert any("aB3dE6gH9jK2" in text[i] for i in live)


def test_redaction_hides_live_values_and_nothing_else(spark):
    df = rows(spark).selectExpr("*", "1 AS row", "2 AS id", "3 AS hash", "4 AS live", "5 AS cut", "6 AS h", "7 AS i")
    before = {r.doc_id: r for r in df.collect()}
    after = secrets.redact(df)
    assert after.columns == df.columns
    got = {r.doc_id: r for r in after.collect()}
    assert got.keys() == before.keys()
    for r in secrets.scan(df).collect():
        text, at, out = before[r.doc_id].text, 0, []
        for s in sorted((s.vstart, s.vend) for s in r.spans if s["class"] == "live"):
            if s[1] > at:
                out += [text[at:max(s[0], at)], "[SECRET]"]
                at = s[1]
        assert got[r.doc_id].text == ("".join(out) + text[at:] if text is not None else None)
    assert "aB3dE6gH9jK2" not in "".join(r.text or "" for r in got.values())


def test_nulls_repeats_and_empty_tables(spark):
    again = documents(spark, [(1, "token=Abcdef123456")] * 3 + [(None, "token=Abcdef123456"), (None, None), (1, "other")], sources=["s0"])
    got = secrets.scan(again).collect()
    assert sorted(len(r.spans) for r in got) == [0, 0, 1, 1, 1, 1]
    assert {s.repositories for r in got for s in r.spans} == {2}
    assert secrets.redact(again).count() == 6
    assert secrets.digest(empty_documents(spark)).count() == 0 and secrets.redact(empty_documents(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    df = rows(spark)
    for frame in (secrets.candidates(df), secrets.digest(df), secrets.redact(df)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def key_body(rng, n):
    return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)) + "="


def pem(body, kind="RSA ", eol="\n", end=True):
    lines = [body[i:i + 64] for i in range(0, len(body), 64)]
    return eol.join([f"-----BEGIN {kind}PRIVATE " + "KEY-----", *lines, *([f"-----END {kind}PRIVATE " + "KEY-----"] if end else [])])


def test_private_keys_are_told_apart_by_their_bodies(spark):
    rng = random.Random(3)
    own = [key_body(rng, 1600 + i) for i in range(5)]
    copied, cut = key_body(rng, 1500), key_body(rng, 1541)
    texts = [f"before {i} {pem(k)} after {i}" for i, k in enumerate(own)]
    texts += [f"copy {i} {pem(copied, eol=eol)} end" for i, eol in enumerate(["\n", "\r\n", "\\n", "\n  ", "\n> "])]
    texts += [f"cut {pem(cut, end=False)}\nSome words follow here, in prose.", "-----BEGIN PRIVATE " + "KEY-----",
              pem("\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n" + own[0][:64]) + pem(own[1], "EC ") + "-" * 20_000, "-----BEGIN PRIVATE " + "KEY----- ... " + "x y " * 50_000]
    df = documents(spark, texts, sources=["s0", "s1", "s2", "s3", "s4"])
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    for i, k in enumerate(own):
        assert got[i + 1] == f"before {i} -----BEGIN RSA PRIVATE " + f"KEY-----[SECRET]-----END RSA PRIVATE KEY----- after {i}"
        assert not any(k[j:j + 64] in got[i + 1] for j in range(0, 1600, 64))
    assert all(got[6 + i] == texts[5 + i] for i in range(5))
    assert got[11] == "cut -----BEGIN RSA PRIVATE " + "KEY-----[SECRET]\nSome words follow here, in prose."
    assert got[12] == texts[11] and got[14] == texts[13]
    assert got[13].count("[SECRET]") == 2 and own[0][:64] not in got[13] and own[1][:64] not in got[13]
    classes = {r.value_hash: r for r in secrets.classify(secrets.candidates(df)).collect()}
    kept = classes[hashlib.sha256(copied.encode()).hexdigest()]
    assert (kept["class"], kept.owners, kept.repositories) == ("example", 5, 5)
    assert all(classes[hashlib.sha256(k.encode()).hexdigest()]["class"] == "live" for k in own)


def test_copies_of_a_text_are_one_vote(spark):
    rng = random.Random(8)
    text = f"{prose(rng, 20)} password: Zq7Kd93Lmx {prose(rng, 20)}"
    texts = [(i, text) for i in range(2000)]                                         # one text in every source
    texts += [(3000 + i, f"{prose(rng, 9)} {i} token=HotSource4455") for i in range(40)]  # many texts of one owner, two quoted elsewhere
    texts += [(4000 + i, f"{prose(rng, 9)} {i} token=Tutorial8812x") for i in range(40)]  # as many texts of all owners
    sources = [f"s{i % 50}" for i in range(2000)] + ["hot"] * 38 + ["s1", "s2"] + [f"s{i % 20}" for i in range(40)]
    df = spark.createDataFrame([(i, t, "en", s, 0) for (i, t), s in zip(texts, sources)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    classes = {r.value_hash: r for r in secrets.classify(secrets.candidates(df)).collect()}
    of = lambda v: classes[hashlib.sha256(v.encode()).hexdigest()]
    copied, hot, tutorial = of("Zq7Kd93Lmx"), of("HotSource4455"), of("Tutorial8812x")
    assert (copied["class"], copied.owners, copied.texts, copied.repositories) == ("live", 1, 1, 2000)
    assert (hot["class"], hot.owners, hot.texts, hot.top) == ("live", 3, 40, 38)
    assert (tutorial["class"], tutorial.owners, tutorial.texts) == ("example", 20, 40)
    after = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert len(after) == len(texts)
    assert not any("Zq7Kd93Lmx" in t or "HotSource4455" in t for t in after.values())
    assert all(after[4000 + i] == t for i, (_, t) in enumerate(texts[-40:]))


def test_frequent_and_rare_values_get_the_same_class_either_way(spark):
    df = rows(spark)
    found = secrets.candidates(df).cache()
    classes = secrets.classify(found).cache()
    each = found.select("id", "text_hash", F.explode("spans").alias("s")).withColumn("value_hash", F.sha2("s.value", 256))
    want = sorted(map(str, secrets._with_class(each, classes, hot=0.0).select("id", "value_hash", "class").collect()))
    for hot in (0.01, 0.2, 2.0):
        assert sorted(map(str, secrets._with_class(each, classes, hot=hot).select("id", "value_hash", "class").collect())) == want
    assert len(want) == each.count()
    classes.unpersist(), found.unpersist()


def test_many_matches_in_one_text_are_linear(spark):
    def took(n):
        df = documents(spark, [" é ".join(f"token=aB3dE6gH{i:06d}" for i in range(n))])
        text = df.first().text
        start = time.time()
        after = secrets.redact(df).first().text
        row = secrets.digest(df).first()
        spent = time.time() - start
        assert after == " é ".join(["token=[SECRET]"] * n) and row.n_assign == n
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b, *_ in base_by_hand(text)).encode()).hexdigest()
        assert row.spans.count("live:") == n
        return spent

    took(100)
    small, large = took(20_000), took(200_000)
    assert large < 15 * small + 5, (small, large)
