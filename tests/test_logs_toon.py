"""Log parsing and previews; TOON encoding."""

from pyspark.sql import functions as F

from tableguard.operators.logs import context_preview, parse_log
from tableguard.sources.toon import toon_rows


def test_parse_and_preview(spark):
    lines = [(1, '{"message":"m","channel":"app","level":"warning","datetime":"2024-01-01T00:00:00",'
                 '"context":{"a":1,"b":"' + "y" * 60 + '","c":true,"d":null},"extra":{}}'),
             (2, "   "), (3, "{broken"), (4, '{"message":"n","level_name":"info","context":{}}')]
    df = spark.createDataFrame(lines, "id long, line string")
    got = {r.id: r for r in parse_log(df, "id", "line").select("*", context_preview(F.col("context")).alias("p"))
           .collect()}
    assert set(got) == {1, 3, 4} and not got[3].valid
    assert got[1].level == "WARNING" and got[4].level == "INFO"
    assert got[1].p == "a: 1\nb: " + "y" * 47 + "...\nc: 1\n..."
    assert got[4].p == ""


def test_toon_quoting(spark):
    df = spark.createDataFrame([(1, "plain", "4532015112830366", "123-45-6789", "a, b", None, "", "say \"hi\"")],
                               "id long, a string, b string, c string, d string, e string, f string, g string")
    lines = {r.line_no: r.line for r in toon_rows(df).collect()}
    assert lines[0] == "[1]{id,a,b,c,d,e,f,g}:"
    assert lines[1] == '  1,plain,"4532015112830366",123-45-6789,"a, b",null,"","say \\"hi\\""'


LONG = "Called twice about a late parcel; " * 7
ROWS = [
    (7, "Ada Quill", "ada@quill.example", "(201) 555-0142", "4000123412341234", 12.5, True, LONG),
    (8, "Bo Finch", "bo@finch.example", "+44 20 7946 0000", "77", -3.0, False, "ok: yes"),
    (9, None, "", "201.555.0199", "0x1f", None, None, "said \"hi\""),
]
SCHEMA = "id int, who string, mail string, phone string, card string, score double, active boolean, remark string"
HEADER = "{id,who,mail,phone,card,score,active,remark}:"
MULTI = (f"[3]{HEADER}\n"
         "  7,Ada Quill,ada@quill.example,(201) 555-0142,\"4000123412341234\",12.5,true,<TEXT>\n"
         "  8,Bo Finch,bo@finch.example,+44 20 7946 0000,\"77\",-3,false,<TEXT>\n"
         "  9,null,\"\",201.555.0199,0x1f,null,null,<TEXT>")
SINGLE = f"[1]{HEADER}\n  7,Ada Quill,ada@quill.example,(201) 555-0142,\"4000123412341234\",12.5,true,\"{LONG}\""


def _toon_text(df):
    from tableguard.sources.toon import toon_rows

    lines = toon_rows(df, ["id"] if "id" in df.columns else None)
    rows = sorted(lines.collect(), key=lambda r: r.line_no)
    return "\n".join(r.line for r in rows)


def test_toon_rows_in_order_with_bare_numbers(spark):
    from tableguard.operators.shaping import mask_long_text

    df = spark.createDataFrame(ROWS, SCHEMA)
    assert _toon_text(mask_long_text(df)) == MULTI
    assert _toon_text(mask_long_text(df.where("id = 7"))) == SINGLE


def test_toon_quotes_odd_column_names(spark):
    df = spark.createDataFrame([(1, "v")], "id int, `no. of \"x\"` string")
    assert _toon_text(df) == '[1]{id,"no. of \\"x\\""}:\n  1,v'


def test_toon_doubles(spark):
    df = spark.createDataFrame([(1, 1.5), (2, 1e20), (3, 1e-7), (4, float("nan")), (5, float("inf")), (6, -0.0), (7, 100.0)], "id int, d double")
    text = _toon_text(df).split("\n")[1:]
    assert text == ["  1,1.5", "  2,100000000000000000000", "  3,0.0000001", "  4,null", "  5,null", "  6,0", "  7,100"]


def test_preview_of_every_kind_of_value(spark):
    cases = {'{}': "", '[]': "", '{"a":true,"b":false,"c":null}': "a: 1\nb: \nc: null", '["x",2,{"k":1}]': '0: x\n1: 2\n2: {"k":1}',
             '{"it\'s":"v","a.b":1.5,"n":[1,2],"m":3}': "it's: v\na.b: 1.5\nn: [1,2]\n...", '{"k":"' + "\u00e9" * 25 + '"}': "k: " + "\u00e9" * 25,
             '{"k":"' + "\u00e9" * 30 + '"}': "k: " + "\u00e9" * 23 + "\ufffd..."}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r.c: r.p for r in df.select("c", context_preview(F.col("c")).alias("p")).collect()}
    assert got == cases


def test_entry_by_id_refuses_what_is_no_entry(spark):
    import pytest

    from tableguard.operators.logs import entry_by_id

    parsed = parse_log(spark.createDataFrame([(1, '{"message":"m"}'), (2, "{broken"), (3, " ")], "id long, line string"), "id", "line")
    assert entry_by_id(parsed, 1, 3).first().message == "m"
    for bad in (0, 2, 3, 4):
        with pytest.raises(ValueError):
            entry_by_id(parsed, bad, 3)


def test_lists_are_valid_entries(spark):
    lines = [(1, "[]"), (2, '["a", {"message": "inner"}]'), (3, "[1,"), (4, "{}"), (5, "3"), (6, '"text"'), (7, "null")]
    got = {r.id: tuple(r) for r in parse_log(spark.createDataFrame(lines, "id long, line string"), "id", "line").collect()}
    empty = (True, "", "", "", "", None, None)
    assert {i for i, r in got.items() if r[1]} == {1, 2, 4} and all(got[i][1:] == empty for i in (1, 2, 4))
    assert got[3][1:] == (False,) + (None,) * 6


def test_line_ids_of_files_in_many_splits(spark, tmp_path):
    """Ids are line numbers, whatever the splits: lines longer than a split, empty lines, empty files."""
    import random

    from tableguard.sources.logs import read_json_log, read_log_lines

    rng = random.Random(7)
    files = {"a-1.log": [], "a-2.log": ["x" * 5000, "", "", "last"]}
    files["b.log"] = ["".join(rng.choice("abé ") for _ in range(rng.choice([0, 3, 40, 900]))) for _ in range(700)]
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines), encoding="utf-8")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_log_lines(spark, str(tmp_path), with_ids=True)
        assert rows.rdd.getNumPartitions() > 20
        got = sorted((r.id, r.line) for r in rows.collect())
        assert got == [(i + 1, x) for i, x in enumerate(files["a-2.log"] + files["b.log"])]
        each = read_log_lines(spark, str(tmp_path), with_ids=True, per_file=True).where("file_path like '%b.log'")
        assert sorted((r.id, r.line) for r in each.collect()) == [(i + 1, x) for i, x in enumerate(files["b.log"])]
        (tmp_path / "one").mkdir()
        (tmp_path / "one" / "c.log").write_text('{"message":"first"}\n\n{broken\n["list"]\n' + '{"message":"m"}\n' * 400)
        parsed = {r.id: r for r in read_json_log(spark, str(tmp_path / "one")).collect()}
        assert set(parsed) == {1, *range(3, 405)} and parsed[1].message == "first" and not parsed[3].valid and parsed[4].valid
        assert "PythonRDD" not in rows._jdf.queryExecution().toString() and "RDDScan" not in rows._jdf.queryExecution().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_newest_entries_of_a_growing_log(spark, tmp_path):
    """Equal to the batch operator after several micro-batches, a restart with late lines, and a batch run again."""
    import shutil

    from tableguard.operators.logs import latest_entries
    from tableguard.streaming.logs import read_latest, write_latest
    from tableguard.streaming.redact import parquet_stream

    def lines(lo, hi):
        body = F.when(F.col("id") % 5 == 0, "{broken").when(F.col("id") % 7 == 0, "").otherwise(
            F.concat(F.lit('{"message":"m'), F.col("id").cast("string"), F.lit('","context":{"a":null}}')))
        return spark.range(lo, hi).select("id", body.alias("line"))

    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    schema = lines(0, 1)

    def run():
        parsed = parse_log(parquet_stream(spark, src, schema, max_files_per_trigger=1), "id", "line")
        write_latest(parsed, out, ckpt, limit=12, buckets=3)
        return [tuple(r) for r in read_latest(spark, out, parsed, 12).collect()]

    def batch():
        return [tuple(r) for r in latest_entries(parse_log(spark.read.parquet(src), "id", "line"), 12).collect()]

    for lo, hi in ((100, 180), (180, 200), (0, 100)):       # the last ones are older
        lines(lo, hi).coalesce(1).write.mode("append").parquet(src)
    first = run()
    assert first == batch() and len(first) == 12
    before = shutil.copytree(tmp_path / "ckpt", tmp_path / "before")
    lines(200, 230).coalesce(1).write.mode("append").parquet(src)
    second = run()
    assert second == batch() != first
    shutil.copytree(before, tmp_path / "ckpt2")             # as after a crash before the batch was committed
    ckpt = str(tmp_path / "ckpt2")
    assert run() == second == batch()
    assert run() == second                                  # nothing new
