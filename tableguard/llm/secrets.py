"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are matches of fixed patterns.  Each candidate's value is hashed, and over
the whole corpus each hash is counted by distinct repositories (rows by owner, id and
text) and distinct owners.  Copies of one text are one vote, for one of its owners
(chosen by hash), so a document copied far and wide does not make an example of the
credential in it.  A value is a widely copied example if its votes come from more owners
than ``max_owners`` and ``OWNER_SHARE`` of all owners, and no owner has over ``TOP_SHARE``
of them; any other value that looks like a credential is owner-specific and taken as
live.  Live values add a span of kind ``live`` over the value itself.

The value of a private key is its body: all between the BEGIN and the END line, or,
where no END line follows, the encapsulated headers and the base64 run after BEGIN.
Its hash leaves out blanks, line ends (written as ``\\n`` too) and other marks that a
copy may be wrapped with.  A BEGIN line without a body is a span, but never live.

Positions are found without any per-character work in the plan: the text between
matches and the matches themselves are split off by the same pattern, and the start
of a match is the length of all that stands before it, by running sums in blocks, so
the work of a row is linear in its matches.

Skew: counts are grouped in steps (hash and repository, hash and text, hash and owner,
then hash), so a value copied into a third of all rows meets as one partial row per task.
Values with a thousandth of all spans or more, at most 1,000 values, get their class by
broadcast and all others by shuffle, so no join key is hot.

Defined results
* Null texts are empty and hold nothing; a null owner or repository is one owner.
* Repeated rows come back as often as given; they are one repository.
* Whole texts are read, also those of many megabytes or with very many matches; a row's
  spans must fit in memory, as its text must.
* An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableguard.functions.sums import let, running_max, running_sum
from tableguard.llm.common import written
from tableguard.operators.spans import apply_spans

# --- fixed patterns: kind, expression, value group, least length of the value, a cheap
#     condition that every text with a match meets
_END_LINE = r"-----END [A-Z ]{0,30}PRIVATE KEY-----"
_WRAP = r"""(?:[\s>|#*"',]|\\+[rnt])*+"""
_RUN = r"(?:[A-Za-z0-9+/]|\\+/)"
_KEY_BODY = (r"(?:(?!-----)[\s\S])*+(?=" + _END_LINE + ")"
             r"|(?:" + _WRAP + r"(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:" + _WRAP + _RUN + r"{16,}+={0,2})*+"
             r"(?:(?<=[A-Za-z0-9+/])" + _WRAP[:-2] + "++" + _RUN + r"{1,15}+={0,2}(?=[\x20\t]*+(?:[\r\n\\]|$)))?")
BASE_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, r"[:=]"),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 16, r"AKIA"),
    ("hex", r"([0-9a-f]{32,})", 1, 32, r"[0-9a-f]{32}"),
)
EXTRA_KINDS = (
    ("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40, r"gh[pousr]_"),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 28, r"eyJ"),
    ("private", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(" + _KEY_BODY + ")(" + _END_LINE + ")?", 1, 0, r"PRIVATE KEY"),
)
#: kinds with a second group, which stands after the value
TAILED = {"private"}
KINDS = BASE_KINDS + EXTRA_KINDS
PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|your|xxxx|1234567|password|test)"

MAX_OWNERS = 2
OWNER_SHARE = 0.001
TOP_SHARE = 0.5
MIN_DISTINCT = 6
#: values with at least this share of all spans are joined by broadcast (at most 1 / HOT of them)
HOT = 0.001

def _matches(text: Column, rank: int, kind: str, pattern: str, group: int, least: int, gate: str) -> Column:
    """All matches of one pattern: whole, value, what stands after the value, the pieces before them; null without any."""
    def groups(g: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    def found(whole: Column) -> Column:
        tails = groups(group + 1) if kind in TAILED else F.transform(whole, lambda w: F.lit(""))
        return F.when(F.size(whole) > 0, F.struct(
            F.lit(rank).alias("rank"), whole.alias("whole"), groups(group).alias("value"), tails.alias("tail"),
            F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("piece")))

    return F.when(text.rlike(gate), let(groups(0), found))


def _spans(found: Column) -> Column:
    """Spans of one pattern's matches, in order, those with too short a value dropped."""
    rank = found["rank"]
    kinds, least = F.array(*[F.lit(k[0]) for k in KINDS]), F.array(*[F.lit(k[3]) for k in KINDS])

    def listed(sizes: Column, before: Column) -> Column:
        def span(size: Column, i: Column) -> Column:
            value, end = F.get(found["value"], i), F.get(before, i) + size
            vend = end - F.length(F.get(found["tail"], i))
            hashed = F.when(F.get(kinds, rank) == "private", F.regexp_replace(value, r"\\+[rnt]|[^A-Za-z0-9+/=]", "")).otherwise(value)
            return F.struct((end - F.length(F.get(found["whole"], i))).cast("long").alias("start"), rank.alias("rank"), F.get(kinds, rank).alias("kind"),
                            end.cast("long").alias("end"), (vend - F.length(value)).cast("long").alias("vstart"), vend.cast("long").alias("vend"),
                            hashed.alias("value"))

        return F.filter(F.transform(sizes, span), lambda s: s["vend"] - s["vstart"] >= F.get(least, s["rank"]))

    # a match, with the piece before it, begins where those before it end
    sizes = F.zip_with(found["piece"], found["whole"], lambda p, w: F.length(p) + F.length(w))
    return let(sizes, lambda z: let(running_sum(z), lambda at: listed(z, at)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """(id, owner, text_hash, spans) per row; ``spans`` sorted by start, then by kind as listed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), text.alias("text"))
    found = F.filter(F.array(*[_matches(F.col("text"), rank, *spec) for rank, spec in enumerate(KINDS)]), lambda x: x.isNotNull())
    spans = F.array_sort(F.flatten(F.transform(found, _spans)))
    return rows.select("id", "owner", F.xxhash64("text").alias("text_hash"), spans.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """Per distinct value: its hash, how many distinct repositories, texts and owners hold it, and the largest owner's texts."""
    each = found.filter(F.size("spans") > 0).select("id", "owner", "text_hash", F.explode("spans").alias("s"))
    held = each.groupBy(F.sha2("s.value", 256).alias("value_hash"), "text_hash", "owner", "id").agg(
        F.count(F.lit(1)).alias("spans"), F.min(_looks_live(F.col("s.kind"), F.col("s.value"))).alias("shape"))
    # all copies of a text are one vote, for one of its owners
    voter = F.min_by("owner", F.xxhash64("text_hash", "owner"))
    votes = held.groupBy("value_hash", "text_hash").agg(
        voter.alias("owner"), F.count(F.lit(1)).alias("repos"), F.sum("spans").alias("spans"), F.min("shape").alias("shape"))
    per_owner = votes.groupBy("value_hash", "owner").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("repos").alias("repos"), F.sum("spans").alias("spans"), F.min("shape").alias("shape"))
    return per_owner.groupBy("value_hash").agg(
        F.sum("repos").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.sum("texts").alias("texts"),
        F.max("texts").alias("top"), F.sum("spans").alias("spans"), F.min("shape").alias("shape"))


def _looks_live(kind: Column, value: Column) -> Column:
    """A credential's shape: enough different characters, no placeholder word."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT
    # a key's body is long enough to hold such a word by chance
    return varied & ((kind == "private") | ~value.rlike(PLACEHOLDER))


def classify(found: DataFrame, max_owners: int = MAX_OWNERS, owner_share: float = OWNER_SHARE, top_share: float = TOP_SHARE) -> DataFrame:
    """``ownership`` with a class: ``example`` (widely copied), ``live`` or ``plain``."""
    least = max(max_owners, owner_share * found.select("owner").distinct().count())
    copied = (F.col("owners") > least) & (F.col("top") <= top_share * F.col("texts"))
    return ownership(found).withColumn("class", F.when(copied, "example").when(F.col("shape"), "live").otherwise("plain"))


def _with_class(each: DataFrame, classes: DataFrame, hot: float = HOT) -> DataFrame:
    """Spans with the class of their value; ``classes`` is a written table with one row per value."""
    total = classes.agg(F.sum("spans")).first()[0] or 0
    often = F.col("spans") >= hot * total
    keys = classes.select("value_hash", "class", "owners", "repositories", "spans")
    few = keys.filter(often).drop("spans")       # at most 1 / hot rows
    rare = each.join(F.broadcast(few.select("value_hash")), "value_hash", "left_anti")
    return each.join(F.broadcast(few), "value_hash").unionByName(rare.join(keys.filter(~often).drop("spans"), "value_hash"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per input row: id, text_hash, spans; each span with its value's class."""
    found = written(candidates(docs, id_col, text_col, owner_col), "secret-candidates")
    classes = written(classify(found, max_owners), "secret-classes", rows=found.agg(F.sum(F.size("spans"))).first()[0] or 0)
    with_any = found.filter(F.size("spans") > 0).select("id", "text_hash", "spans").dropDuplicates(["id", "text_hash"])
    each = with_any.select("id", "text_hash", F.explode("spans").alias("s")).withColumn("value_hash", F.sha2("s.value", 256))
    spans = _with_class(each, classes).groupBy("id", "text_hash").agg(F.array_sort(F.collect_list(F.struct(
        F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"),
        F.col("s.vstart").alias("vstart"), F.col("s.vend").alias("vend"), "class", "owners", "repositories"))).alias("spans"))
    spans = spans.select(F.col("id").alias("i"), F.col("text_hash").alias("h"), "spans")
    rows = found.select("id", "text_hash")
    return (rows.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left")
            .select(F.col("id").alias(id_col), "text_hash", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,rank:int,"
                    "kind:string,end:bigint,vstart:bigint,vend:bigint,class:string,owners:bigint,repositories:bigint>>)")).alias("spans")))


def _apart(ranges: Column) -> Column:
    """Sorted ranges without what an earlier one covers."""
    def clipped(r: Column, ends: Column) -> Column:
        cut = F.transform(r, lambda x, i: F.struct(F.greatest(x["start"], F.get(ends, i)).alias("start"), x["end"].alias("end"), F.get(ends, i).alias("at")))
        return F.filter(cut, lambda x: x["end"] > x["at"])

    return let(F.array_sort(ranges), lambda r: let(running_max(F.transform(r, lambda x: x["end"])), lambda ends: clipped(r, ends)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
           max_owners: int = MAX_OWNERS) -> DataFrame:
    """``docs`` with every live value replaced by ``[SECRET]``; all rows and columns stay."""
    live = scan(docs, id_col, text_col, owner_col, max_owners).select(
        F.col(id_col).alias("i"), F.col("text_hash").alias("h"),
        F.expr("transform(filter(spans, s -> s.class = 'live'), s -> struct(int(s.vstart) AS start, int(s.vend) AS end))").alias("live"))
    live = written(live.filter(F.size("live") > 0).dropDuplicates(["i", "h"]), "secret-live", rows=docs.count())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    joined = rows.join(live, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left")
    cut = let(_apart(F.col("live")), lambda spans: apply_spans(F.col("text"), spans, lambda s: F.lit("[SECRET]")))
    fixed = joined.withColumn("cut", F.when(F.col("live").isNotNull(), cut))
    return fixed.select(*[(F.coalesce(F.col("cut"), F.col(f"row.`{c}`")) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """The scan's counts, base digest and span list per row."""
    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    rows = scan(docs, id_col, text_col, owner_col)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    live = F.expr(f"transform(filter(spans, s -> s.class = 'live'), s -> struct(s.vstart AS start, {len(KINDS)} AS rank, 'live' AS kind, s.vend AS end))")
    # sorted, so that equal spans are neighbours (``array_distinct`` would compare all pairs of structs)
    every = let(F.array_sort(F.concat(F.transform("spans", lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"])), live)),
                lambda a: F.filter(a, lambda s, i: (i == 0) | (s != F.get(a, F.greatest(i - 1, F.lit(0))))))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k, *_ in BASE_KINDS]
    return rows.select(id_col, *counts, F.sha2(F.encode(listed(base), "utf-8"), 256).alias("base_sha256"), listed(every).alias("spans"))
