"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the ``SIZE`` smallest distinct 64-bit hashes of a
text's shingles of five words.  Sketches of parts merge into the sketch of the whole
(the smallest of the union), and tell without the texts
* ``resemblance``: the share of shared shingles among all of both,
* ``containment``: the share of one text's shingles that the other has,
* ``distinct_shingles``: how many different shingles there are (exact below SIZE).

``merge_sketches`` merges any number of sketches per group without gathering a group
in one task: distinct hashes are counted per group and leading bits, which gives a
bound below which at least SIZE hashes of the group lie; only those are gathered.

Words are the runs between white space of the lower-cased text; a word's hash, and
the chained hash of five word hashes, are Spark's ``xxhash64``.

Defined results
* Fewer than five words are one shingle; null, empty and blank texts have an empty
  sketch.  Two empty sketches resemble each other fully (1.0), an empty and another
  one not at all.
* Repeated rows are sketched alike; repeated ids stand next to each other in the
  order of their text's hash; null ids come first.  Ids must be numbers.
* An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableguard.llm.common import shuffle_width

SIZE = 128
WIDTH = 5
_LEADING = 52


# -------------------------------------------------------------------- expressions

def sketch(text: Column, size: int = SIZE, width: int = WIDTH) -> Column:
    """Sketch of a text column: sorted array of at most ``size`` hashes."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # bind the word hashes once, then slide over them
    def slide(of: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(of) - (width - 1), F.lit(1)))
        return F.when(F.size(of) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(starts, lambda i: F.xxhash64(F.slice(of, i, F.lit(width)))))

    shingles = F.flatten(F.transform(F.array(hashed), slide))
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, size)


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard likeness of the two shingle sets (0 to 1)."""
    both = merge(a, b, size)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of different shingles."""
    least = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise(F.lit(size - 1.0) / least)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has (0 to 1; an empty a is contained in all)."""
    shared = resemblance(a, b, size) * distinct_shingles(merge(a, b, size), size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, size)))


def as_text(a: Column) -> Column:
    """The sketch as lower-case hex, 16 digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def from_text(text: Column) -> Column:
    """The sketch of such a text."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(0), (F.length(text) / 16 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def signed(i: Column) -> Column:
        high, low = (F.conv(F.substring(text, i * 16 + at, F.lit(8)), 16, 10).cast("long") for at in (1, 9))
        return F.shiftleft(high, 32).bitwiseOR(low)

    return F.transform(places, signed)


# ------------------------------------------------------------------------- tables

def merge_sketches(parts: DataFrame, keys: list[str], sketch_col: str = "sketch", size: int = SIZE) -> DataFrame:
    """One sketch per group: the merge of all its rows' sketches (groups without any hash: empty)."""
    rows = parts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(sketch_col).alias("part"))
    names = [f"k{i}" for i in range(len(keys))]
    hashes = rows.select(*names, F.explode("part").alias("h")).distinct().withColumn("lead", F.shiftright("h", _LEADING))
    counts = hashes.groupBy(*names, "lead").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy(*names).orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0))).filter(F.col("before") < size)
    needed = needed.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("lead").alias("_lead"))
    same = F.col("lead") == F.col("_lead")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    kept = hashes.join(needed, same).groupBy(*names).agg(F.slice(F.sort_array(F.collect_list("h")), 1, size).alias("whole"))
    groups = rows.select(*names).distinct()
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    kept = kept.select(*[F.col(n).alias(f"_{n}") for n in names], "whole")
    return groups.join(kept, same, "left").select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)], F.coalesce("whole", F.array().cast("array<bigint>")).alias(sketch_col))


def _block_of(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most ``value`` (null: none), in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    firsts = F.array(*[F.lit(g[0]) for g in groups])
    group = F.size(F.filter(firsts, lambda b: b <= value))
    inside = F.element_at(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), F.greatest(group, F.lit(1)))
    return F.when(value.isNull() | (group == 0), 0).otherwise((group - 1) * step + F.size(F.filter(inside, lambda b: b <= value)))


def with_next_text(docs: DataFrame, id_col: str, text_col: str, blocks: int | None = None) -> DataFrame:
    """(block, extra, id, hash, text) rows where the row after each, in its block, is the next document.

    Documents are dealt into blocks of neighbouring ids.  The first document of the
    next block (of the first block, after the last) is added at the end of each block
    as an ``extra`` row, so no task needs more than its own blocks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = blocks or 4 * shuffle_width(docs.sparkSession)
    shares = [i / blocks for i in range(1, blocks)]
    found = docs.select(F.percentile_approx(F.col(id_col).cast("long"), shares, 20 * blocks)).first()[0] if shares else None
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("block", _block_of(F.col("id"), sorted(set(found or []))))
    first = rows.groupBy("block").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "hash")).alias("f"))
    order = Window.orderBy("block")  # one row a block
    first = first.select(F.coalesce(F.lag("block").over(order), F.max("block").over(Window.partitionBy())).alias("to"),
                         F.col("f.id").alias("fid"), F.col("f.hash").alias("fhash"))
    extra = rows.join(F.broadcast(first) if blocks <= 100_000 else first, F.col("id").eqNullSafe(F.col("fid")) & (F.col("hash") == F.col("fhash")))
    extra = extra.select(F.col("to").alias("block"), F.lit(1).alias("extra"), "id", "hash", "text").dropDuplicates(["block"])
    return rows.select("block", F.lit(0).alias("extra"), "id", "hash", "text").unionByName(extra)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                      blocks: int | None = None) -> DataFrame:
    """Sketch of every text and of its edited text, and the likeness of each to its neighbours.

    The edited text is the text with its last half of code points replaced by as many
    of the next document's first ones (all, if it has fewer).  ``kept_in_edited`` and
    ``kept_in_next`` estimate the share of the text's shingles that the other text has,
    ``shingles`` how many different ones it has.
    """
    within = Window.partitionBy("block").orderBy("extra", F.col("id").asc_nulls_first(), "hash")
    rows = with_next_text(docs, id_col, text_col, blocks)
    rows = rows.withColumn("next_text", F.lead("text").over(within)).withColumn("n", F.length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("block", "extra", "id", "hash", F.col("n").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.select("block", "extra", "id", "hash", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
                       sketch(F.col("text"), size).alias("sketch"),
                       F.when(F.col("extra") == 0, sketch(F.col("edited"), size)).alias("edited_sketch"))
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(within)).filter("extra = 0")
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "sketch", "edited_sketch",
                       resemblance(F.col("sketch"), F.col("edited_sketch"), size).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("next_sketch"), size).alias("near_next"),
                       containment(F.col("sketch"), F.col("edited_sketch"), size).alias("kept_in_edited"),
                       containment(F.col("sketch"), F.col("next_sketch"), size).alias("kept_in_next"),
                       distinct_shingles(F.col("sketch"), size).alias("shingles"))
