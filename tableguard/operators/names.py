"""Name matching over any table of names: filters, near matches, reports."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableguard.functions.names import (
    NEAR_MATCHES,
    glob_literals,
    glob_regex,
    name_distance,
    name_matches,
    normalize_mode,
    normalize_name,
    part_matches,
)
from tableguard.plans.joins import checked_broadcast
from tableguard.session import written as _written

BLANKS = " \t\n\r\x00\x0b"
GRAM = 3                # least characters of a gram that is counted
KEY_SIZES = [1, 2, GRAM, 4, 6, 8, 12, 16]               # characters of the grams that filters and names meet on
BEGIN_SIZES = [*range(1, 25), 32, 48, 64]               # characters of the beginnings that they meet on in prefix mode
REPORT_DISTANCE = 2     # edits that the report's index covers; filters farther away are scanned for
SCAN_BLOCK = 2000       # far filters compared in one scan of the names
SCAN_SAMPLE = 2000      # names that give far filters their first bound
FAR = 1 << 20           # more edits than any name needs
PARTS = {"canonical": 1, "leaf": 2}     # what a string can be of a name, as bits
FILTER_WORDS = 1 << 19  # words of the filter that keeps keys no target has from being shuffled
FILTER_BITS = 4         # longs of a word, in each of which a key sets a bit


def _filter_struct(flt: str):
    return normalize_name(F.lit(flt))


def match_names(df: DataFrame, col: str, flt: str, mode: str = "contains") -> DataFrame:
    """Rows whose name matches one filter; a blank filter matches everything."""
    mode = normalize_mode(mode)
    if flt.strip(BLANKS) == "":
        return df
    return df.where(name_matches(normalize_name(F.col(col)), _filter_struct(flt), mode))


def _by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for joins that may not broadcast it: written names are many times their size on disk."""
    return df.hint("merge")


def _grams(col: Column, sizes: Iterable[int]) -> Column:
    """``struct(g, pos)`` of every substring of the given sizes; ``pos`` counts from 1."""
    def of(n):
        return F.when(F.char_length(col) >= n, F.transform(F.sequence(F.lit(1), F.char_length(col) - (n - 1)),
                                                           lambda i: F.struct(F.substring(col, i, n).alias("g"), i.alias("pos"))))
    none = F.array().cast("array<struct<g:string,pos:int>>")
    return F.flatten(F.array(*[F.coalesce(of(n), none) for n in sizes])) if sizes else none


def _name_keys(col: Column, mode: str, sizes: Iterable[int]) -> Column:
    """What a name can meet a filter on: its grams, with their place where a match fixes it (prefix)."""
    grams = _grams(col, sizes)
    if mode == "prefix":        # short beginnings only where a name begins
        return F.filter(grams, lambda x: (F.char_length(x["g"]) == GRAM) | (x["pos"] == 1))
    return F.array_distinct(F.transform(grams, lambda x: F.struct(x["g"].alias("g"), F.lit(0).alias("pos"))))


def _filter_keys(col: Column, mode: str) -> Column:
    """Grams that every match of a filter holds, as long as its runs allow; runs shorter than a gram stand for themselves."""
    runs = glob_literals(col) if mode == "glob" else F.array(col)
    sizes = [GRAM] if mode == "prefix" else [n for n in KEY_SIZES if n >= GRAM]

    def of(run):
        grams = F.array(F.struct(run.alias("g"), F.lit(1).alias("pos")))
        for n in sizes:
            grams = F.when(F.char_length(run) >= n, _grams(run, [n])).otherwise(grams)
        return grams if mode == "prefix" else F.transform(grams, lambda x: F.struct(x["g"].alias("g"), F.lit(0).alias("pos")))

    return F.flatten(F.transform(F.filter(runs, lambda r: r != ""), of))


def _sizes(keys: DataFrame, key: str) -> list[int]:
    """The lengths of keys, of which there are few."""
    return sorted(r[0] for r in keys.where(f"{key} IS NOT NULL").select(F.char_length(f"{key}.g")).distinct().collect())


def rarest_keys(names: DataFrame, name: Column, filters: DataFrame, flt: Column, mode: str) -> DataFrame:
    """``filters`` with ``__k`` (g, pos): of the grams that a match must hold, the longest one that fewest names hold.

    Whole grams come before shorter runs, whose frequency is not counted; only grams of
    filters are counted.  ``__k`` is null for a filter without any literal character.
    """
    grams = _written(filters.select("__fid", F.explode(F.array_distinct(_filter_keys(flt, mode))).alias("k")), "match-grams")
    mine = checked_broadcast(grams.where(F.char_length("k.g") >= GRAM).select("k").distinct())
    held = names.select(F.explode(_name_keys(name, mode, [n for n in _sizes(grams, "k") if n >= GRAM])).alias("k"))
    counts = held.join(mine, "k").groupBy("k").agg(F.count(F.lit(1)).alias("__n"))
    ranked = grams.join(counts, "k", "left").groupBy("__fid").agg(F.min_by("k", F.struct(
        -F.char_length("k.g"), F.coalesce("__n", F.lit(0)), "k")).alias("__k"))
    return filters.join(ranked, "__fid", "left")


def begin_keys(filters: DataFrame, flt: Column) -> DataFrame:
    """``filters`` with ``__k`` (g, pos): the longest beginning of a filter of a size that names are cut to."""
    begin = F.lit(None).cast("string")
    for n in BEGIN_SIZES:
        begin = F.when(F.char_length(flt) >= n, F.substring(flt, 1, n)).otherwise(begin)
    return filters.withColumn("__k", F.when(begin.isNotNull(), F.struct(begin.alias("g"), F.lit(1).alias("pos"))))


def match_names_join(names: DataFrame, name_col: str, filters: DataFrame, filter_col: str,
                     mode: str = "contains") -> DataFrame:
    """All (name row, filter row) pairs that match, for many filters at once.

    No pair is tested unless it can match: exact mode joins on the part itself, prefix
    mode on the beginning; in the other modes a filter meets the names that hold its
    *rarest* gram, by a table of the names' gram frequencies.  A pair that matches by its
    canonical name comes from the canonical join, one that matches by its leaf only from
    the leaf join, so nothing is found twice.  Names and filters that are equal when
    normalised are tested once, and their rows are joined to the pairs found.  Globs
    without any literal character are tested against every name, behind a size-checked
    broadcast.  A blank filter is no filter and is left out.
    """
    mode = normalize_mode(mode)
    n = names.withColumn("__n", normalize_name(F.col(name_col)))
    f = filters.where(F.btrim(F.col(filter_col), F.lit(BLANKS)) != F.lit("")).withColumn("__f", normalize_name(F.col(filter_col)))
    out = [*names.columns, *[c for c in filters.columns if c not in names.columns]]
    name = {p: F.col(f"__n.{p}") for p in ("canonical", "leaf")}
    flt = {p: F.col(f"__f.{p}") for p in ("canonical", "leaf")}
    if mode == "exact":
        hit = {p: part_matches(name[p], flt[p], mode) for p in name}
        found = {"canonical": hit["canonical"], "leaf": hit["leaf"] & ~hit["canonical"]}
        return reduce(DataFrame.unionByName, [n.join(f, (name[p] == flt[p]) & found[p]).select(*out) for p in name])
    nd = _written(n.where("__n.canonical IS NOT NULL").select("__n").distinct(), "match-names")
    fd = f.select("__f").distinct()
    if mode == "glob":      # translated once per filter, not once per pair
        fd = fd.withColumn("__r", F.struct(*[glob_regex(flt[p]).alias(p) for p in flt]))
        hit = {p: F.regexp_like(name[p], F.col(f"__r.{p}")) for p in name}
    else:
        hit = {p: part_matches(name[p], flt[p], mode) for p in name}
    fd = _written(fd.withColumn("__fid", F.monotonically_increasing_id()), "match-filters")    # ids are fixed by writing
    keys = [(begin_keys(fd, flt[p]) if mode == "prefix" else rarest_keys(nd, name[p], fd, flt[p], mode)).select("__fid", F.lit(p).alias("__p"), "__k")
            for p in name]
    keys = _written(reduce(DataFrame.unionByName, keys), "match-keys")
    sizes = _sizes(keys, "__k")
    parts = []
    for p, found in (("canonical", hit["canonical"]), ("leaf", hit["leaf"] & ~hit["canonical"])):
        keyed = fd.join(keys.where(F.col("__p") == p), "__fid")
        if mode == "prefix":
            met = F.filter(F.array(*[F.when(F.char_length(name[p]) >= k, F.struct(F.substring(name[p], 1, k).alias("g"), F.lit(1).alias("pos")))
                                     for k in sizes]), lambda x: x.isNotNull())
        else:
            met = _name_keys(name[p], mode, sizes)
        wide = _spread(nd).withColumn("__nk", F.explode(met)) if sizes else nd.limit(0).withColumn("__nk", F.lit(None).cast("struct<g:string,pos:int>"))
        parts.append(wide.join(checked_broadcast(keyed.where("__k IS NOT NULL")), (F.col("__nk") == F.col("__k")) & found))
        if mode == "glob":
            parts.append(nd.join(checked_broadcast(keyed.where("__k IS NULL")), found))
    pairs = reduce(DataFrame.unionByName, [x.select("__n", "__f") for x in parts])
    return (pairs.join(_by_shuffle(f), "__f").join(_by_shuffle(n), "__n")).select(*out)


def near_names(df: DataFrame, name_col: str, type_col: str, target: str, k: int = NEAR_MATCHES) -> DataFrame:
    """The k nearest names to one target; ties by type, then name (byte order).

    A top-k (TakeOrdered): each task keeps its k best, the driver merges them.
    """
    t = _filter_struct(target)
    n = normalize_name(F.col(name_col))
    scored = df.select(F.col(name_col).alias("name"), F.col(type_col).alias("type"),
                       n["canonical"].alias("normalized_name"), name_distance(n, t).alias("score"))
    return scored.orderBy("score", "type", "name").limit(k)


def _spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as the session shuffles to, for costly work per row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _left_keys(s: Column, gone: int) -> Column:
    """Keys of every string left when exactly ``gone`` characters of ``s`` go; it must have as many."""
    def left(u: Column, start: Column, more: int) -> Column:
        def cut(j: Column) -> Column:
            return F.concat(F.substr(u, F.lit(1), j - 1), F.substr(u, j + 1))

        places = F.sequence(start, F.char_length(u) - (more - 1))
        if more == 1:
            return F.transform(places, lambda j: F.xxhash64(cut(j)))
        rest = F.transform(places, lambda j: F.struct(cut(j).alias("u"), j.alias("j")))
        return F.flatten(F.transform(rest, lambda x: left(x["u"], x["j"], more - 1)))

    return left(s, F.lit(1), gone) if gone else F.array(F.xxhash64(s))


def deletion_index(strings: DataFrame, gone: dict[int, set[int]]) -> DataFrame:
    """``strings`` with ``v``: keys of what is left when exactly n characters of ``s`` go, n being those with its length in ``gone[n]``.

    Two strings within d edits have m - d characters in common, in the same order, m being
    the longer one's length; so they become one when the others go, and hardly any strings
    farther apart do, however much all names look alike.  A string of n characters has
    about n^d / d! rows.
    """
    size = F.char_length("s")
    keys = F.array(*[F.when(size.isin(sizes), _left_keys(F.col("s"), n)) for n, sizes in gone.items()]).cast("array<array<bigint>>")
    # a short table makes a long one: its few small partitions are dealt out first
    some = _spread(strings.where(size.isin(set().union(*gone.values()))))
    return some.withColumn("v", F.explode(F.array_distinct(F.flatten(F.filter(keys, lambda x: x.isNotNull())))))


def met_keys(index: DataFrame, keys: DataFrame) -> DataFrame:
    """``index`` without most rows whose ``v`` is not in ``keys``, and with all whose ``v`` is, before they are shuffled.

    A Bloom filter in blocks: a key sets a bit in each of a word's ``FILTER_BITS`` longs.
    The words, broadcast, are at most ``FILTER_WORDS`` (21 MB), however many keys there
    are; above some ten million keys it lets more and more rows through.
    """
    def word(v: Column) -> Column:
        return v.bitwiseAND(F.lit(FILTER_WORDS - 1))

    def place(v: Column, i: int) -> Column:
        return F.shiftrightunsigned(v, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int")

    v = F.col("v")
    bits = keys.select(word(v).alias("__w"), *[F.call_function("shiftleft", F.lit(1).cast("long"), place(v, i)).alias(f"__b{i}") for i in range(FILTER_BITS)])
    words = bits.groupBy("__w").agg(*[F.bit_or(f"__b{i}").alias(f"__b{i}") for i in range(FILTER_BITS)])
    held = index.join(F.broadcast(words), word(v) == F.col("__w"))
    return held.where(reduce(Column.__and__, [F.getbit(F.col(f"__b{i}"), place(v, i)) == 1 for i in range(FILTER_BITS)])).select(*index.columns)


class NearIndex:
    """Names (equal rows once, with their ``copies``) in their order ``__o`` by type and name, and the distinct strings of their parts.

    A string has its first name's place and the sum of the ``PARTS`` that it is of that
    name; it stands twice where its first names as canonical name and as leaf differ.
    """

    def __init__(self, names: DataFrame, name_col: str, type_col: str, distance: int):
        rows = names.groupBy(F.col(name_col).alias("name"), F.col(type_col).alias("type")).agg(F.count(F.lit(1)).alias("copies"))
        self.names = _written(rows.orderBy("type", "name").select("name", "type", normalize_name(F.col("name")).alias("__n"), "copies",
                                                                  F.monotonically_increasing_id().alias("__o")), "near-names")
        first = self._parts(self.names, "__n").groupBy("s").agg(*[F.min(F.when(F.col("__p") == bit, F.col("__o"))).alias(p) for p, bit in PARTS.items()])
        one = F.array(F.struct(F.col("leaf").alias("__o"), F.lit(sum(PARTS.values())).alias("__p")))
        each = F.array(*[F.when(F.col(p).isNotNull(), F.struct(F.col(p).alias("__o"), F.lit(bit).alias("__p"))) for p, bit in PARTS.items()])
        entries = F.when(F.col("canonical") == F.col("leaf"), one).otherwise(F.filter(each, lambda x: x.isNotNull()))
        self.strings = _written(first.select("s", F.inline(entries)), "near-strings")
        self.distance = distance

    @staticmethod
    def _parts(rows: DataFrame, col: str) -> DataFrame:
        parts = F.array(*[F.struct(F.col(f"{col}.{p}").alias("s"), F.lit(bit).alias("__p")) for p, bit in PARTS.items()])
        return rows.select("*", F.inline(parts)).where("s IS NOT NULL")

    def _met(self, targets: DataFrame, distance: int) -> DataFrame:
        """(__t, __s, __o, __p): strings of targets and names that meet on a deletion, with the parts that they are of both."""
        wanted = self._parts(targets, "__f").groupBy("s").agg(F.bit_or("__p").alias("__q"))
        sizes, known = ({r[0] for r in x.select(F.char_length("s")).distinct().collect()} for x in (wanted, self.strings))   # few
        less, gone = {}, {}
        for n in sizes:
            for m in known.intersection(range(n - distance, n + distance + 1)):
                common = max(0, max(n, m) - distance)
                less.setdefault(n - common, set()).add(n)
                gone.setdefault(m - common, set()).add(m)
        mine = deletion_index(wanted, less)
        theirs = met_keys(deletion_index(self.strings, gone), mine).withColumnRenamed("s", "__s")
        met = mine.withColumnRenamed("s", "__t").join(_by_shuffle(theirs), "v")
        return met.select("__t", "__s", "__o", F.col("__p").bitwiseAND(F.col("__q")).alias("__p")).where("__p > 0")

    def candidates(self, targets: DataFrame) -> DataFrame:
        """(__t, __s): target and name strings that meet on a deletion, each pair once."""
        return self._met(targets, self.distance).select("__t", "__s").distinct()

    def _nearest(self, targets: DataFrame, k: int) -> DataFrame:
        """(__t, __p, __s): of the strings near a target string in a part, the k first ones by distance and by their first names.

        Pairs that meet are measured where they meet, so only near ones are shuffled.  One
        edit is looked for first; only targets still short of k go on to the next.
        """
        pending = _written(targets.select("__f").distinct(), "near-wanted")
        parts = []
        for distance in range(min(1, self.distance), self.distance + 1):
            near = self._met(pending, distance).withColumn("__d", F.levenshtein("__t", "__s", distance)).where("__d >= 0").distinct()
            each = near.withColumn("__p", F.explode(F.filter(F.array(*map(F.lit, PARTS.values())), lambda p: F.col("__p").bitwiseAND(p) > 0)))
            ranked = each.withColumn("__r", F.row_number().over(Window.partitionBy("__t", "__p").orderBy("__d", "__o"))).where(F.col("__r") <= k)
            found = _written(ranked.select("__t", "__p", "__s"), "near-pairs")
            parts.append(found)
            if distance < self.distance:
                full = found.groupBy("__t", "__p").count().where(F.col("count") >= k)
                for p, bit in PARTS.items():
                    enough = full.where(F.col("__p") == bit).select("__t")
                    pending = pending.join(_by_shuffle(enough), F.col(f"__f.{p}") == F.col("__t"), "left_anti")
                pending = _written(pending, "near-wanted")
        return reduce(DataFrame.unionByName, parts)

    def pairs(self, targets: DataFrame, k: int) -> DataFrame:
        """(target row, name row, score) within ``distance`` edits by canonical name or leaf, once each.

        ``targets`` has the normalised target in ``__f``.  Every target keeps its k best
        names, and few others: a name that is not among the first k of its string, or whose
        string is not among the first k near to the target's (:meth:`_nearest`), has k others
        before it, by that part.
        """
        found = self._nearest(targets, k)
        wanted = targets.select("__f").distinct()
        parts = []
        for p, bit in PARTS.items():
            rows = self.names.select("*", F.col(f"__n.{p}").alias("__s")).where("__s IS NOT NULL")
            first = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__s").orderBy("__o"))).where(F.col("__r") <= k)
            near = found.where(F.col("__p") == bit).select("__t", "__s").distinct()
            parts.append(wanted.join(_by_shuffle(near), F.col(f"__f.{p}") == F.col("__t")).join(_by_shuffle(first), "__s"))
        apart = [F.levenshtein(F.col(f"__f.{p}"), F.col(f"__n.{p}"), self.distance) for p in PARTS]
        score = F.least(*[F.when(d >= 0, d) for d in apart])
        scored = parts[0].unionByName(parts[1]).select("__f", "name", "type", "__n", "copies", score.alias("score")).distinct()
        return targets.join(_by_shuffle(scored), "__f")


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of every ``__tid`` with their ``rank``; equal names come as often as they have ``copies``."""
    w = Window.partitionBy("__tid").orderBy("score", "type", "name")
    each = (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("rank", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int")))))
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("copies")


def near_names_join(names: DataFrame, name_col: str, type_col: str, targets: DataFrame, target_col: str,
                    k: int = NEAR_MATCHES, max_distance: int = 2) -> DataFrame:
    """For every target, its k nearest names within ``max_distance`` edits.

    Candidates come from a :func:`deletion_index`; only the first k near strings of a
    target's parts reach the window per target.  Targets that occur more than once are
    looked up once.
    """
    index = NearIndex(names, name_col, type_col, max_distance)
    targets = targets.select(F.col(target_col).alias("target"))
    t = _written(targets.distinct().select("target", normalize_name(F.col("target")).alias("__f"),
                                           F.monotonically_increasing_id().alias("__tid")), "near-targets")
    scored = index.pairs(t, k).select(
        "target", "name", "type", F.col("__n.canonical").alias("normalized_name"), "score", "__tid", "copies")
    best = _best(scored, k).select("target", "name", "type", "normalized_name", "score", F.col("rank").cast("int").alias("rank"))
    return targets.join(_by_shuffle(best), "target")


def _scan_pairs(names: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(__tid, name, type, __n, copies, score) of names that may be among the k nearest of targets far from all names.

    A bound for each target, its k-th distance among ``SCAN_SAMPLE`` names, stops most
    distances early.  Targets are taken in blocks, each sent whole to a scan of the names.
    """
    some = F.broadcast(names.orderBy(F.xxhash64("name", "type")).limit(SCAN_SAMPLE).select("name", "type", "__n"))
    near = _spread(targets).join(some).select("__tid", name_distance(F.col("__n"), F.col("__f")).alias("d"))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("__tid").orderBy("d"))).where(F.col("r") <= k)
    bounds = best.groupBy("__tid").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("__ub"))
    far = F.greatest(F.char_length("__f.canonical"), F.char_length("__f.leaf")) + FAR
    bounded = _written(targets.join(bounds, "__tid").select("__tid", "__f", F.coalesce("__ub", far).alias("__ub"),
                                                            F.pmod(F.xxhash64("__tid"), F.lit(1 << 16)).alias("__h")), "scan-targets")
    blocks = max(1, -(-bounded.count() // SCAN_BLOCK))
    names = _spread(names)
    parts = []
    for b in range(blocks):
        block = bounded.where((F.col("__h") % blocks) == b)
        apart = [F.expr(f"levenshtein(__f.{p}, __n.{p}, __ub)") for p in ("canonical", "leaf")]
        pairs = names.join(F.broadcast(block), F.least(*[F.abs(F.char_length(f"__f.{p}") - F.char_length(f"__n.{p}")) for p in ("canonical", "leaf")]) <= F.col("__ub"))
        scored = pairs.withColumn("score", F.least(*[F.when(d >= 0, d) for d in apart])).where("score IS NOT NULL")
        parts.append(scored.select("__tid", "name", "type", "__n", "copies", "score"))
    return reduce(DataFrame.unionByName, parts)


def no_match_report(names: DataFrame, name_col: str, type_col: str, filters: DataFrame, filter_col: str,
                    k: int = NEAR_MATCHES) -> DataFrame:
    """For every non-blank filter with no exact match: status and its k nearest names.

    ``(filter, status, canonical, leaf, names_tried, rank, name, type, normalized_name)``.
    Filters near to names (mistyped ones) get theirs from a deletion index: all names
    within ``REPORT_DISTANCE`` edits are found, so a filter with k hits has its k best.
    Filters still short of k are farther from the names; they are compared with all of
    them in bounded blocks (:func:`_scan_pairs`), and each task keeps k names per filter
    only.
    """
    index = NearIndex(names, name_col, type_col, REPORT_DISTANCE)
    n = index.names
    f = (filters.where(F.btrim(F.col(filter_col), F.lit(BLANKS)) != F.lit(""))
         .select(F.col(filter_col).alias("filter"), normalize_name(F.col(filter_col)).alias("__f")))
    nc = _by_shuffle(n.select(F.col("__n.canonical").alias("__key")).distinct())
    nleaf = _by_shuffle(n.select(F.col("__n.leaf").alias("__key")).distinct())
    unmatched = _written(f.join(nc, F.col("__f.canonical") == F.col("__key"), "left_anti")
                 .join(nleaf, F.col("__f.leaf") == F.col("__key"), "left_anti")
                 .dropDuplicates(["filter"])
                 .withColumn("__tid", F.monotonically_increasing_id()), "report-filters")

    def best(scored: DataFrame) -> DataFrame:
        rows = scored.select("__tid", "name", "type", F.col("__n.canonical").alias("normalized_name"), "score", "copies")
        return _written(_best(rows, k), "report-best")

    wanted = unmatched.select("__tid", "__f")
    top = best(index.pairs(wanted, k))
    done = top.groupBy("__tid").count().where(F.col("count") >= k).select("__tid")
    found = [top.join(_by_shuffle(done), "__tid", "left_semi")]
    pending = _written(wanted.join(_by_shuffle(done), "__tid", "left_anti"), "report-pending")
    if not pending.isEmpty():
        found.append(best(_scan_pairs(n, pending, k)))
    report = unmatched.select(
        "__tid", "filter", F.lit("no_exact_match").alias("status"),
        F.col("__f.canonical").alias("canonical"), F.col("__f.leaf").alias("leaf"),
        F.when(F.col("__f.canonical") == F.col("__f.leaf"), F.array(F.col("__f.canonical")))
        .otherwise(F.array(F.col("__f.canonical"), F.col("__f.leaf"))).alias("names_tried"))
    return (report.join(_by_shuffle(reduce(DataFrame.unionByName, found)), "__tid", "left")
            .select("filter", "status", "canonical", "leaf", "names_tried",
                    F.col("rank").cast("int").alias("rank"), "name", "type", "normalized_name"))


def distinct_names(df: DataFrame, col: str) -> DataFrame:
    """Non-blank names, each once."""
    return (df.select(col).where(F.btrim(F.col(col), F.lit(" \t\n\r\x00\x0b")) != F.lit(""))
            .dropDuplicates([col]))


def filter_with_children(parents: DataFrame, parent_col: str, children: DataFrame, child_parent_col: str,
                         child_col: str, flt: str, mode: str = "contains") -> DataFrame:
    """Parents that match or have a matching child; their children to show.

    All children of a matching parent (or of every parent for a blank filter);
    otherwise only the matching children.  ``(parent, child)``; a kept parent
    without children to show appears once with a null child.
    """
    mode = normalize_mode(mode)
    blank = flt.strip() == ""
    p = parents.select(F.col(parent_col).alias("parent"))
    c = children.select(F.col(child_parent_col).alias("parent"), F.col(child_col).alias("child"))
    if blank:
        pm = p.withColumn("__pm", F.lit(True))
        cm = c.withColumn("__cm", F.lit(True))
    else:
        fs = _filter_struct(flt)
        pm = p.withColumn("__pm", name_matches(normalize_name(F.col("parent")), fs, mode))
        cm = c.withColumn("__cm", name_matches(normalize_name(F.col("child")), fs, mode))
    any_child = cm.groupBy("parent").agg(F.max("__cm").alias("__any"))
    kept = (pm.join(any_child, "parent", "left")
            .where(F.col("__pm") | F.coalesce(F.col("__any"), F.lit(False))))
    shown = kept.join(cm, "parent", "left").where(
        F.col("child").isNull() | F.col("__pm") | F.col("__cm"))
    return shown.select("parent", "child")
