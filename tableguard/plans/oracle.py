"""DuckDB SQL that computes the same results as our Spark operators.

Used only to build ``oracle_sql()`` entries: the driver runs these strings in
DuckDB on the same parquet tables and compares results.  DuckDB reads the
patterns with RE2; they are written in the common subset (see
``pii_patterns``).  Lambdas use DuckDB's ``lambda x: ...`` form.
"""

from __future__ import annotations

from tableguard.functions.pii_labels import DEFAULT_THRESHOLD, GROUP_OF, validate_labels
from tableguard.functions.pii_patterns import (
    SCORE_CHECK_FAIL,
    SCORE_CHECK_PASS,
    Detector,
    detectors_for,
)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def duck_check(v: str, check: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    digit = f"CAST(reverse({d})[__k] AS INTEGER)"
    total = (f"list_sum(list_transform(range(1, length({d}) + 1), lambda __k: "
             f"CASE WHEN __k % 2 = 0 THEN 2 * {digit} - CASE WHEN {digit} >= 5 THEN 9 ELSE 0 END ELSE {digit} END))")
    if check == "card":
        return f"(length({d}) <= 19 AND {total} % 10 = 0)"
    if check == "imei":
        return f"(length({d}) = 15 AND {total} % 10 = 0)"
    if check == "vin":
        return f"(length({v}) = 17 AND regexp_matches({v}, '[A-Z]') AND regexp_matches({v}, '[0-9]'))"
    raise ValueError(check)


def duck_score(d: Detector, v: str) -> str:
    if d.check is None:
        return f"CAST({d.score} AS DOUBLE)"
    return f"CASE WHEN {duck_check(v, d.check)} THEN {SCORE_CHECK_PASS} ELSE {SCORE_CHECK_FAIL} END"


def duck_spans_select(table: str, id_col: str, text_col: str, d: Detector) -> str:
    """One detector's spans: (id, start, end, label, score, value), offsets 0-based."""
    p = q(d.pattern)
    v = f"__v[__i]" if d.group else "__m[__i]"
    start = (f"(coalesce(list_sum(list_transform(list_slice(__p, 1, __i), lambda __x: length(__x))), 0)"
             f" + coalesce(list_sum(list_transform(list_slice(__m, 1, __i - 1), lambda __y: length(__y))), 0)"
             f" + length(__m[__i]) - length({v}))")
    struct = (f"{{'start': CAST({start} AS INTEGER), 'end': CAST({start} + length({v}) AS INTEGER), "
              f"'score': {duck_score(d, v)}, 'value': {v}}}")
    vals = f"regexp_extract_all({text_col}, {p}, {d.group})" if d.group else "NULL"
    return (f"SELECT {id_col}, __s['start'] AS start, __s['end'] AS \"end\", {q(d.label)} AS label, "
            f"__s['score'] AS score, __s['value'] AS value FROM ("
            f"SELECT {id_col}, unnest(list_transform(range(1, len(__m) + 1), lambda __i: {struct})) AS __s "
            f"FROM (SELECT {id_col}, regexp_extract_all({text_col}, {p}, 0) AS __m, "
            f"{vals} AS __v, string_split_regex({text_col}, {p}) AS __p "
            f"FROM {table} WHERE {text_col} IS NOT NULL) WHERE len(__m) > 0)")


def duck_spans(table: str, id_col: str, text_col: str, labels=None) -> str:
    dets = detectors_for(validate_labels(labels))
    return "\nUNION ALL\n".join(duck_spans_select(table, id_col, text_col, d) for d in dets)


def duck_redact_ctes(source: str, cols: list[str], labels=None,
                     threshold: float = DEFAULT_THRESHOLD, prefix: str = "r") -> tuple[str, str]:
    """CTEs that redact ``cols`` of ``source``; returns (cte_sql, last_cte_name).

    Per cell: all spans at or above the threshold; the better one of two that
    overlap stays (higher score, then longer, earlier, label order); the pieces
    between the kept spans are joined with their tokens.
    """
    ctes = [f"{prefix}base AS (SELECT row_number() OVER () AS __rid, * FROM {source})"]
    done = []
    for k, c in enumerate(cols):
        spans = duck_spans(f"(SELECT __rid, {c} AS __t FROM {prefix}base)", "__rid", "__t", labels)
        ctes.append(f"{prefix}s{k} AS (SELECT __rid, list({{'s': start, 'e': \"end\", 'l': label}} "
                    f"ORDER BY -score, start - \"end\", start, label) AS ss FROM ({spans}) "
                    f"WHERE score >= {threshold} AND start < \"end\" GROUP BY __rid)")
        ctes.append(f"{prefix}k{k} AS (SELECT __rid, list_sort(list_reduce(list_transform(ss, lambda a: [a]), lambda kept, x: "
                    f"CASE WHEN len(list_filter(kept, lambda o: o.s < x[1].e AND x[1].s < o.e)) > 0 THEN kept ELSE kept || x END)) AS kk "
                    f"FROM {prefix}s{k})")
        before = "CASE WHEN i = 1 THEN 0 ELSE kk[i - 1].e END"
        done.append(f"CASE WHEN {prefix}k{k}.kk IS NULL THEN b.{c} ELSE array_to_string(list_transform(range(1, len({prefix}k{k}.kk) + 1), "
                    f"lambda i: substr(b.{c}, {before.replace('kk', f'{prefix}k{k}.kk')} + 1, {prefix}k{k}.kk[i].s - {before.replace('kk', f'{prefix}k{k}.kk')}) "
                    f"|| '[REDACTED_' || {prefix}k{k}.kk[i].l || ']'), '') || substr(b.{c}, {prefix}k{k}.kk[len({prefix}k{k}.kk)].e + 1) END AS {c}")
    joins = " ".join(f"LEFT JOIN {prefix}k{k} ON b.__rid = {prefix}k{k}.__rid" for k in range(len(cols)))
    ctes.append(f"{prefix}out AS (SELECT b.* EXCLUDE (__rid) REPLACE ({', '.join(done)}) FROM {prefix}base b {joins})")
    return ",\n".join(ctes), f"{prefix}out"


def duck_group_map(labels=None) -> str:
    """CASE expression label -> group."""
    labels = validate_labels(labels)
    whens = " ".join(f"WHEN {q(x)} THEN {q(GROUP_OF[x])}" for x in labels)
    return f"CASE label {whens} END"
