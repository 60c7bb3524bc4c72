"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1.  For each codeword position a binary
classifier over character n-grams tells the languages with +1 there from those with
-1.  Decoding is loss-weighted: for each language the classifiers' logistic losses
against its codeword are summed, each weighted by how well that classifier does on
that language's training rows, and the language with the least loss wins.

Features are hashed character n-grams (n = 1, 2, 3) of the lower-cased letters;
everything that is not a letter is one blank.  Only the text enters a prediction.

Evidence: every text has one classifier output, known language or not, so a second
measure says whether the text is in a learned language at all.  It is the mean, over
the n-grams that hold a letter, of log(1 + c / UNSEEN), where c is how often the
language's training rows hold the n-gram: 0 if none was ever seen.  Each training row is
measured so without its own counts; a language's floor is ``FLOOR`` of the value that
all but ``TAIL`` of its rows reach.  ``evidence`` is the value less the floor, for the
language found or, if that is negative, for the language where it is largest.

Training reads a bounded sample: about ``PER_LANGUAGE`` rows of each language, chosen
by a hash of all given columns (with the id among them copies of a text are chosen one
by one), whole texts, one row of each language at least.  At most ``MAX_LANGUAGES`` languages are learned
(more is an error), so the model that is broadcast has a fixed bound:
``BUCKETS`` x (code length + languages) floats.

Defined results
* Null texts and texts without a letter: ``und``, score 0, evidence null.
* Nothing to learn from: every text is ``und``, evidence 0 if it has a letter (nothing
  speaks against it); one language only: that
  language, score 1.
* ``score`` is 1 - least loss / second least loss: 0 is a tie, and ties go to the
  language that sorts first.  ``ambiguous`` marks scores below ``AMBIGUOUS``.
* Repeated rows count as often as given; an empty table gives no rows; extra columns
  pass through untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableguard.llm.common import map_batches, written

UNDETERMINED = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 10_000
MAX_LANGUAGES = 256
AMBIGUOUS = 0.1
SHARPNESS = 4.0
UNSEEN = 0.5
TAIL = 0.01
FLOOR = 2 / 3
_SLICE = 1 << 18


# ---------------------------------------------------------------------- features

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or a blank (built once per worker)."""
    if not _LETTERS:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (char := chr(c)).isalpha():
                table[c] = ord(char.lower()[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def _codes(text: str) -> np.ndarray:
    """The text's letters and blanks, with a blank at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.full(len(points) + 2, 32, np.uint32)
    out[1:-1] = _letters()[points]
    return out


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of each n-gram of ``codes`` (multiplicative hash in 32 bits)."""
    n = max(0, len(codes) - order + 1)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ codes[k:k + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _slices(codes: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Buckets of one order over pieces of a text, every n-gram once."""
    for at in range(0, max(0, len(codes) - order + 1), _SLICE):
        yield _buckets(codes[at:at + _SLICE + order - 1], order)


def _lettered(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the n-grams that hold a letter, every n-gram once, in pieces."""
    letter = codes != 32
    for order in ORDERS:
        for at in range(0, max(0, len(codes) - order + 1), _SLICE):
            b = _buckets(codes[at:at + _SLICE + order - 1], order)
            holds = np.zeros(len(b), bool)
            for k in range(order):
                holds |= letter[at + k:at + k + len(b)]
            yield b[holds]


# ------------------------------------------------------------------------- codes

def codewords(n: int) -> np.ndarray:
    """n codewords (rows of +1 and -1): exhaustive up to six languages, else pseudo-random
    columns, the best of 32 fixed draws by least distance between rows."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 6:
        columns = [[1 if b else -1 for b in bits] for bits in itertools.product((True, False), repeat=n)]
        return np.array([c for c in columns if c[0] == 1 and -1 in c], np.int8).T
    length, best = max(15, int(np.ceil(12 * np.log2(n)))), None
    for draw in range(32):
        columns, seen = [], set()
        for k in itertools.count():
            column = tuple(1 if xxhash.xxh64_intdigest(f"{draw}:{k}:{i}") & 1 else -1 for i in range(n))
            if abs(sum(column)) < n and column not in seen and tuple(-c for c in column) not in seen:
                seen.add(column)
                columns.append(column)
                if len(columns) == length:
                    break
        matrix = np.array(columns, np.int8).T
        least = min(int((matrix[i] != matrix[j]).sum()) for i in range(n) for j in range(i))
        if best is None or least > best[0]:
            best = least, matrix
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x code length
    scale: np.ndarray  # code length
    trust: np.ndarray  # languages x code length, rows sum to 1
    seen: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS), np.float32))  # languages x buckets: log(1 + c / UNSEEN)
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))  # languages

    def margins(self, codes: np.ndarray) -> np.ndarray:
        """Mean log-odds of the text's n-grams for every codeword position."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for order in ORDERS:
            for b in _slices(codes, order):
                total += self.weights[b].sum(axis=0, dtype=np.float64)
                n += len(b)
        return total / max(n, 1)

    def decode(self, margins: np.ndarray) -> tuple[str, float]:
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        signed = self.code * (margins / self.scale) * SHARPNESS
        loss = (self.trust * np.logaddexp(0, -signed)).sum(axis=1)
        best = int(np.argmin(loss))
        second = float(np.delete(loss, best).min())
        return self.languages[best], float(max(0.0, 1 - loss[best] / second)) if second > 0 else 0.0

    def familiar(self, codes: np.ndarray, language: int) -> float:
        """Mean over the text's n-grams of how much the language's training rows hold them."""
        total, n = 0.0, 0
        for b in _lettered(codes):
            total += self.seen[language][b].sum(dtype=np.float64)
            n += len(b)
        return total / max(n, 1)

    def familiar_to_others(self, codes: np.ndarray, language: int) -> float:
        """``familiar`` for one of the training rows, without what it has counted itself."""
        own, n = np.unique(np.concatenate(list(_lettered(codes))), return_counts=True)
        others = np.maximum(np.expm1(self.seen[language][own].astype(np.float64)) * UNSEEN - n, 0)
        return float((np.log1p(others / UNSEEN) * n).sum() / max(n.sum(), 1))

    def evidence(self, codes: np.ndarray, language: int) -> float:
        here = self.familiar(codes, language) - self.floor[language]
        if here >= 0:
            return here
        return max(self.familiar(codes, i) - self.floor[i] for i in range(len(self.languages)))

    def predict(self, text: str | None) -> tuple[str, float, float | None]:
        codes = _codes(text or "")
        if not (codes != 32).any():
            return UNDETERMINED, 0.0, None
        if not self.languages:
            return UNDETERMINED, 0.0, 0.0
        found, score = self.decode(self.margins(codes)) if self.code.shape[1] else (self.languages[0], 1.0)
        return found, score, self.evidence(codes, self.languages.index(found))


# ---------------------------------------------------------------------- training

def training_sample(labelled: DataFrame, lang_col: str, text_col: str, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text): about ``per_language`` rows of each language, chosen by hash."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(*labelled.columns), F.lit(1 << 30)).alias("pick"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min("pick").alias("least")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    keep = F.lit(False)
    for r in counts:
        share = min(1.0, per_language / r["count"])
        keep = keep | ((F.col("lang") == r["lang"]) & (F.col("pick") < max(int(share * (1 << 30)), r["least"] + 1)))
    return rows.filter(keep).select("lang", "text")


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE,
          smoothing: float = 0.5) -> Model:
    """Fit the classifiers and their trust on a bounded sample of ``labelled``."""
    # written once: the counts, the floor and the trust all read the sample, not the whole table
    sample = written(training_sample(labelled, lang_col, text_col, per_language), "language-sample")
    spark = sample.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = _codes(text.as_py() or "")
                if (codes != 32).any():
                    into = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for order in ORDERS:
                        for b in _slices(codes, order):
                            if len(b) < BUCKETS // 8:
                                np.add.at(into, b, 1)
                            else:
                                into += np.bincount(b, minlength=BUCKETS)
        for lang, into in sums.items():
            used = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(into[used])], ["lang", "bucket", "n"])

    grams = map_batches(sample, count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(grams.column("lang").to_pylist(), object)
    languages = sorted(set(names.tolist()))
    if not languages:
        return Model([], codewords(0), np.zeros((BUCKETS, 0), np.float32), np.ones(0), np.ones((0, 0)))
    code = codewords(len(languages))
    share = np.zeros((len(languages), BUCKETS))
    for i, lang in enumerate(languages):
        of = names == lang
        share[i, grams.column("bucket").to_numpy()[of]] += grams.column("n").to_numpy()[of]
    seen = np.log1p(share / UNSEEN).astype(np.float32)
    share += smoothing
    share /= share.sum(axis=1, keepdims=True)
    weights = np.empty((BUCKETS, code.shape[1]), np.float32)
    for j in range(code.shape[1]):
        up, down = share[code[:, j] == 1].mean(axis=0), share[code[:, j] == -1].mean(axis=0)
        weights[:, j] = np.log(up) - np.log(down)
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape), seen, np.zeros(len(languages)))
    _fit_floor(model, sample, spark)
    if code.shape[1]:
        _fit_trust(model, sample, spark)
    return model


def _fit_floor(model: Model, sample: DataFrame, spark) -> None:
    """Per language the least evidence that a text of that language is expected to have."""
    sent = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        place = {lang: i for i, lang in enumerate(m.languages)}
        for batch in batches:
            names, values = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = _codes(text.as_py() or "")
                if lang in place and (codes != 32).any():
                    names.append(lang)
                    values.append(m.familiar_to_others(codes, place[lang]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], ["lang", "value"])

    low = map_batches(sample, judge, "lang string, value double").groupBy("lang").agg(F.percentile_approx("value", TAIL).alias("low")).collect()
    for r in low:
        model.floor[model.languages.index(r.lang)] = FLOOR * r.low


def _fit_trust(model: Model, sample: DataFrame, spark) -> None:
    """Per language and classifier the share of right signs; per classifier its mean margin."""
    sent = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        place = {lang: i for i, lang in enumerate(m.languages)}
        n, right, size = np.zeros(len(place), np.int64), np.zeros(m.code.shape, np.int64), np.zeros(m.code.shape)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = _codes(text.as_py() or "")
                if lang in place and (codes != 32).any():
                    margins = m.margins(codes)
                    n[i := place[lang]] += 1
                    right[i] += margins * m.code[i] > 0
                    size[i] += np.abs(margins)
        i, j = np.indices(m.code.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, j, np.repeat(n, m.code.shape[1]), right, size)], ["i", "j", "n", "right", "size"])

    judged = (map_batches(sample, judge, "i bigint, j bigint, n bigint, right bigint, size double").groupBy("i", "j")
              .agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("size").alias("size")).collect())
    n, right, size = np.zeros(model.code.shape), np.zeros(model.code.shape), np.zeros(model.code.shape)
    for r in judged:
        n[r.i, r.j], right[r.i, r.j], size[r.i, r.j] = r.n, r.right, r["size"]
    accuracy = (right + 1) / (n + 2)
    model.trust = accuracy / accuracy.sum(axis=1, keepdims=True)
    model.scale = np.maximum((size / np.maximum(n, 1)).mean(axis=0), 1e-6)


# -------------------------------------------------------------------- prediction

def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score, evidence, ambiguous): ``row`` is the untouched input row as a struct."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(1)]
            names, scores, evidence = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(evidence, pa.float64())],
                                             ["row", "lang_pred", "score", "evidence"])

    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    out = map_batches(rows, run, T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType())]))
    return out.withColumn("ambiguous", F.col("score") < AMBIGUOUS)


def rejected(evidence: Column) -> Column:
    """Documents without a letter, and those without evidence for any learned language."""
    return evidence.isNull() | (evidence < 0)
