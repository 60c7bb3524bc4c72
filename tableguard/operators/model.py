"""Spans from a user-supplied predictor (a NER model, say), batch by batch.

The predictor is built by a factory and kept, under a key that the caller gives
(the model's name and version, say), for every Arrow batch and every later task that
the Python worker process sees with that key.  One model is kept at a time.  Batches hold
``spark.sql.execution.arrow.maxRecordsPerBatch`` rows, of which a worker makes the
model's batches by length (:func:`plan_batches`).
This is the one place Python runs inside tasks: a model is Python code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableguard.functions.pii_labels import validate_labels
from tableguard.functions.pii_patterns import SCORE_CHECK_FAIL, SCORE_CHECK_PASS, Detector, detectors_for
from tableguard.functions.sums import running_sum
from tableguard.operators.chunks import DEFAULT_MAX_LEN, ROW_SEP, WINDOW_AFTER, WINDOW_BEFORE, chunk_windows
from tableguard.operators.shaping import assign_batches
from tableguard.session import written

BATCH_CHARS = 64 * 1800     # padded characters of a model batch

_SPAN_COLUMNS = ["id", "start", "end", "label", "score", "value"]
_PREDICTORS: dict[str, object] = {}


class Predictor:
    """Interface: ``predict_batch(texts, labels) -> list[list[dict]]``.

    Each dict has ``start``, ``end`` (character offsets), ``label``, ``score``
    and optionally ``text``.
    """

    def predict_batch(self, texts: list[str], labels: list[str]) -> list[list[dict]]:  # pragma: no cover
        raise NotImplementedError


class PatternPredictor(Predictor):
    """A deterministic stand-in predictor (regular expressions per label), for
    tests and for running the pipeline shape without a model file."""

    def __init__(self, patterns: dict[str, str], score: float = 0.9):
        self.patterns = {k: re.compile(v) for k, v in patterns.items()}
        self.score = score

    def predict_batch(self, texts, labels):
        out = []
        for t in texts:
            found = []
            for label in labels:
                rx = self.patterns.get(label)
                if rx is None or t is None:
                    continue
                for m in rx.finditer(t):
                    g = rx.groups and 1      # the first group is the value, if there is one
                    found.append({"start": m.start(g), "end": m.end(g), "label": label,
                                  "score": self.score, "text": m.group(g)})
            out.append(found)
        return out


class DetectorPredictor(Predictor):
    """The package's own pattern and keyword detectors as a predictor of many labels.

    A stand-in that finds, in Python, what :func:`tableguard.operators.spans.with_spans`
    finds in the JVM, with the same scores.
    """

    def __init__(self, labels: list[str] | None = None):
        self.by_label: dict[str, list[tuple[Detector, re.Pattern]]] = {}
        for d in detectors_for(validate_labels(labels)):
            self.by_label.setdefault(d.label, []).append((d, re.compile(d.pattern, re.ASCII)))

    def predict_batch(self, texts, labels):
        wanted = [x for label in labels for x in self.by_label.get(label, [])]
        return [self._spans(t, wanted) for t in texts]

    def _spans(self, text, wanted):
        if text is None:
            return []
        lowered = text.lower()
        return [{"start": m.start(d.group), "end": m.end(d.group), "label": d.label, "score": self._score(d, m.group(d.group)),
                 "text": m.group(d.group)} for d, rx in wanted if not d.hints or any(h in lowered for h in d.hints) for m in rx.finditer(text)]

    @staticmethod
    def _score(d: Detector, value: str) -> float:
        if not d.check:
            return d.score
        digits = [int(c) for c in value if c in "0123456789"]
        doubled = [x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(digits))]
        luhn = bool(digits) and sum(doubled) % 10 == 0
        good = {"card": luhn and len(digits) <= 19, "imei": luhn and len(digits) == 15,
                "vin": len(value) == 17 and bool(re.search("[A-Z]", value)) and bool(re.search("[0-9]", value))}[d.check]
        return SCORE_CHECK_PASS if good else SCORE_CHECK_FAIL


def plan_batches(sizes: list[int], most_rows: int | None = None, budget: int = BATCH_CHARS) -> list[list[int]]:
    """Positions of ``sizes`` in batches for a model that pads each batch to its longest text.

    Texts of like length go together (length buckets); a batch's padded size, its longest
    text times its texts, stays within ``budget``, or it is one text.
    """
    batches: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        full = batches and (sizes[i] * (len(batches[-1]) + 1) > budget or most_rows and len(batches[-1]) >= most_rows)
        if not batches or full:
            batches.append([])
        batches[-1].append(i)
    return batches


def _predict(pred: Predictor, texts: list, labels: list[str], batch_rows: int | None) -> list[list[dict]]:
    """Spans of every text, in the texts' order, predicted in planned batches; nulls have none."""
    out: list[list[dict]] = [[] for _ in texts]
    real = [k for k, t in enumerate(texts) if t]
    for batch in plan_batches([len(texts[k]) for k in real], batch_rows):
        places = [real[i] for i in batch]
        for k, spans in zip(places, pred.predict_batch([texts[k] for k in places], labels), strict=True):
            out[k] = spans
    return out


def _predictor(key: str, factory: Callable[[], Predictor]) -> Predictor:
    if key not in _PREDICTORS:
        _PREDICTORS.clear()      # one model in memory
        _PREDICTORS[key] = factory()
    return _PREDICTORS[key]


def _row_schema(df: DataFrame, id_col: str) -> T.StructType:
    """Rows of spans; the id keeps its own type."""
    span = "start int, end int, label string, score double, value string"
    return T.StructType([T.StructField("id", df.schema[id_col].dataType), *T.StructType.fromDDL(span).fields])


def model_spans(df: DataFrame, id_col: str, text_col: str, predictor_factory: Callable[[], Predictor],
                labels: list[str], model_key: str, batch_rows: int | None = None, max_len: int | None = None) -> DataFrame:
    """``(id, start, end, label, score, value)`` from the predictor, per row.

    ``model_key`` names the model: calls with the same key share a loaded predictor,
    calls with different keys never do.  Runs as ``mapInPandas`` over the input
    partitions; no shuffle.  A failing prediction fails the task (and so the job)
    instead of returning the text unredacted.

    With ``max_len`` the model never sees more than ``max_len`` characters:
    texts are cut into chunks of ``max_len - 300`` characters, each seen with
    100 characters before and 200 after; a span is kept by the chunk it starts
    in and mapped back to text offsets, so values on chunk edges are found once.
    A span that touches the end of its window is continued to the next blank of the
    text, so no tail of a long value is left out.
    """
    labels = list(labels)
    if max_len is not None:
        return _windowed_model_spans(df, id_col, text_col, predictor_factory, labels, model_key, batch_rows, max_len)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pred = _predictor(model_key, predictor_factory)
        for pdf in batches:
            texts = pdf["text"].tolist()
            rows = [(i, int(s["start"]), int(s["end"]), s["label"], float(s["score"]),
                     s.get("text", t[s["start"]:s["end"]] if t else None))
                    for i, t, spans in zip(pdf["id"].tolist(), texts, _predict(pred, texts, labels, batch_rows)) for s in spans]
            yield pd.DataFrame(rows, columns=_SPAN_COLUMNS)

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, _row_schema(df, id_col)).withColumnRenamed("id", id_col)


def _windowed_model_spans(df, id_col, text_col, predictor_factory, labels, model_key, batch_rows, max_len):
    chunk_len = max_len - WINDOW_BEFORE - WINDOW_AFTER
    if chunk_len < 1:
        raise ValueError(f"max_len must exceed {WINDOW_BEFORE + WINDOW_AFTER}")
    windows = chunk_windows(df, id_col, text_col, chunk_len).select(
        F.col(id_col).alias("id"), "start", "clen", "wstart", F.col("window").alias("text"), "rest")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pred = _predictor(model_key, predictor_factory)
        for pdf in batches:
            texts = pdf["text"].tolist()
            results = _predict(pred, texts, labels, batch_rows)
            rows = []
            for i, st, cl, ws, t, rest, spans in zip(pdf["id"].tolist(), pdf["start"].tolist(), pdf["clen"].tolist(),
                                                     pdf["wstart"].tolist(), texts, pdf["rest"].tolist(), results):
                for s in spans:
                    g = int(ws) + int(s["start"])
                    if st <= g < st + cl:           # the chunk this span starts in keeps it
                        more = rest if s["end"] == len(t) else ""
                        rows.append((i, g, int(ws) + int(s["end"]) + len(more), s["label"], float(s["score"]),
                                     s.get("text", t[s["start"]:s["end"]]) + more))
            yield pd.DataFrame(rows, columns=_SPAN_COLUMNS)

    return windows.mapInPandas(run, _row_schema(df, id_col)).withColumnRenamed("id", id_col)


def model_row_spans(df: DataFrame, id_col: str, text_col: str, order_cols: list[str], predictor_factory: Callable[[], Predictor],
                    labels: list[str], model_key: str, batch_rows: int | None = None, max_len: int = DEFAULT_MAX_LEN) -> DataFrame:
    """``(id, start, end, label, score, value)`` of many small rows, several rows to a model text.

    Consecutive rows (by ``order_cols``) are packed by the byte rule of
    :func:`tableguard.operators.shaping.assign_batches` and joined by the row separator,
    at which chunks are cut first; the packs go through the windowed model.  A span
    belongs to the row it starts in and ends with it at the latest.  Ids are a key of the
    rows; null and empty texts have no spans.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order_cols)])
    order = [f"o{k}" for k in range(len(order_cols))]
    batched = assign_batches(rows.where("text <> ''"), "text", order, out_col="pack")
    packs = batched.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct(*order, "id", "text"))).alias("r"))
    packs = packs.withColumn("at", running_sum(F.transform("r", lambda x: F.char_length(x["text"]) + len(ROW_SEP))))
    packs = written(packs.select("pack", F.array_join(F.transform("r", lambda x: x["text"]), ROW_SEP).alias("text"), F.transform(
        "r", lambda x, i: F.struct(x["id"].alias("id"), F.get("at", i).alias("lo"), (F.get("at", i) + F.char_length(x["text"])).alias("hi"))).alias("r")), "model-packs")
    spans = model_spans(packs, "pack", "text", predictor_factory, labels, model_key, batch_rows, max_len)
    places = packs.select("pack", F.explode("r").alias("r")).select("pack", "r.*")
    found = spans.join(places, "pack").where((F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi")))
    end = F.least("end", "hi")
    return found.select(F.col("id").alias(id_col), (F.col("start") - F.col("lo")).alias("start"), (end - F.col("lo")).alias("end"), "label", "score",
                        F.substr("value", F.lit(1), end - F.col("start")).alias("value"))
