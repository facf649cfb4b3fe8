"""Quality rules and a hashed n-gram logistic regression.

The rules count words, characters, symbols, repeated lines and repeated word
windows of whole texts.  The model hashes words and 3- and 4-grams of code points to a
fixed number of bins, is fitted by full-batch descent on labelled rows and
calibrated (Platt) on a held-out fifth; documents are scored in Arrow batches
against a fixed threshold.

``max_rows`` bounds the labelled sample (the rows with the smallest id
hashes); it is a parameter of ``fit``.  Everything else covers all rows.

Edge cases: a null or empty text has zero counts and fails the rules.  Null
labels and labels without a document are not used; of several labels of one
id the smallest counts.  Without rows of both classes, or with an empty
table, the model passes every document.  Columns beside the named ones are
ignored by ``rules`` and kept by ``keep_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import common, textnum

BINS = 8192
THRESHOLD = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def counts(text: str) -> dict[str, int]:
    """The rule counts of one whole text."""
    data = text.encode("utf-8", "replace")
    starts, ends, h = textnum.words(data)
    buf = np.frombuffer(data, np.uint8)
    n = len(h)
    covered = np.zeros(n, bool)
    if n >= 3:
        _, which, times = np.unique(textnum.windows(h, 3), return_inverse=True, return_counts=True)
        twice = times[which] > 1
        for i in range(3):
            covered[i : i + n - 2] |= twice
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            repeated += line in seen
            seen.add(line)
    return {
        "n_words": n,
        "word_chars": int((ends - starts).sum()) - int(np.count_nonzero((buf & 0xC0) == 0x80)),
        "n_symbols": int(np.count_nonzero(_SYMBOL[buf])),
        "n_dup_lines": repeated,
        "n_repeat_words": int(covered.sum()),
    }


def breaks_rules(c: dict[str, int]) -> bool:
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins and weights (unit length) of the hashed words and character n-grams."""
    found = [textnum.words(text.encode("utf-8", "replace"))[2] >> np.uint64(51)]
    b = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    for n in (3, 4):
        if len(b) >= n:
            gram = b[: len(b) - n + 1].copy()
            for i in range(1, n):
                gram = gram * np.uint32(0x01000193) + b[i : len(b) - n + 1 + i]
            found.append(((gram * np.uint32(0x9E3779B1)) >> np.uint32(19)).astype(np.uint64))
    total = np.bincount(np.concatenate(found).astype(np.int64), minlength=BINS)
    bins = np.flatnonzero(total)
    weight = np.log1p(total[bins]).astype(np.float32)
    norm = float(np.sqrt((weight * weight).sum()))
    return bins.astype(np.uint16), weight / norm if norm else weight


class Model:
    """Weights, bias and the two calibration terms."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def logit(self, text: str) -> float:
        bins, weight = features(text)
        return float(self.weights[bins] @ weight) + self.bias

    def probability(self, text: str) -> float:
        z = self.slope * self.logit(text) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(rows: list[tuple[bytes, bytes, int]], steps: int = 250, decay: float = 1e-4) -> Model:
    """Fits on four fifths of (bins, weights, label) rows and calibrates on the rest."""
    y = np.array([r[2] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BINS, np.float32), 10.0)
    held = np.arange(len(rows)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(rows), bool)
    x = np.zeros((len(rows), BINS), np.float32)  # the held rows last, so that both parts are views of it
    for i, n in enumerate(np.argsort(held, kind="stable")):
        x[i, np.frombuffer(rows[n][0], np.uint16)] = np.frombuffer(rows[n][1], np.float32)
    a, t = x[: len(rows) - held.sum()], y[~held]
    w, bias = np.zeros(BINS, np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam
        p = 1 / (1 + np.exp(-np.clip(a @ w + bias, -60, 60)))
        g = a.T @ (p - t) / len(t) + decay * w
        gb = float((p - t).mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        bias -= float(rate * mb / (np.sqrt(vb) + 1e-8))
    slope, shift = 1.0, 0.0
    if held.any():
        z, t = x[len(a) :] @ w + bias, (y[held] * held.sum() + 1) / (held.sum() + 2)
        for _ in range(50):  # Newton, slightly damped
            p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -60, 60)))
            r, d = p - t, np.maximum(p * (1 - p), 1e-6)
            h = np.array([[(d * z * z).sum() + 1e-3, (d * z).sum()], [(d * z).sum(), d.sum() + 1e-3]])
            step = np.linalg.solve(h, np.array([(r * z).sum(), r.sum()]))
            slope, shift = slope - float(np.clip(step[0], -1, 1)), shift - float(np.clip(step[1], -1, 1))
        if slope <= 0:
            slope, shift = 1.0, 0.0
    return Model(w, bias, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Trains on at most ``max_rows`` labelled documents, in one task of an executor: only the model comes to the driver."""
    common.prepare(docs.sparkSession)
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    own = own.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text")).join(F.broadcast(own), "id")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [features(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())], names=["id", "label", "bins", "weight"])

    found = rows.select("id", "text", "label").mapInArrow(common.lean(run), "id long, label int, bins binary, weight binary")

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, bins, weight, int(label > 0)) for part in parts for i, bins, weight, label in zip(*(c.to_pylist() for c in part.columns), strict=True))
        m = train([got[i][1:] for i in np.random.default_rng(11).permutation(len(got))])
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), *(pa.array([float(v)], pa.float64()) for v in (m.bias, m.slope, m.shift))], names=["weights", "bias", "slope", "shift"])

    one = found.groupBy("id").agg(F.min(F.struct("bins", "weight", "label")).alias("r")).select("id", "r.bins", "r.weight", "r.label")  # of repeated rows one: at most max_rows
    m = one.coalesce(1).mapInArrow(common.lean(learn), "weights binary, bias double, slope double, shift double").head()
    return Model(np.frombuffer(m["weights"], np.float32), m["bias"], m["slope"], m["shift"]) if m else train([])


def rules(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the counts, base_failed, kept and the calibrated probability of good quality, one row per row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1).to_pylist()
            found = [counts(t) for t in texts]
            failed = [breaks_rules(c) for c in found]
            p = [model.probability(t) for t in texts]
            cols = [part.column(0), *(pa.array([c[n] for c in found], pa.int64()) for n in names), pa.array(failed, pa.bool_()), pa.array([not f and x >= threshold for f, x in zip(failed, p, strict=True)], pa.bool_()), pa.array(p, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *names, "base_failed", "kept", "p_quality"])

    common.prepare(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text")).mapInArrow(common.lean(run), f"id long, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, p_quality double")
    return out.withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that pass the rules and the model, with all their columns and rows."""
    common.prepare(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            yield part.filter(pa.array([not breaks_rules(counts(t)) and model.probability(t) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(common.lean(run), docs.schema)
