"""Compression classifier: dictionaries of good and bad text, and the calibrated difference of compressed sizes.

Two zstandard dictionaries are built from labelled text, one from good and one from bad documents. A text is cut into
windows and every window is compressed with both; the bad dictionary shortens bad text more. The differences of the
compressed sizes, normalised by length, over all windows of the text are calibrated into a probability by a logistic
regression fitted on labelled documents that no dictionary has seen.

Training uses a bounded sample of labelled rows (``sample_docs`` documents of each label, chosen by a hash of the id;
``sample_bytes`` of text for each dictionary), always whole texts; so does scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

#: Bytes of a window: short enough that the dictionary, not the window's own history, decides how it compresses.
WINDOW = 768
LEVEL = 3


@dataclass
class Model:
    """Both dictionaries and the calibration."""

    good: bytes
    bad: bytes
    weights: list[float] = field(default_factory=list)
    means: list[float] = field(default_factory=list)
    scales: list[float] = field(default_factory=list)
    trained: bool = True


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary of at most ``size`` bytes, half of it and so on where the trainer finds the samples too few.

    A handful of windows trains none of 1 KB: then the different windows as they are, all of them, are the dictionary.
    """
    while size >= 1 << 10:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            size //= 2
    return b"".join(dict.fromkeys(samples))


def cut(text: bytes) -> list[bytes]:
    """All windows of a text; an empty text is one."""
    return [text[i : i + WINDOW] for i in range(0, max(len(text), 1), WINDOW)]


class Scorer:
    """Compressors for a model's dictionaries; made once a process and model."""

    def __init__(self, model: Model):
        self.model = model
        self.sides = [self._sizes(d) for d in (model.good, model.bad)]

    @staticmethod
    def _sizes(data: bytes):
        if data:
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)
        else:
            c = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        return lambda window: len(c.compress(window))

    def features(self, text: bytes) -> list[float]:
        """Normalised size differences (whole, worst, spread) and compressed sizes, from all windows of the text."""
        windows = cut(text)
        n = np.array([len(w) for w in windows], float)
        good, bad = (np.array([size(w) for w in windows], float) for size in self.sides)
        gap, rate = (good - bad) / (n + 32), good / (n + 32)
        return [
            (good.sum() - bad.sum()) / (n.sum() + 32), gap.max(), gap.min(), float(np.sqrt(np.average((gap - gap.mean()) ** 2))),
            good.sum() / (n.sum() + 32), rate.min(), rate.max(), 1 / (1 + n.sum() / 200),
        ]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([self.features(t) for t in texts])
        z = expand((x - self.model.means) / self.model.scales) @ np.array(self.model.weights)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def expand(x: np.ndarray) -> np.ndarray:
    """A constant, the standardised values (held to a range) and their squares."""
    x = np.clip(x, -8, 8)
    return np.hstack([np.ones((len(x), 1)), x, x**2 / 4])


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 60) -> np.ndarray:
    """Newton's method with an L2 penalty on all but the constant; steps are halved while they make it worse."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    loss = lambda v: np.logaddexp(0, -(2 * y - 1) * (x @ v)).sum() + 0.5 * (ridge * v * v).sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        t = 1.0
        while t > 1e-4 and loss(w + t * step) > loss(w):
            t /= 2
        w = w + t * step
        if np.abs(t * step).max() < 1e-6:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, sample_docs: int, sample_bytes: int) -> list[tuple[int, int, int, bool]]:
    """(doc_id, hash of the text, label, goes into a dictionary?) of the documents to learn from, in the order of a hash.

    Ids are chosen first, without texts; only sizes of the chosen few are looked at then. Of each label every other
    document goes into the dictionary, unless it would bring that over ``sample_bytes``.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    known = docs.select("doc_id").join(labels.where("label in (0, 1)").select("doc_id", "label"), "doc_id").distinct().withColumn("at", order)
    chosen = [tuple(r) for label in (0, 1) for r in known.where(F.col("label") == label).orderBy("at", "doc_id").limit(sample_docs).collect()]
    few = F.broadcast(spark.createDataFrame(chosen, "doc_id long, label int, at long"))
    rows = docs.where("text is not null").join(few, "doc_id").select("at", "doc_id", F.xxhash64("text").alias("h"), "label", F.octet_length("text").alias("n")).distinct()
    out, held, turn = [], [0, 0], [0, 0]
    for _, doc_id, h, label, n in rows.orderBy("at", "doc_id", "h", "label").limit(2 * sample_docs).collect():
        turn[label] += 1
        into = bool(turn[label] % 2) and held[label] + n <= sample_bytes
        held[label] += n * into
        out.append((doc_id, h, label, into))
    return out


def of_sample(docs: DataFrame, chosen: list[tuple[int, int, int, bool]]) -> DataFrame:
    """(doc_id, h, label, text) of chosen documents, once each; the list is bounded by the sample's parameters."""
    few = F.broadcast(docs.sparkSession.createDataFrame([c[:3] for c in chosen], "doc_id long, h long, label int"))
    rows = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("h"))
    return rows.join(few, ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "label"]).select("doc_id", "h", "label", "text")


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 2500, sample_bytes: int = 8 << 20, dictionary_bytes: int = 96 << 10) -> Model:
    """Fit a model to the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, label 0 or 1) covers.

    Rows without a label or text are left out. The sample is bounded by the parameters, whatever the tables' size. Of
    each label, half of the sampled documents go into the dictionary, the other half, reduced to features by the
    executors, into the calibration.
    """
    base.ship(docs.sparkSession)
    chosen = sample(docs.select("doc_id", "text"), labels, sample_docs, sample_bytes)
    place = {(i, h, label): k for k, (i, h, label, _) in enumerate(chosen)}
    windows: dict[int, list[bytes]] = {0: [], 1: []}
    into = of_sample(docs, [c for c in chosen if c[3]]).collect()
    for r in sorted(into, key=lambda r: place[r["doc_id"], r["h"], r["label"]]):
        windows[r["label"]] += cut(r["text"].encode())
    model = Model(dictionary(windows[1], dictionary_bytes), dictionary(windows[0], dictionary_bytes))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in base.slices(batches):
            x = [scorer.features(t.encode()) for t in base.text_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h", "label")), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "h", "label", "x"])

    check = of_sample(docs, [c for c in chosen if not c[3]]).mapInArrow(features, "doc_id long, h long, label int, x array<double>").collect()
    check = sorted(check, key=lambda r: place[r["doc_id"], r["h"], r["label"]])
    x = np.array([r["x"] for r in check]).reshape(len(check), len(Scorer(model).features(b"")))
    y = np.array([r["label"] for r in check], float)
    model.means = list(x.mean(0)) if len(x) else [0.0] * x.shape[1]
    model.scales = [s or 1.0 for s in x.std(0)] if len(x) else [1.0] * x.shape[1]
    model.weights = list(fit_logistic(expand((x - model.means) / model.scales), y)) if len(x) else [0.0] * (2 * x.shape[1] + 1)
    return model


_scorers: dict[tuple[bytes, bytes, tuple], Scorer] = {}


def _scorer(model: Model) -> Scorer:
    key = (model.good, model.bad, tuple(model.weights))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def _scored(rows: DataFrame, model: Model, threshold: float) -> DataFrame:
    """(row, score, predicted) of (row, text)."""
    base.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in base.slices(batches):
            s = scorer.scores([t.encode() for t in base.text_of(batch).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["row", "score", "predicted"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int")


def score(docs: DataFrame, model: Model, threshold: float = 0.7, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """Return the columns ``carry``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold``).

    Only the text is an input of the score: equal texts have equal scores. A null text counts as empty, and both get a
    score from the same formula. Ids may be null or repeated; an empty table gives an empty result. A carried column
    called ``score`` or ``predicted`` gives way to the result's; no other name is reserved.
    """
    carry = tuple(c for c in carry if c.lower() not in ("score", "predicted"))
    rows = docs.select(base.packed(carry, docs).alias("row"), docs[text_column].cast("string").alias("text"))
    return _scored(rows, model, threshold).select(*base.unpacked(carry), "score", "predicted")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a score of ``threshold`` or more, with all their columns, whatever their names."""
    rows = docs.select(base.packed(docs.columns, docs).alias("row"), docs[text_column].cast("string").alias("text"))
    return _scored(rows, model, threshold).where("predicted = 1").select(*base.unpacked(docs.columns))


def held_out(id_column: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out, and not learnt from either."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == fold, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **training) -> DataFrame:
    """Learn from the labelled documents outside the held-out fold, and score all documents.

    Returns doc_id, held_out, score, predicted: a row for each row of ``docs``. An id that ``labels`` or ``docs``
    repeats is learnt from once for each label and text.
    """
    learn = docs.where(~held_out(docs["doc_id"])).select("doc_id", "text")
    model = train(learn, labels.select("doc_id", F.col("quality").cast("int").alias("label")), **training)
    scored = score(docs, model, threshold)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
