"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import text_of

#: N-grams of these lengths are hashed to so many features.
LENGTHS, FEATURES = (3, 4, 5), 1 << 20
#: At most so many labelled rows of each class train the model; the smallest hashes of the ids are taken.
TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
#: Longer texts are not trained on, so that what comes to the driver is bounded (they are scored whole).
TRAIN_CHARS = 20_000
#: Features in fewer training texts, or with a smaller absolute log-count ratio, are left out.
LEAST_TEXTS, LEAST_RATIO = 3, 0.7
#: Strength of the ridge penalty, steps of the solver, and the score from which a text is toxic.
RIDGE, STEPS, THRESHOLD = 5e-5, 300, 0.7


@dataclass(frozen=True)
class Model:
    """The products of ratio and coefficient by feature, and the constant."""

    weight: np.ndarray
    constant: float


def features(text: str) -> np.ndarray:
    """The hashed n-grams of a text in lower case, as they occur."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) + np.uint32(1)
    out, rolled = [], code
    for n in range(2, max(LENGTHS) + 1):
        if len(code) < n:
            break
        rolled = rolled[:-1] * np.uint32(0x01000193) + code[n - 1 :] * np.uint32(0x9E3779B1)
        if n in LENGTHS:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append((mixed ^ (mixed >> np.uint32(12))) & np.uint32(FEATURES - 1))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def fit(sets: list[np.ndarray], labels: np.ndarray) -> Model:
    """Ratios from the presence of features, then a ridge logistic regression on the scaled ones."""
    weight = np.zeros(FEATURES, dtype=np.float32)
    toxic = labels > 0
    if not len(labels) or toxic.all() or not toxic.any():
        return Model(weight, 4.0 if len(labels) and toxic.all() else -4.0)
    own = lambda flag: np.bincount(np.concatenate([s for s, t in zip(sets, toxic, strict=True) if t == flag]), minlength=FEATURES)
    p, q = own(True).astype(float), own(False).astype(float)
    ratio = np.log((p + 0.5) / (toxic.sum() + 1.0)) - np.log((q + 0.5) / ((~toxic).sum() + 1.0))
    ratio[(p + q < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    used = np.flatnonzero(ratio)
    if not len(used):
        return Model(weight, float(np.log(toxic.sum() / (~toxic).sum())))
    at = np.zeros(FEATURES, dtype=np.int32)
    at[used] = np.arange(1, len(used) + 1)
    columns = [c[c > 0] - 1 for c in (at[s] for s in sets)]
    length = np.array([len(c) for c in columns])
    row, column = np.repeat(np.arange(len(sets)), length), np.concatenate(columns)
    value = ratio[used][column]
    scale = np.sqrt(np.maximum(1.0, np.bincount(row, weights=value**2, minlength=len(sets)))).max() / 8
    value = value / scale
    y, n = toxic.astype(float), len(labels)
    # each step is bounded by the largest eigenvalue, found by power iteration
    x = np.ones(len(used) + 1) / np.sqrt(len(used) + 1)
    times = lambda w: np.bincount(row, weights=value * w[column], minlength=n) + w[-1]
    back = lambda e: np.append(np.bincount(column, weights=value * e[row], minlength=len(used)), e.sum())
    for _ in range(8):
        x = back(times(x))
        top = np.linalg.norm(x)
        x /= top
    step = 1.0 / (0.3 * top / n + RIDGE)
    w = z = np.zeros(len(used) + 1)
    for k in range(STEPS):  # accelerated gradient descent
        error = 1.0 / (1.0 + np.exp(-np.clip(times(z), -30, 30))) - y
        gradient = back(error) / n
        gradient[:-1] += RIDGE * z[:-1]
        new = z - step * gradient
        z = new + k / (k + 3) * (new - w)
        w = new
    weight[used] = (w[:-1] * ratio[used] / scale).astype(np.float32)
    return Model(weight, float(w[-1]))


def score_text(text: str, model: Model) -> float:
    found = features(text)
    found = np.unique(found[model.weight[found] != 0])
    return float(1.0 / (1.0 + np.exp(-np.clip(model.constant + model.weight[found].sum(dtype=np.float64), -30.0, 30.0))))


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    At most TOXIC_ROWS and CLEAN_ROWS ids of the two labels, each with one text (the smallest, where
    an id has several) of at most TRAIN_CHARS characters.
    """
    usable = labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = None
    for value, rows in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        own = usable.where(F.col("label") == value).orderBy(F.xxhash64(id_col), id_col).limit(rows)
        chosen = own if chosen is None else chosen.unionByName(own)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(features(t)).astype("<u4").tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(sets, pa.binary())], ["id", "label", "found"])

    texts = docs.select(F.col(id_col).alias(id_col), text_of(text_col).alias("text"))
    # at most TOXIC_ROWS + CLEAN_ROWS ids are broadcast, and as many sets come to the driver
    joined = texts.where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), id_col)
    joined = joined.groupBy(F.col(id_col).alias("id"), "label").agg(F.min("text").alias("text"))
    kind = joined.schema["id"].dataType.simpleString()
    found = joined.mapInArrow(extract, f"id {kind}, label int, found binary").toArrow().sort_by("id")
    sets = [np.frombuffer(s, dtype="<u4") for s in found["found"].to_pylist()]
    return fit(sets, np.array(found["label"].to_pylist(), dtype=np.int64))


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD
) -> DataFrame:
    """Score every document by a model trained on part of the labels.

    Features are the distinct character n-grams of the whole text in lower case, each scaled by
    its naive Bayes log-count ratio; the score is the logistic of their weighted sum. Nothing
    but the text enters a score. Scoring needs no shuffle; the weights (4 MB whatever the
    input) go to the executors with the code.

    Defined cases: a null, empty or very short text has the score of the constant; without
    labels, or with one class, the constant alone decides; null ids are scored and count as not
    held out; of several labels of an id the greatest holds; repeated rows get equal scores;
    extra columns are ignored; an empty table gives none.
    Out: id, held_out, score, predicted.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), held_out(id_col).alias("held_out"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([score_text(t, model.value) for t in batch["text"].to_pylist()], dtype=np.float64)
            columns = [batch["id"], batch["held_out"], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "score", "predicted"])

    kind = base.schema["id"].dataType.simpleString()
    out = base.mapInArrow(score, f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
