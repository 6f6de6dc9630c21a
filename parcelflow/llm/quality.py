"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model by dual
coordinate descent (naive Bayes support vectors).

The fit uses a bounded sample of labelled training rows (``sample`` rows, those with the least hash of doc_id) in one
task; its weights, of a fixed size, are broadcast and every whole text is scored where it is read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear_svm as svm
from . import textops as t
from .spark_util import with_text

ORDERS, BITS, COST = (1, 2, 3), 18, 4.0
SAMPLE = 8000
FOLDS = 5


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    distinct = svm.Distinct(BITS)
    for batch in batches:
        lists = [distinct(x).astype(np.int32).tobytes() for x in svm.bucket_lists(t.texts_of(batch), ORDERS, BITS, False)]
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(lists[a : a + 500], pa.binary())], names=["doc_id", "label", "buckets"])


def _scaled(buckets: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[buckets]
    return v / max(float(np.sqrt(v @ v)), 1e-9)


def fit_rows(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(log-count ratios, weights with the bias last, a, b of the sigmoid) from (distinct buckets, label 0/1) rows."""
    y = np.array([1.0 if label else -1.0 for _, label in rows])
    if len(set(y.tolist())) < 2:
        prior = float(((y > 0).sum() + 1) / (len(y) + 2))
        return np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS) + 1, np.float32), 0.0, float(np.log(prior / (1 - prior)))
    held = np.arange(len(rows)) % 4 == 3
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    count = {1.0: np.ones(1 << BITS), -1.0: np.ones(1 << BITS)}
    for (b, _), sign in zip(rows, y):
        count[sign][b] += 1
    ratio = np.log((count[1.0] / count[1.0].sum()) / (count[-1.0] / count[-1.0].sum()))
    values = [_scaled(b, ratio) for b, _ in rows]

    def fit(which: np.ndarray) -> np.ndarray:
        ptr = np.cumsum([0] + [len(values[i]) for i in which])
        return svm.fit_hinge(ptr, np.concatenate([rows[i][0] for i in which]), np.concatenate([values[i] for i in which]), y[which], 1 << BITS, np.full(len(which), COST))

    part = fit(np.flatnonzero(~held))
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    margin = np.array([part[rows[i][0]] @ values[i] + part[-1] for i in check])
    a, b = svm.fit_sigmoid(margin, y[check])
    return ratio.astype(np.float32), fit(np.arange(len(rows))).astype(np.float32), a, b


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "buckets")))]
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    model = fit_rows([(np.frombuffer(b, np.int32), label) for _, label, b in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model from labelled rows outside the held-out fold (crc32 of doc_id mod 5 is 0)."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    own = own.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0) & F.col("label").isin(0, 1))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = with_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(_features, "doc_id long, label int, buckets binary")
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "buckets").limit(sample)  # repeated ids may bring more rows
    return pickle.loads(few.mapInArrow(_fit, "model binary").first().model)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    Null texts count as empty, which score by the bias alone; very long texts are taken whole; repeated rows score alike.  A null doc_id is held out or not by the hash of the empty
    text.  Labels other than 0 and 1 are not learned; with fewer than two classes the score is their smoothed share."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, w, a, b = model.value
        both = (ratio * w[:-1]).astype(np.float64)
        square = ratio.astype(np.float64) ** 2
        distinct = svm.Distinct(BITS)
        for batch in batches:
            margin = []
            for values in svm.bucket_lists(t.texts_of(batch), ORDERS, BITS, False):
                d = distinct(values)
                margin.append(both[d].sum() / max(float(np.sqrt(square[d].sum())), 1e-9) + float(w[-1]))
            score = 1 / (1 + np.exp(-np.clip(a * np.array(margin, np.float64) + b, -500, 500)))
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array(t.crc_mod(ids.to_pylist(), FOLDS) == 0), pa.array(score)], names=["doc_id", "held_out", "score"])

    out = with_text(docs).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
