"""Quality: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds t1 < t2 < ... cut the line: P(grade >= k) = sigmoid(w.x - tk). This gives
an expected grade and a tail probability, by which documents are selected.

Features: counts of hashed byte n-grams (case kept) and of hashed word pairs, damped by
a logarithm and scaled to unit length, so the length of a text does not decide. The
fit uses a bounded sample of labelled rows (``sample_rows``), drawn by hash.

Defined results: null and empty texts have no features and are graded by the thresholds
alone; without two grades among the labels nothing can be learnt, and every row gets that grade
(0 if none) with tail probability 1, so that nothing is rejected; repeated rows agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .common import ascii_space_words, slices, text_buffers
from .hashed_text import Sparse, byte_ngrams, distinct, minimise, row_sums, sigmoid

_U = np.uint64
_WORDS = ascii_space_words()


@dataclass(frozen=True)
class Params:
    orders: tuple[int, ...] = (3,)
    bits: int = 18
    sample_rows: int = 6000  # bound of the fitted sample
    ridge: float = 1e-5


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray
    params: Params


def features(raw: np.ndarray, offsets: np.ndarray, p: Params):
    """(row, feature, value) with values of unit length in each row."""
    rows, feats = [], []
    for n in p.orders:
        row, feature = byte_ngrams(raw, offsets, n, p.bits)
        rows.append(row)
        feats.append(feature)
    h, _, _, doc = _WORDS.words(raw, offsets)
    if len(h) > 1:
        same = doc[1:] == doc[:-1]
        again = h[1:] == h[:-1]  # a word said twice in a row is one feature, whatever the word
        pair = np.where(again, _U(11), h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:]) * _U(0xC2B2AE3D27D4EB4F)
        rows.append(doc[1:][same])
        feats.append((pair >> _U(64 - p.bits)).astype(np.int64)[same])
    row, feature, n = distinct(np.concatenate(rows), np.concatenate(feats), p.bits)
    value = np.log1p(n)
    length = np.sqrt(row_sums(row, value * value, len(offsets) - 1))
    return row, feature, value / length[row]


def _vectors(p: Params):
    def run(batches):
        for batch in batches:
            raw, off = text_buffers(batch.column("text"))
            grade = batch.column("label").to_numpy(zero_copy_only=False)
            for lo, hi in slices(off):
                row, feature, value = features(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], p)
                ends = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.record_batch(
                    [pa.array(grade[lo:hi].astype(np.int32)),
                     pa.ListArray.from_arrays(ends, pa.array(feature.astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32)))],
                    names=["label", "features", "values"])
    return run


def fit(row, feature, value, grade, p: Params):
    """Weights and thresholds for ``grade`` coded 0 .. K-1, by maximum penalised likelihood."""
    n, k = len(grade), int(grade.max())  # k thresholds
    entries = Sparse(row, feature, value, n, 1 << p.bits)
    each = np.full(n, 1 / n)

    def cuts(a):  # ordered by construction
        return a[0] + np.append(0, np.cumsum(np.exp(a[1:])))

    def loss(x):
        w, a = x[:-k], x[-k:]
        t = cuts(a)
        z = entries.times(w)
        upper = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - t), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        hi, lo = upper[at, grade], upper[at, grade + 1]
        like = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        dz = -each * (dhi - dlo) / like
        dt = np.zeros(k)
        np.add.at(dt, grade[grade > 0] - 1, (each * dhi / like)[grade > 0])
        np.add.at(dt, grade[grade < k], -(each * dlo / like)[grade < k])
        da = np.append(dt.sum(), [dt[j:].sum() * np.exp(a[j]) for j in range(1, k)])
        gw = entries.back(dz) + p.ridge * w
        return -(each * np.log(like)).sum() + 0.5 * p.ridge * (w @ w), np.concatenate([gw, da])

    share = np.array([(grade >= j).mean() for j in range(1, k + 1)]).clip(1e-3, 1 - 1e-3)
    t0 = np.sort(np.log((1 - share) / share))
    a0 = np.append(t0[0], np.log(np.maximum(np.diff(t0), 0.05)))
    x = minimise(loss, np.concatenate([np.zeros(1 << p.bits), a0]), steps=80)
    return x[:-k], cuts(x[-k:])


def _flat(column) -> np.ndarray:
    """The items of a column of lists."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])


def train(labelled: DataFrame, totals: dict[int, int], p: Params = Params()) -> Model:
    """Fit on ``labelled`` (doc_id, text, label: integer grade), a bounded sample in proportion;
    ``totals``: rows of each grade in all."""
    grades = np.array(sorted(totals), np.int64)
    if len(grades) < 2:
        return Model(np.zeros(1 << p.bits), np.zeros(0), grades if len(grades) else np.zeros(1, np.int64), p)
    got = labelled.select("text", "label").mapInArrow(
        _vectors(p), "label int, features array<int>, values array<float>").limit(2 * p.sample_rows).toArrow()
    if got.num_rows == 0:
        return Model(np.zeros(1 << p.bits), np.zeros(0), grades[:1], p)
    grade = np.searchsorted(grades, got.column("label").to_numpy())
    sizes = np.concatenate([c.value_lengths().to_numpy() for c in got.column("features").chunks])
    row = np.repeat(np.arange(got.num_rows, dtype=np.int32), sizes)
    feature, value = (_flat(got.column(c)) for c in ("features", "values"))
    del got  # the driver holds the entries once
    seen = np.unique(grade)  # a rare grade may miss the sample
    if len(seen) < 2:
        return Model(np.zeros(1 << p.bits), np.zeros(0), grades[seen] if len(seen) else grades[:1], p)
    weight, thresholds = fit(row, feature, value, np.searchsorted(seen, grade), p)
    return Model(weight, thresholds, grades[seen], p)


def grade_rows(docs: DataFrame, model: Model, at_least: int, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row of ``docs`` with expected_grade and tail = P(grade >= at_least)."""
    p, thresholds, grades = model.params, model.thresholds, model.grades
    shared = docs.sparkSession.sparkContext.broadcast(model.weight.astype(np.float32))  # 4 x 2 ** bits bytes
    step = int(np.searchsorted(grades, at_least))
    names = [*columns, "expected_grade", "tail"]
    given = [*columns, *([] if text in columns else [text])]  # a text that is asked for travels once
    text_at = given.index(text)

    def run(batches):
        weight = shared.value
        for batch in batches:
            raw, off = text_buffers(batch.column(text_at))
            expected, tail = np.full(batch.num_rows, float(grades[0])), np.ones(batch.num_rows)
            for lo, hi in slices(off) if len(thresholds) else ():
                row, feature, value = features(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], p)
                z = row_sums(row, value * weight[feature], hi - lo)
                above = sigmoid(z[:, None] - thresholds)
                expected[lo:hi] = grades[0] + above @ np.diff(grades)
                if step:
                    tail[lo:hi] = above[:, step - 1] if step <= len(thresholds) else 0.0
            yield pa.record_batch([*batch.columns[:len(columns)], pa.array(expected), pa.array(tail)], names=names)

    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("expected_grade", T.DoubleType()),
                           T.StructField("tail", T.DoubleType())])
    return docs.select(*given).mapInArrow(run, schema)
