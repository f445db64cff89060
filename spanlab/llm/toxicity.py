"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed n-grams of characters (code points) inside words, a word's border counting as
one; case is folded.  The ratios are counted in Spark and the weights are fitted by logistic regression, both on a
bounded sample of the labelled rows (``ratio_rows`` and ``sample_rows``), drawn by hash of doc_id, about
half of each class and weighted back to the class rates of all labels. A feature seen in fewer than ``least`` rows
is left out, and while the weights are fitted a row's features are scaled by ratios that were counted without that
row: otherwise n-grams that only one toxic text has explain it, and the marks that toxic texts share are never
learnt (in a language with few labels no toxic text was found).  Of all features the ``kept`` with the most
telling difference between the classes stay.  The sample's ids are what is broadcast, so no text is shuffled to
learn, and scoring is one pass without a shuffle.

Defined results: null and empty texts get the score of no features (the class prior);
without rows of both classes nothing can be learnt and every score is the share of
toxic rows (0 if none); repeated rows score alike; a document with several labels, or several documents
of one label, count once for each pair; a row's memory is that of its text.
Learning reads the columns ``doc_id, text`` and ``doc_id, <label>`` only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffers
from .hashed_text import Sparse, distinct, letter_ngrams, minimise, row_sums, sigmoid


@dataclass(frozen=True)
class Params:
    # orders, least, ridge and smooth: chosen by threefold cross-validation on rows that may be learnt from
    orders: tuple[int, ...] = (5, 6, 7)
    bits: int = 20
    ratio_rows: int = 20000  # bound of the rows whose features are counted
    sample_rows: int = 5000  # bound of those that the weights are fitted on
    least: int = 10
    kept: int = 1 << 16
    ridge: float = 1e-3
    smooth: float = 1.0


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # ratio x fitted weight of each feature
    bias: float
    params: Params


def features(raw: np.ndarray, offsets: np.ndarray, p: Params, wanted: np.ndarray | None = None):
    """Distinct (row, feature) pairs of some texts, of the ``wanted`` features only if given as flags."""
    row, feature = letter_ngrams(raw, offsets, p.orders, p.bits)
    if wanted is not None:
        here = wanted[feature]
        row, feature = row[here], feature[here]
    row, feature, _ = distinct(row, feature, p.bits)
    return row, feature


def _counts(p: Params):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            raw, off = text_buffers(batch.column("text"))
            for lo, hi in slices(off):
                row, feature = features(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], p)
                for y in np.unique(label[lo:hi]):
                    mine = total.setdefault(int(y), np.zeros((1 << p.bits) + 1, np.int64))
                    here = label[lo:hi] == y
                    mine[:-1] += np.bincount(feature[here[row]], minlength=1 << p.bits)
                    mine[-1] += here.sum()
        for y, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(at), y, np.int32)), pa.array(at.astype(np.int32)),
                                   pa.array(n[at])], names=["label", "feature", "n"])
    return run


def class_counts(labelled: DataFrame, p: Params) -> dict[int, np.ndarray]:
    """Documents of each label with each feature; the last entry counts the documents.
    At most 2 x (2 ** bits + 1) sums reach the driver."""
    sums = labelled.mapInArrow(_counts(p), "label int, feature int, n long").groupBy("label", "feature").agg(
        F.sum("n").alias("n")).toArrow()
    out = {}
    label, feature, n = (sums.column(c).to_numpy() for c in ("label", "feature", "n"))
    for y in np.unique(label):
        out[int(y)] = np.zeros((1 << p.bits) + 1, np.int64)
        out[int(y)][feature[label == y]] = n[label == y]
    return out


def log_ratio(in_toxic, in_clean, n_toxic, n_clean, smooth: float):
    """ln of a feature's rate among toxic texts to that among clean ones."""
    return np.log((in_toxic + smooth) / (n_toxic + 2 * smooth)) - np.log((in_clean + smooth) / (n_clean + 2 * smooth))


def telling(counts: dict[int, np.ndarray], p: Params) -> np.ndarray:
    """Flags of the features that take part."""
    toxic, clean = counts[1][:-1], counts[0][:-1]
    total, n = toxic + clean, counts[1][-1] + counts[0][-1]
    rate = total / n
    apart = np.abs(toxic / counts[1][-1] - clean / counts[0][-1]) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    apart[total < p.least] = 0
    limit = np.partition(apart, -p.kept)[-p.kept] if p.kept < len(apart) else 0
    return (apart > 0) & (apart >= limit)


def _vectors(p: Params, shared):
    def run(batches):
        wanted = shared.value
        for batch in batches:
            raw, off = text_buffers(batch.column("text"))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for lo, hi in slices(off):
                row, feature = features(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], p, wanted)
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(feature.astype(np.int32)))
                yield pa.record_batch([pa.array(label[lo:hi].astype(np.int32)), lists], names=["label", "features"])
    return run


def fit(row, feature, y, each, counts: dict[int, np.ndarray], prior: float, p: Params) -> tuple[np.ndarray, float]:
    """Weights of the features, before scaling, and the bias: penalised logistic regression of ``y`` on ratios that leave the
    row itself out."""
    toxic, clean = counts[1][:-1], counts[0][:-1]
    own = (y == 1)[row].astype(np.int64)
    value = log_ratio(toxic[feature] - own, clean[feature] - (1 - own), counts[1][-1] - own, counts[0][-1] - (1 - own), p.smooth)
    entries = Sparse(row, feature, value, len(y), 1 << p.bits)

    def loss(x):
        w, b = x[:-1], x[-1]
        q = sigmoid(entries.times(w) + b)
        d = each * (q - y)
        fit = -(each * (y * np.log(q + 1e-12) + (1 - y) * np.log(1 - q + 1e-12))).sum()
        return (fit + 0.5 * p.ridge * (w @ w),
                np.append(entries.back(d) + p.ridge * w, d.sum()))

    x = minimise(loss, np.append(np.zeros(1 << p.bits), prior), steps=60)
    return x[:-1], float(x[-1])


def train(labelled: DataFrame, totals: dict[int, int], p: Params = Params()) -> Model:
    """Fit on ``labelled`` (doc_id, text, label 0 or 1), of which ``totals`` rows of each label exist."""
    counts = class_counts(labelled.select("text", "label"), p)
    n = {y: int(counts[y][-1]) if y in counts else 0 for y in (0, 1)}
    if not n[0] or not n[1]:
        return Model(np.zeros(1 << p.bits), np.inf if n[1] else -np.inf, p)
    wanted = telling(counts, p)
    shared = labelled.sparkSession.sparkContext.broadcast(wanted)  # 2 ** bits bytes

    share = {y: min(1.0, p.sample_rows / 2 / n[y]) for y in (0, 1)}
    sample = labelled.where(_draw(17) < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    got = sample.select("text", "label").mapInArrow(_vectors(p, shared), "label int, features array<int>").limit(
        2 * p.sample_rows).toArrow()  # a draw by doc_id has no bound where ids repeat
    y = got.column("label").to_numpy().astype(float)
    lists = pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(c.cast(pa.list_(pa.int32())) for c in got.column("features").chunks)])
    feature = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    if not len(y):
        return Model(np.zeros(1 << p.bits), float(np.log(totals[1] / totals[0])), p)
    each = np.where(y == 1, totals[1] / max(y.sum(), 1), totals[0] / max((1 - y).sum(), 1))
    weight, bias = fit(row, feature, y, each / each.sum(), counts, np.log(totals[1] / totals[0]), p)
    ratio = log_ratio(counts[1][:-1], counts[0][:-1], n[1], n[0], p.smooth)
    return Model(np.where(wanted, ratio * weight, 0), bias, p)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and score (0 to 1) of every row of ``docs``."""
    p, bias = model.params, model.bias
    shared = docs.sparkSession.sparkContext.broadcast(model.weight.astype(np.float32))  # 4 x 2 ** bits bytes

    def run(batches):
        weight = shared.value
        wanted = weight != 0
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            out = np.empty(batch.num_rows)
            for lo, hi in slices(off):
                row, feature = features(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], p, wanted)
                out[lo:hi] = sigmoid(row_sums(row, weight[feature], hi - lo) + bias)
            yield pa.record_batch([batch.column(0), pa.array(out)], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, score double").withColumnRenamed("key", key)


def held_out(doc_id="doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _draw(seed: int):
    """A fixed number in [0, 1) for each doc_id."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, even: bool = True):
    """(doc_id, text, label) of at most ``bound`` rows that may be learnt from, drawn by hash of doc_id,
    and how many of each label there are in all. ``even``: as many of each label, else all in proportion."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(
        "doc_id", F.col(label).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    aim = 0.95 * bound  # a draw strays from its aim by far less than the rest, so that the limit doesn't bind
    share = F.lit(0.0)
    for y, n in totals.items():
        part = aim / len(totals) / n if even else aim / sum(totals.values())
        share = F.when(F.col("label") == y, min(1.0, part)).otherwise(share)
    few = known.where(_draw(5) < share).limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), totals
