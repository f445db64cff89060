"""Language identification by mixture inference.

Each learnt language has a multinomial over hashed byte trigrams. A document is a
mixture: every word comes from one of the languages, with the likelihood of its
trigrams. Expectation-maximisation estimates the document's language proportions; languages are
then dropped, rarest first, while the penalised likelihood rises. The answer is the
language with the largest share, which is also the score.

Counts are gathered over all learning rows in Spark (languages x 2 ** bits sums);
inference is one pass over the texts without a shuffle.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for every
row when nothing was learnt; repeated rows agree; rows without a language teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_large_strings, slices, text_buffers

_U32 = np.uint32


@dataclass(frozen=True)
class Params:
    bits: int = 16
    smooth: float = 0.5
    steps: int = 12  # of expectation-maximisation
    penalty: float = 3.0  # times log(words) / 2, for each language beside the first


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logp: np.ndarray  # languages x 2 ** bits
    params: Params


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    for a in range(97, 123):
        table[a] = table[a - 32] = a
    table[128:] = np.arange(128, 256)
    return table


_LETTER = _letters()


def spaced(column) -> pa.LargeStringArray:
    """Texts with a space after each, so that no trigram joins two rows."""
    none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    return pc.binary_join_element_wise(as_large_strings(column), none, space)


def trigrams(raw: np.ndarray, offsets: np.ndarray, bits: int):
    """Hashed trigram around each letter byte, the first of these for each word, and each word's row."""
    text = np.concatenate([np.array([32], np.uint8), _LETTER[raw], np.array([32], np.uint8)])
    at = np.flatnonzero(text[1:-1] != 32)
    if len(at) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    code = text[at].astype(_U32) | text[at + 1].astype(_U32) << _U32(8) | text[at + 2].astype(_U32) << _U32(16)
    code = (code * _U32(0x9E3779B1)) >> _U32(32 - bits)
    first = np.flatnonzero(text[at] == 32)
    row = np.searchsorted(offsets, at[first], "right") - 1
    return code.astype(np.int64), first, row


def _counts(p: Params):
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, off = text_buffers(spaced(batch.column("text")))
            names = batch.column("lang").to_pylist()
            known = {x: i for i, x in enumerate(dict.fromkeys(names))}
            lang = np.array([known[x] for x in names])
            for lo, hi in slices(off):
                code, first, row = trigrams(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], p.bits)
                of = np.repeat(lang[lo:hi][row], np.diff(np.append(first, len(code)))) if len(code) else first
                for name, i in known.items():
                    mine = total.setdefault(name, np.zeros(1 << p.bits, np.int64))
                    mine += np.bincount(code[of == i], minlength=1 << p.bits)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                   pa.array(n[at])], names=["lang", "feature", "n"])
    return run


def train(rows: DataFrame, p: Params = Params()) -> Model:
    """Learn from ``rows`` (text, lang), all of them; the sums that reach the driver
    are at most 2 ** bits for each language."""
    sums = rows.where("lang is not null and text is not null").select("text", "lang").mapInArrow(
        _counts(p), "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names, feature, n = sums.column("lang").to_pylist(), sums.column("feature").to_numpy(), sums.column("n").to_numpy()
    languages = tuple(sorted(set(names)))
    counts = np.zeros((len(languages), 1 << p.bits))
    index = {x: i for i, x in enumerate(languages)}
    counts[[index[x] for x in names], feature] = n
    counts += p.smooth
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)), p)


def _em(like, starts, sizes, allowed, steps):
    """Proportions and log likelihood of each document; ``like`` is words x languages."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(steps):
        part = like * np.repeat(share, sizes, axis=0)
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, starts, axis=0) / sizes[:, None]
    total = np.log((like * np.repeat(share, sizes, axis=0)).sum(axis=1))
    return share, np.add.reduceat(total, starts)


def infer(word_logp: np.ndarray, sizes: np.ndarray, p: Params):
    """Proportions (documents x languages) after selection of the language set.
    ``sizes``: words of each document, over 0."""
    top = word_logp.max(axis=1, keepdims=True)
    # a floor, so that a word that a language can't have leaves a finite likelihood
    like = np.exp(np.maximum(word_logp - top, -60.0))
    n, k = len(sizes), like.shape[1]
    starts = np.cumsum(sizes) - sizes
    allowed = np.ones((n, k))
    share, value = _em(like, starts, sizes, allowed, p.steps)
    open_ = np.arange(n)
    for _ in range(k - 1):
        if len(open_) == 0:
            break
        words = np.repeat(starts[open_] - (np.cumsum(sizes[open_]) - sizes[open_]), sizes[open_]) + np.arange(sizes[open_].sum())
        fewer = allowed[open_].copy()
        fewer[np.arange(len(open_)), np.where(fewer > 0, share[open_], np.inf).argmin(axis=1)] = 0
        size = sizes[open_]
        share2, value2 = _em(like[words], np.cumsum(size) - size, size, fewer, p.steps)
        better = value2 + p.penalty * np.log(size + 1) / 2 >= value[open_]
        open_ = open_[better]
        allowed[open_], share[open_], value[open_] = fewer[better], share2[better], value2[better]
        open_ = open_[allowed[open_].sum(axis=1) > 1]
    return share * (allowed > 0)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred, score and n_langs (languages selected) of every row."""
    p, languages = model.params, model.languages
    shared = docs.sparkSession.sparkContext.broadcast(model.logp.astype(np.float32))  # 4 x 2 ** bits bytes a language

    def run(batches):
        logp = shared.value
        for batch in batches:
            column = spaced(batch.column(1))
            raw, off = text_buffers(column)
            best = np.full(batch.num_rows, -1)
            score, chosen = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for lo, hi in slices(off) if languages else ():
                code, first, row = trigrams(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], p.bits)
                if len(first) == 0:
                    continue
                words = np.stack([np.add.reduceat(table[code], first) for table in logp], axis=1).astype(float)
                at, sizes = np.unique(row, return_counts=True)
                share = infer(words, sizes, p)
                best[lo + at], score[lo + at] = share.argmax(axis=1), share.max(axis=1)
                chosen[lo + at] = (share > 0).sum(axis=1)
                for i in lo + at:  # bytes over 127 needn't be letters
                    t = raw[off[i]:off[i + 1]]
                    if not ((t | 32) - 97 < 26).any() and not any(map(str.isalpha, t.tobytes().decode("utf-8", "replace"))):
                        best[i], score[i], chosen[i] = -1, 0.0, 0
            names = pa.array([languages[b] if b >= 0 else "und" for b in best], pa.string())
            yield pa.record_batch([batch.column(0), names, pa.array(np.minimum(score, 1.0)), pa.array(chosen)],
                                  names=["key", "lang_pred", "score", "n_langs"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, lang_pred string, score double, n_langs int").withColumnRenamed("key", key)
