"""Passage dedup: cuts every later copy of ``words`` tokens in a row, wherever it starts.

A token is a run without white space, in lower case; in scripts that put no spaces between words
each letter is one. Lines and sentences don't matter. Two passages of ``words`` equal tokens
share a run of ``GRAM`` tokens that has the least hash of its neighbourhood, in the same
place (winnowing). Only such runs are counted over the whole corpus; around those that
occur again all windows of ``words`` tokens are hashed and compared.

A window is cut if an equal one stands earlier by (doc_id, text digest, place): in another document,
or in the same one and not overlapping. Every token that is cut has an earlier equal.

Defined results: a null or empty text stays as it is; documents equal in doc_id and text are one
document said twice and are cut alike; a null doc_id ranks first. Shorter passages stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, seeded, written
from .line_dedup import text_key

GRAM = 10
# Thai to Myanmar, Khmer, kana, Han with extensions and compatibility forms
_NO_SPACES = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_TOKEN = re.compile(f"[{_NO_SPACES}]|[^\\s{_NO_SPACES}]+")
_U = np.uint64


def _tokens(text: str):
    """(hash, first, end) of each token, in code points."""
    found = list(_TOKEN.finditer(text))
    digest = xxhash.xxh3_64_intdigest
    return (np.array([digest(m[0].lower()) for m in found], np.uint64),
            np.array([m.start() for m in found], np.int32), np.array([m.end() for m in found], np.int32))


def _rolled(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of the n tokens from each place on."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k, odd in enumerate(seeded(seed, n) | _U(1)):
        out += h[k:k + len(out)] * odd
    return mix(out)


def _least(grams: np.ndarray, width: int) -> np.ndarray:
    """The places of the least hash (ties: the last) of any ``width`` neighbours."""
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    out = [lo + np.arange(len(part)) + width - 1 - part[:, ::-1].argmin(axis=1)
           for lo in range(0, len(view), 1 << 14) for part in [view[lo:lo + (1 << 14)]]]
    return np.unique(np.concatenate(out))


def _batch(rows, kinds):
    return pa.record_batch([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds.values())],
                           names=list(kinds))


_GRAMS = {"g": pa.int64(), "doc_id": pa.int64(), "text_key": pa.int64(), "at": pa.int32()}
_WINDOWS = {"h1": pa.int64(), "h2": pa.int64(), "doc_id": pa.int64(), "text_key": pa.int64(), "at": pa.int32(),
            "first": pa.int32(), "end": pa.int32()}


def _ids(doc_id, n):
    return np.full(n, doc_id, object)  # a null stays one


def _grams(words: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                h, _, _ = _tokens(text)
                if len(h) >= words:
                    grams = _rolled(h, GRAM, 31)
                    at = _least(grams, words - GRAM + 1)
                    rows.append((grams[at].view(np.int64), _ids(doc_id, len(at)), np.full(len(at), key), at.astype(np.int32)))
            yield _batch(rows, _GRAMS)
    return run


def _windows(words: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, key, text, hits in zip(*(c.to_pylist() for c in batch.columns)):
                h, first, end = _tokens(text)
                near = (np.array(hits)[:, None] - np.arange(words - GRAM + 1)).ravel()
                at = np.unique(near[(near >= 0) & (near <= len(h) - words)])
                rows.append((_rolled(h, words, 32)[at].view(np.int64), _rolled(h, words, 33)[at].view(np.int64),
                             _ids(doc_id, len(at)), np.full(len(at), key), at.astype(np.int32), first[at], end[at + words - 1]))
            yield _batch(rows, _WINDOWS)
    return run


def _cut(batches):
    for batch in batches:
        out = []
        for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if cut:
                kept, at = [], 0
                for s in cut:  # sorted; windows overlap
                    if s["first"] > at:
                        kept.append(text[at:s["first"]])
                    at = max(at, s["end"])
                text = "".join([*kept, text[at:]]).rstrip()
            out.append(text)
        yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc", "kept_text"])


def repeated_windows(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, spans): code point ranges of windows that stand earlier in the corpus."""
    source = docs.where("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    grams = written(source.mapInArrow(_grams(words), "g long, doc_id long, text_key long, at int"), "grams")
    place = F.struct("doc_id", "text_key", "at")
    again = written(grams.groupBy("g").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x != y").select("g"), "repeated")
    hits = grams.join(again, "g").groupBy(F.col("doc_id").alias("id__"), F.col("text_key").alias("key__")).agg(
        F.collect_set("at").alias("hits"))  # bounded by the document's tokens
    same = F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("text_key") == F.col("key__"))
    found = source.join(hits, same).select("doc_id", "text_key", "text", "hits").mapInArrow(
        _windows(words), "h1 long, h2 long, doc_id long, text_key long, at int, first int, end int")
    found = written(found, "windows")
    again = found.groupBy("h1", "h2").agg(F.min(place).alias("earliest"), F.max(place).alias("latest")).where(
        "earliest != latest").select("h1", "h2", "earliest")
    again = written(again, "repeated")
    own = F.col("doc_id").eqNullSafe(F.col("earliest.doc_id")) & (F.col("text_key") == F.col("earliest.text_key"))
    later = found.join(again, ["h1", "h2"]).where(~own | (F.col("at") >= F.col("earliest.at") + words))
    return later.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans"))


def dedup(docs: DataFrame, words: int = 50) -> DataFrame:
    """doc (the input row) and kept_text."""
    spans = repeated_windows(docs, words).select(
        F.col("doc_id").alias("id__"), F.col("text_key").alias("key__"), "spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text__"),
                       F.col("doc_id").cast("long").alias("id2__"), text_key(F.col("text")).alias("key2__"))
    rows = rows.join(spans, F.col("id2__").eqNullSafe(F.col("id__")) & (F.col("key2__") == F.col("key__")), "left")
    rows = rows.select("doc", "text__", "spans")
    return rows.mapInArrow(_cut, T.StructType([rows.schema["doc"], T.StructField("kept_text", T.StringType())]))
