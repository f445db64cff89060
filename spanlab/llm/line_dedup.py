"""Substring dedup by hashing lines and, inside them, groups of sentences.

A unit is a line, or part of one: sentences are joined from the left until a unit has
``min_words`` words, so that after any long sentence two copies of a passage are cut
alike, whatever stands before them. Units are normalised (case, white space) and
their digests grouped over the whole corpus. The earliest occurrence by (doc_id,
text digest, offset) stays, all others are cut out; their code point ranges in the
original text are kept. Units of under ``min_words`` words are never cut.

Digests are counted with partial aggregation and only those that occur again are joined
back, so a unit that stands in a third of all documents makes no large group.

Defined results: a null or empty text has no units and stays as it is; a text of repeated units
only becomes empty; documents equal in doc_id and text are one document
said twice and are cut alike; a null doc_id ranks first. Extra columns pass through.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

_LINE = re.compile(r"[^\n]+\n?")
_SENTENCE = re.compile(r"\S.*?(?:[.!?…]+(?=\s)|$)\s*", re.S)

def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_key(text):
    """Digest that tells documents of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def units(text: str, min_words: int):
    """(first, end, normalised text) of every unit, in code points; white space after a unit belongs to it."""
    for line in _LINE.finditer(text):
        words = line.group().split()
        if len(words) < min_words:
            continue
        at, count = None, 0
        found: list[list] = []
        for sentence in _SENTENCE.finditer(text, line.start(), line.end()):
            at = sentence.start() if at is None else at
            count += len(sentence.group().split())
            if count >= min_words:
                found.append([at, sentence.end()])
                at, count = None, 0
        if at is not None and found:  # a short rest belongs to the unit before it
            found[-1][1] = line.end()
        for first, end in found:
            yield first, end, " ".join(text[first:end].lower().split())


def _digests(min_words: int):
    def run(batches):
        for batch in batches:
            rows = ([], [], [], [], [], [])
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                for first, end, norm in units(text or "", min_words):
                    h = xxhash.xxh3_128_intdigest(norm)
                    for column, v in zip(rows, (_signed(h >> 64), (h & 0x7FFFFFFF), doc_id, key, first, end)):
                        column.append(v)
                if len(rows[0]) > 50_000:
                    yield _batch(rows)
                    rows = ([], [], [], [], [], [])
            yield _batch(rows)
    return run


def _batch(rows):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds)],
                           names=["h1", "h2", "doc_id", "text_key", "first", "end"])


def repeated_spans(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """(doc_id, text_key, spans) of the documents with units that stand earlier in the corpus;
    spans: sorted code point ranges of those units."""
    source = docs.where("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    found = written(source.mapInArrow(
        _digests(min_words), "h1 long, h2 int, doc_id long, text_key long, first int, end int"), "units")
    place = F.struct("doc_id", "text_key", "first")
    again = found.groupBy("h1", "h2").agg(F.min(place).alias("earliest"), F.max(place).alias("latest")).where(
        "earliest != latest").select("h1", "h2", "earliest")
    again = written(again, "repeated")  # so that the join shuffles both sides itself and can split a hot unit
    later = found.join(again, ["h1", "h2"]).where(~place.eqNullSafe(F.col("earliest")))
    return later.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans"))  # bounded by the document's units


def _cut(batches):
    for batch in batches:
        texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        out = []
        for text, cut in zip(texts, spans):
            if cut:
                kept, at = [], 0
                for s in cut:
                    kept.append(text[at:s["first"]])
                    at = s["end"]
                text = "".join([*kept, text[at:]]).rstrip()
            out.append(text)
        yield pa.record_batch([batch.column(0), pa.array(out, pa.string()), batch.column(2)],
                              names=["doc", "kept_text", "spans"])


def dedup(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """doc (the input row), kept_text and spans (what was cut, in the original's code points; null: nothing)."""
    spans = repeated_spans(docs, min_words).select(
        F.col("doc_id").alias("id__"), F.col("text_key").alias("key__"), "spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text__"),
                       F.col("doc_id").cast("long").alias("id2__"), text_key(F.col("text")).alias("key2__"))
    rows = rows.join(spans, F.col("id2__").eqNullSafe(F.col("id__")) & (F.col("key2__") == F.col("key__")), "left")
    rows = rows.select("doc", "text__", "spans")
    schema = T.StructType([rows.schema["doc"], T.StructField("kept_text", T.StringType()), rows.schema["spans"]])
    return rows.mapInArrow(_cut, schema)
