"""Ranked lexical search without random access (NRA) over impact-sorted lists.

Documents are indexed in shards of bounded size: for every query term a list of the documents that hold it and
how often. Each list is read in sequence, highest impact first, and a document's score is known only as an
interval: the sum of what was read of it, and that plus, for every list in which it hasn't been met, the last impact read
there. Reading goes on until every document whose upper bound reaches the k-th best lower bound is known
exactly: membership, ties and final scores are then settled. Nothing is looked up out of sequence.

A share of the shards is searched first; the k-th best score found there holds as a bound in all others, most of
whose lists then needn't be read to their ends. A task carries its own k best from shard to shard, too, and gives out
at most k rows an item. Texts are read once and never shuffled; the index holds the query terms only. The items are
taken in blocks of at most about ``block_bytes`` of text, and a block's results are written before the next is begun.

A document's impact for a term is (1000000000 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L; an item's score sums
w x impact over its terms, repeats included, with w = floor(1000 ln((2 N + 2) / (2 df + 1))).

Defined results: null texts and texts without terms have none and count nowhere; items without terms, or whose
terms are in no document, have no results; equal items are ranked each for itself; equal documents all
take part; equal scores go by the id, a null id last; words are told apart by 64-bit hashes; columns that clash are never
read; a row's memory is that of its text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alphanumeric_words, slices, text_buffers, written

_WORDS = alphanumeric_words()
_TIES = 64  # groups of an item's rows that are cut to k on their own first


@dataclass(frozen=True)
class Params:
    k: int = 20
    block_bytes: int = 8 << 20  # text of items searched at once
    shard_docs: int = 4096
    shard_postings: int = 1 << 19
    first_read: int = 128  # postings of each list in the first round, twice as many in each further one
    seed_shards: int = 8  # one in so many shards is searched first


@dataclass(frozen=True)
class Items:
    ids: list
    terms: list[np.ndarray]  # places in ``vocabulary``
    times: list[np.ndarray]  # how often the item holds each
    vocabulary: np.ndarray  # sorted hashes


def parse_items(ids: list, texts: list[str | None]) -> Items:
    raw, off = text_buffers(pa.array(texts, pa.string()))
    h, _, _, row = _WORDS.words(raw, off)
    vocabulary, place = np.unique(h, return_inverse=True)
    terms, times = [], []
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        t, n = np.unique(place.reshape(-1)[a:b], return_counts=True)
        terms.append(t)
        times.append(n)
    return Items(ids, terms, times, vocabulary)


def _index(vocabulary, p: Params, id_type: pa.DataType):
    """Task function: shards of documents as lists by term."""
    def run(batches):
        words = vocabulary.value
        held, ids, all_docs, all_terms, size = [], [], 0, 0, 0

        def shard():
            doc, term, tf, n = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((doc, term))
            doc, term, tf = doc[order], term[order], tf[order]
            terms, sizes = np.unique(term, return_counts=True)
            one = [pa.array([v], t) for v, t in (
                (all_docs, pa.int64()), (all_terms, pa.int64()), (terms, pa.list_(pa.int32())), (sizes, pa.list_(pa.int32())),
                (ids, pa.list_(id_type)), (n.astype(np.int64).tobytes(), pa.binary()), (doc.astype(np.int32).tobytes(), pa.binary()),
                (tf.astype(np.int32).tobytes(), pa.binary()))]
            return pa.record_batch(one, names=["n_docs", "n_terms", "terms", "sizes", "ids", "n", "doc", "tf"])

        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            keys = batch.column(0).to_pylist()
            for lo, hi in slices(off):
                h, _, _, row = _WORDS.words(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                n = np.bincount(row, minlength=hi - lo) if len(row) else np.zeros(hi - lo, np.int64)
                all_docs, all_terms = all_docs + int((n > 0).sum()), all_terms + len(h)
                at = np.searchsorted(words, h)
                known = at < len(words)
                known[known] = words[at[known]] == h[known]
                pairs, tf = np.unique(row[known].astype(np.int64) * max(len(words), 1) + at[known], return_counts=True)
                doc, term = pairs // max(len(words), 1), pairs % max(len(words), 1)
                mine, doc = np.unique(doc, return_inverse=True)
                held.append((doc.reshape(-1) + len(ids), term, tf, n[mine]))
                ids += [keys[lo + i] for i in mine]
                size += len(tf)
                if len(ids) >= p.shard_docs or size >= p.shard_postings:
                    yield shard()
                    held, ids, all_docs, all_terms, size = [], [], 0, 0, 0
        if held:
            yield shard()
    return run


def index(docs: DataFrame, vocabulary: np.ndarray, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards: counts over all their documents, and the lists of the terms whose hashes ``vocabulary`` holds."""
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([
        T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("ids", T.ArrayType(kind)), *[T.StructField(c, T.BinaryType()) for c in ("n", "doc", "tf")]])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # words of one block of items
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        _index(shared, p, to_arrow_type(kind)), schema)


def weights(shards: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """The weight of each term of the vocabulary of ``size`` words, N and L."""
    n, total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    pairs = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
    out = np.zeros(size, np.int64)
    for r in pairs.toLocalIterator():  # at most ``size`` rows
        out[r["terms"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    return out, n or 0, total or 0


def nra(lists: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, k: int, bound: int, first_read: int):
    """(documents, scores, postings read): every document with a score of at least the k-th best and of ``bound``, exactly.

    ``lists``: weight, documents and impacts, highest first.
    """
    lower, unmet = np.zeros(n_docs, np.int64), np.ones((len(lists), n_docs))
    last = np.array([w * int(x[0]) for w, _, x in lists], float)  # no posting is above its list's first
    at, step = 0, first_read
    while True:
        upper = lower + last @ unmet
        best = max(bound, int(np.partition(lower, n_docs - k)[n_docs - k])) if n_docs > k else bound
        open_ = (upper * (1 + 1e-12) >= best) & (upper > lower)
        if not open_.any():
            found = np.flatnonzero(lower >= best)
            return found, lower[found], sum(min(at, len(d)) for _, d, _ in lists)
        for t, (w, docs, impacts) in enumerate(lists):
            part = docs[at:at + step]
            if len(part):
                lower[part] += w * impacts[at:at + step]
                unmet[t, part] = 0
                last[t] = w * int(impacts[at + len(part) - 1]) if at + len(part) < len(docs) else 0
        at += step
        step *= 2


def _order(entry):
    score, key = entry
    return -score, key is None, key if key is not None else 0


def _search(shared, p: Params, id_type: pa.DataType, item_type: pa.DataType):
    """Task function: the k best of a task's shards for each item."""
    def run(batches):
        items, weight, n_all, total, bounds = shared.value
        best: list[list] = [[] for _ in items.ids]
        for batch in batches:
            for i in range(batch.num_rows):
                terms, sizes = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("terms", "sizes"))
                if not len(terms):
                    continue
                ids = batch.column("ids")[i].as_py()
                n = np.frombuffer(batch.column("n")[i].as_py(), np.int64)
                doc, tf = (np.frombuffer(batch.column(c)[i].as_py(), np.int32).astype(np.int64) for c in ("doc", "tf"))
                m = (75 + 25 * n.astype(object) * n_all // total).astype(np.int64)
                impact = 1000000000 * tf // (1000 * tf + 12 * m[doc])
                order = np.lexsort((-impact, np.repeat(np.arange(len(terms)), sizes)))
                doc, impact = doc[order], impact[order]
                ends = np.cumsum(sizes)
                for q, (own, times) in enumerate(zip(items.terms, items.times)):
                    at = np.searchsorted(terms, own)
                    here = at < len(terms)
                    here[here] = terms[at[here]] == own[here]
                    w = weight[own] * times
                    lists = [(int(x), doc[ends[a] - sizes[a]:ends[a]], impact[ends[a] - sizes[a]:ends[a]])
                             for x, a in zip(w[here], at[here]) if x]
                    mine = best[q]
                    bound = max(1, int(bounds[q]), mine[-1][0] if len(mine) == p.k else 0)
                    if not lists or sum(x * int(imp[0]) for x, _, imp in lists) < bound:
                        continue
                    found, score, _ = nra(lists, len(ids), p.k, bound, p.first_read)
                    if len(found):
                        best[q] = sorted([*mine, *((int(s), ids[d]) for d, s in zip(found, score))], key=_order)[:p.k]
        for q, rows in enumerate(best):
            if rows:
                yield pa.record_batch([pa.array([q] * len(rows), pa.int32()), pa.array([items.ids[q]] * len(rows), item_type),
                                       pa.array([d for _, d in rows], id_type), pa.array([s for s, _ in rows], pa.int64())],
                                      names=["q", "item_id", "doc_id", "score"])
    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank; groups of an item's rows are cut to k first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(_TIES))
    few = hits.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order))).where(F.col("r") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k).drop("r", "part")


def search(docs: DataFrame, items: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the ``p.k`` best documents of each row of ``items`` (item_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    id_type, item_type = docs.schema[key].dataType, items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", item_type),
                           T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // p.block_bytes) or 1
    place, out = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)), None
    for b in range(blocks):
        got = items.where(place == b).select("item_id", "text").collect()  # about block_bytes
        asked = parse_items([r["item_id"] for r in got], [r["text"] for r in got])
        shards = written(index(docs, asked.vocabulary, p, key, text).withColumn("shard", F.monotonically_increasing_id()), "shards")
        weight, n, length = weights(shards, len(asked.vocabulary))

        def run(part, bounds):
            shared = spark.sparkContext.broadcast((asked, weight, n, length, bounds))
            return written(part.select("terms", "sizes", "ids", "n", "doc", "tf").mapInArrow(
                _search(shared, p, to_arrow_type(id_type), to_arrow_type(item_type)), schema), "hits")

        first = F.pmod(F.xxhash64("shard"), F.lit(p.seed_shards)) == 0
        bounds = np.zeros(len(got), np.int64)
        seeds = _ranked(run(shards.where(first), bounds), p.k)
        for r in seeds.where(F.col("rank") == p.k).select("q", "score").collect():  # at most a row an item
            bounds[r["q"]] = r["score"]
        hits = _ranked(seeds.select(*schema.names).unionByName(run(shards.where(~first), bounds)), p.k).select(
            "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        hits = written(hits, "ranked") if blocks > 1 else hits
        out = hits if out is None else out.unionByName(hits)
    return out
