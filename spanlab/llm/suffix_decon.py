"""Benchmark decontamination with suffix arrays of the training text.

Every slice of training documents is a shard. A shard's words get a suffix array
(prefix doubling, to a depth of at least one window); each test suffix that opens a window is
found in it by binary search, which gives all its occurrences. Occurrences in a row on
one diagonal are joined into the longest verbatim matches with their places.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
window. No document is shuffled. The benchmark is taken in blocks of at most
``block_bytes`` of text: a larger benchmark costs more passes, not more memory.

Defined results: null texts and texts without words have no words and no hits; an empty benchmark
hits nothing; a null item_id counts as the empty string; equal items all
count; repeated documents get equal results; a row's memory is that of its text. Extra
columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alphanumeric_words, slices, text_buffers, written

_WORDS = alphanumeric_words()
_TOP = np.uint64((1 << 64) - 1)
SHARD_BYTES = 1 << 20  # text of a training shard; sorting takes some 60 times as much

_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("matches", T.ArrayType(T.StructType([
        T.StructField("item_id", T.StringType()), T.StructField("item_start", T.IntegerType()),
        T.StructField("doc_start", T.IntegerType()), T.StructField("n_words", T.IntegerType())])))])


@dataclass(frozen=True)
class Block:
    """Distinct windows of some items, by length, and the items that hold them."""
    item_ids: list[str]
    windows: dict[int, np.ndarray]  # length: distinct windows x length word hashes
    owners: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: start of each window's owners; item; place


def build_block(item_ids: list[str], texts: list[str | None], window: int) -> Block:
    raw, off = text_buffers(pa.array(texts, pa.string()))
    h, _, _, row = _WORDS.words(raw, off)
    size = np.bincount(row, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    windows, owners = {}, {}
    for n in sorted({int(min(window, s)) for s in size if s}):
        mine = np.flatnonzero(np.minimum(size, window) == n)
        count = size[mine] - n + 1
        item = np.repeat(mine, count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        content = h[(first[item] + place)[:, None] + np.arange(n)]
        distinct, inverse = np.unique(content, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        # of an item's equal windows the first place is kept
        order = np.lexsort((place, item, inverse))
        o_win, o_item, o_place = inverse[order], item[order], place[order]
        keep = np.append(True, (o_win[1:] != o_win[:-1]) | (o_item[1:] != o_item[:-1]))
        o_win, o_item, o_place = o_win[keep], o_item[keep], o_place[keep]
        windows[n] = distinct
        owners[n] = (np.searchsorted(o_win, np.arange(len(distinct) + 1)), o_item, o_place)
    return Block(item_ids, windows, owners)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes, sorted by their first ``depth`` words or more (ties in any order)."""
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.reshape(-1).astype(np.int64)
    n, done = len(words), 1
    order = np.argsort(rank, kind="stable")
    while done < depth:
        nxt = np.zeros(n, np.int64)
        nxt[:n - done] = rank[done:] + 1
        key = rank << 32 | nxt
        order = np.argsort(key)
        key = key[order]
        new = np.append(0, np.cumsum(key[1:] != key[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        done *= 2
        if n and new[-1] == n - 1:
            break
    return order


def search(words: np.ndarray, order: np.ndarray, windows: np.ndarray):
    """For each window, the range of ``order`` whose suffixes begin with it."""
    n, depth = len(order), windows.shape[1]
    padded = np.append(words, np.full(depth, _TOP))
    step = np.arange(depth)

    def bound(after: bool):
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), n, np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            there = padded[order[mid][:, None] + step]
            differ = there != windows[open_]
            at = differ.argmax(axis=1)
            some = differ[np.arange(len(at)), at]
            less = some & (there[np.arange(len(at)), at] < windows[open_][np.arange(len(at)), at])
            right = less | (~some if after else False)
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo

    return bound(False), bound(True)


def _occurrences(words, doc, block: Block):
    """(place, length) of all occurrences of windows, and (place, length, item, place in the item)."""
    if not block.windows or len(words) == 0:
        return np.zeros((0, 2), np.int64), np.zeros((0, 4), np.int64)
    # documents are parted by a word of their own, which no window holds
    size = np.bincount(doc)
    gap = np.cumsum(size > 0)[doc] - 1
    parted = np.empty(len(words) + gap[-1] + 1, np.uint64)
    at = np.arange(len(words)) + gap
    ends = np.setdiff1d(np.arange(len(parted)), at, assume_unique=True)
    parted[at] = words
    parted[ends] = _TOP - np.arange(len(ends), dtype=np.uint64)
    back = np.zeros(len(parted), np.int64)
    back[at] = np.arange(len(words))
    order = suffix_array(parted, max(block.windows))
    places, pairs = [], []
    for n, windows in block.windows.items():
        possible = np.flatnonzero(np.isin(windows[:, 0], words))
        if len(possible) == 0:
            continue
        lo, hi = search(parted, order, windows[possible])
        found = hi > lo
        lo, hi, possible = lo[found], hi[found], possible[found]
        count = hi - lo
        window = np.repeat(possible, count)
        place = back[order[np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)]]
        places.append(np.stack([place, np.full(len(place), n)], axis=1))
        start, item, where = block.owners[n]
        many = start[window + 1] - start[window]
        own = np.arange(many.sum()) + np.repeat(start[window] - (np.cumsum(many) - many), many)
        pairs.append(np.stack([np.repeat(place, many), np.full(len(own), n), item[own], where[own]], axis=1))
    none = (np.zeros((0, 2), np.int64), np.zeros((0, 4), np.int64))
    return np.concatenate([none[0], *places]), np.concatenate([none[1], *pairs])


def _merge(pairs, doc, doc_first):
    """Longest matches: occurrences of one item on one diagonal of a document, joined."""
    if len(pairs) == 0:
        return np.zeros((0, 5), np.int64)
    place, n, item, where = pairs.T
    order = np.lexsort((place, place - where, item, doc[place]))
    place, n, item, where = place[order], n[order], item[order], where[order]
    d = doc[place]
    same = (d[1:] == d[:-1]) & (item[1:] == item[:-1]) & ((place - where)[1:] == (place - where)[:-1])
    joined = same & (place[1:] <= place[:-1] + n[:-1])
    head = np.flatnonzero(np.append(True, ~joined))
    last = np.append(head[1:], len(place)) - 1
    return np.stack([d[head], item[head], where[head], place[head] - doc_first[d[head]],
                     place[last] + n[last] - place[head]], axis=1)


def _find(block: Block, text_at: int, pass_count: int):
    """Task function: adds what a block finds to ``found__`` of every row; the text is field
    ``text_at`` of the row."""
    def run(batches):
        arrow_type = pa.struct([
            ("n_words", pa.int64()),
            ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
            ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()),
                                            ("doc_start", pa.int32()), ("n_words", pa.int32())])))])
        for batch in batches:
            raw, off = text_buffers(batch.column(0).field(text_at))
            before = batch.column(1).to_pylist() if pass_count else None
            for lo, hi in slices(off, SHARD_BYTES):
                out = []
                words, _, _, doc = _WORDS.words(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                size = np.bincount(doc, minlength=hi - lo) if len(doc) else np.zeros(hi - lo, np.int64)
                first = np.cumsum(size) - size
                places, pairs = _occurrences(words, doc, block)
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, places[:, 0], 1)
                np.add.at(mark, places[:, 0] + places[:, 1], -1)
                hit = np.cumsum(mark)[:-1] > 0
                edge = np.flatnonzero(hit & (np.append(True, ~hit[:-1]) | np.append(True, doc[1:] != doc[:-1]))) if len(hit) else []
                end = np.flatnonzero(hit & (np.append(~hit[1:], True) | np.append(doc[1:] != doc[:-1], True))) + 1 if len(hit) else []
                spans: dict[int, list] = {}
                for a, b in zip(edge, end):
                    d = int(doc[a])
                    spans.setdefault(d, []).append({"first": int(a - first[d]), "end": int(b - first[d])})
                matches: dict[int, list] = {}
                for d, i, j, p, n in _merge(pairs, doc, first).tolist():
                    matches.setdefault(d, []).append(
                        {"item_id": block.item_ids[i], "item_start": j, "doc_start": p, "n_words": n})
                for d in range(hi - lo):
                    found = {"n_words": int(size[d]), "spans": spans.get(d, []), "matches": matches.get(d, [])}
                    if before is not None:
                        old = before[lo + d]
                        found["spans"] = _union(old["spans"] + found["spans"])
                        found["matches"] = old["matches"] + found["matches"]
                    out.append(found)
                yield pa.record_batch([batch.column(0)[lo:hi], pa.array(out, arrow_type)], names=["doc__", "found__"])
    return run


def _union(spans):
    out = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[DataFrame]:
    """The items in parts of about ``block_bytes`` of text each."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(part == i) if n > 1 else items for i in range(n)]


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32 << 20,
                 text: str = "text") -> DataFrame:
    """``doc`` (the input row), n_words, spans (hit word ranges) and matches (longest
    verbatim matches: item_id, item_start, doc_start, n_words, counted in words)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc__"))
    text_at = [c.lower() for c in docs.columns].index(text.lower())
    schema = T.StructType([*rows.schema.fields, T.StructField("found__", _FOUND)])
    blocks = benchmark_blocks(benchmark, window, block_bytes)
    for i, part in enumerate(blocks):
        got = part.collect()  # at most about block_bytes
        block = build_block([r["item_id"] for r in got], [r["text"] for r in got], window)
        rows = rows.mapInArrow(_find(block, text_at, i), schema)
        if i + 1 < len(blocks):  # so that neither the driver nor a task holds two blocks
            rows = written(rows, "matches")
    return rows.select(F.col("doc__").alias("doc"), "found__.*")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc, n_words, n_hit, n_items, items_sha256, contaminated, longest_match of every document."""
    found = find_matches(docs, benchmark, window)
    items = F.array_sort(F.array_distinct(F.col("matches")["item_id"]))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]))
    return found.select(
        "doc", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.col("matches")["n_words"]), F.lit(0)).alias("longest_match"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any hit, with their columns."""
    return find_matches(docs, benchmark, window).where(F.size("spans") == 0).select("doc.*")
