"""Sequence packing by non-negative least squares over the length histogram.

Documents are tokenised once; every full window of a document becomes a sequence of its
own and the rest is one piece. Shallow combinations of piece lengths that fill a
window are enumerated, their repeat counts solved by non-negative least squares
against the histogram, rounded down, and what remains is packed greedily, largest
first. The histogram (at most ``window`` numbers) and the plan made from it are all the
driver holds; pieces are matched to the plan by their rank among equal lengths.

Defined results: a null or empty text is a piece of the end id alone; repeated rows are
packed each; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, as_large_strings, text_buffers, written
from .sharding import number_slots

WINDOW = 2048
END_ID = 1
RANK_SALTS = 32
_CACHE_WORDS = 1 << 19  # some tens of MB
# White space after which the tokenizer parts words; Arrow also splits at U+001C to U+001F, which it keeps
_SPACE = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_ODD_SPACE = "[\\x1c-\\x1f]"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: The task that cut a piece and, for a full window, its number among that task's.
_CUT = f"{PIECES}, task int, nth long"


# Letters that the tokenizer's normal form leaves as they are but for their case, then marks
_PLAIN = "^(?P<letters>[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}]+)(?P<marks>[.,!]*)$"


def _lists(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for one in ids for i in one], np.uint32), np.array([len(one) for one in ids], np.int64)


def _joined(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of ``ids`` that begin at ``first``, in a row."""
    before = np.cumsum(size) - size
    return ids[np.arange(size.sum()) + np.repeat(first - before, size)]


class WordIds:
    """Ids of texts for a tokenizer that drops white space and folds case: each distinct word
    between white space is encoded once and kept, up to a bound. A word of letters with
    marks after it is its lower-case letters and its marks; such letters are encoded many
    at a time, parted again where a token ends a word. Words stay in Arrow arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)  # for lower-case letters parted by spaces
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.words = pa.array([], pa.large_string())
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])

    def _direct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _lists([e.ids for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)])

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Encode words not yet kept; their places among the kept words."""
        parts = pc.extract_regex(words, _PLAIN)
        plain = pc.is_valid(parts)
        is_plain = plain.to_numpy(zero_copy_only=False)
        places = np.where(is_plain, (~is_plain).sum() + np.cumsum(is_plain), np.cumsum(~is_plain)) - 1 + len(self.words)
        other = words.filter(pc.invert(plain))
        if len(other):
            self._add(other, *self._direct(other))
        parts = parts.filter(plain)
        if not len(parts):
            return places
        letters = pc.utf8_lower(parts.field("letters")).dictionary_encode()
        marks = parts.field("marks").dictionary_encode()
        text = " ".join(letters.dictionary.to_pylist())
        ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        size = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
        mark_ids, mark_size = self._direct(marks.dictionary)
        ids, size = np.concatenate([ids, mark_ids]), np.concatenate([size, mark_size])
        at = np.stack([letters.indices.to_numpy(), len(letters.dictionary) + marks.indices.to_numpy()], axis=1)
        first = np.cumsum(size) - size
        self._add(words.filter(plain), _joined(ids, first[at.ravel()], size[at.ravel()]), size[at].sum(axis=1))
        return places

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by the end id, and their offsets."""
        odd = pc.any(pc.match_substring_regex(texts, _ODD_SPACE)).as_py()
        split = pc.split_pattern_regex(texts, _SPACE) if odd else pc.utf8_split_whitespace(texts)
        ends = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        at = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)
        if len(self.words) + (at < 0).sum() > _CACHE_WORDS:
            self.clear()
            at[:] = -1
        if (at < 0).any():
            at[at < 0] = self._learn(words.filter(pa.array(at < 0)))
        at = at[coded.indices.to_numpy()]
        size = self.size[at]
        ids = _joined(self.ids, self.first[at], size)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])[ends]
        offsets = np.concatenate([np.zeros(1, np.int64), ends + np.arange(1, len(ends) + 1)])
        return np.insert(ids, ends, np.uint32(END_ID)), offsets


def _cut(path: str, window: int):
    def run(batches):
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, task, full = WordIds(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            column = as_large_strings(batch.column("text"))
            _, off = text_buffers(column)
            keys = batch.column("doc_id")
            for lo, hi in slices(off, 1 << 21):  # many words at once; they take little room here
                ids, at = encoder.encode(column[lo:hi])
                raw, size = ids.astype("<u4").view(np.uint8), np.diff(at)
                many = -(-size // window)
                doc = np.repeat(np.arange(hi - lo), many)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * window
                length = np.minimum(size[doc] - start, window)
                first = (at[doc] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + length * 4).tolist())]
                whole = length == window
                nth = np.where(whole, full + np.cumsum(whole) - 1, 0)
                full += int(whole.sum())
                yield pa.record_batch(
                    [keys[lo:hi].take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                     pa.array(size[doc]), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth.astype(np.int64))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"])
    return run


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """All pieces of all documents: full windows and the rest."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _cut(tokenizer_path, window), _CUT)


def combinations(counts: np.ndarray, window: int, frequent: int = 48) -> list[tuple[int, ...]]:
    """Shallow combinations that fill ``window`` exactly: all pairs, and triples with two of
    the ``frequent`` lengths that hold most tokens. ``counts[n]``: pieces of length n."""
    have = np.flatnonzero(counts[:window])
    have = have[have > 0]
    present = counts > 0
    out = {(window - int(a), int(a)) for a in have if a * 2 <= window and present[window - a]}
    top = sorted(have.tolist(), key=lambda n: (-counts[n] * n, n))[:frequent]
    for i, a in enumerate(top):
        for b in top[i:]:
            c = window - a - b
            if c > 0 and present[c]:
                out.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(out, reverse=True)


def solve_nnls(patterns: list[tuple[int, ...]], counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeats x >= 0 that minimise |A x - counts|^2 (accelerated projected gradient)."""
    if not patterns:
        return np.zeros(0)
    at = np.array([n for p in patterns for n in p])
    of = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    use = lambda x: np.bincount(at, weights=x[of], minlength=len(counts))
    back = lambda r: np.bincount(of, weights=r[at], minlength=len(patterns))
    step = 1.0 / max(1.0, float(back(use(np.ones(len(patterns)))).max()))
    x = z = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        x2 = np.maximum(z - step * back(use(z) - counts), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = x2 + (t - 1) / t2 * (x2 - x), x2, t2
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use every piece exactly once; ``counts[n]``: pieces of length n."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    patterns = combinations(left, window)
    repeats = np.floor(solve_nnls(patterns, left.astype(float)) + 1e-6).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] <= 0:
            break
        need = np.unique(patterns[k], return_counts=True)
        n = int(min(repeats[k], (left[need[0]] // need[1]).min()))
        if n > 0:
            left[need[0]] -= n * need[1]
            out.append((patterns[k], n))
    return out + greedy(left, window)


def greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Largest first, each time the largest that still fits; a pattern is repeated while it can."""
    left, out = left.copy(), []
    have = sorted(np.flatnonzero(left).tolist())
    while have:
        parts, space, taken = [], window, {}
        i = len(have) - 1
        while i >= 0 and space > 0:
            n = have[i]
            if n > space:
                i = int(np.searchsorted(have, space, "right")) - 1
                continue
            fit = min(space // n, int(left[n]) - taken.get(n, 0))
            parts += [n] * fit
            taken[n] = taken.get(n, 0) + fit
            space -= n * fit
            i -= 1
        repeats = min(int(left[n]) // k for n, k in taken.items() if k)
        for n, k in taken.items():
            left[n] -= k * repeats
        out.append((tuple(parts), repeats))
        have = [n for n in have if left[n]]
    return out


def assignments(patterns: list[tuple[tuple[int, ...], int]]):
    """Arrays (length, first rank, pieces per sequence, first sequence, offset), sorted by length
    and rank: which ranks of a length go to which sequences."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, repeats in patterns:
        offset = 0
        for n in sorted(set(parts), reverse=True):
            many = parts.count(n)
            rows.append((n, used.get(n, 0), many, sequence, offset))
            used[n] = used.get(n, 0) + many * repeats
            offset += n * many
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """The pieces with sequence_id and offset. Sequences are filled without gaps from 0."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, window), "pieces")
    counts = np.zeros(window + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``window`` rows
        counts[r["length"]] = r["count"]
    table = assignments(plan(counts, window))  # rows grow with the lengths, not with the pieces
    shared = spark.sparkContext.broadcast((table, table[:, 0] << 44 | table[:, 1]))

    def run(batches):
        rows, key = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("slot").to_numpy()
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            _, first, many, sequence, offset = rows[at].T
            nth = rank - first
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(sequence + nth // many), pa.array(offset + nth % many * length)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # most pieces are full windows, which need no order: they are numbered by task, where they were cut
    whole = F.col("length") == window
    tasks = cut.where(whole).groupBy("task").agg((F.max("nth") + 1).alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # one row a task
    full = cut.where(whole).join(tasks, "task").withColumn("slot", F.col("first") + F.col("nth"))
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANK_SALTS)).cast("int")
    short = number_slots(cut.where(~whole).withColumn("salt__", salt), "length", "salt__", ["doc_id", "start", "ids_crc32"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot"]
    ranked = full.select(*columns).unionByName(short.select(*columns))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot").mapInArrow(
        run, f"{PIECES}, sequence_id long, offset long")
