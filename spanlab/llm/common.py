"""Helpers shared by the operators: shared scratch tables, Arrow text buffers, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from spanlab.session import ensure_checkpoint_dir

# Text handled by numpy at once; a longer document forms a slice of its own. Columns of a
# slice take some 100 bytes for each of its bytes, and freed ones stay with the worker.
SLICE_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


_MADE: dict[str, list[str]] = {}  # application: its scratch folders


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names in spark.checkpoint.dir."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def passing(spark: SparkSession):
    """Tables written inside are removed at the end: for steps whose result is written elsewhere by then."""
    made = _MADE.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    yield
    for path in made[before:]:
        _remove(spark, path)
    del made[before:]


def _remove(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))


def release(spark: SparkSession) -> int:
    """Remove all tables that this session's operators have written between their steps, once their results
    have been read or written elsewhere; returns how many."""
    return sum(_remove(spark, path) for path in _MADE.pop(spark.sparkContext.applicationId, []))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor
    costs its running tasks only, and what was written isn't computed again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_large_strings(column) -> pa.LargeStringArray:
    """One array without nulls (null: empty string) and with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in a row, and the rows' offsets into them."""
    arr = as_large_strings(column)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (or of one row)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs only give equal outputs."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


class WordHasher:
    """Words of whole texts, as byte ranges and 64-bit hashes, without a loop over words.

    ``is_word``: 256 flags, which bytes belong to words (all bytes of a multi-byte
    character alike). A-Z are folded to a-z. A word's hash is a polynomial in its
    bytes, taken from running sums.
    """

    def __init__(self, is_word: np.ndarray):
        self.is_word = np.asarray(is_word, bool)
        self.value = seeded(7, 256)
        self.value[65:91] = self.value[97:123]
        self.power = self.inverse = np.ones(1, np.uint64)

    def __reduce__(self):  # the tables of powers are built where they are used
        return WordHasher, (self.is_word,)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, SLICE_BYTES + 1)
            step = np.full(size, _BASE, np.uint64)
            back = np.full(size, pow(_BASE, -1, 1 << 64) & _MASK, np.uint64)
            step[0] = back[0] = 1
            self.power, self.inverse = np.cumprod(step), np.cumprod(back)

    def words(self, raw: np.ndarray, offsets: np.ndarray):
        """(hash, first byte, end byte, document row) of every word, in order."""
        n = len(raw)
        if n == 0:
            z = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), z, z, z
        self._grow(n + 1)
        inside = self.is_word[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        first = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[raw] * self.power[:n], out=total[1:])
        h = mix((total[end] - total[first]) * self.inverse[first] + (end - first).astype(np.uint64))
        doc = np.searchsorted(offsets, first, "right") - 1
        return h, first, end, doc


def ascii_space_words() -> WordHasher:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    flags = np.ones(256, bool)
    flags[[0x20, *range(0x09, 0x0E)]] = False
    return WordHasher(flags)


def alphanumeric_words() -> WordHasher:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of text with A-Z folded."""
    flags = np.zeros(256, bool)
    flags[0x30:0x3A] = flags[0x41:0x5B] = flags[0x61:0x7B] = flags[0x80:] = True
    return WordHasher(flags)
