"""Hashed text features and the linear solvers over them (numpy inside tasks)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
        0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def fold(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, white space of any ASCII kind to a space."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] = table[97:123]
    table[9:14] = 32
    return table[raw]


def byte_ngrams(raw: np.ndarray, offsets: np.ndarray, n: int, bits: int):
    """Hashed n-grams of bytes as (row, feature) for every position; none crosses a row.
    A row shorter than n bytes has none."""
    if len(raw) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(raw) - n + 1
    code = raw[:m].astype(np.uint64)
    for k in range(1, n):
        code |= raw[k:k + m].astype(np.uint64) << _U(8 * k)
    code *= _U(_ODD[n % len(_ODD)])
    code ^= code >> _U(29)
    code *= _U(_ODD[(n + 3) % len(_ODD)])
    feature = (code >> _U(64 - bits)).astype(np.int64)
    lengths = np.maximum(np.diff(offsets) - (n - 1), 0)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(lengths) - lengths), lengths)
    return row, feature[at]


def letter_ngrams(raw: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int):
    """Hashed n-grams of code points inside words as (row, feature), A-Z folded.

    Whatever isn't a letter, a digit or beyond ASCII is one border sign; an n-gram may begin or end with it and
    holds none inside, so that a word's start and end count as characters.
    """
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets]  # code points before each row
    n_rows = len(offsets) - 1
    row = np.repeat(np.arange(n_rows + 1), np.append(np.diff(begins), 0))
    sign = np.zeros(len(points) + n_rows + 1, np.uint64)  # a border before, between and after the rows
    at = np.arange(len(points)) + row + 1
    folded = points + np.where((points >= 65) & (points <= 90), 32, 0).astype(np.uint32)
    sign[at] = np.where((points >= 128) | ((folded >= 97) & (folded <= 122)) | ((points >= 48) & (points <= 57)), folded, 0)
    borders = np.cumsum(sign == 0)
    owner = np.searchsorted(begins + np.arange(n_rows + 1), np.arange(len(sign)), "right") - 1  # a border before a row is its
    rows, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    code = sign + _U(1)
    for n in range(2, max(orders) + 1):
        if len(sign) < n:
            break
        code = code[:-1] * _U(_ODD[0]) + (sign[n - 1:] + _U(1))
        if n in orders:
            m = len(code)
            inside = np.flatnonzero(borders[n - 2:n - 2 + m] == borders[:m])
            key = code[inside] * _U(_ODD[n % len(_ODD)])
            key ^= key >> _U(31)
            key *= _U(_ODD[(n + 3) % len(_ODD)])
            rows.append(owner[inside])
            features.append((key >> _U(64 - bits)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(features)


def distinct(row: np.ndarray, feature: np.ndarray, bits: int):
    """Distinct (row, feature) pairs sorted by row, and how often each occurs."""
    key = (row.astype(np.uint64) << _U(bits)) | feature.astype(np.uint64)
    key.sort()
    if len(key) == 0:
        return row[:0], feature[:0], np.zeros(0, np.int64)
    new = np.empty(len(key), bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> _U(bits)).astype(np.int64), (key & _U((1 << bits) - 1)).astype(np.int64), counts


def row_sums(row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(row, weights=value, minlength=n_rows)


class Sparse:
    """Rows of (feature, value) entries for a linear model; products are taken a part at a time, so that nothing of the
    entries' number is made beside them."""

    PART = 1 << 18

    def __init__(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n_rows: int, n_features: int):
        self.row, self.feature, self.value = row.astype(np.int32), feature.astype(np.int32), value
        self.n_rows, self.n_features = n_rows, n_features

    def _parts(self):
        return (slice(lo, lo + self.PART) for lo in range(0, len(self.row), self.PART))

    def times(self, weight: np.ndarray) -> np.ndarray:
        """The sum of value x weight of each row."""
        out = np.zeros(self.n_rows)
        for p in self._parts():
            out += np.bincount(self.row[p], weights=self.value[p] * weight[self.feature[p]], minlength=self.n_rows)
        return out

    def back(self, slope: np.ndarray) -> np.ndarray:
        """The sum of value x the row's slope for each feature."""
        out = np.zeros(self.n_features)
        for p in self._parts():
            out += np.bincount(self.feature[p], weights=self.value[p] * slope[self.row[p]], minlength=self.n_features)
        return out


def minimise(fun, x0: np.ndarray, steps: int = 60, memory: int = 8, tol: float = 1e-5) -> np.ndarray:
    """Limited-memory BFGS with backtracking; ``fun(x)`` gives (loss, gradient)."""
    x = x0.copy()
    f, g = fun(x)
    ss, ys = [], []
    for _ in range(steps):
        q = g.copy()
        alphas = []
        for s, y in zip(reversed(ss), reversed(ys)):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if ys:
            q *= (ss[-1] @ ys[-1]) / (ys[-1] @ ys[-1])
        else:
            q /= max(1.0, np.abs(g).sum())
        for (s, y), a in zip(zip(ss, ys), reversed(alphas)):
            q += s * (a - (y @ q) / (s @ y))
        slope, t = -(q @ g), 1.0
        if slope >= 0:
            break
        while True:
            x2 = x - t * q
            f2, g2 = fun(x2)
            if f2 <= f + 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        s, y = x2 - x, g2 - g
        if s @ y > 1e-12:
            ss, ys = [*ss, s][-memory:], [*ys, y][-memory:]
        done = abs(f - f2) <= tol * max(1.0, abs(f))
        x, f, g = x2, f2, g2
        if done:
            break
    return x


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
