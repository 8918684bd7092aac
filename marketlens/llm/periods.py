"""Periodic runs of words: blocks of dyadic sizes, convolved with the windows after them.

A run with period q is a stretch whose words recur q words later. For each size
b = 2, 4, 8, ... the text is cut into blocks of b words. A run with a period of
this scale (2b-1 to 4b-2 words; 1 to 6 for the least size) holds at least one
whole block that stands again q words later. Where that is, the sum of squared
differences between the block and the words at distance q is zero; the sums for
all distances of the scale are one convolution, computed exactly by number
theoretic transforms, all blocks of a size at once. Each distance found is a
seed that is compared word by word to both sides and so becomes a run.

Blocks that cannot recur (some pair of neighbouring words does not stand again
within the window) and blocks deep inside a run of a shorter period are left
out before the transforms; neither loses a run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12

#: Primes k * 2**m + 1 with a root that generates all their residues, and m.
_PRIMES = ((2013265921, 31, 27), (469762049, 3, 26))
#: Numbers in one array of a transform.
_CHUNK = 1 << 19

SCHEMA = ("n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def _powers(root: int, n: int, prime: int) -> np.ndarray:
    """The first ``n`` powers of ``root``, by doubling."""
    out = np.ones(1, "u8")
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), prime)) % np.uint64(prime)])
    return out[:n]


class _Transform:
    """Cyclic convolution of rows of length ``n`` (a power of two) over the integers modulo a prime."""

    def __init__(self, n: int, prime: int, generator: int, most: int):
        if n.bit_length() - 1 > most:
            raise ValueError(f"a transform of {n} places is beyond the prime {prime}")
        self.n, self.prime = n, np.uint64(prime)
        root = pow(generator, (prime - 1) // n, prime)
        self.there = _powers(root, max(1, n // 2), prime)
        self.back = _powers(pow(root, -1, prime), max(1, n // 2), prime)
        self.scale = np.uint64(pow(n, -1, prime))

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Values in bit-reversed order; ``convolve`` needs no other."""
        p, half = self.prime, self.n // 2
        while half:
            x = x.reshape(-1, 2, half)
            a, b = x[:, 0], x[:, 1]
            x = np.stack([(a + b) % p, (a + p - b) * self.there[:: self.n // 2 // half][:half] % p], axis=1)
            half //= 2
        return x.reshape(-1, self.n)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        p, half = self.prime, 1
        while half < self.n:
            x = x.reshape(-1, 2, half)
            a, b = x[:, 0], x[:, 1] * self.back[:: self.n // 2 // half][:half] % p
            x = np.stack([(a + b) % p, (a + p - b) % p], axis=1)
            half *= 2
        return x.reshape(-1, self.n) * self.scale % p

    def convolve(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.inverse(self.forward(a) * self.forward(b) % self.prime)


_transforms: dict[tuple[int, int], _Transform] = {}


def _transform(n: int, which: int) -> _Transform:
    found = _transforms.get((n, which))
    if found is None:
        found = _Transform(n, *_PRIMES[which])
        if n <= _CHUNK:  # tables of larger ones are not kept
            _transforms[n, which] = found
    return found


def _differences(blocks: np.ndarray, windows: np.ndarray, places: int, which: int) -> np.ndarray:
    """Sums of squared differences modulo a prime, of each block with the first ``places`` of its window.

    ``windows`` has rows of 4b words. The b - 1 sums before whole overlap, the
    only ones that the cycle folds others into, are cut off.
    """
    b, n = blocks.shape[1], windows.shape[1]
    engine = _transform(n, which)
    p = engine.prime
    turned = np.zeros(windows.shape, "u8")
    turned[:, :b] = blocks[:, ::-1]
    cross = engine.convolve(turned, windows)[:, b - 1 : b - 1 + places]
    squares = np.cumsum(windows * windows % p, axis=1)  # fewer than 2**32 terms below 2**31
    own = (blocks * blocks % p).sum(axis=1, keepdims=True) % p
    inside = squares[:, b - 1 : b - 1 + places].copy()
    inside[:, 1:] -= squares[:, : places - 1]
    return (own + inside % p + 2 * (p - cross)) % p


def _matches(ids: np.ndarray, starts: np.ndarray, b: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, distance) wherever a block stands again ``low`` to ``high`` (at most 3b more) words later.

    Words beyond the end of the text get a number that no word has. If a sum
    could reach the prime, a second prime has to agree; a sum is then zero
    only if the words are equal.
    """
    n, rows, places = len(ids), max(1, _CHUNK // (4 * b)), high - low + 1
    top = int(ids.max()) + 1
    primes = 1 if b * top * top < _PRIMES[0][0] else 2
    padded = np.concatenate([ids, np.full(low + 4 * b, top, "u8")])
    for at in range(0, len(starts), rows):
        some = starts[at : at + rows]
        blocks = padded[some[:, None] + np.arange(b)]
        windows = padded[some[:, None] + low + np.arange(4 * b)]
        zero = _differences(blocks, windows, places, 0) == 0
        if primes == 2 and zero.any():
            hit = zero.any(axis=1)
            zero[hit] &= _differences(blocks[hit], windows[hit], places, 1) == 0
        row, by = np.nonzero(zero)
        fits = some[row] + low + by + b <= n
        yield some[row][fits], (low + by)[fits]


def _reach(ids: np.ndarray, at: int, q: int) -> int:
    """How many words from ``at`` on equal the words q later."""
    n, end, step = len(ids) - q, at, 32
    while end < n:
        stop = min(n, end + step)
        differ = ids[end:stop] != ids[end + q : stop + q]
        if differ.any():
            return end + int(differ.argmax()) - at
        end, step = stop, step * 4
    return n - at


def _reach_back(ids: np.ndarray, at: int, q: int) -> int:
    """How many words before ``at`` equal the words q later."""
    end, step = at, 32
    while end > 0:
        low = max(0, end - step)
        differ = ids[low:end] != ids[low + q : end + q]
        if differ.any():
            return at - (low + len(differ) - int(differ[::-1].argmax()))
        end, step = low, step * 4
    return at


class _Runs:
    """The runs found so far, by period; those of one period overlap by less than it, so both ends rise."""

    def __init__(self):
        self.by_period: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, period: int, stretches: list[tuple[int, int]]) -> None:
        starts, ends = zip(*sorted(stretches))
        self.by_period[period] = np.array(starts), np.array(ends)

    def cover(self, period: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether one run of the period holds all words from ``low`` up to ``high``."""
        starts, ends = self.by_period[period]
        at = np.searchsorted(starts, low, "right") - 1
        return (at >= 0) & (ends[np.maximum(at, 0)] >= high)


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """All runs of a row of numbers as (start, length, period), by start, then period.

    A run has at least ``min_length`` (12 or more) words and twice its smallest
    period, and is as long as the period lasts to both sides.
    """
    if min_length < MIN_LENGTH:
        raise ValueError(f"runs of fewer than {MIN_LENGTH} words are not covered by the blocks")
    n = len(ids)
    if n < min_length:
        return []
    ids = np.unique(ids, return_inverse=True)[1].astype("u8")
    pairs = ids[:-1] * np.uint64(n) + ids[1:]
    order = np.argsort(pairs, kind="stable")
    again = np.full(n, n, "i8")  # how far on a pair of words stands next; n: nowhere
    same = pairs[order[1:]] == pairs[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    runs, out, b = _Runs(), [], 2
    while b == 2 or 2 * (2 * b - 1) <= n:
        low, high = (1, 6) if b == 2 else (2 * b - 1, 4 * b - 2)
        whole = (n - b - low) // b + 1  # blocks that can stand once more
        if whole <= 0:
            break
        starts = np.arange(whole) * b
        far = again[: whole * b].reshape(whole, b)[:, : b - 1].max(axis=1)
        starts = starts[far <= high]
        for p in runs.by_period:
            if p <= b and len(starts):
                starts = starts[~runs.cover(p, starts, np.minimum(n, starts + high + b))]
        if len(starts):
            _scale(ids, starts, b, low, high, min_length, runs, out)
        b *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def _scale(ids, starts, b, low, high, min_length, runs: _Runs, out: list) -> None:
    """Adds the runs whose periods are of the scale of ``b``, the shortest period first."""
    found = []
    for s, q in _matches(ids, starts, b, low, high):
        keep = np.ones(len(q), bool)
        for p in runs.by_period:  # words that a shorter period holds already
            if keep.any():
                keep &= ~((q % p == 0) & runs.cover(p, s, s + q + b))
        found.append((s[keep], q[keep]))
    at, by = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, by))
    at, by = at[order], by[order]
    cuts = np.flatnonzero(np.diff(by)) + 1
    for group in np.split(np.arange(len(by)), cuts) if len(by) else ():
        q, new, done = int(by[group[0]]), [], -1
        divisors = [p for p in runs.by_period if q % p == 0]
        seeds = at[group]
        for p in divisors:
            seeds = seeds[~runs.cover(p, seeds, seeds + q + b)]
        for s in seeds.tolist():
            if s < done:  # inside the stretch before
                continue
            first = s - _reach_back(ids, s, q)
            done = s + _reach(ids, s, q)  # words up to here stand again
            last = done + q
            if last - first >= max(min_length, 2 * q) and not any(
                    runs.cover(p, np.array([first]), np.array([last]))[0] for p in divisors):
                new.append((first, last))
        if new:
            runs.add(q, new)
            out += [(first, last - first, q) for first, last in new]


def planted(words: list, doc_id: int | None) -> list:
    """The words with the repetition that the id asks for; those of nine of ten ids, and of a null id, as they are."""
    if doc_id is None or not words:
        return words
    g, r = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if r:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def word_ids(words: list) -> np.ndarray:
    known: dict = {}
    return np.array([known.setdefault(w, len(known)) for w in words], "u8")


def _digest(words: list, ids: np.ndarray) -> tuple:
    runs = find_runs(ids) if len(words) >= MIN_LENGTH else []
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = words
    if runs:
        depth = np.zeros(len(words) + 1, "i8")
        s, n, q = np.array(runs).T
        np.add.at(depth, s + q, 1)
        np.add.at(depth, s + n, -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        longest = s, n, q, 1000 * n // q
    else:
        longest = (None,) * 4
    return (len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def run_digests(documents: DataFrame, plant: bool = False) -> DataFrame:
    """One row per row of ``documents`` (``doc_id``, ``text``) with its runs of words in digest form.

    Words stand between white space (blank and the controls 9 to 13). A null or
    empty text has no words, no run, and the digests of nothing; runs of equal
    length are decided by start, then period. Each row is treated by itself, so
    repeated rows give repeated results, an empty table none, and other columns
    are left aside. ``plant`` puts the repetition of :func:`planted` in first.
    The work on a text takes memory in proportion to it.
    """
    rows = documents.select("doc_id", "text")
    columns = [f.name for f in rows.limit(0).selectExpr("doc_id").schema] + [c.split()[0] for c in SCHEMA.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = (text or "").encode().split()
                words = planted(words, doc_id) if plant else words
                out.append(_digest(words, word_ids(words)))
            values = list(zip(*out)) if out else [()] * (len(columns) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(v), t) for v, t in zip(values, [pa.int64()] * 5 + [pa.string()] * 2))],
                names=columns)

    schema = rows.select("doc_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMA.split(", ")]).schema
    return rows.mapInArrow(work, schema)


def runs(documents: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Every run of every text as a row: ``doc_id``, ``start``, ``length``, ``period`` (words), edge cases as :func:`run_digests`."""
    rows = documents.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                here = find_runs(word_ids((text or "").encode().split()), min_length)
                found += here
                owner += [i] * len(here)
            ids = batch.column("doc_id").take(pa.array(owner, pa.int64()))
            numbers = np.array(found, "i8").reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(numbers[:, k]) for k in range(3))],
                                             names=["doc_id", "start", "length", "period"])

    whole = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period")]
    return rows.mapInArrow(work, rows.select("doc_id", *whole).schema)
