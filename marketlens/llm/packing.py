"""Token sequences packed by dominance reduction and best fit.

Only the lengths of pieces decide a packing, so it is worked out on their
histogram, which has at most as many lines as a sequence has tokens. Sets of
pieces that provably dominate all others are fixed first; best fit takes the
rest, the longest first. The result is a list of patterns with counts; the
executors then deal the pieces of each length to the places of the patterns.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import stored

CAPACITY = 1024
END_ID = 2
#: Rows that are numbered in one task, about.
RANK_ROWS = 100_000
_CACHED_WORDS = 400_000

#: One shape of sequence: (length, how many of it), longest first.
Pattern = tuple[tuple[int, int], ...]


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the strings that a tokenizer's JSON file takes out of a text before words are looked for."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if odd := [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens that depend on what is around them: {odd}")
    return {t["content"]: t["id"] for t in tokens}


class Tokens:
    """Ids of whole texts as little-endian 32-bit numbers, the same as of the tokenizer file. Strings of ``added`` have
    the ids given there, wherever they stand; without it they are taken as text.

    A single blank before a printing character always begins a new unit of the
    tokenizer, so texts are cut there and the bytes of a cut's ids are kept, up
    to a bound. Texts with runs of blanks are encoded as a whole.
    """

    def __init__(self, path: str, pattern: str, added: Mapping[str, int] | None = None):
        self.encode = _encoding(path, pattern).encode_ordinary
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}  # words that a blank stands before
        self.added = dict(added or {})
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def __call__(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self._ordinary(text)
        return b"".join(_little([self.added[part]]) if i % 2 else self._ordinary(part)
                        for i, part in enumerate(self.cut.split(text)))

    def _ordinary(self, text: str) -> bytes:
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return _little(self.encode(text))
        head, *words = text.split(" ")
        first, later = self.first, self.later
        if head not in first:
            if len(first) > _CACHED_WORDS:
                first.clear()
            first[head] = _little(self.encode(head))
        try:
            return first[head] + b"".join([later[w] for w in words])
        except KeyError:
            pass
        if len(later) > _CACHED_WORDS:
            later.clear()
        for w in words:
            if w not in later:
                later[w] = _little(self.encode(" " + w))
        return first[head] + b"".join([later[w] for w in words])


def _little(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def cut(length: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole if it fits, else a first piece with what is over and full ones."""
    if length <= capacity:
        return [length]
    over = length % capacity
    return [over] * bool(over) + [capacity] * (length // capacity)


def pieces(
    documents: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
    added: Mapping[str, int] | None = None,
) -> DataFrame:
    """Pieces of the documents: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked, ``ids``.

    ``path`` and ``pattern`` are a file of byte-pair ranks and its pattern of
    words, present on all executors, ``added`` the result of :func:`added_tokens`. A null text is empty: one piece with the
    end id alone.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = Tokens(path, pattern, added), _little([end_id])
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids, start = memoryview(tokens(text or "") + end), 0
                for i, n in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    row = doc_id, i, start, n, zlib.crc32(part)
                    out.append((*row, np.frombuffer(part, "<i4")) if with_ids else row)
                    start += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fix sequences that some best packing has, and what is left of the histogram.

    For the longest piece j, anything else in its sequence sums to at most
    r = capacity - j. If nothing fits, {j} is fixed. If k, the longest that
    fits, fills r, or no two or more pieces have a sum over k and up to r, then
    whatever stands with j can be changed for k without loss: {j, k} is fixed.
    Sums are taken as if lengths came without end, so the test errs only on
    the safe side. Repeated until nothing more can be fixed.
    """
    left, fixed = {s: n for s, n in counts.items() if n}, []
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room = capacity - j
                fits = [s for s in left if s <= room and (s != j or left[j] > 1)]
                k = max(fits, default=None)
                if k is None:
                    fixed.append((((j, 1),), left.pop(j)))
                elif j + k == capacity or not _sum_between(fits, k, room):
                    m = left[j] // 2 if j == k else min(left[j], left[k])
                    fixed.append((((j, 2),) if j == k else ((j, 1), (k, 1)), m))
                    for s in (j, k):
                        left[s] -= m
                    for s in {j, k}:
                        if not left[s]:
                            del left[s]
                else:
                    break
                changed = True
    return fixed, left


def _sum_between(sizes: list[int], low: int, high: int) -> bool:
    """Whether two or more of the sizes, each any number of times, can sum to over ``low`` and up to ``high``."""
    small = min(sizes)
    if any(low < small + s <= high for s in sizes):
        return True
    inside, reach = (1 << (high + 1)) - 1, 1
    for s in sizes:
        by = s
        while by <= high:
            reach |= (reach << by) & inside
            by *= 2
    # one more piece on top of any sum of one or more
    some, two = reach & ~1, 0
    for s in sizes:
        two |= (some << s) & inside
    return bool(two >> (low + 1))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, the longest first, for all pieces of a length at once: into the fullest sequence that takes one."""
    open_: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        room = size
        while left:
            while room < capacity and not open_[room]:
                room += 1
            # an untouched sequence has the whole capacity as room and is never used up
            pattern, n = open_[room].pop() if room < capacity else ((), left)
            each = room // size
            full = min(n, left // each)
            if full:
                open_[room - each * size].append((pattern + ((size, each),), full))
                left, n = left - each * full, n - full
            elif left:
                open_[room - left * size].append((pattern + ((size, left),), 1))
                left, n = 0, n - 1
            if n and room < capacity:
                open_[room].append((pattern, n))
    return [x for found in open_ for x in found]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns with how many sequences have each; the pieces of the histogram fill them exactly."""
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def _places(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Per length and run of ranks: first sequence, pieces of the length per sequence and offset of their first."""
    rows, base, ranks = [], 0, {}
    for pattern, n in patterns:
        offset = 0
        for size, each in pattern:
            rank = ranks.get(size, 0)
            rows.append((size << 44 | rank, rank, base, each, offset))
            ranks[size] = rank + n * each
            offset += size * each
        base += n
    table = np.array(sorted(rows), "int64").reshape(-1, 5)
    return dict(zip(("key", "rank", "base", "each", "offset"), table.T))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts``, a stored table of :func:`pieces`, with ``sequence_id`` and ``offset``.

    Pieces of a length are ranked by id, piece and checksum; those that agree
    in all are alike and may change places. Lengths with many pieces are ranked
    in salted parts. The histogram and the patterns, both bounded by
    ``capacity``, are all that passes the driver. An empty table stays empty.
    Columns ``sequence_id`` and ``offset`` of the input are replaced.
    """
    parts = parts.drop("sequence_id", "offset")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    salts = max(8, -(-max(counts.values(), default=0) // RANK_ROWS))
    keys = ("doc_id", "piece", "ids_crc32")
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n")).select(
        "length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("length", "__salt").orderBy(*keys)
    ranked = salted.withColumn("__at", F.row_number().over(inside)).join(starts, ["length", "__salt"]).select(
        *parts.columns, (F.col("__start") + F.col("__at") - 1).alias("__rank"))
    places, columns_kept = _places(plan(counts, capacity)), parts.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            at = np.searchsorted(places["key"], size << 44 | rank, "right") - 1
            turn, nth = np.divmod(rank - places["rank"][at], places["each"][at])
            columns = {c: batch.column(c) for c in columns_kept}
            columns["sequence_id"] = pa.array(places["base"][at] + turn, pa.int64())
            columns["offset"] = pa.array(places["offset"][at] + nth * size, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    schema = parts.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return ranked.mapInArrow(place, schema)


def pack_documents(
    documents: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False, added: Mapping[str, int] | None = None,
) -> DataFrame:
    """Tokenize, cut and pack; the tokens are made once and the pieces stored."""
    return pack(stored(pieces(documents, path, pattern, capacity, end_id, with_ids, added), "pieces"), capacity)
