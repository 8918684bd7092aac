"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A code is cut into segments, each segment indexes all codes. Two codes at
distance d agree in some segment up to d / segments bits, so once all segments
were probed up to radius r, every code within segments * (r + 1) - 1 bits has
been met. The radius grows until a query's k-th distance lies within that.
Codes are dealt into blocks that one task can index, every query visits every
block and brings its best from each; rows are made for results alone, none for
probes or candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import stored

BITS = 64
K = 10
#: Codes and queries that one task compares; both are dealt by hash, so blocks are even.
BLOCK_CODES, BLOCK_QUERIES = 20_000, 2_000
#: Tasks that the pairs of a block and a list of queries are dealt to.
MAX_TASKS = 20_000


def sign_code(vector: str = "embedding") -> Column:
    """A 64-bit code of the signs of a vector of at most 64 numbers: bit i is set if number i is above zero.

    Null for a null or empty vector; a null or NaN number leaves its bit unset.
    A longer vector is an error, since a code could not hold it.
    """
    bits = F.transform(F.col(vector), lambda x, i: F.when(
        (x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    folded = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a vector has more than {BITS} numbers")).cast("long")).when(
        F.size(vector) > 0, folded)


def segments_for(n_codes: int) -> int:
    """Segments whose values are about as many as there are codes."""
    return max(2, min(16, round(BITS / max(1.0, math.log2(max(2, n_codes))))))


@lru_cache(maxsize=256)
def _flips(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with ``radius`` bits set."""
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(width), radius)], "u8")


class Index:
    """The segments' tables over one block of codes: the distinct values of each and the codes that have them."""

    def __init__(self, codes: np.ndarray, segments: int):
        self.codes = codes
        cuts = [BITS * i // segments for i in range(segments + 1)]
        self.parts = []
        for low, high in zip(cuts, cuts[1:]):
            mask = np.uint64((1 << (high - low)) - 1)
            values = (codes >> np.uint64(low)) & mask
            order = np.argsort(values, kind="stable")
            distinct, begins = np.unique(values[order], return_index=True)
            self.parts.append((np.uint64(low), mask, high - low, distinct, np.append(begins, len(codes)), order))

    def _at_radius(self, part: tuple, query: np.uint64, radius: int) -> np.ndarray:
        """Places of the codes whose segment differs from the query's in ``radius`` bits.

        The values that differ so are looked up, or the distinct values there
        are compared, whichever are fewer.
        """
        low, mask, width, distinct, begins, order = part
        if radius > width:
            return np.empty(0, "i8")
        value = (query >> low) & mask
        if math.comb(width, radius) < len(distinct):
            probes = value ^ _flips(width, radius)
            found = np.minimum(np.searchsorted(distinct, probes), len(distinct) - 1)
            found = found[distinct[found] == probes]
        else:
            found = np.flatnonzero(np.bitwise_count(distinct ^ value) == radius)
        sizes = begins[found + 1] - begins[found]
        shift = np.repeat(begins[found] - np.cumsum(sizes) + sizes, sizes)
        return order[shift + np.arange(sizes.sum())]

    def search(self, query: np.uint64, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and distances of codes among which are all of the ``k`` nearest rows' codes, and the last radius.

        ``wanted`` has the rows of each code. The radius grows while fewer than
        ``k`` rows lie within the distance that is covered, at most to the width
        of a segment, when all codes have been met.
        """
        at, distance, radius = np.empty(0, "i8"), np.empty(0, "i4"), 0
        for radius in range(max(width for _, _, width, *_ in self.parts) + 1):
            met = np.unique(np.concatenate([self._at_radius(part, query, radius) for part in self.parts]))
            new = np.setdiff1d(met, at, assume_unique=True)
            at = np.concatenate([at, new])
            distance = np.concatenate([distance, np.bitwise_count(self.codes[new] ^ query).astype("i4")])
            covered = len(self.parts) * (radius + 1) - 1
            if wanted[at[distance <= covered]].sum() >= k:
                break
        return at, distance, radius


def nearest(codes: DataFrame, queries: DataFrame, k: int = K, segments: int | None = None) -> DataFrame:
    """The ``k`` nearest other rows of every query: ``query_id``, ``rank``, ``neighbor_id``, ``distance``.

    ``codes`` and ``queries`` have ``id`` and ``code``. Rows of a null id or
    code take no part. Neighbours are ordered by distance, then id, and exact;
    fewer than ``k`` only where the table has no more. A row is no neighbour of
    its own id. Equal codes are one entry of the index with their count and
    their k + 1 least ids, which is all that an answer can hold. Of rows that
    share an id the one of the least code counts. An empty table gives no rows.
    """
    def one_each(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").cast("long").alias("id"), "code").dropna().groupBy("id").agg(F.min("code").alias("code"))

    codes, queries = one_each(codes), one_each(queries)
    least = Window.partitionBy("code").orderBy("id")
    entries = stored(
        codes.withColumn("__n", F.row_number().over(least)).filter(F.col("__n") <= k + 1)
        .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    blocks = max(1, -(-entries.count() // BLOCK_CODES))
    asked = queries.select(F.col("code").alias("q")).distinct()
    query_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    index = entries.select(F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block"), F.struct(
        "code", F.col("ids")[0].alias("first"), F.size("ids").alias("n")).alias("e")).groupBy("block").agg(
        F.collect_list("e.code").alias("codes"), F.collect_list("e.first").alias("firsts"), F.collect_list("e.n").alias("ns"))
    lists = asked.groupBy(F.pmod(F.xxhash64("q", F.lit(1)), F.lit(query_blocks)).alias("part")).agg(
        F.collect_list("q").alias("qs")).select(
        "part", "qs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes_, firsts, ns, qs = (
                    batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("codes", "firsts", "ns", "qs"))
                table = Index(codes_.view("u8"), segments or segments_for(len(codes_)))
                out: list[list[np.ndarray]] = [[], [], [], []]
                for q in qs.view("u8"):
                    at, distance, _ = table.search(q, ns, k + 1)
                    order = np.lexsort((codes_[at], firsts[at], distance))[: k + 1]
                    for column, x in zip(out, (np.full(len(order), q), codes_[at[order]], distance[order], firsts[at[order]])):
                        column.append(x)
                q, code, distance, first = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.view("i8")), pa.array(code), pa.array(distance, pa.int32()), pa.array(first)],
                    ["q", "code", "distance", "first"])

    # Codes are ranked by distance and least id: a row among the k + 1 best has a code among the k + 1 best, and
    # k + 1 rows leave k for a query that is one of them.
    # Adaptive execution would put small blocks together into one task, so the number of partitions is given.
    pairs = index.join(lists.hint("merge"), "block").repartition(min(blocks * query_blocks, MAX_TASKS), "block", "part")
    best = pairs.select("codes", "firsts", "ns", "qs").mapInArrow(
        run, "q long, code long, distance int, first long")
    order = Window.partitionBy("q").orderBy("distance", "first", "code")
    found = best.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k + 1)
    rows = found.join(entries, "code").select("q", "distance", F.explode("ids").alias("neighbor_id"))
    best_rows = Window.partitionBy("q").orderBy("distance", "neighbor_id")
    rows = rows.withColumn("__rank", F.row_number().over(best_rows)).filter(F.col("__rank") <= k + 1).drop("__rank")
    again = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return (
        queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(rows, "q").filter("query_id != neighbor_id")
        .withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "neighbor_id", "distance")
    )
