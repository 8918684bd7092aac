"""Shards from a keyed permutation of global row numbers.

Rows are numbered by their content, a Feistel network with cycle walking
permutes the numbers, and the permuted number gives shard and slot by division.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlens.llm.common import let, stored

ROUNDS = 6
#: Walks that nearly every row outside the range needs at most; the rest walks on to the proven bound.
SHORT_WALK = 8
#: Rows per numbering bucket that the number of buckets aims at, and buckets at least.
BUCKET_ROWS = 100_000
MIN_BUCKETS = 1024
#: Copies of one row that a single task writes out.
COPIES_PER_BLOCK = 100_000


def permuted(number: Column, n_rows: int, seed: int = 7) -> Column:
    """The place of row ``number`` of ``n_rows`` after a keyed shuffle: a bijection of 0..n_rows-1.

    The network works on a by b places, a the root of ``n_rows`` rounded up and
    b just large enough, so fewer than a places lie outside the range. A number
    that lands outside is permuted again until it lands inside. A walk passes
    each outside place at most once, so a * b - n_rows further steps always do.
    """
    if n_rows <= 1:
        return F.lit(0).cast("long") * number
    a = math.isqrt(n_rows - 1) + 1
    b = -(-n_rows // a)

    def once(x: Column) -> Column:
        # widths swap with the halves: the left half of an even round counts to a, of an odd one to b
        def round_of(half: Column, i: Column) -> Column:
            width = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
            mixed = F.pmod(half["left"] + F.pmod(F.xxhash64(half["right"], F.lit(seed), i), width), width)
            return F.struct(half["right"].alias("left"), mixed.alias("right"))

        start = F.struct(F.floor(x / b).cast("long").alias("left"), F.pmod(x, F.lit(b)).cast("long").alias("right"))
        # floor(x / b) of a long goes through a double; exact below 2**53 rows
        rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
        return F.aggregate(rounds, start, round_of, lambda h: h["left"] * F.lit(b) + h["right"])

    def walk(x: Column, steps: int) -> Column:
        return F.when(x < n_rows, x).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x,
                        lambda at, _: F.when(at < n_rows, at).otherwise(once(at))))

    outside = a * b - n_rows
    first = once(number.cast("long"))
    if not outside:
        return first
    short = let(first, lambda x: walk(x, min(outside, SHORT_WALK)))
    return short if outside <= SHORT_WALK else let(short, lambda x: walk(x, outside))


def numbered(rows: DataFrame, number: str) -> DataFrame:
    """``rows`` with a gapless global number that depends on their values alone.

    Equal rows are counted before they are moved and written out again in
    blocks, so a row with many copies burdens no task. The order is that of a
    hash of all columns, then of the columns. No window spans more than a
    bucket; the one over the buckets sees ``rows / 100,000`` lines.
    """
    keys = rows.columns
    counted = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__copies")), "rows")
    n = counted.count()
    buckets = max(MIN_BUCKETS, n // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    counted = counted.withColumn("__bucket", bucket)
    totals = counted.groupBy("__bucket").agg(F.sum("__copies").alias("__in"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__bucket", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__start"))
    inside = (Window.partitionBy("__bucket").orderBy(F.xxhash64(F.lit(1), *keys), *keys)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (
        counted.withColumn("__before", F.coalesce(F.sum("__copies").over(inside), F.lit(0)))
        .join(starts, "__bucket")
        .withColumn("__first", F.col("__start") + F.col("__before"))
    )
    single = placed.filter("__copies = 1").select(*keys, F.col("__first").alias(number))
    many = placed.filter("__copies > 1").select(
        *keys, "__first", "__copies",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(COPIES_PER_BLOCK))).alias("__block"),
    ).repartition(F.col("__first"), F.col("__block"))
    last = F.least(F.col("__block") + COPIES_PER_BLOCK, F.col("__copies")) - 1
    copies = many.select(*keys, "__first", F.explode(F.sequence(F.col("__block"), last)).alias("__i"))
    return single.unionByName(copies.select(*keys, (F.col("__first") + F.col("__i")).alias(number)))


def shard_rows(rows: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """``rows`` with ``shard`` int and ``slot`` long under the law ``rows``.

    Counts of shards differ by one at most and slots run from 0 without gaps.
    Both follow from a row's number, the number of rows, ``shards`` and
    ``seed``: shard = place mod shards, slot = place div shards. Equal input
    rows, in any files and order, give equal output rows. Null values, repeated
    rows and an empty table need no care; repeated rows get places of their own.
    Columns of the input named ``shard`` or ``slot`` are replaced.
    """
    rows = rows.drop("shard", "slot")
    with_number = numbered(rows, "__number")
    n = rows.count()
    placed = with_number.withColumn("__place", permuted(F.col("__number"), n, seed))
    return placed.select(
        *rows.columns,
        F.pmod(F.col("__place"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"__place div {shards}").cast("long").alias("slot"),
    )


def text_keys(documents: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, none for null, plus 8) and text_crc32 (null: that of no bytes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
