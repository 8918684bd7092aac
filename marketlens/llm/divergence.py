"""How the words of sources differ, over the terms that enough documents of a language have.

The terms are found by iceberg refinement: the documents that hold a prefix of
some bytes are counted per language, prefixes below the threshold are dropped,
and only terms behind a kept prefix are looked at with twice the bytes, until no
kept prefix is longer. No table of all terms is ever made; a rare term goes with
its beginning. What a level kept reaches the tasks of the next as a bitmap of
fixed size: a prefix that shares a bit may go on for nothing, but is counted
exactly where it goes, so the kept terms are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import stored

MIN_DOCUMENTS = 10
FIRST_BYTES = 4
UNIT = 1_000_000_000
TOP_TERMS = 10
#: The bitmap has 2**BITMAP_BITS places, 4 MB, however much is kept.
BITMAP_BITS = 25
CHUNK_TERMS = 2048
BLOCK_SOURCES = 256
_PART_BYTES = 8 << 20

#: Letters A to Z as a to z; a to z and bytes of other characters as they are; the rest parts words.
_FOLDS = np.array([i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256)], "u1")
_END = b" "
_MARK = pa.scalar(_END, pa.large_binary()), pa.scalar(b"", pa.large_binary())  # what is joined on, and between


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The terms of all texts in order, as codes into their different values, with the number of the text of each."""
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    edges = np.frombuffer(places, "i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, "u1")[edges[0] : edges[-1]] if data is not None else np.zeros(0, "u1")
    edges = edges - edges[0]
    folded = _FOLDS[data]
    solid = folded != _END[0]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    border = edges[(edges > 0) & (edges < len(data))]  # a term ends with its text
    first[border] = solid[border]
    last[border - 1] = solid[border - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("i8")
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(folded[solid])])
    return np.searchsorted(edges, starts, "right") - 1, terms.dictionary_encode()


def _hashes(lang: str, terms: pa.Array, width: int) -> np.ndarray:
    """A place of a bitmap of 2**width bits for each term (large binary) of a language."""
    _, places, data = terms.buffers()
    edges = np.frombuffer(places, "i8")[terms.offset : terms.offset + len(terms) + 1]
    lengths = np.diff(edges)
    if not len(lengths):
        return np.zeros(0, "u8")
    letters = np.frombuffer(data, "u1")[edges[0] : edges[-1]].astype("u8") + np.uint64(1)
    power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, "u8"))
    at = np.arange(len(letters)) - np.repeat(edges[:-1] - edges[0], lengths)
    sums = np.add.reduceat(letters * power[at], edges[:-1] - edges[0])
    mixed = (sums + np.uint64(zlib.crc32(lang.encode()))) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return mixed >> np.uint64(64 - width)


def _bitmap(kept: DataFrame, width: int) -> np.ndarray:
    """2**width bits, set for the (lang, term) rows; at most 2**width / 64 numbers pass the driver."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (lang,), part in _groups(batch, ["lang"]):
                place = np.sort(_hashes(lang, part.column("term").cast(pa.large_binary()), width))
                word, inside = np.unique(place >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), inside)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype("i4")), pa.array(bits.view("i8"))], names=["w", "b"])

    bits = kept.mapInArrow(places, "w int, b long").groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
    out = np.zeros(1 << width - 6, "i8")
    rows = bits.toArrow()
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view("u8")


def _has(bits: np.ndarray, lang: str, terms: pa.Array) -> np.ndarray:
    place = _hashes(lang, terms, len(bits).bit_length() + 5)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _groups(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of a batch by equal values of some columns, in parts of bounded bytes (of one row at least)."""
    if not batch.num_rows:
        return
    codes = [np.asarray(batch.column(c).dictionary_encode().indices) for c in names]
    order = np.lexsort(codes)
    batch = batch.take(pa.array(order))
    new = np.zeros(len(order), bool)
    for code in codes:
        new[1:] |= np.diff(code[order]) != 0
    sizes = pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype("i8")
    new[1:] |= np.diff(np.cumsum(sizes) // _PART_BYTES) != 0
    edges = np.concatenate([[0], np.flatnonzero(new), [len(order)]])
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        part = batch.slice(low, high - low)
        yield tuple(part.column(c)[0].as_py() for c in names), part


def _prefix_counts(docs: DataFrame, before: int, size: int, bits) -> DataFrame:
    """(lang, term, n): documents per prefix of ``size`` bytes of terms with their end mark, in partial counts.

    Terms whole within ``before`` bytes were decided by the level before;
    others are looked at if their first ``before`` bytes are kept.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (lang,), part in _groups(batch, ["lang"]):
                owner, terms = _words(part.column("text"))
                different = terms.dictionary
                codes = terms.indices.to_numpy()
                if before:
                    open_ = pc.binary_length(different).to_numpy() >= before
                    open_ &= _has(bits.value, lang, pc.binary_slice(different, 0, before))
                    number = np.where(open_, np.cumsum(open_) - 1, -1)
                    different = different.filter(pa.array(open_))
                    codes = number[codes]
                    owner, codes = owner[codes >= 0], codes[codes >= 0]
                marked = pc.binary_slice(pc.binary_join_element_wise(different, *_MARK), 0, size).dictionary_encode()
                n = len(marked.dictionary)
                if n:
                    pairs = np.sort(owner * n + marked.indices.to_numpy()[codes])
                    counts = np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] % n, minlength=n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(lang, pa.string()), n), marked.dictionary.cast(pa.binary()), pa.array(counts, pa.int64())],
                        names=["lang", "term", "n"])

    return docs.select("lang", "text").mapInArrow(work, "lang string, term binary, n long")


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """(lang, term) of all terms (as bytes) in at least ``min_documents`` rows of a language, by prefix refinement.

    ``docs`` has ``lang`` and ``text`` without nulls; each row is a document.
    Per level the documents are read once; what passes a shuffle are counts of
    prefixes whose beginning was kept, summed in the tasks before.
    """
    context, before, size, bits, whole = docs.sparkSession.sparkContext, 0, FIRST_BYTES, None, []
    while True:
        counts = _prefix_counts(docs, before, size, bits).groupBy("lang", "term").agg(F.sum("n").alias("n"))
        level = stored(counts.filter(F.col("n") >= min_documents).select("lang", "term"), "prefixes")
        ended = F.expr("substring(term, -1, 1) = X'20'")
        whole.append(level.filter(ended).select("lang", F.expr("substring(term, 1, octet_length(term) - 1)").alias("term")))
        open_ = level.filter(~ended)
        if open_.isEmpty():
            break
        bits = context.broadcast(_bitmap(open_, bitmap_bits))
        before, size = size, 2 * size
    out = whole[0]
    for more in whole[1:]:
        out = out.union(more)
    return out


def term_uses(docs: DataFrame, kept: DataFrame, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """(lang, source, term, uses): occurrences of kept terms per group, where there are any."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(kept, bitmap_bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (lang, source), part in _groups(batch, ["lang", "source"]):
                _, terms = _words(part.column("text"))
                counts = np.bincount(terms.indices.to_numpy(), minlength=len(terms.dictionary))
                good = _has(bits.value, lang, terms.dictionary)
                n = int(good.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n),
                     terms.dictionary.filter(pa.array(good)).cast(pa.binary()), pa.array(counts[good], pa.int64())],
                    names=["lang", "source", "term", "uses"])

    counts = docs.mapInArrow(work, "lang string, source string, term binary, uses long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses")).join(kept, ["lang", "term"], "left_semi")


def _share(uses: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (uses + 2) / (total + 2 * terms)), in decimals; null if there are no terms."""
    wide = (uses + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = (total + 2 * terms).cast("decimal(20,0)")
    return 1 + F.call_function("div", wide, F.nullif(below, F.lit(0).cast("decimal(20,0)")))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(
    documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS, bitmap_bits: int = BITMAP_BITS,
    chunk_terms: int = CHUNK_TERMS, block_sources: int = BLOCK_SOURCES,
) -> DataFrame:
    """Differences between sources of a language: ``lang, source, part, item, value, rank``.

    Part ``pair`` has the value against each other source, over all kept terms;
    part ``term`` the ``top`` terms that a source uses more than its language.
    Null ``text``, ``lang`` and ``source`` count as empty; each row is a
    document, repeated ones too; equal values are ranked by item. A source
    without terms is compared with the others like any, a language without kept
    terms gives pairs of value 0, an empty table nothing. Other columns are
    left aside. ``bitmap_bits`` (6 to 32) bounds what is broadcast, the last
    two the memory of a cell; none changes the result.
    """
    docs = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = kept_terms(docs, min_documents, bitmap_bits)
    uses = stored(term_uses(docs, kept, bitmap_bits), "uses")
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    sums = uses.groupBy("lang", "source").agg(F.sum("uses").alias("total"))
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = stored(
        docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"),
                (F.row_number().over(numbered) - 1).alias("number")), "groups")
    shares = uses.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("uses"), F.col("total"), F.col("terms")))
    return _pairs(shares, groups, chunk_terms, block_sources).unionByName(_terms(uses, shares, groups, top))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    out = out.filter(F.col("rank") <= top) if top is not None else out
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _terms(uses: DataFrame, shares: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    of_lang = uses.groupBy("lang", "term").agg(F.sum("uses").alias("all_uses"))
    found = shares.join(whole, "lang").join(of_lang, ["lang", "term"]).withColumn(
        "q", _share(F.col("all_uses"), F.col("all_total"), F.col("terms")))
    return _ranked(found.filter("p > q").select(
        "lang", "source", F.decode("term", "utf-8").alias("item"), _gap(F.col("p"), F.col("q")).alias("value")), "term", top)


def _pairs(shares: DataFrame, groups: DataFrame, chunk_terms: int, block_sources: int) -> DataFrame:
    """Values of all pairs of sources of a language, from cells of some terms by two blocks of sources.

    A cell sees the terms that a source of its blocks uses; all other terms
    have the shares of no use on both sides and are added at the end.
    """
    chunks = F.greatest(F.lit(1), F.ceil(F.col("terms") / chunk_terms)).cast("int")
    block = F.floor(F.col("number") / block_sources).cast("int")
    blocks = groups.groupBy("lang").agg((F.floor(F.max("number") / block_sources) + 1).cast("int").alias("blocks"))
    none = F.coalesce(_share(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(1).cast("long"))
    zeros = groups.select("lang", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "number",
                          F.lit(None).cast("binary").alias("term"), none.alias("p"))
    used = shares.select("lang", F.pmod(F.xxhash64("term"), chunks).cast("int").alias("chunk"), "number", "term", "p")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = zeros.unionByName(used).join(blocks, "lang").select("*", block.alias("own"), other.alias("other")).select(
        "lang", "chunk", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "number", "term", "p")
    def cell(key: tuple, rows: pa.Table) -> pa.Table:
        return _cell(block_sources, key, rows)

    sums = cells.groupBy("lang", "chunk", "a", "b").applyInArrow(
        cell, "lang string, x int, y int, zx long, zy long, value long, seen long")
    rest = groups.select("lang", "terms").distinct()
    values = sums.groupBy("lang", "x", "y", "zx", "zy").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")).join(
        rest, "lang").select("lang", "x", "y", (F.col("value") + (F.col("terms") - F.col("seen")) * _gap(F.col("zx"), F.col("zy"))).alias("value"))
    both = values.select("lang", "value", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("s")).select(
        "lang", "value", "s.*")
    names = groups.select("lang", "source", "number")
    named = both.join(names.withColumnRenamed("number", "x"), ["lang", "x"]).join(
        names.select("lang", F.col("source").alias("item"), F.col("number").alias("y")), ["lang", "y"])
    return _ranked(named.select("lang", "source", "item", "value"), "pair")


def _cell(block_sources: int, key: tuple, rows: pa.Table) -> pa.Table:
    """Sums over the terms of a cell for each pair of its sources (first number below the second)."""
    lang, _, a, b = (k.as_py() for k in key)
    term = rows.column("term").combine_chunks()
    number, p = (rows.column(c).to_numpy() for c in ("number", "p"))
    blank = np.asarray(term.is_null())
    order = np.argsort(number[blank])
    numbers, zero = number[blank][order], p[blank][order]
    code = np.asarray(term.filter(pa.array(~blank)).dictionary_encode().indices)
    seen = int(code.max()) + 1 if len(code) else 0
    table = np.repeat(zero[:, None], seen, axis=1)
    table[np.searchsorted(numbers, number[~blank]), code] = p[~blank]
    block = numbers // block_sources
    first, second = np.flatnonzero(block == a), np.flatnonzero(block == b)
    xs, ys, values = [], [], []
    for i in first:
        js = second[second > i]
        gap = table[js] - table[i]
        values.append((gap * gap // (table[js] + table[i])).sum(axis=1))
        xs.append(np.full(len(js), i))
        ys.append(js)
    x, y = np.concatenate(xs), np.concatenate(ys)
    return pa.table({
        "lang": pa.array([lang] * len(x), pa.string()), "x": pa.array(numbers[x], pa.int32()), "y": pa.array(numbers[y], pa.int32()),
        "zx": pa.array(zero[x], pa.int64()), "zy": pa.array(zero[y], pa.int64()),
        "value": pa.array(np.concatenate(values), pa.int64()), "seen": pa.array(np.full(len(x), seen), pa.int64())})
