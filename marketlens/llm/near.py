"""Near copies by a MinHash LSH forest and exact Jaccard similarity of word 5-grams.

A document is the set of its shingles. Documents of one set are one node. A node
has a path of MinHash values in each of 32 trees; the paths of a tree, sorted,
are its prefix trie. Nodes meet where their paths share a prefix. Prefixes
begin at the whole path and are shortened, a value at a time, until the recall
is met: the chance of a pair at the threshold to meet, and the share of links
that a sample of documents, compared exactly with all others, would find.

Nodes that meet, directly or over others, are compared exactly, all pairs, in
blocks; pairs are counted where they are compared and never written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import stored
from marketlens.operators.lookup import is_small

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 32, 8
TARGET_RECALL = 0.999
#: Share of the links that the forest has to find, of any similarity from the threshold on.
FOREST_RECALL = 0.99999
#: Documents whose links the recall is measured on, and their shingles, at most; longer documents are not among them.
SAMPLED, SAMPLED_SHINGLES = 256, 200_000
#: Shingles and nodes that one task compares at once; more are compared block by block.
BLOCK_SHINGLES, BLOCK_NODES = 400_000, 1500
BROADCAST_ROWS = 500_000

_CHUNK = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 63, 256, "u8") * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_MULTIPLY = _rng.integers(0, 1 << 31, TREES * DEPTH, "u4") * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, TREES * DEPTH, "u4")
_KEY = _rng.integers(0, 1 << 63, (TREES, DEPTH), "u8") * np.uint64(2) + np.uint64(1)


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK + 1, base, "u8")
    out[0] = 1
    return out.cumprod(dtype="u8")


_POW = _powers(_BASE)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word between white space."""
    data = np.frombuffer(text.encode(errors="replace"), np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(at + _CHUNK, len(data))
        if end < len(data):  # cut behind the last white space; a word longer than a chunk is hashed in parts
            spaces = np.flatnonzero(_SPACE[data[at:end]])
            end = at + int(spaces[-1]) + 1 if len(spaces) else end
        part = data[at:end]
        inside = ~_SPACE[part]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype("i1")))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(part) + 1, "u8")
        np.cumsum(_BYTE[part] * _POW[: len(part)], dtype="u8", out=sums[1:])
        out.append(_mix((sums[ends] - sums[starts]) * _INVERSE[starts] + (ends - starts).astype("u8")))
        at = end
    return np.concatenate(out) if out else np.empty(0, "u8")


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``k`` words; a shorter text is one run, one without words none."""
    words = _word_hashes(text or "")
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, "u8")
    for i in range(k):
        total = _mix(total * np.uint64(_BASE) + words[i : i + n])
    return np.unique(total)


def node_of(sorted_shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(sorted_shingles.tobytes(), digest_size=16).digest()


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix by which a pair at the threshold meets in some tree with the target probability."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < target:
        length -= 1
    return length


def _minima(sorted_shingles: np.ndarray, length: int = DEPTH) -> np.ndarray:
    """The least values of the node under the first ``length`` functions of each tree."""
    x = (sorted_shingles >> np.uint64(32)).astype("u4")
    least = np.full(TREES * length, 0xFFFFFFFF, "u4")
    multiply, add = (v.reshape(TREES, DEPTH)[:, :length].ravel() for v in (_MULTIPLY, _ADD))
    for i in range(0, len(x), 128):
        block = x[i : i + 128, None] * multiply
        block += add
        np.minimum(least, block.min(axis=0), out=least)
    return least.reshape(TREES, length).astype("u8")


def tree_keys(sorted_shingles: np.ndarray, length: int) -> np.ndarray:
    """Per tree the node's prefix of ``length`` minima, as one number."""
    minima = _minima(sorted_shingles, length)
    return _mix((minima * _KEY[:, :length]).sum(axis=1, dtype="u8") + np.arange(TREES, dtype="u8")).view("i8")


def paths_of(sorted_shingles: np.ndarray) -> np.ndarray:
    """The node's path in each tree, a row of 16 bits a value; equal minima have equal bits."""
    return (_mix(_minima(sorted_shingles) * _KEY) >> np.uint64(48)).astype("u2")


class _Sample:
    """Shingles and paths of some documents, to be compared with every document."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], "i8")
        self.nodes = [node_of(s) for s in sets]
        self.paths = [paths_of(s) for s in sets]
        values = np.concatenate([np.empty(0, "u8"), *sets])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def depths(self, s: np.ndarray, node: bytes, paths: np.ndarray, threshold: float) -> list[int]:
        """For each other node of the sample at the threshold, the longest prefix that a tree has in common."""
        low, high = np.searchsorted(self.values, s, "left"), np.searchsorted(self.values, s, "right")
        held = np.flatnonzero(high > low)
        if not len(held):
            return []
        owners = np.concatenate([self.owner[a:b] for a, b in zip(low[held].tolist(), high[held].tolist())])
        common = np.bincount(owners, minlength=len(self.sizes))
        linked = np.flatnonzero((common > 0) & (common >= threshold * (len(s) + self.sizes - common) - 1e-6))
        return [int(np.cumprod(paths == self.paths[i], axis=1).sum(axis=1).max()) for i in linked if self.nodes[i] != node]


def _sample(docs: DataFrame) -> _Sample:
    """About ``SAMPLED`` different texts, chosen by hash, as far as their shingles have room."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                s = shingles(text.as_py())
                if 0 < len(s) <= SAMPLED_SHINGLES:
                    yield pa.RecordBatch.from_arrays([pa.array([len(s)], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["size", "set"])

    parts = max(1, docs.count() // SAMPLED)
    texts = docs.filter(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(parts)) == 0).select("text").distinct()
    sets = stored(texts.mapInArrow(run, "size long, set binary"), "sample").withColumn("h", F.xxhash64("set"))
    taken = F.sum("size").over(Window.orderBy("h", "set").rowsBetween(Window.unboundedPreceding, 0))
    first = sets.orderBy("h", "set").limit(2 * SAMPLED)
    rows = first.withColumn("taken", taken).filter(F.col("taken") <= SAMPLED_SHINGLES).select("set").collect()
    return _Sample([np.frombuffer(r["set"], "u8") for r in rows])


def signatures(documents: DataFrame, threshold: float = THRESHOLD, sample: _Sample | None = None) -> DataFrame:
    """``doc_id``, ``node`` (null without words), ``size`` in shingles, ``paths`` (of all trees, one behind the other) and
    ``depths``, the longest prefix in common with each linked node of the sample."""
    known = documents.sparkSession.sparkContext.broadcast(sample if sample is not None else _Sample([]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, paths, depths = [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py())
                node, path = (node_of(s), paths_of(s)) if len(s) else (None, None)
                nodes.append(node)
                sizes.append(len(s))
                paths.append(path.astype(">u2").tobytes() if len(s) else None)
                depths.append(known.value.depths(s, node, path, threshold) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(paths, pa.binary()),
                 pa.array(depths, pa.list_(pa.int32()))], ["doc_id", "node", "size", "paths", "depths"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, node binary, size long, paths binary, depths array<int>")


def shortened(depths: dict[int, int], threshold: float = THRESHOLD, target: float = FOREST_RECALL) -> int:
    """The longest prefix that meets the target: for a pair at the threshold by chance, and for the sample's links,
    of which ``depths`` tells how many have so many values in common."""
    length, links = DEPTH, sum(depths.values())
    while length > 1:
        found = sum(n for depth, n in depths.items() if depth >= length)
        if 1 - (1 - threshold**length) ** TREES >= target and found >= target * links:
            break
        length -= 1
    return length


def met(nodes: DataFrame, length: int) -> DataFrame:
    """Edges ``a``, ``b`` between nodes (``node``, ``paths``) that share a prefix of ``length`` values in a tree.

    The paths of a tree are sorted; nodes of one prefix follow one another, and
    each is joined to the first of them.
    """
    step, width = 2 * DEPTH, 2 * length
    leaves = nodes.select("node", "paths", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "tree", F.expr(f"substring(paths, tree * {step} + 1, {step})").alias("path"), "node")
    leaves = leaves.withColumn("prefix", F.expr(f"substring(path, 1, {width})"))
    tries = leaves.repartitionByRange("tree", "prefix").sortWithinPartitions("tree", "path", "node").select("tree", "prefix", "node")

    def fixed(column: pa.Array, size: int) -> np.ndarray:
        at = np.frombuffer(column.buffers()[1], "i4")[column.offset]
        return np.frombuffer(column.buffers()[2], "u1")[at : at + size * len(column)].reshape(-1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.hstack([batch.column("tree").to_numpy().astype(">u4").view("u1").reshape(-1, 4), fixed(batch.column("prefix"), width)])
            node = fixed(batch.column("node"), 16)
            if last is not None:
                key, node = np.vstack([last, key]), np.vstack([hub, node])
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            a, b = node[first[~new]], node[~new]
            last, hub = key[-1:], node[first[-1:]]
            offsets = pa.py_buffer(np.arange(0, 16 * len(a) + 1, 16, dtype="i4"))
            yield pa.RecordBatch.from_arrays(
                [pa.Array.from_buffers(pa.binary(), len(a), [None, offsets, pa.py_buffer(np.ascontiguousarray(x))]) for x in (a, b)], ["a", "b"])

    return tries.mapInArrow(run, "a binary, b binary").filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for edges ``a``, ``b``.

    Large and small stars take turns until nothing changes; a star's least node
    is found by an aggregation and joined back, so hubs are no burden.
    """
    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(least, "u")

    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).select(F.col("v").alias("u"), F.least("m", "u").alias("v"), F.col("u").alias("from"))
        large = large.filter(F.col("u") > F.col("from")).select("u", "v").filter("u != v").distinct()
        small = star(large).select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = stored(small.select("e.*").filter("u != v").distinct(), "edges")
        print_ = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_ == seen:
            break
        seen = print_
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def _linked(members: list[tuple], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which members have an exact similarity of the threshold or more, and the numbers of their sets."""
    sets = [m[3] for m in members]
    sizes = np.array([len(s) for s in sets], "i8")
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    common = np.zeros((len(sets), len(sets)), "f4")
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        width = 2048
        at = np.searchsorted(column, np.arange(0, int(column[-1]) + width + 1, width))
        for i, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
            block = np.zeros((len(sets), width), "f4")
            block[owner[lo:hi], column[lo:hi] - i * width] = 1
            common += block @ block.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * union - 1e-6
    np.fill_diagonal(linked, False)
    return linked, sizes


def _verify(members: list[tuple], crossed: bool, threshold: float) -> list[tuple]:
    """(node, linked documents, least node of its linked group) for members (node, copies, side, shingles)."""
    members = list({m[0]: m for m in members}.values())
    linked, _ = _linked(members, threshold)
    if crossed:  # pairs within a side are another task's
        side = np.array([m[2] for m in members])
        linked &= side[:, None] != side[None, :]
    copies = np.array([m[1] for m in members], "i8")
    links = linked.astype("i8") @ copies
    rank = np.argsort(np.argsort(np.array([m[0].hex() for m in members])))
    label, n = rank.copy(), len(members)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        if (least == label).all():
            break
        label = least
    by_rank = {int(r): m[0] for r, m in zip(rank, members)}
    return [(m[0], int(k), by_rank[int(g)]) for m, k, g in zip(members, links, label)]


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rest: tuple[str, ...]) -> Iterator[tuple]:
    """Rows that follow one another with equal keys, as (keys, rows)."""
    last, held = None, []
    for batch in batches:
        named = zip(*[batch.column(c).to_pylist() for c in keys])
        for key, row in zip(named, zip(*[batch.column(c).to_pylist() for c in rest])):
            if key != last:
                if held:
                    yield last, held
                last, held = key, []
            held.append(row)
    if held:
        yield last, held


def classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id``, ``n_links``, ``n_copies``, ``node``,
    ``class_root``.

    ``class_id`` is the least id of the documents that links connect,
    ``n_links`` the number of other documents at the threshold or above, copies
    included, ``n_copies`` the number of documents of the same shingles, its own
    included. A document without words, null text included, has no link and is
    a class of its own; ids may be null or repeated, a class of null ids alone
    has a null id. Only the columns ``doc_id`` and ``text`` are read. An empty
    table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(docs, threshold, _sample(docs)), "signatures")
    worded = signed.filter("node is not null")
    nodes = stored(worded.groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"),
        F.first("paths").alias("paths")), "nodes")
    depths = worded.select(F.explode("depths").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    length = shortened({r["d"]: r["n"] for r in depths.collect()}, threshold)  # as many rows as a path has values
    placed = components(met(nodes, length)).join(nodes.drop("paths"), "node")
    totals = placed.groupBy("root").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).select(
        "root", F.greatest(F.ceil(F.col("s") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_NODES)).cast("int").alias("blocks"))
    fetch = stored(placed.join(totals, "root").select(F.col("least_id").alias("__id"), "node", "root", "copies", "blocks"), "fetch")
    blocks = fetch.agg(F.max("blocks")).first()[0] or 1
    side = F.broadcast(fetch) if is_small(fetch, BROADCAST_ROWS) else fetch

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("root", pa.binary()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.binary()),
                            ("copies", pa.int64()), ("side", pa.int32()), ("set", pa.binary())])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("node", "root", "copies", "blocks", "text")]
            out: list[tuple] = []
            for node, root, copies, n, text in zip(*columns):
                s = shingles(text)
                if node_of(s) != node:  # another document of the same id
                    continue
                own = int.from_bytes(hashlib.blake2b(node, digest_size=4).digest(), "big") % n
                out += [(root, min(own, b), max(own, b), node, copies, own, s.tobytes()) for b in range(n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _groups(batches, ("root", "i", "j"), ("node", "copies", "side", "set")):
            found = _verify([(a, b, c, np.frombuffer(d, "u8")) for a, b, c, d in rows], i != j, threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), (pa.binary(), pa.int64(), pa.binary()))], ["node", "links", "anchor"])

    sets = docs.join(side, docs["doc_id"].eqNullSafe(side["__id"])).select("node", "root", "copies", "blocks", "text").mapInArrow(
        spread, "root binary, i int, j int, node binary, copies long, side int, set binary")
    compared = stored(
        sets.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInArrow(
            compare, "node binary, links long, anchor binary"), "links")
    if blocks == 1:
        linked = compared
    else:
        roots = components(compared.select(F.col("node").alias("a"), F.col("anchor").alias("b")))
        sums = compared.groupBy("node").agg(F.sum("links").alias("links"))
        linked = sums.join(roots, "node", "left").select("node", "links", F.coalesce("root", "node").alias("anchor"))
    known = nodes.select("node", "least_id", "copies").join(linked, "node", "left").withColumn(
        "anchor", F.coalesce("anchor", "node"))
    ids = known.groupBy("anchor").agg(F.min("least_id").alias("class_id"))
    info = known.join(ids, "anchor").select(
        "node", "class_id", F.col("anchor").alias("class_root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return signed.select("doc_id", "node").join(info, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "node", "class_root",
    )


def one_of_each(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, with one left of each class: that of the least id.

    Documents without words all stay. Where the least id of a class is null or
    on several rows, the least row by all its columns stays.
    """
    found = stored(classes(documents, threshold).filter("node is not null"), "classes")
    repeated = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").select("doc_id")
    if repeated.isEmpty():
        gone = found.filter("doc_id != class_id").select("doc_id")
        side = F.broadcast(gone) if is_small(gone, BROADCAST_ROWS) else gone
        return documents.join(side, "doc_id", "left_anti").select(documents.columns)

    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*columns, "__node"])

    with_node = documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField("__node", T.BinaryType())]))
    least = found.groupBy("class_root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("k")).select("k.*")
    kept = with_node.join(least.select(F.col("node").alias("__node"), F.col("doc_id").alias("__id")), "__node").filter(
        F.col("doc_id").eqNullSafe(F.col("__id")))
    one = kept.groupBy("__node").agg(F.min(F.struct(*columns)).alias("r")).select("r.*")
    return one.unionByName(with_node.filter("__node is null").select(columns))
