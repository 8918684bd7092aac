"""Ordered windows over keys of any size.

A window partitioned by symbol sends every row of a symbol to one task, which
fails once a symbol holds a third of the data. Keys above a row limit are
therefore cut into segments along their order. Rows that a frame needs from
before a segment are copied into it, so results equal those of the plain
window. Keys below the limit stay whole; without a large key the plan is the
plain window: one exchange, one sort.

Rows that the order columns do not tell apart cannot be cut. Where such copies
exceed the limit, they are first counted (map tasks combine them), a few stand
for all in the window, and the result is repeated by the count.

Where only positions are asked for, large keys are not cut but sorted in ranges
over all tasks, which takes one sort whatever the values (:func:`number_rows`).

Looking for large keys costs one count per key; only if there are any, a second
pass takes the ranges of their order columns. What reaches the driver is one
row per over-full key or segment, and ``MAX_SEGMENTS`` bounds their number
whatever the data size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators.lookup import hold

ROWS_PER_SEGMENT = 4_000_000
MAX_SEGMENTS = 200_000

SEGMENT = "__segment"
OWN = "__own"
COPY = "__copy"
COPIES = "__copies"
MARK = "__mark"
# bounds of positions; nulls take the lower one (they sort first), NaN the upper one
_LOWEST, _HIGHEST = -1e300, 1e300
#: Bytes of a text that one position holds.
_PIECE = 6
#: Rows of one range of :func:`number_rows`.
_ROWS_PER_RANGE = 100_000


@dataclass(frozen=True)
class Segmented:
    """A frame whose rows carry the segment they belong to."""

    frame: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool
    crowded: bool = False  # some rows beyond the limit share all order columns

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, SEGMENT).orderBy(*self.order)


#: A position of an order column, given how many pieces of a text the rows share.
_Position = Callable[[Column], Column]


def _text_piece(value: Column, skip: Column) -> Column:
    """``_PIECE`` bytes of a text behind ``skip`` such pieces as a whole number below 2**51 that keeps their order.

    Bytes past the end count as zero, and the number of bytes that are there
    comes last, so a text sorts behind its own beginning.
    """
    part = value.cast("binary").substr(skip * _PIECE + 1, F.lit(_PIECE))
    padded = F.conv(F.rpad(F.hex(part), 2 * _PIECE, "0"), 16, 10).cast("long")
    return padded * 8 + F.octet_length(part)


def _long_piece(value: Column, skip: Column) -> Column:
    """A long as a double, or, where that cannot tell longs apart, its upper (``skip`` 1) or lower (2) 32 bits."""
    whole, upper, lower = value.cast("double"), F.shiftright(value, 32), value.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(skip == 0, whole).when(skip == 1, upper.cast("double")).otherwise(lower.cast("double"))


def _positions(df: DataFrame, order: Sequence[str]) -> dict[str, _Position]:
    """The leading order columns as doubles that keep their order, as far as they have such a form.

    Texts have one piece by piece: the rows of a range share the pieces that
    are skipped.
    """
    found = {}
    for name in order:
        kind = df.schema[name].dataType
        piece = lambda skip, name=name: _text_piece(F.col(name), skip)
        if isinstance(kind, T.TimestampType):
            number = F.unix_micros(name)
        elif isinstance(kind, T.TimestampNTZType):
            # by way of the session zone, a clock change would swap times
            since = F.col(name) - F.lit("1970-01-01").cast("timestamp_ntz")
            number = since.cast("interval second").cast("decimal(20,6)")
        elif isinstance(kind, T.DateType):
            number = F.unix_date(name)
        elif isinstance(kind, T.LongType):
            found[name] = _bounded(lambda skip, name=name: _long_piece(F.col(name), skip))
            continue
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            number = F.col(name)
        elif not _is_text(kind):
            break
        found[name] = _bounded(piece if _is_text(kind) else lambda skip, number=number: number)
    return found


def _is_text(kind: T.DataType) -> bool:
    """Whether values are ordered by their bytes; other collations are not."""
    return kind == T.StringType() or isinstance(kind, T.BinaryType)


def _bounded(number: _Position) -> _Position:
    def position(skip: Column) -> Column:
        placed = F.coalesce(number(skip).cast("double"), F.lit(_LOWEST))
        return F.greatest(F.least(placed, F.lit(_HIGHEST)), F.lit(_LOWEST))

    return position


def _shared_pieces(low: Column, high: Column) -> Column:
    """Pieces that the lowest and the highest text, and so all between, have in common; 0 for equal ones."""
    pieces = F.sequence(F.lit(0), F.floor(F.octet_length(high) / _PIECE).cast("int"))
    differs = F.filter(pieces, lambda skip: _text_piece(low, skip) != _text_piece(high, skip))
    return F.coalesce(F.get(differs, F.lit(0)), F.lit(0))


def _extent(df: DataFrame, groups: Sequence[str], positions: dict[str, _Position]) -> DataFrame:
    """Rows of each group, and per order column the lowest and highest position and the pieces before it."""
    bounds, shown = [], []
    for i, (name, position) in enumerate(positions.items()):
        low, high = F.col(f"min{i}"), F.col(f"max{i}")
        bounds += [F.min(name).alias(f"min{i}"), F.max(name).alias(f"max{i}")]
        if _is_text(df.schema[name].dataType):
            bounds.append(F.count_if(F.col(name).isNull()).alias(f"nulls{i}"))
            skip = F.when(F.col(f"nulls{i}") > 0, F.lit(0)).otherwise(_shared_pieces(low, high))
            lowest = F.when(F.col(f"nulls{i}") > 0, F.lit(_LOWEST)).otherwise(_text_piece(low, skip).cast("double"))
            highest = F.coalesce(_text_piece(high, skip).cast("double"), F.lit(_LOWEST))
        else:
            bounds += [F.min(position(F.lit(0))).alias(f"low{i}"), F.max(position(F.lit(0))).alias(f"high{i}")]
            skip, lowest, highest = F.lit(0), F.col(f"low{i}"), F.col(f"high{i}")
            if isinstance(df.schema[name].dataType, T.LongType):
                blurred = (low != high) & (lowest == highest)
                skip = F.when(~blurred | blurred.isNull(), F.lit(0)).when(F.shiftright(low, 32) != F.shiftright(high, 32), F.lit(1)).otherwise(F.lit(2))
                lowest = F.when(skip == 0, lowest).otherwise(_long_piece(low, skip))
                highest = F.when(skip == 0, highest).otherwise(_long_piece(high, skip))
        shown += [lowest.alias(f"lo{i}"), highest.alias(f"hi{i}"), skip.alias(f"skip{i}"),
                  low.eqNullSafe(high).alias(f"same{i}")]
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), *bounds).select(*groups, "rows", *shown)


def _axis(row, parts: int, columns: int) -> tuple[int, float] | None:
    """The first order column that varies and the width of one of ``parts`` equal ranges of it.

    A later column orders rows only where the earlier ones are equal. Decimals
    that differ, but not as doubles, are therefore not cut at all.
    """
    for i in range(columns):
        width = (row[f"hi{i}"] - row[f"lo{i}"]) / parts
        if width > 0:
            return i, width
        if not row[f"same{i}"]:
            return None
    return None


def split_large_keys(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_segment: int = ROWS_PER_SEGMENT,
    max_segments: int = MAX_SEGMENTS,
) -> Segmented:
    """Assign a segment to each row.

    ``order`` should identify a row within its key; the columns after the
    first also allow a crowd of rows at one timestamp to be cut. An over-full
    key is cut into equal ranges of its first order column that varies, and
    ranges that are still over-full are cut again.
    """
    keys, order = tuple(keys), tuple(order)
    frame = df.withColumn(SEGMENT, F.lit(0).cast("long"))
    positions = _positions(df, order)

    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    total, largest = sizes.agg(F.sum("rows"), F.max("rows")).first()
    limit = max(rows_per_segment, math.ceil((total or 0) / max_segments))
    if (largest or 0) <= limit:
        return Segmented(frame, keys, order, False)
    full = _extent(df, keys, positions).filter(F.col("rows") > limit).collect()

    next_id, split, crowded = 1, False, False
    while full:  # a cut parts the lowest from the highest position, so this ends
        cuts, first_id = [], next_id
        for row in full:
            parts = math.ceil(2 * row["rows"] / limit)
            found = _axis(row, parts, len(positions))
            if found is None:
                crowded = True
                continue
            axis, width = found
            segment = row[SEGMENT] if split else 0
            cuts.append((*(row[k] for k in keys), segment, axis, row[f"skip{axis}"], row[f"lo{axis}"], width, next_id))
            next_id += parts + 1
        if not cuts:
            break
        frame = _cut(frame, keys, positions, cuts, df.schema)
        split = True
        fresh = frame.filter(F.col(SEGMENT) >= first_id)
        full = _extent(fresh, [*keys, SEGMENT], positions).filter(F.col("rows") > limit).collect()
    return Segmented(frame, keys, order, split, crowded)


def collapse_copies(df: DataFrame, kept: int = 1, rest_on_first: bool = False) -> DataFrame:
    """Up to ``kept`` numbered rows for all copies of a row, with the count each stands for.

    The last of them, or the first, stands for the copies beyond ``kept``.
    """
    bits = _needs_mark(df)
    marked = df.withColumn(MARK, _mark(bits)) if bits else df
    alike = [c for c in marked.columns if c not in [f.name for f in bits]]
    values = [F.first(f.name).alias(f.name) for f in bits]
    counted = marked.groupBy(*alike).agg(F.count(F.lit(1)).alias("__n"), *values).select(*marked.columns, "__n")
    shown = F.least(F.col("__n"), F.lit(kept).cast("long"))
    numbered = counted.withColumn("__shown", shown).withColumn(COPY, F.explode(F.sequence(F.lit(1).cast("long"), shown)))
    taker = F.lit(1) if rest_on_first else F.col("__shown")
    copies = F.when(F.col(COPY) == taker, F.col("__n") - F.col("__shown") + 1).otherwise(F.lit(1))
    return numbered.withColumn(COPIES, copies.cast("long")).drop("__n", "__shown")


def _holds(kind: T.DataType, *kinds: type) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, *kinds)
    if isinstance(kind, T.MapType):
        return T.MapType in kinds or _holds(kind.keyType, *kinds) or _holds(kind.valueType, *kinds)
    if isinstance(kind, T.StructType):
        return any(_holds(f.dataType, *kinds) for f in kind)
    return isinstance(kind, kinds)


def _needs_mark(df: DataFrame) -> list[T.StructField]:
    """Columns that grouping would change (0.0 and -0.0 are one group) or refuse (maps)."""
    return [f for f in df.schema if _holds(f.dataType, T.FloatType, T.DoubleType, T.MapType)]


def _mark(fields: Sequence[T.StructField]) -> Column:
    """A text that is equal where the values are, to the bit; keys of a map count in their order."""
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    options = {"ignoreNullFields": "false", "timestampFormat": f"{micros}XXX", "timestampNTZFormat": micros}

    def text(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.FractionalType):
            return F.col(field.name).cast("string")
        return F.to_json(F.struct(field.name), options)

    return F.concat_ws("\x1f", *[F.coalesce(text(f), F.lit("\x1e")) for f in fields])


def copy_order(df: DataFrame, order: Sequence[str]) -> list[str]:
    """An order that keeps copies next to each other."""
    rest = [f.name for f in df.schema if f.name not in order and not _holds(f.dataType, T.MapType)]
    return [*order, *rest, *[MARK] * bool(_needs_mark(df)), COPY]


def expand_copies(df: DataFrame) -> DataFrame:
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), F.col(COPIES)))
    return df.withColumn("__repeat", repeat).drop("__repeat", COPY, COPIES, MARK)


def _cut(frame: DataFrame, keys, positions, cuts, schema) -> DataFrame:
    table_schema = T.StructType(
        [T.StructField(f"__key{i}", schema[k].dataType) for i, k in enumerate(keys)]
        + [
            T.StructField("__from", T.LongType()),
            T.StructField("__axis", T.IntegerType()),
            T.StructField("__skip", T.IntegerType()),
            T.StructField("__low", T.DoubleType()),
            T.StructField("__width", T.DoubleType()),
            T.StructField("__base", T.LongType()),
        ]
    )
    table = frame.sparkSession.createDataFrame(cuts, table_schema)
    same_key = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    match = reduce(Column.__and__, [*same_key, F.col(SEGMENT) == F.col("__from")])
    along = F.coalesce(*[F.when(F.col("__axis") == i, p(F.col("__skip"))) for i, p in enumerate(positions.values())])
    # each row stands for more than total / MAX_SEGMENTS rows, so there are fewer than MAX_SEGMENTS
    joined = frame.join(F.broadcast(table), match, "left")
    steps = F.floor((along - F.col("__low")) / F.col("__width"))
    moved = F.col("__base") + steps.cast("long")
    return joined.withColumn(SEGMENT, F.coalesce(moved, F.col(SEGMENT))).drop(*table_schema.fieldNames())


def _ends(seg: Segmented, count: int) -> DataFrame:
    """The last ``count`` rows of each segment of a split key, as one array per segment.

    The rank limit is applied before the shuffle as well, so each map task
    sends at most ``count`` rows per segment.
    """
    row = F.struct(*dict.fromkeys([*seg.order, *[c for c in seg.frame.columns if c != SEGMENT]]))
    latest_first = Window.partitionBy(*seg.keys, SEGMENT).orderBy(*[F.desc(c) for c in seg.order])
    return (
        seg.frame.filter(F.col(SEGMENT) > 0)
        .withColumn("__rank", F.row_number().over(latest_first))
        .filter(F.col("__rank") <= count)
        .groupBy(*seg.keys, SEGMENT)
        .agg(_sorted_rows(row, seg).alias("__end"))
    )


def _sorted_rows(row: Column, seg: Segmented) -> Column:
    """The rows of a group as an array in the order of the segments; rows with maps have none of their own."""
    if not any(_holds(f.dataType, T.MapType) for f in seg.frame.schema):
        return F.array_sort(F.collect_list(row))
    keyed = F.collect_list(F.struct(F.struct(*seg.order).alias("by"), row.alias("row")))
    in_order = F.array_sort(keyed, lambda a, b: F.when(a["by"] < b["by"], -1).when(a["by"] > b["by"], 1).otherwise(0))
    return F.transform(in_order, lambda x: x["row"])


def with_preceding_rows(seg: Segmented, count: int) -> DataFrame:
    """Add to each segment the ``count`` rows before its first row, marked not ``OWN``."""
    own = seg.frame.withColumn(OWN, F.lit(True))
    if not seg.split:
        return own
    # one row per segment, so this window is bounded by MAX_SEGMENTS; every
    # segment holds a row, so `count` segments back hold enough rows
    before = Window.partitionBy(*seg.keys).orderBy(F.struct(*[F.col("__end")[0][c].alias(c) for c in seg.order])).rowsBetween(-count, -1)
    earlier = F.flatten(F.collect_list("__end").over(before))
    ends = _ends(seg, count).select(*seg.keys, SEGMENT, earlier.alias("__earlier"))
    start = F.greatest(F.size("__earlier") - count + 1, F.lit(1))
    copies = (
        ends.withColumn("__row", F.explode(F.slice("__earlier", start, F.lit(count))))
        .select(
            *[F.col(f"__row.{c}").alias(c) for c in seg.frame.columns if c != SEGMENT],
            F.col(SEGMENT),
            F.lit(False).alias(OWN),
        )
    )
    return own.unionByName(copies)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str = "rank", size: str = "size",
    rows_per_segment: int = ROWS_PER_SEGMENT, without: Sequence[str] = (),
) -> DataFrame:
    """Add the position of each row within its key (from 1) and the key's row count.

    Rows of keys above the limit are sorted once over all tasks, in ranges of
    key and order; a position is that in its range plus the key's rows in the
    ranges before. ``without`` are columns that the result does not need, long
    texts of the order for instance; they are not kept.
    """
    columns = [c for c in df.columns if c not in without]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    total, largest, least = sizes.agg(F.sum("__rows"), F.max("__rows"), F.min("__rows")).first()
    limit = max(rows_per_segment, math.ceil((total or 0) / MAX_SEGMENTS))
    if (largest or 0) <= limit:
        return _number_within(df, keys, order, columns, rank, size)
    # each stands for more than total / MAX_SEGMENTS rows, so there are fewer than MAX_SEGMENTS
    over = hold(sizes.filter(F.col("__rows") > limit).select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]))
    numbered = _number_across(df.join(F.broadcast(over), _same_key(keys), "left_semi"), keys, order, columns, rank, size, limit)
    if least > limit:
        return numbered
    small = df.join(F.broadcast(over), _same_key(keys), "left_anti")
    return numbered.unionByName(_number_within(small, keys, order, columns, rank, size))


def _same_key(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])


def _number_within(df: DataFrame, keys, order, columns, rank: str, size: str) -> DataFrame:
    whole = Window.partitionBy(*keys)
    position = F.row_number().over(whole.orderBy(*order)).cast("long")
    return df.select(*columns, position.alias(rank), F.count(F.lit(1)).over(whole).alias(size))


def _number_across(df: DataFrame, keys, order, columns, rank: str, size: str, limit: int) -> DataFrame:
    """As :func:`number_rows`, for keys that are too much for one task."""
    # rows alike in their order go to one range; the hash stands for texts, and one hash for two at worst counts too many
    alike = df.groupBy(F.xxhash64(*keys, *order)).agg(F.count(F.lit(1)).alias("__rows"))
    rows, most = alike.agg(F.sum("__rows"), F.max("__rows")).first()
    crowded = most > limit
    if crowded:
        names = df.columns
        df = collapse_copies(df)
        order = copy_order(df.select(*names), order)
    # few ranges for few rows: Spark samples values of the order for each
    ranges = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / _ROWS_PER_RANGE))
    in_order = df.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order)
    kept = [*columns, *[COPIES] * crowded]
    # held, as the borders of the ranges may be others in another run; the number has the range above bit 33
    placed = hold(in_order.select(*kept, F.monotonically_increasing_id().alias("__place"))).withColumn("__range", F.shiftright("__place", 33))
    weight = F.col(COPIES) if crowded else F.lit(1).cast("long")
    # a row per range and one more per key at most
    pieces = placed.groupBy(*keys, "__range").agg(F.sum(weight).alias("__n"), F.min("__place").alias("__first"))
    of_key = Window.partitionBy(*keys)
    earlier = of_key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)],
        F.col("__range").alias("__from"),
        "__first",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"),
        F.sum("__n").over(of_key).alias("__total"),
    )
    joined = placed.join(F.broadcast(offsets), _same_key(keys) & (F.col("__range") == F.col("__from")))
    upto = F.col("__place") - F.col("__first") + 1
    if crowded:  # a row's rank is that of the last copy it stands for
        upto = F.sum(weight).over(Window.partitionBy(*keys, "__range").orderBy("__place"))
    numbered = joined.withColumn(rank, upto + F.col("__offset")).withColumn(size, F.col("__total"))
    if crowded:
        numbered = numbered.withColumn(rank, F.explode(F.sequence(F.col(rank) - F.col(COPIES) + 1, F.col(rank))))
    return numbered.select(*columns, rank, size)


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, present: Column,
    name: str, rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Add ``value`` of the latest row, up to the current one, where ``present`` holds."""
    columns = df.columns
    seg = split_large_keys(df, keys, order, rows_per_segment)
    if seg.crowded:
        df = collapse_copies(df)
        seg = split_large_keys(df, keys, copy_order(df.select(*columns), order), rows_per_segment)
    finish = expand_copies if COPIES in df.columns else (lambda done: done)
    held = F.when(present, F.struct(value.alias("v")))
    upto = seg.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.last(held, ignorenulls=True).over(upto)
    if not seg.split:
        return finish(seg.frame.withColumn(name, running["v"]).drop(SEGMENT))
    # one row per segment of a split key, bounded by MAX_SEGMENTS
    place = F.struct(*seg.order)
    pieces = (
        seg.frame.filter(F.col(SEGMENT) > 0)
        .groupBy(*seg.keys, SEGMENT)
        .agg(
            F.min(place).alias("__start"),
            F.max_by(held, F.when(present, place)).alias("__last"),
        )
    )
    earlier = Window.partitionBy(*seg.keys).orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    inherited = pieces.select(
        *[F.col(k).alias(f"__key{i}") for i, k in enumerate(seg.keys)],
        F.col(SEGMENT).alias("__from"),
        F.last("__last", ignorenulls=True).over(earlier).alias("__inherited"),
    )
    same_key = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(seg.keys)]
    match = reduce(Column.__and__, [*same_key, F.col(SEGMENT) == F.col("__from")])
    return finish(
        seg.frame.withColumn("__running", running)
        .join(F.broadcast(inherited), match, "left")
        .select(*df.columns, F.coalesce("__running", "__inherited")["v"].alias(name))
    )
