"""Result tables with last-write-wins semantics, kept as append-only logs.

A keyed store overwrites a row when its key is written again. Here each write
is a new version of the key in a log, and the current table is the latest
version of each key. Writing a batch again replaces that batch in the log, so
a replay after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "log_batch"
DAY = "log_day"
DELETED = "log_deleted"


def _version(columns: Sequence[str]) -> Column:
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)


def latest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row with the highest version of each key.

    Map tasks reduce their rows to one per key before the shuffle, so a key
    with very many versions stays cheap.
    """
    rest = [c for c in df.columns if c not in keys]
    chosen = F.max_by(F.struct(*rest), _version(version)).alias("__row")
    return df.groupBy(*keys).agg(chosen).select(*[c if c in keys else f"__row.{c}" for c in df.columns])


def latest_value(df: DataFrame, key: str, value: str, version: Sequence[str], name: str) -> DataFrame:
    """``value`` of the highest version of each key; it may be null."""
    return df.groupBy(key).agg(F.max_by(value, _version(version)).alias(name))


def merge_partial_rows(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Per key, the latest value of each column that is not null.

    A write that leaves a column out does not erase what an earlier write put
    there. Of several values of one version the greatest counts.
    """
    rest = [f for f in df.schema.fields if f.name not in keys and f.name not in version]

    def order(field: T.StructField) -> Column:
        return F.struct(*version, field.name) if _orderable(field.dataType) else _version(version)

    return df.groupBy(*keys).agg(
        *[F.max_by(F.col(f.name), F.when(F.col(f.name).isNotNull(), order(f))).alias(f.name) for f in rest]
    )


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def prediction_rows(scored: DataFrame, ts: str = "timestamp", extra: Sequence[str] = ()) -> DataFrame:
    """Scored bars in the types of the prediction table, and ``extra`` columns.

    Volume is cut to a whole number, null when it exceeds the column's range.
    """
    return scored.select(
        F.col("symbol"),
        F.col(ts).alias("timestamp"),
        F.col("prediction").cast("float").alias("prediction"),
        F.col("price").cast("float").alias("price"),
        F.col("volume").try_cast("int").alias("volume"),
        *extra,
    )


def prediction_file_rows(scored: DataFrame, ts: str = "timestamp") -> DataFrame:
    """As :func:`prediction_rows` for the variant without volume."""
    return scored.select(
        F.col("symbol"),
        F.col(ts).alias("timestamp"),
        F.col("prediction").cast("float").alias("prediction"),
        F.col("price").cast("float").alias("price"),
        F.lit(None).cast("int").alias("volume"),
    )


def sentiment_rows(
    scored: DataFrame, ts: str = "fetch_timestamp", extra: Sequence[str] = (), whole_millis: bool = False
) -> DataFrame:
    """Scored articles in the types of the sentiment table.

    ``extra`` keeps further columns, for instance the url: articles of one
    fetch can share a company and millisecond, and only a key that has more
    than these two tells them apart. ``whole_millis`` cuts the time to the
    millisecond, for tables that store no more.
    """
    at = F.date_trunc("millisecond", F.col(ts)) if whole_millis else F.col(ts)
    return scored.select(
        "company",
        at.alias("timestamp"),
        "description",
        F.col("description_sentiment").cast("float").alias("description_sentiment"),
        F.col("overall_sentiment").cast("float").alias("overall_sentiment"),
        "sentiment_label",
        "title",
        F.col("title_sentiment").cast("float").alias("title_sentiment"),
        *extra,
    )


def snapshot(
    bars: DataFrame, values: Sequence[str] = ("price", "volume"), ts: str = "timestamp",
    ties: Sequence[str] = (),
) -> DataFrame:
    """The latest bar of each symbol with its values as a map of floats."""
    newest = F.max_by(F.struct(F.col(ts).alias("at"), *values), F.struct(ts, *ties))
    entries = [e for v in values for e in (F.lit(v), F.col(f"__row.{v}").cast("float"))]
    return (
        bars.groupBy("symbol")
        .agg(newest.alias("__row"))
        .select(
            "symbol",
            F.date_format("__row.at", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
            F.create_map(*entries).alias("data"),
        )
    )


class VersionedLog:
    """A parquet log of keyed rows, one directory per batch and day.

    ``keys`` identify a row of the table; the batch number is its version.
    Rows of one key within a batch are ordered by ``ties``, then by all other
    columns that have an order, so the one that counts does not depend on how
    the batch is dealt out.
    Within a file rows are sorted by ``sort_by``, so that a scan for one symbol
    skips most row groups; the day directories serve time ranges. A log with
    ``deletes`` takes rows with a boolean column ``log_deleted``; a key whose
    latest version has it set is not in the table.

    :meth:`compact` puts batches that will not run again together in place,
    while others go on writing and reading: their table is written beside the
    log, and a row in a small pointer table then makes it count. Batch numbers
    stay as they are.
    """

    def __init__(
        self, path: str, schema: T.StructType, keys: Sequence[str], ts: str = "timestamp",
        sort_by: Sequence[str] | None = None, ties: Sequence[str] = (), deletes: bool = False,
    ):
        self.path = path
        self.keys = list(keys)
        self.ts = ts
        self.ties = list(ties)
        self.sort_by = list(sort_by or keys)
        self.deletes = deletes
        marks = [T.StructField(DELETED, T.BooleanType())] if deletes else []
        self.schema = T.StructType([*schema.fields, *marks])

    def _order(self) -> list[str]:
        known = {BATCH, *self.ties, *self.keys}
        return [BATCH, *self.ties, *[f.name for f in self.schema if f.name not in known and _orderable(f.dataType)]]

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch from the executors, in place of an earlier try of it as a whole.

        A batch has a folder of its own, so a try with fewer days or no rows
        leaves nothing of the one before.

        Rows of a day are brought together first, so that a batch of many tasks
        and days does not write tasks times days files. The rebalance hint lets
        adaptive execution cut a large day and join small ones.
        """
        upto = self._compacted(rows.sparkSession)
        if upto is not None and batch_id <= upto:
            raise ValueError(f"batch {batch_id} of {self.path} is compacted; batches up to {upto} cannot run again")
        self._write(rows, f"{self.path}/{BATCH}={int(batch_id)}")

    def _write(self, rows: DataFrame, path: str, *more: str) -> None:
        (
            self._marked(rows).select(*self.schema.fieldNames(), *more)
            .withColumn(DAY, F.to_date(self.ts))
            .hint("rebalance", F.col(DAY))
            .sortWithinPartitions(DAY, *self.sort_by)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(DAY)
            .parquet(path)
        )

    def _marked(self, rows: DataFrame) -> DataFrame:
        unmarked = self.deletes and DELETED not in rows.columns
        return rows.withColumn(DELETED, F.lit(False)) if unmarked else rows

    def _compacted(self, spark: SparkSession) -> int | None:
        """The last batch of those that are compacted."""
        try:
            return spark.read.schema("upto long").parquet(f"{self.path}-compacted").agg(F.max("upto")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # never compacted

    def _base(self, upto: int) -> str:
        return f"{self.path}-base/upto-{upto}"

    def versions(self, spark: SparkSession) -> DataFrame:
        """All rows ever written, with their batch and day; of compacted batches those of their table."""
        extra = [T.StructField(BATCH, T.LongType()), T.StructField(DAY, T.DateType())]
        reader = spark.read.schema(T.StructType([*self.schema.fields, *extra]))
        upto = self._compacted(spark)
        if upto is None:
            return reader.parquet(self.path)
        base = reader.parquet(self._base(upto))
        try:
            later = reader.parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return base
        return base.unionByName(later.filter(F.col(BATCH) > upto))

    def compact(self, spark: SparkSession, upto: int, by_column: bool = False) -> None:
        """Put the batches up to ``upto`` together; they must not run again, later ones may be under way.

        A key keeps the batch of its latest version, deleted keys go. Logs that
        are read ``by_column`` are compacted so too. A try that fails before
        its end changes nothing. The folders of the batches stay for readers
        that began before; :meth:`remove_compacted` takes them away.
        """
        known = self._compacted(spark)
        if known is not None and upto <= known:
            return
        versions = self.versions(spark).filter(F.col(BATCH) <= upto).drop(DAY)
        if by_column and (self.ties or self.deletes):
            raise ValueError("values per column have neither ties nor delete marks")
        if by_column:
            table = merge_partial_rows(versions, self.keys, [BATCH]).withColumn(BATCH, F.lit(upto).cast("long"))
        else:
            table = latest_per_key(versions, self.keys, self._order())
        if self.deletes:
            table = table.filter(~F.coalesce(DELETED, F.lit(False)))
        self._write(table, self._base(upto), BATCH)
        spark.range(1).select(F.lit(upto).cast("long").alias("upto")).write.mode("append").parquet(f"{self.path}-compacted")

    def remove_compacted(self, spark: SparkSession) -> None:
        """Delete the folders of compacted batches and older tables, once no reader that began before is left."""
        upto = self._compacted(spark)
        if upto is None:
            return
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for root, prefix, last in ((self.path, f"{BATCH}=", upto), (f"{self.path}-base", "upto-", upto - 1)):
            place = jvm.org.apache.hadoop.fs.Path(root)
            fs = place.getFileSystem(conf)
            for entry in fs.listStatus(place) if fs.exists(place) else ():
                name = entry.getPath().getName()
                if name.startswith(prefix) and int(name.removeprefix(prefix)) <= last:
                    fs.delete(entry.getPath(), True)

    def current(
        self, spark: SparkSession, by_column: bool = False, days: tuple[str, str] | None = None
    ) -> DataFrame:
        """The table: the latest version of each key.

        ``by_column`` takes the latest value of each column that is not null,
        for logs whose writers leave columns out. ``days`` keeps a range of days,
        both ends included. Only where the time is part of the key all versions
        of a row lie in one day, and other directories need not be read.
        """
        versions = self.versions(spark)

        def inside(day: Column) -> Column:
            return day.between(*[F.lit(d).cast("date") for d in days])

        if days and self.ts in self.keys:
            versions = versions.filter(inside(F.col(DAY)))
        versions = versions.drop(DAY)
        if self.deletes and by_column:
            raise ValueError("a deleted row has no latest value per column")
        if by_column:
            ties = {f"__tie_{t}": F.col(t) for t in self.ties}  # the columns themselves stay in the table
            table = merge_partial_rows(versions.withColumns(ties) if ties else versions, self.keys, [BATCH, *ties])
        else:
            table = latest_per_key(versions, self.keys, self._order()).drop(BATCH)
        if self.deletes:
            table = table.filter(~F.coalesce(DELETED, F.lit(False))).drop(DELETED)
        return table.filter(inside(F.to_date(self.ts))) if days and self.ts not in self.keys else table

    def compact_to(self, spark: SparkSession, path: str) -> "VersionedLog":
        """Write the current table as the first batch of a log at a new path."""
        shape = T.StructType([f for f in self.schema.fields if f.name != DELETED])
        target = VersionedLog(path, shape, self.keys, self.ts, self.sort_by, self.ties, self.deletes)
        target.append(self.current(spark), 0)
        return target
