"""What a batch changed in a versioned log, and statistics that follow the changes.

A :class:`ChangeFeed` stores, per batch of a log, each key that the batch
touched with its row before and after. Statistics that can add and take away
then read the batches since they were last up to date and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators.upsert import BATCH, DAY, DELETED, VersionedLog, _orderable, latest_per_key

INSERTED, REPLACED, REMOVED = "inserted", "replaced", "removed"


class ChangeFeed:
    """The changes of a log, one folder per batch below ``path``.

    :meth:`record` is called after a batch was appended, in the order of the
    batches. Where the time is part of the key all versions of a row lie in one
    day, and only the days of the batch are read to find the rows before.
    A batch that runs again replaces its folder; batches recorded after it are
    taken back, since what they met has changed, and are recorded again.
    """

    def __init__(self, log: VersionedLog, path: str):
        self.log, self.path = log, path

    def _shape(self) -> T.StructType:
        row = T.StructType([f for f in self.log.schema if f.name not in (*self.log.keys, DELETED)])
        return T.StructType([*[self.log.schema[k] for k in self.log.keys], T.StructField("change", T.StringType()),
                             T.StructField("before", row), T.StructField("after", row)])

    def _rows(self, versions: DataFrame, name: str) -> DataFrame:
        """The table of some versions, the other columns as a struct; deleted keys are absent."""
        rest = [f.name for f in self._shape()["after"].dataType]
        table = latest_per_key(versions.drop(DAY), self.log.keys, self.log._order())
        if self.log.deletes:
            table = table.filter(~F.coalesce(DELETED, F.lit(False)))
        return table.select(*self.log.keys, F.struct(*rest).alias(name))

    def record(self, spark: SparkSession, batch_id: int) -> None:
        """Store what batch ``batch_id`` changed, and anew what the recorded batches after it did."""
        again = [b for b in self.batches(spark) if b > batch_id]
        for batch in [batch_id, *again]:
            self._record(spark, batch)

    def _record(self, spark: SparkSession, batch_id: int) -> None:
        versions = self.log.versions(spark)
        new = versions.filter(F.col(BATCH) == batch_id)
        earlier = versions.filter(F.col(BATCH) < batch_id)
        if self.log.ts in self.log.keys:
            days = F.broadcast(new.select(DAY).distinct())  # one row a day of the batch
            earlier = earlier.join(days, DAY, "left_semi").unionByName(earlier.filter(F.col(DAY).isNull()))
        touched = new.select(*self.log.keys).distinct()
        old = self._rows(self._same(earlier, touched, "left_semi"), "before")
        # a key whose latest row is a delete mark is in `touched` but has no row after
        both = self._same(self._same(touched, old, "left"), self._rows(new, "after"), "left")
        change = (F.when(F.col("before").isNull(), INSERTED).when(F.col("after").isNull(), REMOVED).otherwise(REPLACED))
        changed = both.filter(~F.col("before").eqNullSafe(F.col("after"))) if self._comparable() else both.filter(
            F.col("before").isNotNull() | F.col("after").isNotNull())
        changed.select(*self.log.keys, change.alias("change"), "before", "after").write.mode("overwrite").parquet(
            f"{self.path}/{BATCH}={int(batch_id)}")

    def _comparable(self) -> bool:
        return _orderable(self._shape()["after"].dataType)

    def _same(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """A join on the keys in which nulls are equal."""
        named = right.withColumnsRenamed({k: f"__{k}" for k in self.log.keys})
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.log.keys]
        return left.join(named, on, how).drop(*[f"__{k}" for k in self.log.keys])

    def batches(self, spark: SparkSession) -> list[int]:
        """The numbers of the recorded batches, from the names of their folders."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(conf)
        names = [e.getPath().getName() for e in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n.removeprefix(f"{BATCH}=")) for n in names if n.startswith(f"{BATCH}="))

    def between(self, spark: SparkSession, after: int, upto: int) -> DataFrame:
        """The changes of the batches behind ``after`` up to ``upto``, with their batch; other folders are not listed."""
        shape = T.StructType([*self._shape(), T.StructField(BATCH, T.LongType())])
        paths = [f"{self.path}/{BATCH}={b}" for b in self.batches(spark) if after < b <= upto]
        if not paths:
            return spark.createDataFrame([], shape)
        return spark.read.schema(shape).option("basePath", self.path).parquet(*paths)


class CompanyTotals:
    """Sentiment statistics per company that follow a change feed.

    Holds sums per company (articles, scored articles, score, labels) as of a
    batch, one folder per batch they were brought up to. :meth:`advance` adds
    what rows brought and takes away what they replaced. Scores are summed as
    decimals of ``DIGITS`` places, so that a score that goes leaves nothing behind.
    """

    DIGITS = 12
    SUMS: Sequence[str] = ("articles", "scored", "score", "positive", "negative")

    def __init__(self, feed: ChangeFeed, path: str):
        self.feed, self.path = feed, path

    def _parts(self, row: str, company: Column) -> Column:
        score = F.nanvl(F.col(f"{row}.overall_sentiment").cast("double"), F.lit(None).cast("double"))
        label = F.col(f"{row}.sentiment_label")
        return F.struct(
            company.alias("company"), F.lit(1).cast("long").alias("articles"), score.isNotNull().cast("long").alias("scored"),
            F.coalesce(score, F.lit(0.0)).cast(f"decimal(38,{self.DIGITS})").alias("score"),
            F.coalesce(label == "positive", F.lit(False)).cast("long").alias("positive"),
            F.coalesce(label == "negative", F.lit(False)).cast("long").alias("negative"))

    def _summed(self, rows: DataFrame) -> DataFrame:
        sums = [F.sum(c).cast(f"decimal(38,{self.DIGITS})" if c == "score" else "long").alias(c) for c in self.SUMS]
        return rows.groupBy("company").agg(*sums).filter("articles <> 0")

    def _deltas(self, changes: DataFrame) -> DataFrame:
        where = (lambda row: F.col("company")) if "company" in self.feed.log.keys else (lambda row: F.col(f"{row}.company"))
        sides = [(F.col(row).isNotNull(), self._parts(row, where(row)), sign) for row, sign in (("after", 1), ("before", -1))]
        signed = F.filter(F.array(*[F.when(there, F.struct(F.lit(sign).alias("sign"), part.alias("part"))) for there, part, sign in sides]),
                          lambda x: x.isNotNull())
        rows = changes.select(F.explode(signed).alias("x"))
        return rows.select("x.part.company", *[
            F.when(F.col("x.sign") > 0, F.col(f"x.part.{c}")).otherwise(-F.col(f"x.part.{c}")).alias(c) for c in self.SUMS])

    def advance(self, spark: SparkSession, upto: int) -> None:
        """Bring the sums up to batch ``upto``, from the latest stored ones before it.

        Sums of a batch that runs again, and of those behind it, have to be
        dropped first with :meth:`rewind`.
        """
        at = self._at(spark, upto)
        known = [] if at is None else [self._stored(spark, at)]
        parts = [self._deltas(self.feed.between(spark, -1 if at is None else at, upto)).select("company", *self.SUMS)]
        rows = known[0].unionByName(parts[0]) if known else parts[0]
        if at != upto:
            self._summed(rows).write.mode("overwrite").parquet(f"{self.path}/upto={int(upto)}")
            spark.range(1).select(F.lit(int(upto)).cast("long").alias("upto"), F.lit(True).alias("valid"),
                                  F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.path}-pointer")

    def rewind(self, spark: SparkSession, batch_id: int) -> None:
        """Forget the sums as of ``batch_id`` and later, before that batch runs again."""
        for upto in self._valid(spark):
            if upto >= batch_id:
                spark.range(1).select(F.lit(upto).cast("long").alias("upto"), F.lit(False).alias("valid"),
                                      F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.path}-pointer")

    def _valid(self, spark: SparkSession) -> list[int]:
        try:
            marks = spark.read.schema("upto long, valid boolean, at timestamp").parquet(f"{self.path}-pointer")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        last = marks.groupBy("upto").agg(F.max_by("valid", "at").alias("valid"))
        return sorted(r["upto"] for r in last.filter("valid").collect())

    def _at(self, spark: SparkSession, upto: int) -> int | None:
        return max((n for n in self._valid(spark) if n <= upto), default=None)

    def _stored(self, spark: SparkSession, at: int) -> DataFrame:
        shape = f"company string, articles long, scored long, score decimal(38,{self.DIGITS}), positive long, negative long"
        return spark.read.schema(shape).parquet(f"{self.path}/upto={at}")

    def current(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The statistics of :func:`sentiment.company_statistics` as of the latest stored batch up to ``upto``."""
        at = self._at(spark, 2**62 if upto is None else upto)
        if at is None:
            raise ValueError(f"no sums below {self.path} yet")
        share = lambda c: (F.col(c) / F.col("articles")).cast("double").alias(f"{c}_ratio")
        mean = F.when(F.col("scored") > 0, F.col("score").cast("double") / F.col("scored"))
        return self._stored(spark, at).select("company", mean.alias("avg_sentiment"), F.col("articles").alias("article_count"),
                                              share("positive"), share("negative"))
