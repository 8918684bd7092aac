"""Models that change while a stream scores.

:class:`ModelShelf` keeps saved models below a folder, and a pointer table that
a training job moves. :class:`VersionedScoring` scores each batch with the
model that the pointer shows when the batch is first begun, and writes that
down before it scores, so a replay uses the same model whatever came since.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import forecast, upsert
from marketlens.operators.upsert import VersionedLog

VERSION = "model_version"
_MOVES = "move long, version long"


def _latest(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Number and version of the last move of a pointer table; of moves that share a number the higher version counts."""
    try:
        newest = spark.read.schema(_MOVES).parquet(path).agg(F.max(F.struct("move", "version")).alias("last")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # never moved
    return tuple(newest["last"]) if newest["last"] else None


@dataclass(frozen=True)
class ModelShelf:
    """Saved models, one folder per version, and the pointer to the one in use.

    One job writes at a time; any number read. A version is written whole
    before the pointer shows it and is never written again, so a reader finds
    the model it read the number of.
    """

    spark: SparkSession
    path: str

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    @property
    def _pointer(self) -> str:
        return f"{self.path}/pointer"

    def publish(self, model: PipelineModel, version: int) -> None:
        """Save the model under a number of the caller's choice (from 1) and point to it.

        A job that runs again under its number saves what is not yet in use;
        a number that the pointer has shown is an error.
        """
        if version < 1 or version in self.used():
            raise ValueError(f"model version {version} is below 1 or has been in use")
        forecast.save_model(model, self._folder(version))
        self.point_to(version)

    def used(self) -> set[int]:
        """The versions that the pointer has shown; one row per move, so it is short."""
        if _latest(self.spark, self._pointer) is None:
            return set()
        return {r.version for r in self.spark.read.schema(_MOVES).parquet(self._pointer).select("version").distinct().collect()}

    def point_to(self, version: int) -> None:
        """Move the pointer, also back to an earlier version."""
        last = _latest(self.spark, self._pointer)
        row = [((last[0] if last else 0) + 1, version)]
        self.spark.createDataFrame(row, _MOVES).coalesce(1).write.mode("append").parquet(self._pointer)

    def current(self) -> int | None:
        last = _latest(self.spark, self._pointer)
        return last[1] if last else None

    def load(self, version: int) -> PipelineModel:
        return forecast.load_model(self._folder(version))


@dataclass
class VersionedScoring:
    """Batch handler that scores feature rows and appends them with ``model_version`` to a log.

    ``uses`` is a folder of its own with the version of every batch. Before a
    model is published, rows are logged with null version and prediction. The
    model stays loaded until another version is asked for. ``extra`` keeps
    further columns of the rows.
    """

    shelf: ModelShelf
    log: VersionedLog
    uses: str
    ts: str = "timestamp"
    extra: tuple[str, ...] = ()
    report: Callable[[DataFrame, int], None] | None = None
    _loaded: dict[int, PipelineModel] = field(default_factory=dict)

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        version = self._version_of(batch_id)
        if version:
            scored = forecast.score(self._model(version), rows)
        else:
            scored = rows.withColumn("prediction", F.lit(None).cast("double"))
        marked = scored.withColumn(VERSION, F.lit(version or None).cast("long"))
        self.log.append(upsert.prediction_rows(marked, self.ts, (*self.extra, VERSION)), batch_id)
        if self.report:
            self.report(marked, batch_id)

    def _version_of(self, batch_id: int) -> int:
        """The version of the batch, 0 for none, chosen once."""
        spark, place = self.shelf.spark, f"{self.uses}/batch={batch_id}"
        known = _latest(spark, place)  # an unfinished write shows no row
        if known is None:
            known = (batch_id, self.shelf.current() or 0)
            spark.createDataFrame([known], _MOVES).coalesce(1).write.mode("overwrite").option(
                "partitionOverwriteMode", "static").parquet(place)
        return known[1]

    def _model(self, version: int) -> PipelineModel:
        if version not in self._loaded:
            self._loaded.clear()
            self._loaded[version] = self.shelf.load(version)
        return self._loaded[version]
