"""The two continuous jobs as batch handlers, and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from marketlens.operators import features, forecast, sentiment, upsert
from marketlens.operators.upsert import VersionedLog


@dataclass(frozen=True)
class NewsResult:
    scored: DataFrame
    companies: DataFrame
    positive: DataFrame
    negative: DataFrame


def news_result(
    news: DataFrame, lexicon: DataFrame | sentiment.Scorer, ties: Sequence[str] = (), top: int = 3
) -> NewsResult:
    """Scored articles, statistics per company, and the articles at both ends."""
    scored = sentiment.score_news(news, lexicon)
    return NewsResult(
        scored,
        sentiment.company_statistics(scored),
        sentiment.most_positive(scored, top, ties),
        sentiment.most_negative(scored, top, ties),
    )


def news_handler(
    lexicon: DataFrame | sentiment.Scorer, log: VersionedLog, report: Callable[[NewsResult, int], None] | None = None,
    extra: Sequence[str] = (),
) -> Callable[[DataFrame, int], None]:
    """Score a batch of articles and append it to the sentiment log; the lexicon is read once, not per batch."""
    known = sentiment.scorer(lexicon)

    def handle(rows: DataFrame, batch_id: int) -> None:
        result = news_result(rows, known)
        scored = result.scored.persist()
        try:
            log.append(upsert.sentiment_rows(scored, extra=extra), batch_id)
            if report:
                report(result, batch_id)
        finally:
            scored.unpersist()

    return handle


@dataclass(frozen=True)
class StockResult:
    scored: DataFrame
    latest: DataFrame
    errors: DataFrame
    rmse: DataFrame


def stock_result(scored: DataFrame, ts: str = "timestamp", ties: Sequence[str] = ("symbol",)) -> StockResult:
    return StockResult(
        scored,
        forecast.latest_predictions(scored, ts=ts, ties=ties),
        forecast.error_statistics(scored),
        forecast.rmse(scored),
    )


def scoring_handler(
    model: PipelineModel, log: VersionedLog, ts: str = "timestamp", ties: Sequence[str] = (),
    report: Callable[[StockResult, int], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Score a batch of feature rows with a trained model and append it to the prediction log."""

    def handle(rows: DataFrame, batch_id: int) -> None:
        scored = forecast.score(model, rows).persist()
        try:
            log.append(upsert.prediction_rows(scored, ts), batch_id)
            if report:
                report(stock_result(scored, ts, ("symbol", *ties)), batch_id)
        finally:
            scored.unpersist()

    return handle


def training_handler(
    log: VersionedLog, ts: str = "timestamp", ties: Sequence[str] = (), trees: int = forecast.TREES,
    depth: int = forecast.DEPTH, report: Callable[[StockResult, int], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Train on each batch of bars alone and append the scored held-out rows.

    Batches below the training gate write nothing. Training anew for every
    batch is costly; prefer a trained model and :func:`scoring_handler`.
    """

    def handle(rows: DataFrame, batch_id: int) -> None:
        table = features.feature_table(rows, ts, ties).persist()
        try:
            scored = forecast.train_and_score(table, ts, ties, trees=trees, depth=depth)
            if scored is None:
                return
            log.append(upsert.prediction_rows(scored, ts), batch_id)
            if report:
                report(stock_result(scored, ts, ("symbol", *ties)), batch_id)
        finally:
            table.unpersist()

    return handle


def partial_handler(
    log: VersionedLog, ts: str = "timestamp", first_batch: int = 0
) -> Callable[[DataFrame, int], None]:
    """Append predictions that come from files and carry no volume.

    ``first_batch`` puts this stream's batches behind those that another writer
    left in the log.
    """

    def handle(rows: DataFrame, batch_id: int) -> None:
        log.append(upsert.prediction_file_rows(rows, ts), first_batch + batch_id)

    return handle
