"""All registered queries."""

from marketlens.plans import (  # noqa: F401
    change_queries,
    context_queries,
    ingest_queries,
    model_queries,
    news_queries,
    raw_queries,
    serving_queries,
    stream_queries,
    tick_queries,
)
from marketlens.plans.catalog import QUERIES, TWINS  # noqa: F401
