"""Column expressions. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label borders of the batch job and of the dashboard, and the
# wire format of bar timestamps.
POSITIVE_FROM, NEGATIVE_TO = 0.1, -0.1
GAUGE_POSITIVE_ABOVE, GAUGE_NEGATIVE_BELOW = 0.2, -0.2
GAUGE_WITHOUT_SCORE = 0.5
BAR_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
ISO_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

_LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def clean_text(text: str | Column) -> Column:
    """Runs of white space, Unicode's included, become one blank, ends are trimmed, letters lowered."""
    return F.lower(F.trim(F.regexp_replace(col(text), r"(?U)[\s\x1c-\x1f]+", " ")))


def percent_error(prediction: str | Column, actual: str | Column) -> Column:
    """Absolute error in percent of the actual value; null where that is 0."""
    p, a = col(prediction), col(actual)
    return F.try_divide(F.abs(p - a), a) * 100


def number_or_zero(value: str | Column) -> Column:
    """Null and NaN become 0."""
    return F.coalesce(F.nanvl(col(value).cast("double"), F.lit(None)), F.lit(0.0))


def parse_double(text: str | Column, prefix: bool = False) -> Column:
    """Text as a number, 0 where it is none. ``prefix`` reads ``12abc`` as 12."""
    raw = col(text)
    if prefix:
        raw = F.regexp_extract(raw, _LEADING_NUMBER, 1)
    return number_or_zero(raw.try_cast("double"))


def parse_int(text: str | Column, prefix: bool = False) -> Column:
    """Text as a whole number, cut towards zero, 0 where it is none."""
    raw = col(text)
    if prefix:
        raw = F.regexp_extract(raw, _LEADING_NUMBER, 1)
    return F.coalesce(raw.try_cast("double").try_cast("int"), F.lit(0))


def utc_day(ts: str | Column) -> Column:
    """The day of a timestamp as text (the session zone is UTC)."""
    return F.date_format(col(ts), "yyyy-MM-dd")


def subjectivity_weighted(polarity: str | Column, subjectivity: str | Column) -> Column:
    return col(polarity) * (F.lit(0.5) + F.lit(0.5) * col(subjectivity))


def overall_sentiment(title: str | Column, description: str | Column) -> Column:
    """Mean of the two scores; null when either is null."""
    return (col(title) + col(description)) / 2


def sentiment_label(score: str | Column) -> Column:
    """Borders belong to the outer labels; a null score is neutral."""
    s = col(score)
    return (
        F.when(s >= POSITIVE_FROM, "positive").when(s <= NEGATIVE_TO, "negative").otherwise("neutral")
    )


def gauge_label(score: str | Column) -> Column:
    """The dashboard's wider scale, borders belong to ``Neutral``."""
    s = col(score)
    return (
        F.when(s > GAUGE_POSITIVE_ABOVE, "Positive")
        .when(s < GAUGE_NEGATIVE_BELOW, "Negative")
        .otherwise("Neutral")
    )


def gauge_position(score: str | Column) -> Column:
    """A score in [-1, 1] as a position in [0, 1]; the middle without a score.

    A score of -1 sits at 0. The dashboard shows it in the middle, because 0
    is falsy there; that looks like an accident and is not kept.
    """
    s = F.nanvl(col(score).cast("double"), F.lit(None))
    return F.coalesce((s + 1) / 2, F.lit(GAUGE_WITHOUT_SCORE))


def blend_linear(
    raw: str | Column, sentiment: str | Column, raw_weight: float | Column = 1.0,
    sentiment_weight: float | Column = 0.0,
) -> Column:
    """Weighted sum; the default weights leave the raw prediction as it is."""
    def weight(w):
        return w if isinstance(w, Column) else F.lit(float(w))

    return col(raw) * weight(raw_weight) + col(sentiment) * weight(sentiment_weight)


def blend_product(raw: str | Column, sentiment: str | Column, x: Column, y: Column, z: Column) -> Column:
    """Weighted sum with an interaction term."""
    p, s = col(raw), col(sentiment)
    return x * p + y * s + z * (p * s)


def wire_time(ts: str | Column) -> Column:
    return F.date_format(col(ts), BAR_TIME_FORMAT)


def zone_to_utc(ts: str | Column, source_zone: str) -> Column:
    """Wall-clock times of ``source_zone`` as UTC times."""
    return F.to_utc_timestamp(col(ts).cast("timestamp"), source_zone)
