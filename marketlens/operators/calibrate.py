"""Scaling of sentiment and least-squares fit of the blend weights."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schemas

_FLAT = 1e-12


def minmax_scaled(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the column scaled to [0, 1]; a constant column stays as it is.

    The bounds enter as a scalar subquery, so rows are neither shuffled nor
    joined. NaN takes no part in the bounds and stays NaN.
    """
    known = _number(column)
    bounds = df.agg(F.struct(F.min(known).alias("lo"), F.max(known).alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    x = F.col(column)
    return df.withColumn(name, F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(x))


def _number(column: str) -> Column:
    """The column as a double; NaN is a missing value."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def fit_blend(
    df: DataFrame, target: str = "price", raw: str = "rawPrediction", sentiment: str = "sentiment"
) -> DataFrame:
    """Weights of ``target ~ alpha * raw + beta * scaled sentiment + intercept``.

    One pass collects the moments; the fit follows from them in closed form,
    see :func:`fit_moments`. Rows with a null or NaN in one of the three
    columns are left out.
    """
    return fit_moments(moments(df, target, raw, sentiment))


def moments(
    df: DataFrame, target: str = "price", raw: str = "rawPrediction", sentiment: str = "sentiment"
) -> DataFrame:
    """One row with all that the fit needs of the rows: ``rows``, means, central sums and the bounds of the sentiment.

    ``caa`` and its like are sums of products of distances from the means.
    Rows with a null or NaN are left out; without any other row ``rows`` is 0
    and the rest null.
    """
    y, a, s = map(_number, (target, raw, sentiment))
    n = F.count(F.lit(1))
    return df.filter(y.isNotNull() & a.isNotNull() & s.isNotNull()).agg(
        n.alias("rows"), n.cast("double").alias("weight"),
        F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(s).alias("ms"),
        (F.var_pop(a) * n).alias("caa"), (F.var_pop(s) * n).alias("css"), (F.covar_pop(a, s) * n).alias("cas"),
        (F.covar_pop(a, y) * n).alias("cay"), (F.covar_pop(s, y) * n).alias("csy"),
        F.min(s).alias("lo"), F.max(s).alias("hi"),
    )


def merge_moments(parts: DataFrame) -> DataFrame:
    """The moments of all rows together, from those of disjoint parts of them.

    Central sums stay central: each part brings its own and the distance of its
    means from the common ones, so large means cancel nothing, however the rows
    are cut. A part counts by its ``weight``. Parts without rows change
    nothing; without parts the result has no rows.
    """
    some = parts.filter((F.col("rows") > 0) & (F.col("weight") > 0))
    total = F.sum("weight")
    means = ("my", "ma", "ms")
    # the mean of all is taken from that of one part, so that its digits are spent on the differences
    near = some.agg(F.struct(*[F.max_by(m, F.struct("weight", m)).alias(m) for m in means])).scalar()
    centre = some.agg(F.struct(*[(F.max(near[m]) + F.sum(F.col("weight") * (F.col(m) - near[m])) / total).alias(m) for m in means])).scalar()
    off = {m[1]: F.col(m) - centre[m] for m in means}

    def central(name: str) -> Column:
        x, y = name[1:]
        return F.sum(F.col(name) + F.col("weight") * off[x] * off[y]).alias(name)

    return some.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"),
        *[F.max(centre[m]).alias(m) for m in means],
        *[central(c) for c in ("caa", "css", "cas", "cay", "csy")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def fit_moments(moments: DataFrame) -> DataFrame:
    """The least-squares weights that follow from a row of :func:`moments`.

    Scaling is linear, so it is applied to the moments instead of the rows.
    When the regressors are collinear, a constant sentiment included, the
    solution of smallest norm is returned. One row, with the bounds ``lo`` and
    ``hi`` that the sentiment was scaled by; none if there were no rows.
    """
    moments = moments.select("rows", "my", "ma", "ms", "lo", "hi",
                             *[(F.col(f"c{v}") / F.col("weight")).alias(f"v{v}") for v in ("aa", "ss", "as", "ay", "sy")])
    varies = F.col("hi") > F.col("lo")
    width = F.when(varies, F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    scaled = moments.select(
        "rows", "my", "ma", "vaa", "vay", "lo", "hi",
        F.when(varies, (F.col("ms") - F.col("lo")) / width).otherwise(F.col("ms")).alias("mb"),
        (F.col("vss") / width / width).alias("vbb"),
        (F.col("vas") / width).alias("vab"),
        (F.col("vsy") / width).alias("vby"),
    )
    det = F.col("vaa") * F.col("vbb") - F.col("vab") * F.col("vab")
    collinear = det <= F.col("vaa") * F.col("vbb") * _FLAT
    trace = F.col("vaa") + F.col("vbb")

    def weight(full, single):
        alone = F.coalesce(F.try_divide(F.col(single), trace), F.lit(0.0))
        return F.when(collinear, alone).otherwise(F.try_divide(full, det))

    alpha = weight(F.col("vay") * F.col("vbb") - F.col("vby") * F.col("vab"), "vay")
    beta = weight(F.col("vby") * F.col("vaa") - F.col("vay") * F.col("vab"), "vby")
    return (
        scaled.filter(F.col("rows") > 0)
        .select("rows", "my", "ma", "mb", "lo", "hi", alpha.alias("alpha"), beta.alias("beta"))
        .select(
            "alpha",
            "beta",
            (F.col("my") - F.col("alpha") * F.col("ma") - F.col("beta") * F.col("mb")).alias("intercept"),
            "rows",
            "lo",
            "hi",
        )
    )


def write_fit(fit: DataFrame, path: str) -> None:
    """Store a fit as a table of one row, in place of an earlier one."""
    fit.coalesce(1).write.mode("overwrite").parquet(path)


def read_fit(spark: SparkSession, path: str) -> DataFrame:
    """The fit that :func:`write_fit` stored, to the last digit."""
    return spark.read.schema(schemas.BLEND_FIT).parquet(path)


class MomentLog:
    """Moments of batches of rows, kept so that a fit never reads the rows again.

    Each batch has a folder under its number, replaced as a whole when the
    batch runs again. ``fading`` between 0 and 1 makes a batch count that much
    less with each batch after it; 1 keeps all alike.
    """

    def __init__(self, path: str, fading: float = 1.0):
        if not 0 < fading <= 1:
            raise ValueError("fading has to be above 0 and at most 1")
        self.path, self.fading = path, fading

    def append(
        self, rows: DataFrame, batch_id: int, target: str = "price", raw: str = "rawPrediction", sentiment: str = "sentiment",
    ) -> None:
        found = moments(rows, target, raw, sentiment)
        found.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={int(batch_id)}")

    def parts(self, spark: SparkSession) -> DataFrame:
        """The moments per batch, with the weights of today."""
        try:
            stored = spark.read.schema(f"{schemas.MOMENTS}, batch long").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], f"{schemas.MOMENTS}, batch long")
        if self.fading == 1:
            return stored
        newest = stored.agg(F.max("batch").alias("b")).scalar()
        fade = F.pow(F.lit(self.fading), (newest - F.col("batch")).cast("double"))
        central = [(F.col(c) * fade).alias(c) for c in ("caa", "css", "cas", "cay", "csy")]
        return stored.select("rows", (F.col("weight") * fade).alias("weight"), "my", "ma", "ms", *central, "lo", "hi", "batch")

    def fit(self, spark: SparkSession) -> DataFrame:
        """The fit over all batches, as :func:`fit_blend` gives it over their rows."""
        return fit_moments(merge_moments(self.parts(spark)))
