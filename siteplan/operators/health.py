"""Health counts, rates and age-standardised rates with suppression and uncertainty bounds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan.operators import quality


def _numerator(name: str) -> Column:
    value = F.col(name).cast("double")
    bad = F.raise_error(F.lit(f"{name} cannot be negative")).cast("double")
    return F.when(value < 0, bad).otherwise(value)


def _denominator(name: str) -> Column:
    value = F.col(name).cast("double")
    bad = F.raise_error(F.lit(f"{name} must be positive")).cast("double")
    return F.when(value <= 0, bad).otherwise(value)


def _clip01(p: Column) -> Column:
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def _binomial(p: Column, n: Column) -> Column:
    return _clip01(p) * (1 - _clip01(p)) / n


def _finish(
    df: DataFrame, out: str, measure: Column, error: Column, small: Column, markers: Sequence[str], confidence: float | None
) -> DataFrame:
    hidden = F.coalesce(small, F.lit(False))
    if markers:
        hidden = hidden | quality.suppressed(df, markers)
    staged = df.withColumns({"_m": measure, "_se": error})
    staged = staged.withColumn("_hide", hidden | F.col("_m").isNull())
    shown = lambda value: F.when(~F.col("_hide"), value)
    columns = {out: shown(F.col("_m")), f"{out}_suppressed": F.col("_hide")}
    if confidence is not None:
        if not 0 < confidence < 1:
            raise ValueError("confidence must lie between 0 and 1")
        z = NormalDist().inv_cdf((1 + confidence) / 2)
        columns[f"{out}_standard_error"] = shown(F.col("_se"))
        columns[f"{out}_lower"] = shown(F.greatest(F.col("_m") - F.col("_se") * z, F.lit(0.0)))
        columns[f"{out}_upper"] = shown(F.col("_m") + F.col("_se") * z)
    return staged.withColumns(columns).drop("_m", "_se", "_hide")


def health_count(df: DataFrame, numerator: str, out: str = "measure", threshold: float | None = None, suppression: Sequence[str] = (), confidence: float | None = None) -> DataFrame:
    """The count with its Poisson standard error sqrt(n)."""
    n = _numerator(numerator)
    small = n < threshold if threshold is not None else F.lit(False)
    return _finish(df, out, n, F.sqrt(n), small, suppression, confidence)


def health_rate(df: DataFrame, numerator: str, denominator: str, scale: float = 1.0, out: str = "measure", threshold: float | None = None, suppression: Sequence[str] = (), confidence: float | None = None) -> DataFrame:
    """Rate times scale with its binomial standard error."""
    n, d = _numerator(numerator), _denominator(denominator)
    p = n / d
    small = n < threshold if threshold is not None else F.lit(False)
    return _finish(df, out, p * scale, F.sqrt(_binomial(p, d)) * scale, small, suppression, confidence)


def age_standardized_rate(df: DataFrame, strata: Sequence[tuple[str, str, float]], scale: float = 1.0, out: str = "measure", threshold: float | None = None, suppression: Sequence[str] = (), confidence: float | None = None) -> DataFrame:
    """Directly standardised rate; ``strata`` are (numerator, denominator, weight) per age band.

    A missing stratum makes the rate missing; one small stratum suppresses it.
    """
    total = sum(w for _, _, w in strata)
    if total <= 0:
        raise ValueError("standard weights must add up to a positive value")
    rates, variances, smalls = [], [], [F.lit(False)]
    for numerator, denominator, weight in strata:
        n, d, w = _numerator(numerator), _denominator(denominator), weight / total
        p = n / d
        rates.append(p * w)
        variances.append(_binomial(p, d) * (w * w))
        if threshold is not None:
            smalls.append(F.coalesce(n < threshold, F.lit(False)))
    add = lambda a, b: a + b
    measure, variance = reduce(add, rates) * scale, reduce(add, variances)
    small = reduce(lambda a, b: a | b, smalls)
    return _finish(df, out, measure, F.sqrt(variance) * scale, small, suppression, confidence)


def derive_health_measure(df: DataFrame, kind: str, **options) -> DataFrame:
    kinds = {"count": health_count, "rate": health_rate, "age_standardized_rate": age_standardized_rate}
    if kind not in kinds:
        raise ValueError(f"unknown health measure {kind}")
    return kinds[kind](df, **options)
