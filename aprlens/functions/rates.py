"""Rate scaling and labelling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Gap classes, their labels and the band called near realized.
NEAR_GAP = 0.0005
GAP_LABELS = {
    "missing": "Insufficient data",
    "near": "Near realized",
    "above": "Paid more than realized",
    "below": "Received more than paid",
}
GAP_CLASSES = {"near": "neutral", "above": "positive-gap", "below": "negative-gap"}


def percent(rate: Column) -> Column:
    return rate * 100


def basis_points(rate: Column) -> Column:
    return rate * 10000


def funding_bps(apr: Column, settlements_per_day: Column) -> Column:
    """Annual rate to basis points per settlement period; NULL without a positive count of periods."""
    return basis_points(apr) / (F.nullif(settlements_per_day, F.lit(0)) * 365)


def gap_label(gap: Column) -> Column:
    return (
        F.when(gap.isNull(), GAP_LABELS["missing"])
        .when(F.abs(gap) < NEAR_GAP, GAP_LABELS["near"])
        .when(gap > 0, GAP_LABELS["above"])
        .otherwise(GAP_LABELS["below"])
    )


def gap_class(gap: Column) -> Column:
    return (
        F.when(gap.isNull() | (F.abs(gap) < NEAR_GAP), GAP_CLASSES["near"])
        .when(gap > 0, GAP_CLASSES["above"])
        .otherwise(GAP_CLASSES["below"])
    )


def above_diagonal(implied: Column, realized: Column) -> Column:
    return implied > realized


def candle_up(open_: Column, close: Column) -> Column:
    return close >= open_
