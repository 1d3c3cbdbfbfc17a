"""Scalar functions as Spark columns: everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Dist


def logit(x: Column) -> Column:
    """ln(x / (1 - x)); infinite at 0 and 1, null outside."""
    inf = F.lit(float("inf"))
    return F.when(x == 1, inf).when(x == 0, -inf).when((x > 0) & (x < 1), F.ln(x / (1 - x)))


def expit(x: Column) -> Column:
    """1 / (1 + e^-x), without overflow for large |x|."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(F.least(x, F.lit(0.0))) / (1 + F.exp(F.least(x, F.lit(0.0)))))


def odds(x: Column) -> Column:
    """x / (1 - x), infinite at 1; an error outside [0, 1]."""
    wrong = F.raise_error(F.lit("odds() takes probabilities in [0, 1]")).cast("double")
    return F.when((x < 0) | (x > 1), wrong).when(x == 1, F.lit(float("inf"))).otherwise(x / F.when(x == 1, F.lit(None)).otherwise(1 - x))


def link_name(dist: Column) -> Column:
    """Name of a distribution's link function."""
    out = F.lit(None).cast("string")
    for d in Dist:
        out = F.when(dist == d.value, d.link).otherwise(out)
    return out


def split_names(text: Column, *separators: str) -> Column:
    """Parts between any of the separators, without white space; empty parts go."""
    for s in separators[1:]:
        text = F.replace(text, F.lit(s), F.lit(separators[0]))
    parts = F.split(F.regexp_replace(text, r"\s", ""), "\\Q" + separators[0] + "\\E")
    return F.filter(parts, lambda p: p != "")
