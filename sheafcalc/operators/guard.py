"""The number guard: numbers in a text must be backed by evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "[0-9]+(?:\\.[0-9]+)?"


def numbers_in(text: Column) -> Column:
    """All numbers of a text, as doubles."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))


def always_allowed(x: Column) -> Column:
    return x.between(0, 100) & (x == F.floor(x))


def allowed(x: Column, evidence: Column) -> Column:
    """Within a cent or a millionth of a number of the evidence (an array), as it is or rounded to 0, 1 or 2 places."""
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(0.01), F.abs(b) * 1e-6)
    return always_allowed(x) | F.exists(evidence, lambda e: near(x, e) | near(x, F.round(e, 0)) | near(x, F.round(e, 1)) | near(x, F.round(e, 2)) | near(x, e * 100))


def unsupported(text: Column, evidence: Column) -> Column:
    """The numbers of a text that the evidence does not back."""
    return F.filter(numbers_in(text), lambda x: ~allowed(x, evidence))
