"""Values with an error lane: a function that can fail gives a Checked pair of columns instead of raising."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error codes.
NULL, DIV0, VALUE, REF, NAME, NUM, NA, CIRC = "#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#CIRC!"
EPOCH = "1899-12-30"
NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def no_error() -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Checked:
    """A value and, where it failed, the code of the first error; the value is null then."""

    value: Column
    error: Column

    @staticmethod
    def of(value: Column, *failures: tuple[Column, str]) -> Checked:
        """The value, unless a condition holds: then that condition's code, first come first."""
        error = no_error()
        for when, code in reversed(failures):
            error = F.when(when, code).otherwise(error)
        return Checked(F.when(error.isNull(), value), error)

    def then(self, make) -> Checked:
        out = make(self.value)
        out = out if isinstance(out, Checked) else Checked(out, no_error())
        error = F.coalesce(self.error, out.error)
        return Checked(F.when(error.isNull(), out.value), error)

    def struct(self) -> Column:
        return F.struct(self.value.alias("value"), self.error.alias("error"))


def iferror(x: Checked, other: Column) -> Column:
    return F.when(x.error.isNotNull(), other).otherwise(x.value)


def ifna(x: Checked, other: Column) -> Checked:
    missing = x.error.eqNullSafe(F.lit(NA))
    return Checked(F.when(missing, other).otherwise(x.value), F.when(~missing, x.error))


def iserror(x: Checked) -> Column:
    return x.error.isNotNull()


def isna(x: Checked) -> Column:
    return x.error.eqNullSafe(F.lit(NA))


def iserr(x: Checked) -> Column:
    return x.error.isNotNull() & ~isna(x)


def to_number(text: Column) -> Checked:
    """Text as a number: commas go, a trailing % divides by 100, empty text is 0, other text is an error."""
    clean = F.trim(F.replace(text, F.lit(","), F.lit("")))
    share = clean.endswith("%")
    body = F.when(share, F.regexp_replace(clean, "%$", "")).otherwise(clean)
    number = F.when(clean == "", F.lit(0.0)).when(body.rlike(NUMERIC), body.try_cast("double") / F.when(share, 100.0).otherwise(1.0))
    return Checked.of(number, (number.isNull(), VALUE))


def general(x: Column) -> Column:
    """A number as text: whole numbers below 1e15 without a point, others with 15 digits at most."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, F.format_string("%.0f", x)).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.10f", x), "0+$", ""), r"\.$", ""))


def values_equal(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Numbers within the tolerance of the larger of 1 and both sizes; null (blank) counts as 0."""
    a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def sort_key(number: Column, text: Column, flag: Column) -> Column:
    """The order of mixed values: numbers, then texts without case, then FALSE and TRUE; blanks count as 0."""
    rank = F.when(flag.isNotNull(), 2).when(text.isNotNull(), 1).otherwise(0)
    return F.struct(rank.alias("rank"), F.coalesce(number, F.lit(0.0)).alias("n"), F.upper(text).alias("s"), flag.alias("b"))


def serial(day: Column) -> Column:
    """Days since 1899-12-30, the serial number of a date; before 1 March 1900 one less."""
    n = F.date_diff(F.to_date(day), F.to_date(F.lit(EPOCH)))
    return F.when(n < 61, n - 1).otherwise(n).cast("double")


def from_serial(n: Column) -> Column:
    return F.date_add(F.to_date(F.lit(EPOCH)), F.when(n < 60, F.floor(n) + 1).otherwise(F.floor(n)).cast("int"))
