"""Scalar worksheet functions: logic, rounding, text, dates and annuities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafcalc.functions.values import DIV0, NA, NUM, VALUE, Checked, to_number


# --- logic ----------------------------------------------------------------------------------------
def ifs(*pairs: tuple[Column, Column]) -> Checked:
    out, any_ = F.when(pairs[0][0], pairs[0][1]), pairs[0][0]
    for c, v in pairs[1:]:
        out, any_ = out.when(c, v), any_ | c
    return Checked.of(out, (~F.coalesce(any_, F.lit(False)), NA))


def switch(value: Column, *pairs: tuple[Column, Column], default: Column | None = None) -> Checked:
    out = ifs(*[(value.eqNullSafe(k), v) for k, v in pairs])
    return out if default is None else Checked(F.coalesce(out.value, default), F.lit(None).cast("string"))


def choose(index: Column, *options: Column) -> Checked:
    i = F.floor(index)
    return Checked.of(F.element_at(F.array(*options), F.greatest(F.lit(1), F.least(F.lit(len(options)), i)).cast("int")), ((i < 1) | (i > len(options)), VALUE))


# --- arithmetic and rounding -------------------------------------------------------------------------
def divide(a: Column, b: Column) -> Checked:
    return Checked.of(F.try_divide(a, b), (b == 0, DIV0))


def power(a: Column, b: Column) -> Checked:
    out = F.pow(a, b)
    return Checked.of(out, ((a == 0) & (b < 0), DIV0), (F.isnan(out) | (F.abs(out) == float("inf")), NUM))


def sqrt(x: Column) -> Checked:
    return Checked.of(F.sqrt(F.greatest(x, F.lit(0.0))), (x < 0, NUM))


def mod(a: Column, b: Column) -> Checked:
    """The sign is the divisor's."""
    return Checked.of(a - b * F.floor(F.try_divide(a, b)), (b == 0, DIV0))


def exact(x: Column) -> Column:
    """The shortest decimal text of a double as a decimal, so that rounding sees the digits that people see."""
    return x.cast("decimal(28,10)")


def scaled(x: Column, digits: int, how) -> Column:
    return F.signum(x) * (how(F.abs(exact(x)) * F.lit(10**digits if digits > 0 else 1) / F.lit(10**-digits if digits < 0 else 1))).cast("double") / (10.0**digits)


def roundup(x: Column, digits: int = 0) -> Column:
    return scaled(x, digits, F.ceil)


def rounddown(x: Column, digits: int = 0) -> Column:
    return scaled(x, digits, F.floor)


def ceiling(x: Column, step: Column) -> Checked:
    return Checked.of(F.when(step == 0, 0.0).otherwise(F.ceil(F.try_divide(x, step) - 1e-12) * step), ((x > 0) & (step < 0), NUM))


def floor(x: Column, step: Column) -> Checked:
    return Checked.of(F.floor(F.try_divide(x, step) + 1e-12) * step, (step == 0, DIV0))


# --- text ------------------------------------------------------------------------------------------
def trim(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def mid(s: Column, start: Column, n: Column) -> Checked:
    return Checked.of(F.substring(s, F.greatest(start, F.lit(1)), n), (start < 1, VALUE))


def substitute(s: Column, old: str, new: str, nth: int | None = None) -> Column:
    if not old:
        return s
    if nth is None:
        return F.replace(s, F.lit(old), F.lit(new))
    parts = F.split(s, "\\Q" + old + "\\E", -1)
    joined = F.concat(F.array_join(F.slice(parts, 1, nth), old), F.lit(new), F.array_join(F.slice(parts, nth + 1, 1_000_000), old))
    return F.when(F.size(parts) > nth, joined).otherwise(s)


def replace_at(s: Column, start: int, n: int, new: str) -> Column:
    return F.overlay(s, F.lit(new), F.lit(start), F.lit(n))


def find(needle: Column, s: Column) -> Checked:
    at = F.position(needle, s)
    return Checked.of(at.cast("double"), (at == 0, VALUE))


def search(needle: Column, s: Column) -> Checked:
    return find(F.lower(needle), F.lower(s))


def value(s: Column) -> Checked:
    return to_number(s)


def text(x: Column, pattern: str) -> Column:
    """Patterns of 0, #, comma, point and %."""
    share = pattern.endswith("%")
    body = pattern.rstrip("%")
    digits = len(body.partition(".")[2])
    n = x * 100 if share else x
    out = F.format_number(F.round(n, digits), digits) if "," in body else F.format_string(f"%.{digits}f", F.round(n, digits))
    return F.concat(out, F.lit("%")) if share else out


def rept(s: Column, n: Column) -> Checked:
    return Checked.of(F.repeat(s, F.greatest(n, F.lit(0))), (n < 0, VALUE))


def proper(s: Column) -> Column:
    """A capital after everything that is not a letter: pieces of letters with their first letter raised."""
    pieces = F.regexp_extract_all(s, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))), "")


# --- dates -----------------------------------------------------------------------------------------
def date(y: Column, m: Column, d: Column) -> Column:
    """Months and days beyond their range roll over."""
    return F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), (m - 1).cast("int")), (d - 1).cast("int"))


def weekday(day: Column, kind: int = 1) -> Column:
    sunday_first = F.dayofweek(day)
    return {2: F.weekday(day) + 1, 3: F.weekday(day)}.get(kind, sunday_first)


def edate(day: Column, months: Column) -> Column:
    return F.add_months(day, months)


def eomonth(day: Column, months: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "MM"), months))


def datedif(start: Column, end: Column, unit: str) -> Checked:
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)
    out = {"D": F.date_diff(end, start), "M": months, "Y": F.floor(months / 12)}.get(unit.upper())
    if out is None:
        return Checked.of(F.lit(None).cast("double"), (F.lit(True), NUM))
    return Checked.of(out.cast("double"), (end < start, NUM))


# --- annuities ---------------------------------------------------------------------------------------
def growth(rate: Column, n: Column) -> Column:
    return F.pow(1 + rate, n)


def pmt(rate: Column, n: Column, pv: Column, fv: Column | float = 0.0, when: int = 0) -> Checked:
    fv = F.lit(fv) if isinstance(fv, (int, float)) else fv
    g = growth(rate, n)
    out = F.when(rate == 0, -F.try_divide(pv + fv, n)).otherwise(-rate * F.try_divide(pv * g + fv, (1 + rate * when) * (g - 1)))
    return Checked.of(out, (n == 0, NUM))


def pv(rate: Column, n: Column, payment: Column, fv: Column | float = 0.0, when: int = 0) -> Column:
    fv = F.lit(fv) if isinstance(fv, (int, float)) else fv
    g = growth(rate, n)
    return F.when(rate == 0, -(fv + payment * n)).otherwise(-(fv + payment * (1 + rate * when) * F.try_divide(g - 1, rate)) / g)


def fv(rate: Column, n: Column, payment: Column, pv: Column | float = 0.0, when: int = 0) -> Column:
    pv = F.lit(pv) if isinstance(pv, (int, float)) else pv
    g = growth(rate, n)
    return F.when(rate == 0, -(pv + payment * n)).otherwise(-(pv * g + payment * (1 + rate * when) * F.try_divide(g - 1, rate)))


def irr(flows: Column, low: float = -0.9999, high: float = 10.0, steps: int = 64) -> Checked:
    """Rate between low and high at which an array of flows is worth 0 today, by halving the bracket, all in the JVM: of two
    halves the one is kept at whose ends the worth differs in sign. Flows of one sign, or worth of one sign at both ends, are #NUM!.
    After 64 halves the bracket is narrower than 1e-18. Worth is nested from the last flow on, one division for each flow."""
    def found(back: Column) -> Column:
        worth = lambda rate: F.aggregate(back, F.lit(0.0), lambda a, v: v + a / (1 + rate))
        at_low, at_high = worth(F.lit(low)), worth(F.lit(high))
        start = F.struct(F.lit(low).alias("from"), F.lit(high).alias("to"), (at_high > 0).alias("rising"))

        def half(span: Column, _: Column) -> Column:
            middle = (span["from"] + span["to"]) / 2
            keep_low = (worth(middle) > 0) == span["rising"]
            return F.struct(F.when(keep_low, span["from"]).otherwise(middle).alias("from"), F.when(keep_low, middle).otherwise(span["to"]).alias("to"), span["rising"].alias("rising"))

        rate = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half, lambda span: (span["from"] + span["to"]) / 2)
        both = F.exists(back, lambda v: v > 0) & F.exists(back, lambda v: v < 0)
        return F.struct(rate.alias("rate"), (~both | (at_low * at_high > 0)).alias("none"))

    # An array of one element, so that the flows are computed once and not in each step.
    got = F.get(F.transform(F.array(F.reverse(flows)), found), F.lit(0))
    return Checked.of(got["rate"], (got["none"], NUM))
