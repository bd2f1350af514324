"""Parsing, rounding and formatting of numbers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"

# Unit marks in measure texts, with the marks of a wrong decoding.
DEFAULT_UNITS = "Ã‚Â°C|Â°C|Ã‚Â°|Â°|°C|°"
UPLOAD_UNITS = "°C|degrees|degree|deg"


def finite(c: Column) -> Column:
    """Null for NaN and infinite values.

    A finite number modulo infinity is itself, an infinite one is NaN. Written this
    way the expression holds ``c`` once; a filter that is pushed through a
    projection would otherwise repeat everything ``c`` is made of.
    """
    return F.nanvl(c.cast("double") % F.lit(float("inf")), F.lit(None).cast("double"))


def parse_number(text: Column) -> Column:
    """Double, or null for anything that is not a finite number."""
    return finite(F.regexp_extract(text, NUMBER, 1).try_cast("double"))


def parse_measure(text: Column, units: str = f"{DEFAULT_UNITS}|degrees|degree|deg") -> Column:
    """A measure with unit marks and thousands commas as a double."""
    return parse_number(F.translate(F.regexp_replace(text, units, ""), ",", ""))


def parse_loose_number(text: Column) -> Column:
    """Read what digits there are, once units are off; scientific notation is kept."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)°|degrees?|deg|c", ""), r"[,\s]", "")
    return F.coalesce(parse_number(bare), parse_number(F.regexp_replace(bare, r"[^0-9.\-]", "")))


def parse_year(text: Column) -> Column:
    """A year as int, cutting off a fraction; null if it is no number or no int."""
    return parse_number(text.cast("string")).try_cast("int")


def rint_to(x: Column, digits: int) -> Column:
    """Array rounding: scale, round half to even, scale back."""
    k = float(10**digits)
    return F.rint(x * k) / k


def round_to(x: Column, digits: int) -> Column:
    """Round the exact binary value to ``digits``, ties to even.

    ``round`` works on the shortest decimal text and sends 16.2375, which lies
    just below the tie in binary, up. The product with 10**digits is therefore
    taken exactly as ``p + err`` (the halves of ``x`` have 26 bits each), and
    ``err`` decides where ``p`` itself looks like a tie.
    """
    k = float(10**digits)
    x = x.cast("double")
    p = x * k
    c = x * 134217729.0
    high = c - (c - x)
    err = (high * k - p) + (x - high) * k
    tie = (p - F.floor(p)) == 0.5
    scaled = (
        F.when(tie & (err < 0), F.floor(p).cast("double"))
        .when(tie & (err > 0), F.ceil(p).cast("double"))
        .otherwise(F.rint(p))
    )
    return scaled / k


def mean(c: Column) -> Column:
    """Sum over count, as double.

    With a decimal input the sum is exact, so the mean does not depend on the
    order in which tasks finish.
    """
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def slope(y: Column, x: Column, digits: int) -> Column:
    """Least-squares slope of ``y`` (``digits`` decimals) on a whole number ``x``; 0 if undefined.

    All sums are whole numbers in decimals, so the result is the exact quotient,
    whatever the order of the rows.
    """
    whole = lambda c, p=38: c.cast(f"decimal({p},0)")
    scaled = whole(y.cast(f"decimal({18 + digits},{digits})") * whole(F.lit(10**digits), digits + 1), 24)
    used = F.when(y.isNotNull(), x.cast("decimal(10,0)"))
    n = whole(F.count(y), 10)
    sum_x, sum_y = whole(F.sum(used), 14), whole(F.sum(scaled), 24)
    top = n * whole(F.sum(scaled * used), 28) - sum_x * sum_y
    bottom = n * whole(F.sum(used * used), 28) - sum_x * sum_x
    return F.when(whole(bottom) > 0, top.cast("double") / (bottom.cast("double") * float(10**digits))).otherwise(0.0)


def exact(c: Column, digits: int = 3) -> Column:
    """A value that was rounded to ``digits`` as the decimal it stands for."""
    return c.cast(f"decimal(28,{digits})")


def fmt_number(c: Column, suffix: str = "", decimals: int = 3) -> Column:
    """Fixed decimals and a unit; null stays null."""
    value = c.cast("double")
    return F.when(
        value.isNotNull() & ~F.isnan(value),
        F.concat(F.format_string(f"%.{decimals}f", round_to(value, decimals)), F.lit(suffix)),
    )


def append_unit(value: Column, unit: str) -> Column:
    """Add the unit unless the text has it already; ``-`` for nothing."""
    text = F.trim(value)
    bare = F.replace(F.lower(text), F.lit(" "))
    return (
        F.when(value.isNull() | text.isin("", "-"), F.lit("-"))
        .when(bare.contains(unit.lower().replace(" ", "")), text)
        .otherwise(F.concat(text, F.lit(unit)))
    )


def display_value(c: Column, dtype: str) -> Column:
    """A cell as shown in a table: grouped whole numbers, three decimals, ``-`` for nothing."""
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        shown = F.format_number(c, 0)
    elif dtype in ("float", "double") or dtype.startswith("decimal"):
        value = c.cast("double")
        shown = F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(
            F.format_string("%.3f", round_to(value, 3))
        )
    else:
        shown = F.nullif(c.cast("string"), F.lit(""))
    return F.coalesce(shown, F.lit("-"))


def value_class(text: Column) -> Column:
    """up / down for change-like texts, hot above 25, cold below 5, else neu."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    first = F.element_at(F.split(t, r"\s+"), 1)
    number = parse_number(F.regexp_replace(first, r"[^0-9.\-]", ""))
    return (
        F.when(number.isNull(), "neu")
        .when(t.rlike("(?i)change|trend|warming|diff"), F.when(number >= 0, "up").otherwise("down"))
        .when(number > 25, "hot")
        .when(number < 5, "cold")
        .otherwise("neu")
    )
