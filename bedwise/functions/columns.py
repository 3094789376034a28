"""Small column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bedwise.settings import DAY_NAMES


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def whole(c: Column, type_: str = "int") -> Column:
    """Truncate toward zero."""
    return c.cast(type_)


def rounded(c: Column, digits: int = 0) -> Column:
    """Round half to even on the scaled double, the rounding of the numeric Python stack."""
    return F.rint(c * F.lit(10.0**digits)) / F.lit(10.0**digits) if digits else F.rint(c)


def rounded_int(c: Column) -> Column:
    return F.rint(c).cast("int")


def lookup(key: Column, mapping: Mapping) -> Column:
    """Literal map lookup; a missing or null key gives null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def pick(values: Sequence, position: Column) -> Column:
    """The ``position``-th (from 1) of a literal list."""
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), position)


def percent_text(ratio: Column) -> Column:
    """``0.857`` -> ``86%``."""
    return F.concat(F.rint(ratio * 100).cast("bigint").cast("string"), F.lit("%"))


def season_of(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isin(9, 10, 11), "autumn")
    )


def day_name_of(dow: Column) -> Column:
    return pick(DAY_NAMES, dow + 1)


def calendar_fields(day: Column) -> dict[str, Column]:
    """Calendar columns of a date. Monday is weekday 0; ``week`` is the ISO week."""
    dow = F.weekday(day)
    return {
        "year": F.year(day),
        "month": F.month(day),
        "day": F.dayofmonth(day),
        "dow": dow,
        "week": F.weekofyear(day),
        "is_weekend": (dow >= 5).cast("int"),
        "day_of_year": F.dayofyear(day),
    }
