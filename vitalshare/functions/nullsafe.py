"""Column helpers with exact NULL behaviour, all on built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalshare.domain import UNKNOWN
from vitalshare.functions.exact import exact_sum

# How the age text of a record maps onto an age group before banding (fixed values).
AGE_TEXT = {
    "MENOR 1 ANO IGN": "Post Neonatal",
    "0 A 6 DIAS": "Early Neonatal",
    "7 A 27 DIAS": "Late Neonatal",
    "28 A 364 DIAS": "Post Neonatal",
    "1 ANO": "1 ANOS",
}
SEX_CODES = {"1": "Masculino", "2": "Feminino", "0": UNKNOWN, "9": UNKNOWN}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_list(c, values) -> Column:
    """Membership that is never NULL."""
    return F.coalesce(_col(c).isin(*values), F.lit(False)) if values else F.lit(False)


def not_in_list(c, values) -> Column:
    return ~in_list(c, values)


def recode(c, mapping: dict[str, str]) -> Column:
    """Replace listed values, pass every other value through."""
    c = _col(c)
    out = reduce(
        lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1])),
        list(mapping.items())[1:],
        F.when(c == next(iter(mapping)), F.lit(next(iter(mapping.values())))),
    )
    return out.otherwise(c)


def pad3(c) -> Column:
    """Left-pad with zeros to 3 without cutting longer text."""
    c = _col(c)
    return F.when(F.length(c) < 3, F.lpad(c, 3, "0")).otherwise(c)


def age_band(years) -> Column:
    """Five-year band of an age, 90 and over together, as whole-number text."""
    lower = F.floor(_col(years) / F.lit(5)) * F.lit(5)
    return F.when(_col(years).isNotNull(), F.least(lower, F.lit(90)).cast("string"))


def standardise_age(text) -> Column:
    """Age text -> neonatal group or five-year band; NULL when it cannot be read."""
    age = recode(text, AGE_TEXT)
    # Dropping the last 5 characters takes " ANOS" off.
    years = F.left(age, F.length(age) - 5).try_cast("double")
    return F.when(age.rlike(r"^\d"), age_band(years)).otherwise(age)


def decimal_comma(c) -> Column:
    """First comma becomes a point, then a number; NULL if it is none."""
    return F.regexp_replace(_col(c), r"^([^,]*),", r"$1.").try_cast("double")


def share(part, total) -> Column:
    """part / total, NULL when the total is 0 or missing; never NaN."""
    return F.try_divide(_col(part), _col(total))


def total(c) -> Column:
    """Sum that ignores NULL and is 0 when nothing is left, the same in any order of rows."""
    return F.coalesce(exact_sum(_col(c).cast("double")), F.lit(0.0))


def strict_total(c) -> Column:
    """Sum that is NULL as soon as one addend is NULL."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def stable_round(c, digits: int = 6) -> Column:
    """Round for publication; the nudge keeps exact ties from flipping."""
    return F.round(_col(c) + F.lit(1e-9), digits)


def left_join(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key; right keys are dropped."""
    tagged = right.selectExpr(
        *[f"`{k}` AS `__right_{k}`" for k in keys],
        *[f"`{c}`" for c in right.columns if c not in keys],
    )
    on = F.expr(" AND ".join(f"`{k}` <=> `__right_{k}`" for k in keys))
    joined = left.join(tagged, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"__right_{k}" for k in keys])
