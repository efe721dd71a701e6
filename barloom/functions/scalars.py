"""Scalar expressions: clamps, name keys, exchange suffixes, text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name keys leave out.
SUFFIX_WORDS = ("LIMITED", "LTD", "LTD.", "LIMITE", "PVT", "PRIVATE", "CO", "COMPANY", "INDUSTRIES", "INDIA", "AND", "&")


def clip(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    """x within lo..hi; NULL gives 0."""
    return F.coalesce(F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))), F.lit(0.0))


def linear(x: Column, x0: float, x1: float, y0: float = 0.0, y1: float = 100.0) -> Column:
    """x from x0..x1 onto y0..y1, clamped; NULL gives 0."""
    if x0 == x1:
        return F.when(x.isNull(), 0.0).otherwise(float(y0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - x0) / (x1 - x0)))
    return F.when(x.isNull(), 0.0).otherwise(y0 + t * (y1 - y0))


def half_away(x: Column, digits: int) -> Column:
    """x rounded as SQL engines round doubles: x * 10^digits to the nearest whole number, halves away from zero. Spark's own
    `round` looks at the decimal text: 63.949999999999996 is 63.9 there, but ten times it is 639.5, which gives 64.0."""
    t = F.abs(x) * 10.0**digits
    whole = F.rint(t) + F.when(t - F.rint(t) == 0.5, 1.0).otherwise(0.0)
    return F.when(t < float("inf"), F.signum(x) * whole / 10.0**digits + 0.0).otherwise(x)


def printed(text: str, *values: Column) -> Column:
    """format_string whose `%.0f` and `%.1f` round what the double is, halves to even, as C's printf does; Java's rounds its
    decimal text, halves up, so that 2.25 would be 2.3 and 82.5 would be 83."""
    kinds = re.findall(r"%(?:\.([01])f|(%))", text)
    places = [d for d, percent in kinds if not percent]
    if len(places) != len(values):
        raise ValueError(f"{text!r} needs {len(places)} values")
    return F.format_string(text, *[F.rint(v) if d == "0" else _tenths(v) for d, v in zip(places, values, strict=True)])


def _tenths(x: Column) -> Column:
    """The tenth nearest to the double x, of two the even one. With k tenths below |x|, 20 |x| is compared with 2k + 1 in two
    parts that are exact: 4 |x|, and the rest to 16 |x|."""
    a = F.abs(x)
    t = a * 10.0
    k = F.rint(t) - F.when(F.rint(t) > t, 1.0).otherwise(0.0)
    rest, part = 2 * k + 1 - a * 16.0, a * 4.0
    up = F.when((part > rest) | ((part == rest) & (k % 2 == 1)), 1.0).otherwise(0.0)
    return F.when(a < 2.0**48, F.when(x < 0, -1.0).otherwise(1.0) * ((k + up) / 10.0)).otherwise(x)


def name_key(name: Column) -> Column:
    """Upper-case words of a company name, runs of initials joined, without suffix words; NULL gives ''."""
    clean = F.trim(F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9& ]", " ")), " +", " "))
    joined = F.regexp_replace(clean, "(?<=(?:^| )[^& ]) (?=[^& ](?: |$))", "")
    return F.array_join(F.filter(F.split(joined, " "), lambda w: ~w.isin(*SUFFIX_WORDS) & (w != "")), " ")


def token_prefix(a: Column, b: Column) -> Column:
    """Whether the words of one key begin those of the other, two words at least."""
    x, y = F.split(a, " "), F.split(b, " ")
    n = F.least(F.size(x), F.size(y))
    return (n >= 2) & (F.slice(x, 1, n) == F.slice(y, 1, n))


def slug(x: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))


def cut(x: Column, n: int = 32) -> Column:
    """At most n characters; NULL as empty."""
    return F.substring(F.coalesce(x, F.lit("")), 1, n)


def quote_symbol(symbol: Column, exchange: Column) -> Column:
    """The quote service's symbol: .NS for NSE and by default, .BO for BSE."""
    return F.concat(symbol, F.when(exchange == "BSE", ".BO").otherwise(".NS"))


def picked(*pairs: tuple[Column, str], sep: str = ", ") -> Column:
    """The texts whose condition holds, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs])), sep)
