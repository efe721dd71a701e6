"""Reversal candles: predicates on a bar and the one or two before it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.windows import back



def shape() -> tuple[Column, Column, Column]:
    """Body, upper and lower shadow."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return F.abs(F.col("close") - F.col("open")), F.col("high") - top, bottom - F.col("low")


def _ago(n: int = 0) -> tuple[Column, Column]:
    """Open and close n bars ago."""
    return tuple(back(F.col(x), n) if n else F.col(x) for x in ("open", "close"))


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def bearish_engulfing() -> Column:
    (o, c), (o1, c1) = _ago(), _ago(1)
    return _sure((c1 > o1) & (c < o) & (o >= c1) & (c <= o1))


def bullish_engulfing() -> Column:
    (o, c), (o1, c1) = _ago(), _ago(1)
    return _sure((c1 < o1) & (c > o) & (o <= c1) & (c >= o1))


def shooting_star() -> Column:
    body, upper, lower = shape()
    return _sure((upper >= 2 * body) & (lower <= body) & (body > 0))


def hammer() -> Column:
    body, upper, lower = shape()
    return _sure((lower >= 2 * body) & (upper <= body) & (body > 0))


def evening_star() -> Column:
    (o, c), (o1, c1), (o2, c2) = _ago(), _ago(1), _ago(2)
    return _sure((c2 - o2 > 0) & (F.abs(c1 - o1) <= 0.3 * (c2 - o2)) & (c < o) & (c < (o2 + c2) / 2))


def morning_star() -> Column:
    (o, c), (o1, c1), (o2, c2) = _ago(), _ago(1), _ago(2)
    return _sure((o2 - c2 > 0) & (F.abs(c1 - o1) <= 0.3 * (o2 - c2)) & (c > o) & (c > (o2 + c2) / 2))


BEARISH = {"bearish_engulfing": bearish_engulfing, "evening_star": evening_star, "shooting_star": shooting_star}
BULLISH = {"bullish_engulfing": bullish_engulfing, "morning_star": morning_star, "hammer": hammer}
