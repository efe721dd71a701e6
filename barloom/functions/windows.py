"""Window expressions over one security's bars in order of date."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, TIME = "security_code", "date"


def ordered(*key: str):
    return Window.partitionBy(*(key or (KEY,))).orderBy(TIME)


def rows(a: int, b: int, *key: str):
    return ordered(*key).rowsBetween(a, b)


def over(a: int | None, b: int, *key: str, order: str = TIME) -> str:
    """The window of rows a (None: the first) to b as SQL text."""
    at = lambda n: "UNBOUNDED PRECEDING" if n is None else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}" if n else "CURRENT ROW"
    by = ", ".join(f"`{k}`" for k in key or (KEY,))
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {at(a)} AND {at(b)})"


def before(x: str, n: int = 1, *key: str, order: str = TIME) -> str:
    """The value n rows before as SQL text."""
    return f"lag({x}, {n}) OVER (PARTITION BY {', '.join(f'`{k}`' for k in key or (KEY,))} ORDER BY {order})"


def so_far(*key: str):
    return ordered(*key).rowsBetween(Window.unboundedPreceding, 0)


def full(agg, x: Column, a: int, b: int, need: int | None = None, *key: str) -> Column:
    """agg(x) over rows a..b, NULL unless `need` (all by default) of them have a value."""
    w = rows(a, b, *key)
    return F.when(F.count(x).over(w) >= (b - a + 1 if need is None else need), agg(x).over(w))


def back(x: Column, n: int = 1, *key: str) -> Column:
    return F.lag(x, n).over(ordered(*key))


def sma(x: Column, n: int, *key: str) -> Column:
    return full(F.avg, x, -(n - 1), 0, None, *key)


def change(x: Column, n: int, *key: str) -> Column:
    """Percent change over n rows."""
    return (x / back(x, n, *key) - 1) * 100


def recent(flag: Column, n: int, *key: str) -> Column:
    """Whether the flag held in one of the last n rows."""
    return F.coalesce(F.max(flag).over(rows(-(n - 1), 0, *key)), F.lit(False))


def crossed_above(p: Column, level: Column, n: int, *key: str) -> Column:
    cross = (p > level) & (back(p, 1, *key) <= back(level, 1, *key))
    return recent(F.coalesce(cross, F.lit(False)), n, *key)


#: name -> (input, smoothing factor, rows needed)
Smooth = dict[str, tuple[Column, float, int]]


#: A block spans so many rows that an average decays to e^-SPAN over it.
SPAN = 300.0


#: The order of rows that are dealt into blocks: that of their dates. One sort by it serves windows over a series and over a block.
DEALT = f"__block, {TIME}"


def block_size(*alphas: float) -> int:
    """How many rows a block may have for averages with these smoothing factors."""
    return max(1, int(SPAN / -math.log1p(-max(alphas))))


def dealt(df: DataFrame, size: int, *key: str) -> DataFrame:
    """df with __row, counted from 0 in each series, and __block, the block of `size` rows it lies in."""
    return df.selectExpr("*", f"row_number() {over(None, 0, *key)} - 1 AS __row").selectExpr("*", f"floor(__row / {size}) AS __block")


def smoothed(df: DataFrame, specs: Smooth, *key: str, blocks: int | None = None) -> DataFrame:
    """Adds recursive exponential averages, seeded by the first value, of series of any length, in window sums.

    With p_i the product of the decays so far, y_i = p_i * sum of b_k * x_k / p_k. That sum is taken within blocks of
    rows, over which p stays between e^-600 and 1, and the end of the block before is carried over with its decay; what
    lies before that block has decayed to nothing. A NULL leaves the average as it is; the next value after g - 1 of
    them weighs alpha against (1 - alpha)^g. Averages start at the `need`-th value. Exact to double precision where a
    fifth of each block's rows have values. Rows already dealt into `blocks` of that many rows keep their blocks and order;
    averages that such blocks don't suit take their own.
    """
    todo = dict(specs)
    if blocks:
        suits = lambda a: -SPAN <= math.log1p(-a) * blocks <= -SPAN / 4
        now = {n: x for n, x in todo.items() if suits(x[1])}
        todo = {n: x for n, x in todo.items() if n not in now}
        df = _smoothed(df, now, blocks, *key) if now else df
        df = df.withColumnsRenamed({"__row": "__outer_row", "__block": "__outer_block"}) if todo else df
    own = bool(todo)
    while todo:
        size = block_size(*(a for _, a, _ in todo.values()))
        now = {n: x for n, x in todo.items() if math.log1p(-x[1]) * size <= -SPAN / 4}
        df = _smoothed(dealt(df, size, *key), now, size, *key).drop("__row", "__block")
        todo = {n: x for n, x in todo.items() if n not in now}
    return df.withColumnsRenamed({"__outer_row": "__row", "__outer_block": "__block"}) if blocks and own else df


def _smoothed(df: DataFrame, specs: Smooth, size: int, *key: str) -> DataFrame:
    """One round of smoothed() over dealt rows, as SQL text: a text is one call to the JVM, a column one for each operator in it."""
    all_, earlier, inside = over(None, 0, *key, order=DEALT), over(None, -1, *key, order=DEALT), over(None, 0, *(key or (KEY,)), "__block")
    c = lambda p, n: f"`__{p}_{n}`"
    add = lambda df, p, text: df.selectExpr("*", *[f"{text(n)} AS {c(p, n)}" for n in specs])
    columns = df.columns
    df = df.withColumns({f"__x_{n}": x for n, (x, _, _) in specs.items()})
    df = add(df, "l", lambda n: f"max(CASE WHEN {c('x', n)} IS NOT NULL THEN __row END) {earlier}")
    df = add(df, "n", lambda n: f"count({c('x', n)}) {all_}")
    df = add(df, "o", lambda n: f"pow({1 - specs[n][1]!r}D, __row - {c('l', n)})")
    df = add(df, "d", lambda n: f"CASE WHEN {c('x', n)} IS NOT NULL AND {c('l', n)} IS NOT NULL THEN greatest(ln({c('o', n)}) - ln({c('o', n)} + {specs[n][1]!r}D), {-SPAN!r}D) ELSE 0.0D END")
    df = add(df, "v", lambda n: f"CASE WHEN {c('l', n)} IS NULL THEN {c('x', n)} ELSE {c('x', n)} * {specs[n][1]!r}D / ({c('o', n)} + {specs[n][1]!r}D) END")
    df = add(df, "p", lambda n: f"sum({c('d', n)}) {inside}")
    df = add(df, "y", lambda n: f"exp({c('p', n)}) * coalesce(sum({c('v', n)} * exp(-{c('p', n)})) {inside}, 0.0D)")
    df = add(df, "e", lambda n: f"last(CASE WHEN __row % {size} = {size - 1} THEN {c('y', n)} END, true) {earlier}")
    out = {n: f"CASE WHEN {c('n', n)} >= {need} THEN {c('y', n)} + exp({c('p', n)}) * coalesce({c('e', n)}, 0.0D) END AS `{n}`" for n, (_, _, need) in specs.items()}
    made = {*specs, *[f"__{p}_{n}" for p in "xlnodvpye" for n in specs]}
    return df.selectExpr(*[f"`{k}`" for k in columns if k not in made], *out.values())


def wilder(x: Column, n: int) -> tuple[Column, float, int]:
    return x, 1 / n, n


def ema(x: Column, span: int) -> tuple[Column, float, int]:
    return x, 2 / (span + 1), span
