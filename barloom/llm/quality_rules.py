"""Quality rules: learned decision lists over text statistics, in DataFrame operations only.

`features` counts words, symbols, repeated lines and repeated windows of whole texts with built-in
functions, row by row and without a shuffle. `learn` joins them with labels, bins each feature at
quantiles and counts (cell, label) pairs: the labelled statistics. On these counts the driver grows
conjunctions of thresholds by FOIL gain on two thirds of the rows, prunes them on the last third and
removes what they cover, until a rule is no longer worth it. `DecisionList.verdict` is an ordered
F.when(rule, verdict) chain.

Bound: rules are fitted on at most about `max_rows` labelled rows (default 40,000), chosen by a hash of
doc_id; every count and verdict covers all rows.

Windows are compared by 64-bit hashes within one text.

Defined results: null and blank texts have no words and fail the base rule; labels without a document
and null labels are ignored, as are doc_ids that are null; repeated labels of one doc_id count once (the
best); with no labels the list is empty and only the base rule decides; repeated rows are judged one by
one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm._store import cut, even

SPACES = r"[\\x20\\x09-\\x0D]+"
WINDOW = 5
MAX_ROWS = 40_000
BINS = 16
MAX_TERMS = 4
MAX_RULES = 12
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "same_share", "upper_share", "bang_share")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words() -> str:
    """Words in windows found twice or more: __s is the sorted array of (hash, start), made only where hashes repeat."""
    marked = "transform(filter(transform(__s, (x, k) -> named_struct('i', x.i, 'r', x.h <=> get(__s, k - 1).h OR x.h <=> get(__s, k + 1).h)), x -> x.r), x -> x.i)"
    return f"sort_array({marked})"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, and the features the rules may use."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("__t"))
    bare = "__t"
    for c in (r"' '", r"'\t'", r"'\n'", r"'\u000b'", r"'\u000c'", r"'\r'"):
        bare = f"replace({bare}, {c}, '')"
    d = d.select(
        "doc_id",
        "__t",
        F.expr(f"array_remove(split(__t, '{SPACES}'), '')").alias("__w"),
        F.expr(f"length({bare})").cast("long").alias("word_chars"),
        F.expr("filter(split(__t, '\\n'), l -> rlike(l, '[^\\\\x20\\\\x09-\\\\x0D]'))").alias("__l"),
        F.expr("regexp_count(__t, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.expr("regexp_count(__t, '[A-Z]')").cast("long").alias("__upper"),
        F.expr("octet_length(__t) - octet_length(replace(__t, '!', ''))").cast("long").alias("__bang"),
    )
    d = d.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        "__upper",
        "__bang",
        F.size("__w").cast("long").alias("n_words"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("__lines"),
        F.expr("transform(__w, x -> xxhash64(x))").alias("__h"),
    )
    each = ", ".join(f"__h[i + {k}]" for k in range(WINDOW))
    d = d.withColumn("__x", F.expr(f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(0, CAST(n_words AS INT) - {WINDOW}), i -> xxhash64({each})) ELSE array(CAST(NULL AS BIGINT)) END"))
    d = d.withColumn("__same", F.expr("size(filter(transform(__h, (x, k) -> x <=> get(__h, k - 1)), x -> x))").cast("long")).drop("__h")
    d = d.withColumn("__s", F.expr("CASE WHEN size(array_distinct(__x)) < size(__x) THEN sort_array(transform(__x, (h, i) -> named_struct('h', h, 'i', i))) END")).drop("__x")
    d = d.withColumn("__p", F.expr(_repeat_words())).drop("__s")
    d = d.withColumn("n_repeat_words", F.expr(f"coalesce(aggregate(transform(__p, (x, k) -> least({WINDOW}, coalesce(get(__p, k + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x), 0L)"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return d.select(
        "doc_id",
        *BASE,
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "__lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("__same", "n_words").alias("same_share"),
        share("__upper", "word_chars").alias("upper_share"),
        share("__bang", "word_chars").alias("bang_share"),
    )


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects the row, and rows that meet none are kept."""

    rules: tuple[tuple[Term, ...], ...] = ()

    def verdict(self) -> Column:
        out = None
        for rule in self.rules:
            cond = rule[0].column()
            for term in rule[1:]:
                cond = cond & term.column()
            out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules)


Cell = tuple[tuple[int, ...], int, int]  # bins, rows to reject, rows to keep


def _count(cells: list[Cell]) -> tuple[int, int]:
    return sum(c[1] for c in cells), sum(c[2] for c in cells)


def _holds(cell: Cell, term: tuple[int, bool, int]) -> bool:
    k, above, cutoff = term
    return (cell[0][k] > cutoff) == above


def _grow(cells: list[Cell], n_features: int) -> list[tuple[int, bool, int]]:
    """Adds the term of the largest FOIL gain until only rows to reject are covered."""
    rule: list[tuple[int, bool, int]] = []
    while len(rule) < MAX_TERMS:
        p0, n0 = _count(cells)
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        before = log2(p0 / (p0 + n0))
        for k in range(n_features):
            hist: dict[int, list[int]] = {}
            for bins, p, n in cells:
                h = hist.setdefault(bins[k], [0, 0])
                h[0] += p
                h[1] += n
            below = [0, 0]
            for b in sorted(hist)[:-1]:
                below = [below[0] + hist[b][0], below[1] + hist[b][1]]
                for above, (p, n) in ((False, below), (True, (p0 - below[0], n0 - below[1]))):
                    if p and (g := p * (log2(p / (p + n)) - before)) > gain:
                        best, gain = (k, above, b), g
        if best is None:
            break
        rule.append(best)
        cells = [c for c in cells if _holds(c, best)]
    return rule


def _prune(rule: list[tuple[int, bool, int]], cells: list[Cell]) -> tuple[list[tuple[int, bool, int]], float, int]:
    """The shortest prefix of the highest precision on the held-out third: (prefix, precision, rows to reject covered)."""
    best, worth, covered, held = rule, -1.0, 0, cells
    for k, term in enumerate(rule):
        held = [c for c in held if _holds(c, term)]
        p, n = _count(held)
        value = (p + 1) / (p + n + 2) if p + n else 0.0
        if value > worth + 1e-9:
            best, worth, covered = rule[: k + 1], value, p
    return best, worth, covered


def _relax(rule: list[tuple[int, bool, int]], cells: list[Cell]) -> list[tuple[int, bool, int]]:
    """Moves each threshold half way into the gap that costs under 1 % of the rows to reject, so that rows near the rest are kept."""
    out = list(rule)
    for at, (k, above, cutoff) in enumerate(out):
        inside = [c for c in cells if all(_holds(c, t) for t in out)]
        most = 0.99 * _count(inside)[0]
        values = sorted({c[0][k] for c in inside})
        last = cutoff
        for b in values if above else reversed(values):
            if sum(c[1] for c in inside if (c[0][k] > b) == above) >= most:
                last = b
        out[at] = (k, above, (cutoff + last) // 2 if above else -(-(cutoff + last) // 2))
    return out


def cover(grow: list[Cell], prune: list[Cell], n_features: int, min_precision: float = 0.8, min_rows: int = 2) -> list[list[tuple[int, bool, int]]]:
    """Sequential covering over cells of counts."""
    rules = []
    while len(rules) < MAX_RULES and _count(grow)[0]:
        rule = _grow(grow, n_features)
        if not rule:
            break
        rule, precision, covered = _prune(rule, prune)
        inside = [c for c in grow if all(_holds(c, t) for t in rule)]
        p, n = _count(inside)
        if precision < min_precision or covered < min_rows or p / max(1, p + n) < min_precision:
            break
        rule = _relax(rule, grow)
        rules.append(rule)
        grow, prune = ([c for c in cells if not all(_holds(c, t) for t in rule)] for cells in (grow, prune))
    return rules


def learn(rows: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, bins: int = BINS) -> DecisionList:
    """A decision list from feature rows and labels (1: keep, 0: reject)."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("__label"))
    total = known.count()
    if not total:
        return DecisionList()
    share = min(1.0, max_rows / total)
    some = known.filter(even("doc_id") <= share)
    labelled = cut(rows.join(some, "doc_id").select("doc_id", "__label", *[F.col(f).cast("double").alias(f) for f in FEATURES]))
    grid = [k / bins for k in range(1, bins)] + [0.005, 0.01, 0.02, 0.98, 0.99, 0.995]
    cuts = labelled.agg(*[F.percentile_approx(f, F.array(*[F.lit(x) for x in sorted(grid)]), F.lit(10_000)).alias(f) for f in FEATURES]).first()
    steps = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    cell = [F.lit(0) if not steps[f] else sum((F.when(F.col(f) > F.lit(x), 1).otherwise(0) for x in steps[f]), F.lit(0)) for f in FEATURES]
    held = F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0
    counts = labelled.groupBy(held.alias("held"), *[c.cast("int").alias(f"b{k}") for k, c in enumerate(cell)]).agg(F.count_if(F.col("__label") < 1).alias("p"), F.count_if(F.col("__label") >= 1).alias("n")).collect()
    sides: dict[bool, list[Cell]] = {False: [], True: []}
    for r in counts:
        sides[r.held].append((tuple(r[f"b{k}"] for k in range(len(FEATURES))), r.p, r.n))
    rules = cover(sides[False], sides[True], len(FEATURES))
    return DecisionList(tuple(tuple(Term(FEATURES[k], above, float(steps[FEATURES[k]][b] if b < len(steps[FEATURES[k]]) else steps[FEATURES[k]][-1])) for k, above, b in rule) for rule in rules))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, base counts, base_failed, kept."""
    rows = cut(features(docs))
    rules = learn(rows, labels)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & rules.verdict()).alias("kept"))
