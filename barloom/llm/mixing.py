"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of all documents by weight; a target stops at `most` times its source's words, and the excess
goes to the others by weight until none is above. That level is found in one pass over the sources in order of the
level at which each one fills up.

A source with the target T and S words takes every document floor(T / S) times: certain whole copies. The remaining
R = T - floor(T / S) * S words come from a sample of one more copy with inclusion probabilities by size: they double with
every RISE-th power of two of the length and are in proportion to the length within a power of two, scaled for R words to be
expected. Powers of two whose probability reaches 1 are certain too. Of each other power, documents are ranked by Pareto
order, their random odds u / (1 - u) divided by their inclusion odds p / (1 - p); the sample is the head of that order up
to the words that the power is to give, its fixed size. What all heads leave open goes to the next SPARE documents of each
order, the long ones first, where they fit.
Random numbers are digests of the seed and doc_id, so reruns agree.

Documents are read once, to rows of about 50 bytes. They are sorted by source and rank in ranges, so a source of any
share is spread over as many tasks as its rows need; statistics are pre-aggregated by source and power of two.

Defined results: null text counts as empty; a document without words takes none; a null source is a source of its own,
the last; documents without a doc_id share one random number and are then ranked by a hash of their texts; of rows equal
in all of that any may be taken, which gives the same rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._components import spread_join
from barloom.llm._order import running
from barloom.llm._store import cut

C = F.col
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix"
RISE, SPARE = 3, 16


def _length(words: Column) -> Column:
    """Binary digits of a document's words: 0 for none."""
    return F.when(words > 0, F.length(F.bin(words))).otherwise(0)


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, digits, key (of source and digits), u (random, between 0 and 1), tie, row, as a checkpoint."""
    doc_id, text = C("doc_id").cast("long"), C("text").cast("string")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)
    out = docs.select(doc_id.alias("doc_id"), C("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), u.alias("u"), F.xxhash64(text).alias("tie"))
    out = out.withColumn("digits", _length(C("size"))).withColumn("row", F.monotonically_increasing_id())
    return cut(out.withColumn("key", F.concat(C("digits").cast("string"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, parts: int = 1) -> DataFrame:
    """sources(source, source_size), one row each, with rank (from 1, by code point, null last) and target."""
    placed = running(sources.withColumn("one", F.lit(1)), [C("source").isNull(), C("source")], {"rank": "one"}, parts)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(C("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    placed = placed.withColumns({"weight": weight, "full": C("source_size") * most})
    filled = running(placed, [C("full") / C("weight"), C("rank")], {"fulls": "full", "weighed": "weight"}, parts)
    total, shares = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    left, open_ = F.lit(total) - (C("fulls") - C("full")), F.lit(shares) - (C("weighed") - C("weight"))
    wide = lambda x: x.cast("decimal(19,0)")  # noqa: E731  products of words and weights of all sources
    filled = cut(filled.withColumn("stops", wide(C("full")) * wide(open_) <= wide(left) * wide(C("weight"))))
    gone, kept = filled.agg(F.coalesce(F.sum(F.when(C("stops"), C("full"))), F.lit(0)), F.coalesce(F.sum(F.when(~C("stops"), C("weight"))), F.lit(1))).first()
    target = F.when(C("stops"), C("full").cast("double")).otherwise((wide(F.lit(total - gone)) * wide(C("weight"))).cast("double") / F.lit(kept))
    return filled.select("source", "source_size", "rank", target.alias("target"))


def _chances(lengths: DataFrame, placed: DataFrame) -> DataFrame:
    """lengths(source, digits, key, words, n) with its source's numbers, whole (certain copies), chance (of one more), and
    due (the words that documents drawn from it are to give)."""
    by = Window.partitionBy("rank")
    down, here = by.orderBy(F.desc("digits")), Window.currentRow
    t = lengths.join(placed, lengths["source"].eqNullSafe(placed["source"])).drop(placed["source"])
    t = t.withColumn("whole", F.when(C("source_size") > 0, F.floor(F.try_divide("target", "source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("rest", C("target") - C("whole") * C("source_size"))
    t = t.withColumn("odds", F.when(C("digits") > 0, F.pow(F.lit(2.0), F.floor(C("digits") / RISE))).otherwise(0.0))
    sure = (C("rest") - F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) * C("odds") >= F.sum(C("odds") * C("words")).over(down.rowsBetween(here, Window.unboundedFollowing))
    t = t.withColumn("sure", (C("rest") > 0) & (C("digits") > 0) & sure)
    t = t.withColumn("rest", C("rest") - F.sum(F.when(C("sure"), C("words")).otherwise(0)).over(by))
    chance = F.try_divide(C("rest") * C("odds"), F.sum(F.when(C("sure"), 0.0).otherwise(C("odds") * C("words"))).over(by))
    t = t.withColumn("chance", F.when(C("sure"), 1.0).otherwise(F.coalesce(F.greatest(F.least(chance, F.lit(1.0)), F.lit(0.0)), F.lit(0.0))))
    return t.withColumns({"due": C("chance") * C("words"), "drawn": (C("chance") > 0) & (C("chance") < 1)})


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies * size) of every row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sized(docs, seed)
    lengths = cut(rows.groupBy("source", "digits", "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
    small = max(1, min(parts, lengths.count() >> 16))
    placed = targets(lengths.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most, small)
    table = cut(_chances(lengths, placed))
    # where the drawn documents of each source and length begin in the order of all
    order = [C("rank"), -C("digits")]
    begin = running(table.filter("drawn").select("key", "rank", "digits", "words"), order, {"words_to": "words"}, small).select("key", (C("words_to") - C("words")).alias("words_at"))
    table = table.join(begin, "key", "left").select("key", "n", "rank", "source_size", "target", "whole", "chance", "drawn", "words", C("n").alias("documents"), "due", "words_at")
    known = spread_join(rows.drop("source"), table, "key", "n").drop("key")
    p = F.least(C("chance") * C("size") * C("documents") / C("words"), F.lit(1 - 1e-9))
    pareto = F.try_divide(C("u") * (1 - p), (1 - C("u")) * p)
    known = known.withColumns({"order": F.when(C("drawn"), pareto).otherwise(-1.0), "w": F.when(C("drawn"), C("size")).otherwise(0), "one": F.when(C("drawn"), 1).otherwise(0)})
    known = running(known.drop("documents", "words"), [*order, C("order"), C("doc_id"), C("tie"), C("row")], {"words_to": "w", "place": "one"}, parts)
    known = known.withColumn("in_head", C("drawn") & (C("words_to") - C("words_at") <= C("due")))
    more = _fitting(known.filter("drawn"))
    known = known.withColumn("place", F.when(C("drawn"), C("place")).otherwise(-1 - C("row"))).join(more, "place", "left")
    extra = (C("chance") == 1) | C("in_head") | C("fits").isNotNull()
    known = known.withColumn("copies", F.when(C("size") > 0, C("whole") + extra.cast("long")).otherwise(0))
    return known.select("doc_id", "size", "source_size", "target", "copies", (C("copies") * C("size")).alias("taken"))


def _fitting(drawn: DataFrame) -> DataFrame:
    """(place, fits) of the documents after the heads that take up what a source's heads leave open."""
    next_ = [F.min(F.when(~C("in_head") & (C("place") % SPARE == k), F.struct("place", (-C("size")).alias("less")))) for k in range(SPARE)]
    given = F.sum(F.when(C("in_head"), C("size")).otherwise(0))
    each = drawn.groupBy("rank", "digits").agg((F.first("due") - given).alias("open"), F.array(*next_).alias("next"))
    near = each.groupBy("rank").agg(F.sum("open").alias("open"), F.flatten(F.collect_list("next")).alias("near"))
    start = F.struct(C("open").alias("open"), F.array().cast("array<bigint>").alias("fits"))
    longest = F.sort_array(F.transform(F.array_compact("near"), lambda x: F.struct(x["less"].alias("less"), x["place"].alias("place"))))
    step = lambda s, x: F.when(-x["less"] <= s["open"], F.struct((s["open"] + x["less"]).alias("open"), F.concat(s["fits"], F.array(x["place"])).alias("fits"))).otherwise(s)
    return cut(near.select(F.explode(F.aggregate(longest, start, step)["fits"]).alias("place"), F.lit(True).alias("fits")))
