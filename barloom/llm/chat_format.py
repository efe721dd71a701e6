"""Chat formatting with budgeted windows, in DataFrame operations only.

A conversation's turns are laid out in windows of at most `budget` tokens (a turn that alone is longer gets a
window of its own). Prefix sums of turn tokens choose the turn-aligned spans: a window takes turns while
the sum stays in the budget; the next one repeats up to `HISTORY` preceding turns of at most
`history_budget` tokens, and every window repeats the leading system turn. Only assistant texts that a window shows
for the first time are under the loss mask, given as (start, length) character spans.

Turns are gathered in blocks of BLOCK turn numbers, never by whole conversation, so a conversation of any
length is dealt out; windows end with their block, and history reaches across it. Tokens are estimated
as a quarter of the text's UTF-8 bytes plus TURN_TOKENS for the marks, as no tokenizer runs in the JVM.

Template: `<|role|>`, a newline, the text, `</s>` for each turn. In roles and texts a backslash is doubled, and every
control string of CONTROL gets a backslash after its first character, which `unescape` takes back exactly.

Defined results: null text and role count as empty; null turns come first, equal turns go by role and text;
repeated rows are turns of their own; a null conv_id is one conversation; an empty table gives no rows;
other columns are ignored. Rows of one conversation that share a block of turn numbers (repeats of the
same turn above all) are held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 2
HISTORY_BUDGET = 256
BLOCK = 64
TURN_TOKENS = 4
#: Strings that chat templates treat as control.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROL:
        c = F.replace(c, F.lit(x), F.lit(x[0] + "\\" + x[1:]))
    return c


def unescape(c: Column) -> Column:
    """What `escape` was given."""
    for x in reversed(CONTROL):
        c = F.replace(c, F.lit(x[0] + "\\" + x[1:]), F.lit(x))
    return F.replace(c, F.lit("\\\\"), F.lit("\\"))


def _fixed(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, so that the optimizer doesn't copy a computed array into every lambda that reads it."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_budget: int = HISTORY_BUDGET) -> DataFrame:
    """One row per window: conv_id, window (ordered within the conversation), formatted, loss (array of
    (start, length), from 0, in characters), n_turns, n_repeated (leading turns shown before), n_tokens."""
    t = turns.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # the leading turn of each conversation: kept in every window where it is a system turn
    lead = t.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("lead")).filter("lead.role = 'system'").select(F.col("conv_id").alias("__conv"), "lead")
    block = F.floor(F.coalesce("turn", F.lit(0)) / BLOCK).cast("long")
    late = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(BLOCK)) >= BLOCK - history
    dealt = t.withColumn("__b", block).withColumn("__to", F.explode(F.when(late, F.array(F.col("__b"), F.col("__b") + 1)).otherwise(F.array("__b"))))
    row = F.struct(F.col("turn"), F.col("role"), F.col("text"), (F.col("__to") == F.col("__b")).alias("own"))
    b = dealt.groupBy("conv_id", F.col("__to").alias("block")).agg(F.sort_array(F.collect_list(row)).alias("ts"))
    b = b.withColumn("a", F.expr("CAST(size(filter(ts, x -> NOT x.own)) AS INT)")).filter("a < size(ts)")
    b = b.join(lead, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    b = b.withColumn("led", F.expr("coalesce(lead.turn <=> ts[0].turn AND lead.role = ts[0].role AND lead.text = ts[0].text, false)"))
    tokens = f"CAST(ceil(octet_length(x.text) / 4) AS BIGINT) + {TURN_TOKENS}"
    b = b.withColumn("p", F.expr(f"aggregate(ts, array(0L), (acc, x) -> concat(acc, array(element_at(acc, -1) + {tokens})))"))
    b = _fixed(b)
    b = b.withColumn("room", F.expr(f"{budget} - CASE WHEN lead IS NULL THEN 0 ELSE CAST(ceil(octet_length(lead.text) / 4) AS BIGINT) + {TURN_TOKENS} END"))
    floor_at = "CAST(led AS INT)"
    reach = f"filter(sequence(greatest(i - {history}, least({floor_at}, i)), i), j -> j = i OR (p[i] - p[j] <= {history_budget} AND p[i + 1] - p[j] <= room))[0]"
    b = _fixed(b)
    hist = b.withColumn("h", F.expr(f"transform(sequence(0, size(ts) - 1), i -> {reach})"))
    hist = _fixed(hist)
    # room counts the lead once, so turns are summed from the first that is not the lead itself
    start = f"greatest(h[a], {floor_at})"
    fold = (
        f"aggregate(sequence(a, size(ts) - 1), named_struct('s', array(a), 'f', {start}), "
        "(acc, i) -> CASE WHEN i = acc.s[size(acc.s) - 1] OR p[i + 1] - p[acc.f] <= room THEN acc "
        "ELSE named_struct('s', concat(acc.s, array(i)), 'f', h[i]) END).s"
    )
    w = hist.withColumn("starts", F.expr(fold)).select("*", F.posexplode("starts").alias("k", "s"))
    w = w.withColumn("e", F.expr("coalesce(get(starts, k + 1), size(ts))"))
    shown = "transform(slice(ts, {0} + 1, {1} - {0}), x -> named_struct('role', x.role, 'text', x.text))"
    w = w.withColumn("first", F.expr("h[s]")).withColumn("with_lead", F.expr("lead IS NOT NULL AND NOT (led AND s = 0)"))
    # history never holds the lead: windows after the first start no earlier than the turn behind it
    w = w.withColumn("pieces", F.expr("concat(CASE WHEN with_lead THEN array(named_struct('role', lead.role, 'text', lead.text)) ELSE array() END, " + shown.format("first", "e") + ")"))
    w = w.withColumn("n_repeated", F.expr("CAST(with_lead AS INT) + s - first"))
    w = _fixed(w.select("conv_id", "block", "k", "s", "e", "first", "with_lead", "pieces", "n_repeated", "p", "room"))
    w = w.withColumn("heads", F.transform("pieces", lambda x: F.concat(F.lit("<|"), escape(x["role"]), F.lit("|>\n")))).withColumn("bodies", F.transform("pieces", lambda x: escape(x["text"])))
    w = _fixed(w)
    w = w.withColumn("ends", F.expr("aggregate(sequence(0, size(pieces) - 1), array(0), (acc, i) -> concat(acc, array(element_at(acc, -1) + length(heads[i]) + length(bodies[i]) + 4)))"))
    w = _fixed(w)
    loss = "transform(filter(sequence(0, size(pieces) - 1), i -> i >= n_repeated AND pieces[i].role = 'assistant'), i -> named_struct('start', ends[i] + length(heads[i]), 'length', length(bodies[i])))"
    return w.select(
        "conv_id",
        (F.col("block") * BLOCK * 1024 + F.col("k")).alias("window"),
        F.expr("array_join(transform(sequence(0, size(pieces) - 1), i -> concat(heads[i], bodies[i], '</s>')), '')").alias("formatted"),
        F.expr(loss).alias("loss"),
        F.expr("size(pieces)").alias("n_turns"),
        "n_repeated",
        F.expr(f"p[e] - p[greatest(first, 0)] + CASE WHEN with_lead THEN {budget} - room ELSE 0L END").alias("n_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """array of (role, text), unescaped, from a formatted window."""
    parts = F.transform(F.slice(F.split(formatted, "</s>"), 1, F.size(F.split(formatted, "</s>")) - 1), lambda x: F.struct(F.substring_index(x, "|>", 1).alias("h"), x.alias("x")))
    return F.transform(parts, lambda x: F.struct(unescape(x["h"].substr(F.lit(3), F.length(x["h"]))).alias("role"), unescape(x["x"].substr(F.length(x["h"]) + 4, F.length(x["x"]))).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from windows."""
    w = formatted.select("conv_id", "window", "n_repeated", "loss", "formatted", read_back(F.col("formatted")).alias("ts"))
    w = _fixed(w)
    w = w.withColumn("new", F.expr("slice(ts, n_repeated + 1, size(ts) - n_repeated)"))
    w = _fixed(w)
    w = w.select(
        "conv_id",
        F.size("new").cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
        F.struct(
            "window",
            F.expr(r"array_join(transform(new, x -> concat(x.role, '\n', x.text, '\n')), '')").alias("turns"),
            F.array_join(F.transform("loss", lambda x: unescape(F.col("formatted").substr(x["start"] + 1, x["length"]))), "").alias("loss"),
        ).alias("part"),
    )
    c = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    c = c.select("conv_id", "n_turns", "formatted_chars", F.expr("array_join(parts.turns, '')").alias("turns"), F.expr("array_join(parts.loss, '')").alias("loss"))
    return c.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
