"""Computations over ordered rows: intervals, guards, ledgers and pages.

The guards here read a finished sequence; ``lumenvault.streaming.guards`` keeps the
same rules as state of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LOOP_WINDOW, LOOP_WARN, LOOP_STOP = 20, 3, 5


def coalesce_intervals(spans: DataFrame, key: str = "file", first: str = "first", last: str = "last") -> DataFrame:
    """(key, first, last): closed intervals merged where they meet or touch.

    Equal intervals are one row first: among them an order by first and last would not say which one opens an island.
    """
    spans = spans.select(key, first, last).distinct()
    order = Window.partitionBy(key).orderBy(first, last)
    before = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.select(key, first, last, F.when(before.isNull() | (F.col(first) > before + 1), 1).otherwise(0).alias("_new"))
    island = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min(first).alias("first"), F.max(last).alias("last")).drop("_island")


def outermost(spans: DataFrame, key: str = "file", first: str = "first", last: str = "last", tie: str = "symbol") -> DataFrame:
    """Spans that no earlier, or equal and earlier named, span contains."""
    order = Window.partitionBy(key).orderBy(F.col(first), F.desc(last), F.col(tie))
    before = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(last) > F.col("_before"))).drop("_before")


def enclosing(points: DataFrame, spans: DataFrame, block: int = 64) -> DataFrame:
    """H5: (point, symbol): the shortest span around each point (point, file, line), ties by start and symbol; null if none.

    A line is looked up once, however many points lie on it. Spans are cut at the ends of blocks of lines, and of those that are
    alike within a block the best one is kept, so a line meets a number of spans that the block bounds.
    """
    cut = lambda x: F.floor(x / block)
    dealt = spans.select("file", "symbol", "first", "last", F.explode(F.sequence(cut(F.col("first")), cut(F.col("last")))).alias("block"))
    begin, end = F.greatest("first", F.col("block") * block), F.least("last", F.col("block") * block + (block - 1))
    alike = dealt.groupBy("file", "block", begin.alias("_a"), end.alias("_b")).agg(F.min(F.struct(F.col("last") - F.col("first"), F.col("first"), F.col("symbol"))).alias("b"))
    lines = points.select("file", "line").distinct().withColumn("block", cut(F.col("line")))
    best = lines.join(alike, ["file", "block"]).where("line between _a and _b").groupBy("file", "line").agg(F.min("b").alias("b"))
    return points.select("point", "file", "line").join(best, ["file", "line"], "left").select("point", F.col("b.symbol").alias("symbol"))


def active_scopes(ranges: DataFrame, spans: DataFrame, block: int = 64) -> DataFrame:
    """H5: (range, symbol): the first span that begins in a range (range, file, first, last), else the shortest around its first line, else null.

    Equal ranges are looked up once, and of the spans that begin on a line only the one that would be told meets them.
    """
    cut = lambda x: F.floor(x / block)
    starts = spans.groupBy("file", F.col("first").alias("_a")).agg(F.min(F.struct("first", -F.col("last"), "symbol")).alias("s")).withColumn("block", cut(F.col("_a")))
    key = ["file", "first", "last"]
    asked = ranges.select(*key).distinct()
    dealt = asked.withColumn("block", F.explode(F.sequence(cut(F.col("first")), cut(F.col("last")))))
    inside = dealt.join(starts, ["file", "block"]).where("_a between first and last").groupBy(*key).agg(F.min("s")["symbol"].alias("_in"))
    around = enclosing(asked.select(F.struct(*key).alias("point"), "file", F.col("first").alias("line")), spans, block).select("point.*", F.col("symbol").alias("_out"))
    found = asked.join(inside, key, "left").join(around, key, "left").select(*key, F.coalesce("_in", "_out").alias("symbol"))
    return ranges.select("range", *key).join(found, key, "left").select("range", "symbol")


def loop_guard(calls: DataFrame, window: int = LOOP_WINDOW, warn: int = LOOP_WARN, stop: int = LOOP_STOP) -> DataFrame:
    """W6, ST1: (thread, seq, times, action) of calls (thread, seq, hash).

    times: how often the call's hash is among the thread's last ``window`` calls, itself
    included. warn is given once for a hash, stop each time.
    """
    order = Window.partitionBy("thread").orderBy("seq")
    last = F.collect_list("hash").over(order.rowsBetween(-(window - 1), 0))
    counted = calls.withColumn("_last", last).select("thread", "seq", "hash", F.size(F.filter("_last", lambda h: h == F.col("hash"))).alias("times"))
    reached = F.sum(F.when(F.col("times") >= warn, 1).otherwise(0)).over(Window.partitionBy("thread", "hash").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    action = F.when(F.col("times") >= stop, "stop").when((F.col("times") >= warn) & (F.coalesce(reached, F.lit(0)) == 0), "warn").otherwise("go")
    return counted.select("thread", "seq", "times", action.alias("action"))


def turn_guard(turns: DataFrame, most: int) -> DataFrame:
    """W7, ST2: (thread, seq, turn, action): warn on the last turn but one, stop from the last on."""
    n = F.row_number().over(Window.partitionBy("thread").orderBy("seq"))
    return turns.select("thread", "seq", n.alias("turn")).withColumn("action", F.when(F.col("turn") >= most, "stop").when(F.col("turn") == most - 1, "warn").otherwise("go"))


def token_guard(usage: DataFrame, limit: int, warn: float = 0.7) -> DataFrame:
    """W8, A16, ST3: (run, seq, total, used, action) of usage (run, message, seq, tokens).

    A message that is told again counts only for what it rises above its own highest count.
    """
    high = F.max("tokens").over(Window.partitionBy("run", "message").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rise = usage.withColumn("_rise", F.greatest(F.lit(0), F.col("tokens") - F.coalesce(high, F.lit(0))))
    total = F.sum("_rise").over(Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    used = rise.select("run", "seq", total.alias("total")).withColumn("used", F.col("total") / limit)
    return used.withColumn("action", F.when(F.col("used") >= 1.0, "stop").when(F.col("used") >= warn, "warn").otherwise("go"))


def ledger(entries: DataFrame, terminal: tuple[str, ...] = ("done", "failed", "cancelled"), most: int = 50) -> DataFrame:
    """W10, ST5: (run, id, status, created_at, place): the last terminal entry of an id, else its last; the ``most`` ids first seen last."""
    of = Window.partitionBy("run", "id")
    ended = F.col("status").isin(*terminal)
    ranked = entries.withColumns({
        "_n": F.row_number().over(of.orderBy(F.desc(ended), F.desc("seq"))),
        "_seen": F.min("seq").over(of),
        "_created": F.min_by("at", "seq").over(of),
    })
    last = ranked.where("_n = 1").withColumn("_from_end", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("_seen"))))
    kept = last.where(F.col("_from_end") <= most)
    return kept.select("run", "id", "status", F.col("_created").alias("created_at"), F.row_number().over(Window.partitionBy("run").orderBy("_seen")).alias("place"))


def final_text(parts: DataFrame) -> DataFrame:
    """(run, text): the parts, in order, of the message of each run that first appears last."""
    first = parts.withColumn("_first", F.min("seq").over(Window.partitionBy("run", "message")))
    last = first.withColumn("_last", F.max("_first").over(Window.partitionBy("run"))).where(F.col("_first") == F.col("_last"))
    return last.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "").alias("text"))


def page(rows: DataFrame, order: list[Column], by: list[str], limit: int, offset: int) -> DataFrame:
    """Rows offset + 1 to offset + limit of each group, with their place and the group's size."""
    of = Window.partitionBy(*by)
    return rows.withColumns({"place": F.row_number().over(of.orderBy(*order)), "total": F.count("*").over(of)}).where(F.col("place").between(offset + 1, offset + limit))


def first_of_each(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def merge_evidence(old: Column, new: Column) -> Column:
    """Evidence of both, distinct by (file, line); the first of equals stays."""
    both = F.concat(old, new)
    keys = F.transform(both, lambda e: F.struct(e["file"], e["line"]))
    return F.filter(both, lambda e, i: F.array_position(keys, F.struct(e["file"], e["line"])) == i + 1)


def changed_files(named: DataFrame, untracked: DataFrame, by: str) -> DataFrame:
    """(by, files): the files that a diff names (by, file) and those that are not tracked (by, file), each once, sorted."""
    both = named.select(by, "file").unionByName(untracked.select(by, "file")).where("file is not null").distinct()
    return both.groupBy(by).agg(F.array_sort(F.collect_list("file")).alias("files"))


def event_texts(lines: DataFrame) -> DataFrame:
    """(run, message, text, place, tokens): the text parts of each message joined in order, messages by their first part, and the run's last told tokens.

    lines (run, seq, value): JSON objects with type and part; lines that are none are left out. Tokens are the output tokens of the last step_finish, null without one.
    """
    form = "type string, part struct<messageID: string, text: string, tokens: struct<input: bigint, output: bigint>>"
    read = lines.select("run", "seq", F.from_json("value", form, {"mode": "PERMISSIVE"}).alias("e")).where("e.type is not null")
    told = read.where("e.type = 'text' and e.part.messageID is not null").groupBy("run", F.col("e.part.messageID").alias("message")).agg(
        F.min("seq").alias("_first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("e.part.text").alias("text")))), lambda x: x["text"]), "").alias("text")
    )
    tokens = read.where("e.type = 'step_finish'").groupBy("run").agg(F.max_by("e.part.tokens.output", "seq").alias("tokens"))
    placed = told.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy("_first", "message"))).drop("_first")
    return placed.join(tokens, "run", "left").select("run", "message", "text", "place", "tokens")
