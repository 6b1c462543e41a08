"""From names and anchors to symbols, line ranges and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenvault.operators.graph import cut
from lumenvault.operators.sequences import coalesce_intervals


def grep_symbols(symbols: DataFrame, pattern: str, regex: bool = False, most: int = 30) -> DataFrame:
    """The first symbols (file, name, qualified_name, kind, start_line), in the order of their places, whose names hold the pattern, case aside.

    A plain pattern may lie in the name or the qualified name; a regular expression is sought in the qualified one.
    """
    low = F.lower(F.lit(pattern))
    hit = F.col("qualified_name").rlike(f"(?i){pattern}") if regex else F.lower("name").contains(low) | F.lower("qualified_name").contains(low)
    return symbols.where(hit).orderBy("file", "start_line", "qualified_name").limit(most).select("file", "start_line", "kind", "qualified_name")


def symbol_bodies(asked: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(file, symbol, body): the lines of the first symbol of the file with that qualified or bare name; null if there is none.

    asked (file, symbol); symbols (file, name, qualified_name, start_line, end_line); files (file, source).
    Symbols and sources are shuffled: what Spark takes them for by their table's size may be far less than they are, and would go to all tasks.
    """
    wanted = asked.distinct()
    named = symbols.select("file", "start_line", "end_line", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("symbol"))
    first = wanted.join(named.hint("merge"), ["file", "symbol"]).groupBy("file", "symbol").agg(F.min(F.struct("start_line", "end_line")).alias("at"))
    lines = F.split("source", "\n")
    body = F.array_join(F.slice(lines, F.col("at.start_line"), F.greatest(F.lit(0), F.least(F.col("at.end_line"), F.size(lines)) - F.col("at.start_line") + 1)), "\n")
    read = first.join(files.select("file", "source").hint("merge"), "file").select("file", "symbol", body.alias("body"))
    return wanted.join(read.hint("merge"), ["file", "symbol"], "left").select("file", "symbol", "body")


def skeleton_line(kind: Column, name: Column, signature: Column, file: Column, start: Column, end: Column, most: int = 120) -> Column:
    """one line for a symbol: its kind, name, parameters (cut at ``most`` characters; a class has none) and place."""
    tag = F.when(kind == "function", "func").when(kind == "method", "meth").otherwise(kind)
    given = F.coalesce(F.nullif(signature, F.lit("")), F.lit("()"))
    at = F.locate("(", given)
    params = F.when(at > 0, F.substring(given, at, F.length(given))).otherwise(given)
    short = F.when(F.length(params) > most, F.concat(F.substring(params, 1, most), F.lit("…"))).otherwise(params)
    return F.concat(tag, F.lit(" "), name, F.when(kind == "class", "").otherwise(short), F.lit("  @ "), file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def anchor_ranges(anchors: DataFrame, symbols: DataFrame, window: int = 10) -> DataFrame:
    """(case, place, why, first, last): the lines that anchors name, ``window`` lines around them.

    anchors (case, file, place, anchor) with anchors "line: 42", "class: A" and "function: f"; symbols (file, name,
    qualified_name, kind, start_line, end_line). A class names all classes of that name, and is the context of the functions behind
    it. A function is the qualified name, else that of the class before it, else the bare name if
    just one function or method has it; of equal qualified names the last one counts. Others give no row. Symbols are made once,
    and shuffled, as Spark may take them for far fewer bytes than they are.
    """
    symbols = cut(symbols.select("file", "name", "qualified_name", "kind", "start_line", "end_line"))
    said = anchors.withColumn("why", F.trim("anchor")).withColumn("_kind", F.lower(F.regexp_extract("why", r"^([A-Za-z]+):", 1))).withColumn("name", F.trim(F.regexp_replace("why", r"^[A-Za-z]+:", "")))
    order = Window.partitionBy("case", "file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    said = said.withColumn("_class", F.last(F.when(F.col("_kind") == "class", F.col("name")), ignorenulls=True).over(order))
    keys = ["case", "file", "place", "why"]
    number = F.col("name").try_cast("int")
    lines = said.where((F.col("_kind") == "line") & number.isNotNull()).select(*keys, number.alias("first"), number.alias("last"))
    classes = symbols.where("kind = 'class'").select("file", "name", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    of_class = said.where("_kind = 'class'").join(classes.hint("merge"), ["file", "name"]).select(*keys, "first", "last")
    asked = said.where("_kind = 'function'").select(*keys, "name", F.concat_ws(".", "_class", "name").alias("_inner"))
    span = F.struct(F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    whole = symbols.groupBy("file", "qualified_name").agg(F.max(span).alias("span"))
    bare = symbols.where("kind in ('function', 'method')").groupBy("file", "name").agg(F.count("*").alias("n"), F.min(span).alias("_bare")).where("n = 1").drop("n")
    by_name = whole.select("file", F.col("qualified_name").alias("name"), F.col("span").alias("_own"))
    by_class = whole.select("file", F.col("qualified_name").alias("_inner"), F.col("span").alias("_in_class"))
    found = asked.join(by_name.hint("merge"), ["file", "name"], "left").join(by_class.hint("merge"), ["file", "_inner"], "left").join(bare.hint("merge"), ["file", "name"], "left")
    of_function = found.select(*keys, F.coalesce("_own", "_in_class", "_bare").alias("s")).where("s is not null").select(*keys, "s.first", "s.last")
    every = lines.unionByName(of_class).unionByName(of_function)
    return every.select("case", "file", "place", "why", F.greatest(F.lit(1), F.col("first") - window).alias("first"), (F.col("last") + window).alias("last"))


def evidence_snippets(evidence: DataFrame, files: DataFrame, window: int = 10) -> DataFrame:
    """(case, file, first, last, snippet): the lines around evidence (case, file, line), ranges of a file that meet merged.

    Evidence without a line is left out; a file that is not among files (file, source) has a null snippet.
    """
    around = evidence.where("line is not null").select(F.struct("case", "file").alias("at"), F.greatest(F.lit(1), F.col("line") - window).alias("first"), (F.col("line") + window).alias("last"))
    merged = coalesce_intervals(around, key="at").select("at.case", "at.file", "first", "last")
    lines = F.split("source", "\n")
    text = F.array_join(F.slice(lines, F.col("first").cast("int"), F.greatest(F.lit(0), (F.least(F.col("last"), F.size(lines).cast("long")) - F.col("first") + 1).cast("int"))), "\n")
    return merged.join(files.select("file", "source").hint("merge"), "file", "left").select("case", "file", "first", "last", text.alias("snippet"))
