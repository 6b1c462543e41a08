"""Unified diffs as rows: files, ranges, hunks and line counts.

All of it is string functions on the diff's own row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _sections(diff: Column) -> Column:
    """What follows each +++ line, its path first."""
    parts = F.split(diff, r"(?m)^\+\+\+ (?:b/)?")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def _own_sections(diff: Column) -> Column:
    """The sections without the --- line of the next file, which else reads as a removed line."""
    return F.transform(_sections(diff), lambda s, i: F.when(i + 1 < F.size(_sections(diff)), F.regexp_replace(s, r"--- [^\n]*\n$", "")).otherwise(s))


def _path(section: Column) -> Column:
    return F.regexp_extract(section, r"^([^\t\n]*)", 1)


def changed_files(diff: Column) -> Column:
    """Paths after the change, each once, in order; /dev/null is none."""
    return F.array_distinct(F.filter(F.transform(_sections(diff), _path), lambda p: (p != "/dev/null") & (p != "")))


def added_lines(diff: Column, symbol: Column | None = None, sign: str = "+") -> Column:
    """Lines that begin with + and are no header, of those that name the symbol if one is given."""
    own = lambda x: x.startswith(sign) & ~x.startswith(sign * 3)
    return F.size(F.filter(F.split(diff, "\n"), lambda x: own(x) & x.contains(symbol) if symbol is not None else own(x)))


def removed_lines(diff: Column, symbol: Column | None = None) -> Column:
    return added_lines(diff, symbol, "-")


def ranges(diffs: DataFrame, key: str = "commit", diff: str = "diff") -> DataFrame:
    """(key, file, first, last) of each hunk's new side; a length not given is 1, one of 0 is skipped."""
    sections = diffs.select(key, F.explode(_sections(F.col(diff))).alias("_s"))
    heads = sections.select(key, _path(F.col("_s")).alias("file"), F.explode(F.regexp_extract_all("_s", F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"), 1)).alias("_h"))
    parts = F.split("_h", ",")
    first, length = parts[0].cast("long"), F.coalesce(F.get(parts, 1).cast("long"), F.lit(1))
    return heads.where("file <> '/dev/null'").select(key, "file", first.alias("first"), (first + length - 1).alias("last")).where("last >= first")


def hunks(diffs: DataFrame, key: str = "commit", diff: str = "diff", old: bool = False) -> DataFrame:
    """(key, file, place, start, body, end): end is the start and the context and added lines, one at least.

    With ``old`` also old_start, n_old and n_new, a length not given being 1, and bodies hold no line of the next file's head.
    """
    sections = diffs.select(key, F.explode((_own_sections if old else _sections)(F.col(diff))).alias("_s"))
    parts = F.split("_s", r"(?m)^@@ ")
    each = sections.select(key, _path(F.col("_s")).alias("file"), F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("place", "_h")).where("file <> '/dev/null'")
    start = F.regexp_extract("_h", r"^-\d+(?:,\d+)? \+(\d+)", 1).cast("long")
    body = F.regexp_replace("_h", r"^[^\n]*\n?", "")
    spanned = F.size(F.filter(F.split("body", "\n"), lambda x: x.startswith(" ") | x.startswith("+")))
    length = lambda sign: F.coalesce(F.nullif(F.regexp_extract("_h", rf"(?:^| ){sign}\d+,(\d+)", 1), F.lit("")).cast("long"), F.lit(1))
    more = [F.regexp_extract("_h", r"^-(\d+)", 1).cast("long").alias("old_start"), length("-").alias("n_old"), length(r"\+").alias("n_new")] if old else []
    found = each.select(key, "file", "place", start.alias("start"), body.alias("body"), *more)
    return found.withColumn("end", F.col("start") + F.greatest(spanned, F.lit(1)))


def nested_files(diff: Column) -> Column:
    """Paths in patches that the diff itself adds."""
    inner = F.transform(F.filter(F.split(diff, "\n"), lambda x: x.startswith("+") & ~x.startswith("+++ b/") & ~x.startswith("+++ /dev/null")), lambda x: F.substring(x, F.lit(2), F.length(x)))
    return changed_files(F.array_join(inner, "\n"))


def log_rows(logs: DataFrame, text: str = "log") -> DataFrame:
    """(sha, author, subject) of a log whose records end in U+001E and whose fields are parted by U+001F."""
    records = logs.select(F.explode(F.split(text, "\x1e")).alias("r")).select(F.regexp_replace("r", r"^\s+|\s+$", "").alias("r")).where("r <> ''")
    parts = F.split("r", "\x1f")
    return records.select(parts[0].alias("sha"), F.get(parts, 1).alias("author"), F.get(parts, 2).alias("subject"))
