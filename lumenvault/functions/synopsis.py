"""Shapes of JSON texts, and long texts cut at line ends. All of it is column expressions on the text's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# How much of a JSON text a synopsis tells.
KEYS, SAMPLES, PATHS, EXAMPLES, DEPTH, SHORT = 12, 3, 24, 6, 4, 80


def _name(kind: Column) -> Column:
    """The type of a value by the type of its variant; kind is told once, so that it is worked out once."""
    names = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.substring_index(kind, "<", 1)), F.lit("number"))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def clipped(x: Column, most: int = SHORT) -> Column:
    """The text, or its head and three dots, in at most ``most`` characters."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most - 3), F.lit("...")))


def _quoted(x: Column) -> Column:
    array = F.to_json(F.array(x))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def _short(kind: Column, value: Column) -> Column:
    """A value that is no container, by its type and text."""
    return (
        F.when(kind == "string", _quoted(clipped(value))).when(kind == "boolean", F.when(value == "true", "True").otherwise("False"))
        .when(kind == "null", "None").otherwise(clipped(value))
    )


def _told(nodes: Column) -> Column:
    """Values (order, path, place, text, value, listed, main) of the tree: their order in the document, two paths, JSON text, type and, without children, a short text.

    What is used several times is told by a step of its own, as a lambda works out each of its expressions anew.
    """
    rest = ("listed", "main")
    place = ("order", "path", "place", "text")
    typed = F.transform(nodes, lambda n: F.struct(*(n[c].alias(c) for c in place), _name(_kind(n["value"])).alias("type"), n["value"].alias("value"), *(n[c].alias(c) for c in rest)))
    plain = F.transform(typed, lambda n: F.struct(*(n[c].alias(c) for c in (*place, "type")), F.when(~n["type"].isin("object", "array"), n["value"].cast("string")).alias("value"), *(n[c].alias(c) for c in rest)))
    return F.transform(plain, lambda n: F.struct(*(n[c].alias(c) for c in (*place, "type")), F.coalesce(_short(n["type"], n["value"]), F.lit("None")).alias("short"), *(n[c].alias(c) for c in rest)))


def _node(order: Column, path: Column, place: Column, text: Column, value: Column, listed: Column, main: Column) -> Column:
    return F.struct(order.alias("order"), path.alias("path"), place.alias("place"), text.alias("text"), value.alias("value"), listed.alias("listed"), main.alias("main"))


def _children(node: Column) -> Column:
    """The first KEYS values of an object, the first two of an array, in the order of the text; a scalar has none."""
    plain = lambda k: k.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")
    step = lambda k: F.when(plain(k), F.concat(F.lit("."), k)).otherwise(F.concat(F.lit("["), _quoted(k), F.lit("]")))
    # A text is read once for all its values: a lambda's variable holds what was read.
    read = lambda kind, *more: F.array(F.struct(F.from_json(node["text"], kind.format("string")).alias("text"), F.from_json(node["text"], kind.format("variant")).alias("value"), *more))
    names = F.slice(F.json_object_keys(node["text"]), 1, KEYS).alias("names")
    of_object = F.flatten(F.transform(read("map<string,{}>", names), lambda m: F.transform(m["names"], lambda k, i: _node(F.concat(node["order"], F.array(i)), F.concat(node["path"], step(k)), F.concat(node["place"], F.lit("."), k), m["text"][k], m["value"][k], F.lit(True), node["main"]))))
    of_array = F.flatten(F.transform(read("array<{}>"), lambda m: F.transform(F.slice(m["text"], 1, 2), lambda t, i: _node(F.concat(node["order"], F.array(i)), F.concat(node["path"], F.lit("[]")), F.concat(node["place"], F.lit("["), i.cast("string"), F.lit("]")), t, F.get(m["value"], i), F.lit(False), node["main"] & (i == 0)))))
    none = F.array().cast("array<struct<order:array<int>,path:string,place:string,text:string,value:variant,listed:boolean,main:boolean>>")
    return F.coalesce(F.when(node["type"] == "object", of_object).when(node["type"] == "array", of_array), none)


def _size(kind: Column, text: Column) -> Column:
    return F.when(kind == "object", F.size(F.json_object_keys(text))).when(kind == "array", F.json_array_length(text))


def _shape(kind: Column, text: Column, inner: Column | None) -> Column:
    """What a value is, with the names of an object and the shapes of an array's first values."""
    names = F.slice(F.json_object_keys(text), 1, KEYS)
    of_object = F.concat(F.lit("object(keys="), F.size(F.json_object_keys(text)).cast("string"), F.when(F.size(names) > 0, F.concat(F.lit(": "), F.array_join(names, ", "))).otherwise(""), F.lit(")"))
    items, kinds = F.slice(F.from_json(text, "array<string>"), 1, SAMPLES), F.slice(F.from_json(text, "array<variant>"), 1, SAMPLES)
    # Types first: a lambda works out each of its expressions anew.
    typed = F.zip_with(items, kinds, lambda t, v: F.struct(t.alias("text"), _name(_kind(v)).alias("type")))
    told = F.transform(items, lambda t: F.lit("...")) if inner is None else F.transform(typed, lambda x: _shape(x["type"], x["text"], None))
    of_array = F.concat(F.lit("array(len="), F.json_array_length(text).cast("string"), F.when(F.size(items) > 0, F.concat(F.lit(", first=["), F.array_join(told, ", "), F.lit("]"))).otherwise(""), F.lit(")"))
    return F.when(kind == "object", of_object).when(kind == "array", of_array).otherwise(kind)


def _described(node: Column) -> Column:
    """A container with its path."""
    names = F.slice(F.json_object_keys(node["text"]), 1, KEYS)
    of_object = F.concat(F.lit("object keys "), _size(node["type"], node["text"]).cast("string"), F.when(F.size(names) > 0, F.concat(F.lit("; keys "), F.array_join(names, ", "))).otherwise(""))
    first = F.get(F.from_json(node["text"], "array<variant>"), F.lit(0))
    of_array = F.concat(F.lit("array length "), _size(node["type"], node["text"]).cast("string"), F.when(F.json_array_length(node["text"]) > 0, F.concat(F.lit("; first item "), _name(_kind(first)))).otherwise(""))
    return F.concat(node["path"], F.lit(": "), F.when(node["type"] == "object", of_object).otherwise(of_array))


def json_synopsis(rows: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., shape, paths, examples, n_top, top_keys) of JSON texts; all null where a text is no JSON object or array.

    paths: the containers within DEPTH levels, PATHS at most, of arrays the first value's; examples: the first EXAMPLES
    values that are no containers, of arrays the first two. Everything is told in the order of the text: types come from variants, which sort
    names, and names and order from the text itself. One level of values is one array, so nothing is shuffled.
    """
    whole = F.when(F.trim(text).rlike(r"^[\[{]"), F.try_parse_json(text))
    read = rows.select(*keep, F.trim(text).alias("_text"), whole.alias("_whole"))
    root = F.when(F.col("_whole").isNotNull(), _node(F.array().cast("array<int>"), F.lit("$"), F.lit("$"), F.col("_text"), F.col("_whole"), F.lit(False), F.lit(True)))
    found = read.select(*keep, _told(F.array_compact(F.array(root))).alias("_0"))
    for depth in range(1, DEPTH + 1):
        found = found.withColumn(f"_{depth}", _told(F.flatten(F.transform(f"_{depth - 1}", _children))))
    top = F.get("_0", F.lit(0))
    inner = F.flatten(F.array(*(F.col(f"_{d}") for d in range(1, DEPTH + 1))))
    shallow = F.flatten(F.array(*(F.col(f"_{d}") for d in range(DEPTH))))
    # Structs are compared by their order first.
    containers = F.array_sort(F.filter(inner, lambda n: n["listed"] & n["main"] & n["type"].isin("object", "array")))
    scalars = F.array_sort(F.filter(shallow, lambda n: ~n["type"].isin("object", "array")))
    there = top.isNotNull()
    return found.select(
        *keep,
        _shape(top["type"], top["text"], F.lit(1)).alias("shape"),
        F.when(there, F.transform(F.slice(containers, 1, PATHS), _described)).alias("paths"),
        F.when(there, F.transform(F.slice(scalars, 1, EXAMPLES), lambda n: F.concat(n["place"], F.lit(": "), n["short"]))).alias("examples"),
        _size(top["type"], top["text"]).alias("n_top"),
        F.slice(F.json_object_keys(top["text"]), 1, KEYS).alias("top_keys"),
    )


#: Headers that a summary lists, their length, and that of its excerpts.
HEADERS, HEADER_CHARS, EXCERPT_CHARS = 16, 160, 420


def one_line(x: Column, most: int) -> Column:
    """The text with single spaces for white space, clipped."""
    return clipped(F.trim(F.regexp_replace(x, r"\s+", " ")), most)


def headers(x: Column) -> Column:
    """The first HEADERS different lines that look like headers: behind marks, or of capitals and digits alone."""
    lines = F.transform(F.split(x, r"\r?\n"), lambda line: F.trim(line))
    found = F.filter(lines, lambda line: line.rlike(r"^#{1,6}\s+") | line.rlike(r"^[A-Z0-9][A-Z0-9\s:_-]{6,}$"))
    return F.slice(F.array_distinct(F.transform(found, lambda line: one_line(line, HEADER_CHARS))), 1, HEADERS)


def opening(x: Column) -> Column:
    """The first EXCERPT_CHARS characters in one line."""
    return one_line(F.substring(x, 1, EXCERPT_CHARS), EXCERPT_CHARS)


def closing(x: Column) -> Column:
    """The last EXCERPT_CHARS characters behind the opening in one line; empty if the opening is all."""
    start = F.greatest(F.lit(EXCERPT_CHARS), F.length(x) - EXCERPT_CHARS)
    return F.when(F.length(x) <= EXCERPT_CHARS, "").otherwise(one_line(F.substring(x, start + 1, F.lit(EXCERPT_CHARS)), EXCERPT_CHARS))


def head_end(text: Column, at: Column) -> Column:
    """a place to end a head: behind the last line end in the second half before ``at``, else ``at``; places count from 0."""
    half = F.floor(at / 2).cast("int")
    back = F.instr(F.reverse(F.substring(text, half + 1, at - half)), "\n")
    return F.when((at > 0) & (at < F.length(text)) & (back > 0), at - back + 1).otherwise(at)


def tail_start(text: Column, at: Column) -> Column:
    """a place to begin a tail: behind the first line end in the first half of what follows ``at``, else ``at``."""
    half = F.floor((F.length(text) - at) / 2).cast("int")
    ahead = F.instr(F.substring(text, at + 1, half), "\n")
    return F.when((at > 0) & (at < F.length(text)) & (ahead > 0), at + ahead).otherwise(at)


def cut_output(text: Column, most: int = 20_000, head: int = 12_000, tail: int = 6_000) -> Column:
    """A text of more than ``most`` characters as its head and tail, whole lines of them if there are, with a note of what is left out between; else the text."""
    n = F.length(text)
    a, b = head_end(text, F.lit(min(head, most))), tail_start(text, F.greatest(F.lit(0), n - tail))
    note = F.concat(F.lit("\n[... "), (b - a).cast("string"), F.lit(" of "), n.cast("string"), F.lit(" characters left out ...]\n"))
    plain = F.concat(F.substring(text, 1, most), F.lit("\n[... of "), n.cast("string"), F.lit(" characters]"))
    parted = F.concat(F.substring(text, F.lit(1), a), note, F.substring(text, b + 1, n))
    return F.when(n <= most, text).when(b <= a, plain).otherwise(parted)


def sample(text: Column, head: int, tail: int) -> Column:
    """the first and the last lines within so many characters, parted by dots; a text that fits is whole."""
    first = F.substring(text, 1, head)
    back = F.instr(F.reverse(first), "\n")
    first = F.when((back > 0) & (back < F.length(first)), F.substring(first, F.lit(1), F.length(first) - back)).otherwise(first)
    last = F.substring(text, F.length(text) - tail + 1, F.lit(tail))
    ahead = F.instr(last, "\n")
    last = F.when((ahead > 0) & (ahead < F.length(last)), F.substring(last, ahead + 1, F.length(last))).otherwise(last)
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(first, F.lit("\n...\n"), last))


def history_pass(messages: DataFrame, tool: Column, exempt: Column, most: int = 20_000, head: int = 12_000, tail: int = 6_000, budget: int | None = None, sample_head: int = 400, sample_tail: int = 200) -> DataFrame:
    """Messages (thread, seq, text, ...) with texts of tools' messages that are too long cut, and ``changed``.

    A tool's message above ``most`` is cut (``cut_output``); others, exempt ones and null texts stay. With a budget the
    newest messages of tools keep their text as long as those newer than them leave some of it; older ones become samples (``sample``).
    """
    own = tool & ~exempt & F.col("text").isNotNull()
    short = F.when(own, cut_output(F.col("text"), most, head, tail)).otherwise(F.col("text"))
    found = messages.withColumn("_cut", short)
    if budget is not None:
        newest = Window.partitionBy("thread").orderBy(F.desc("seq"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
        used = F.coalesce(F.sum(F.when(own, F.length("_cut")).otherwise(0)).over(newest), F.lit(0))
        found = found.withColumn("_cut", F.when(own & (used >= budget), sample(F.col("_cut"), sample_head, sample_tail)).otherwise(F.col("_cut")))
    return found.withColumn("changed", ~F.col("_cut").eqNullSafe(F.col("text"))).withColumn("text", F.col("_cut")).drop("_cut")
