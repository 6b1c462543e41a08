"""Column functions on text, identifiers, JSON arguments and paths."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, functions as F

# The fields of a call's arguments that say what the call is.
SALIENT = ("path", "url", "query", "command", "pattern", "glob", "cmd")
# Names that a search leaves out.
IGNORED_NAMES = (
    ".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".venv", "venv", "env", ".tox", "dist", "build", "target", "out", ".next", ".nuxt", "data", "lancedb", ".lancedb", ".cache", ".gradle", "eggs", ".eggs",
)
# Suffixes of names that a search leaves out.
IGNORED_SUFFIXES = ("pyc", "pyo", "so", "o", "a", "dll", "dylib", "wasm", "png", "jpg", "jpeg", "gif", "pdf", "zip", "tar", "gz", "tgz", "class", "lock")
# Parts of messages of errors that pass by themselves.
TRANSIENT = ("connection reset", "broken pipe", "eof", "timeout", "timed out", "deadline exceeded", "transport", "socket hang up", "fetch failed", "network", "502", "503", "504", "service unavailable")


def _text(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@cache
def _folds() -> dict[str, str]:
    """Characters whose folding is not their lower case, by Unicode's own tables; capital sigma among them, as its lower case depends on its place."""
    every = (chr(k) for k in range(0x20000) if not 0xD800 <= k < 0xE000)
    return {c: c.casefold() for c in every if c.casefold() != c.lower()} | {"\u03a3": "\u03c3"}


def _ranges(chars: list[str], gap: int = 64) -> str:
    """A few ranges, for a class of a pattern, that hold the characters and others near them: a class tries its parts one by one."""
    runs: list[list[int]] = []
    for n in sorted(map(ord, chars)):
        if runs and n - runs[-1][1] <= gap:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


def casefold(x: Column | str) -> Column:
    """the text without differences of case: lower case, and ß as ss, final sigma as sigma and the like."""
    # Lower case comes first, as some letters fold to capitals; what it gives has a fold of its own.
    folds = {c: f for c, f in _folds().items() if c != "\u03a3"}
    one, more = {c: f for c, f in folds.items() if len(f) == 1}, {c: f for c, f in folds.items() if len(f) > 1 and c != "ß"}
    plain = F.replace(F.translate(F.lower(F.translate(_text(x), "\u03a3", "\u03c3")), "".join(one), "".join(one.values())), F.lit("ß"), F.lit("ss"))
    table = F.create_map(*(F.lit(part) for pair in more.items() for part in pair))
    odd = f"[{_ranges(list(more))}]"
    each = F.transform(F.split(plain, f"(?={odd})|(?<={odd})"), lambda c: F.coalesce(F.element_at(table, c), c))
    return F.when(plain.rlike(odd), F.array_join(each, "")).otherwise(plain)


def content_key(x: Column | str) -> Column:
    """trimmed, white space collapsed to single spaces, without differences of case."""
    return casefold(F.regexp_replace(F.regexp_replace(_text(x), r"(?U)\s+", " "), r"^ | $", ""))


def short_id(owner: Column, codebase: Column, kind: Column, summary: Column) -> Column:
    """The 16 hex digits that identify an item by owner, codebase, kind and content."""
    return F.substring(F.sha2(F.concat(owner, F.lit("/"), codebase, F.lit(":"), kind, F.lit(":"), content_key(summary)), 256), 1, 16)


def call_key(name: Column, args: Column) -> Column:
    """name:key of one call: its salient arguments as JSON in the order of their names, numbers and strings told apart.

    Without any: an object or other JSON in compact form with sorted names, text that is no JSON as it is, nothing as {}.
    """
    said = F.try_parse_json(args)
    at = lambda f: F.variant_get(said, f"$.{f}", "string")  # noqa: E731  null for JSON's null
    is_object = F.coalesce(F.schema_of_variant(said).startswith("OBJECT"), F.lit(False))
    fields = [F.when(is_object & at(f).isNotNull(), F.concat(F.lit(f'"{f}": '), F.to_json(F.variant_get(said, f"$.{f}", "variant")))) for f in sorted(SALIENT)]
    salient = F.array_compact(F.array(*fields))
    whole = F.when(args.isNull(), F.lit("{}")).when(said.isNull(), args).otherwise(F.to_json(said))
    return F.concat(name, F.lit(":"), F.when(F.size(salient) > 0, F.concat(F.lit("{"), F.array_join(salient, ", "), F.lit("}"))).otherwise(whole))


def calls_hash(keys: Column) -> Column:
    """12 hex digits for a set of call keys in any order."""
    return F.substring(F.md5(F.array_join(F.array_sort(keys), "\n")), 1, 12)


def split_identifier(x: Column | str) -> Column:
    """Parts of an identifier at _, - and space and at camel boundaries, case kept."""
    # A space goes before a capital behind a small letter or digit, then before the last of several capitals.
    spaced = F.regexp_replace(F.regexp_replace(_text(x), r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, r"[_\-\s]+"), lambda p: p != "")


# Words that say nothing about a symbol.
STOP_WORDS = (
    "def", "class", "return", "if", "elif", "else", "for", "while", "try", "except", "finally", "with", "as", "import", "from", "pass", "break", "continue", "in", "is", "not", "and", "or",
    "lambda", "yield", "global", "nonlocal", "raise", "assert", "del", "async", "await", "self", "cls", "none", "true", "false", "the", "a", "an", "to", "of", "on", "by", "it", "its", "this", "that",
)


def _told(words: Column) -> Column:
    return F.filter(F.transform(words, F.lower), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def module_words(x: Column | str) -> Column:
    """the parts of all identifiers of a text, in lower case, stop words left out."""
    return _told(F.flatten(F.transform(F.regexp_extract_all(_text(x), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1), split_identifier)))


def symbol_words(name: Column, qualified: Column, body: Column, docstring: Column) -> Column:
    """F8: the words by which a symbol is found: its names' parts twice, those of its body, and its docstring's words twice."""
    names = F.transform(F.concat(split_identifier(name), F.flatten(F.transform(F.split(qualified, r"\."), split_identifier))), F.lower)
    said = _told(F.split(F.coalesce(docstring, F.lit("")), "[^A-Za-z0-9]+"))
    return F.concat(names, names, module_words(body), said, said)


def embed_text(file: Column, symbol: Column, kind: Column, language: Column, body: Column) -> Column:
    """a chunk's text behind a comment that says where it is from."""
    mark = F.when(language.isin("c", "cpp"), "//").otherwise("#")
    said = (mark, F.lit(" file: "), file, F.lit(" · symbol: "), symbol, F.lit(" · kind: "), kind, F.lit(" · lang: "), F.coalesce(language, F.lit("None")), F.lit("\n"), body)
    return F.concat(*said)


def non_blank(x: Column | str) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(_text(x), r"(?U)\s", ""))


def query_identifiers(x: Column | str, least: int = 3, most: int = 5) -> Column:
    """The first few identifiers of a query."""
    return F.slice(F.filter(F.regexp_extract_all(_text(x), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1), lambda w: F.length(w) >= least), 1, most)


def honest_truncate(x: Column | str, limit: int) -> Column:
    """At most limit characters, with a note of by how many the text was longer."""
    x = _text(x)
    note = F.concat(F.lit("... [cut "), (F.length(x) - limit).cast("string"), F.lit(" chars]"))
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, F.lit(1), F.greatest(F.lit(0), F.lit(limit) - F.length(note))), note))


def clip(x: Column | str, limit: int) -> Column:
    """One line of at most limit characters; a cut one ends in three dots."""
    one = F.trim(F.regexp_replace(_text(x), r"\s+", " "))
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit), F.lit("..."))).otherwise(one)


def repo_of_url(x: Column | str) -> Column:
    """The last part of a url's path, without .git and a closing slash."""
    return F.regexp_extract(F.regexp_replace(_text(x), r"(\.git)?/*$", ""), r"([^/:]*)$", 1)


def outer_json(x: Column | str) -> Column:
    """The text from the first { to the last }, fences removed; null unless it is JSON."""
    found = F.nullif(F.regexp_extract(F.regexp_replace(_text(x), r"```[a-z]*", ""), r"(?s)\{.*\}", 0), F.lit(""))
    # The parser takes what stands behind a closed value, so brackets are counted, those in strings aside.
    bare = F.regexp_replace(found, r'"(\\.|[^"\\])*"', "")
    even = lambda a, b: F.length(F.translate(bare, a, "")) == F.length(F.translate(bare, b, ""))
    return F.when(F.try_parse_json(found).isNotNull() & even("{", "}") & even("[", "]"), found)


def first_line_number(x: Column | str) -> Column:
    """The first integer of "a", "a,b" or "a-b"; anything else is null."""
    return F.trim(F.split(F.split(F.trim(_text(x)), ",").getItem(0), "-").getItem(0)).try_cast("int")


def token_estimate(x: Column | str) -> Column:
    """A quarter of the characters, and one."""
    return (F.floor(F.length(_text(x)) / 4) + 1).cast("long")


def ignored_name(x: Column | str) -> Column:
    """Whether a search leaves the name out."""
    x = _text(x)
    return x.isin(*IGNORED_NAMES) | F.coalesce(F.regexp_extract(x, r"\.([^.]+)$", 1).isin(*IGNORED_SUFFIXES), F.lit(False))


def binary_text(x: Column | str) -> Column:
    """A NUL, or over 5 % control characters, in the first 1000 characters."""
    head = F.substring(_text(x), 1, 1000)
    controls = F.length(head) - F.length(F.regexp_replace(head, r"[\x01-\x08\x0b\x0c\x0e-\x1f]", ""))
    return F.coalesce(head.contains("\0") | (controls > 0.05 * F.length(head)), F.lit(False))


def binary_bytes(content: Column | str, sniff: int = 8192) -> Column:
    """A NUL or invalid UTF-8 in the first bytes, or nothing to read. A character that the limit cuts counts as invalid."""
    head = F.substring(_text(content), 1, sniff)
    return F.coalesce((F.instr(F.decode(head, "ISO-8859-1"), "\0") > 0) | ~F.is_valid_utf8(head.cast("string")), F.lit(True))


def language_of_path(x: Column | str) -> Column:
    """python or c by suffix, else null."""
    suffix = F.lower(F.regexp_extract(_text(x), r"\.([^./]+)$", 1))
    return F.when(suffix.isin("py", "pyi"), "python").when(suffix.isin("c", "h"), "c")


def paths_match(a: Column, b: Column) -> Column:
    """Equal, of equal last part, or one ends in the other."""
    base = lambda p: F.element_at(F.split(p, "/"), -1)
    return (a == b) | (base(a) == base(b)) | a.endswith(b) | b.endswith(a)


def transient_error(status: Column, message: Column) -> Column:
    """An error whose message says that it passes."""
    low = F.lower(F.coalesce(message, F.lit("")))
    found = F.lit(False)
    for part in TRANSIENT:
        found = found | low.contains(part)
    return (status == "error") & found


def output_budget(x: Column | str, externalize: int = 30_000, fallback: int = 20_000) -> Column:
    """What becomes of a tool's output: externalize, cut or keep. Between the two limits it is cut."""
    n = F.length(_text(x))
    return F.when(n > externalize, "externalize").when(n > fallback, "cut").otherwise("keep")


def baseline_name(path: Column | str) -> Column:
    """A relative path's parts in reverse, joined by -."""
    return F.concat_ws("-", F.reverse(F.filter(F.split(_text(path), "/"), lambda p: p != "")))
