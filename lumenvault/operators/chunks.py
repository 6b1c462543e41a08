"""Source files to symbols and chunks, and reports to passages.

Parsing and greedy filling are sequential within a file, so they run in Python on
one file at a time; files are spread over tasks as they are read.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_CHARS = 16_000
PASSAGE_CHARS = 6_000
SYMBOL = "name string, qualified_name string, kind string, language string, file string, start_line int, end_line int, signature string, docstring string"
CHUNK = "id string, symbol string, kind string, file string, language string, start_line int, end_line int, part int, total int, text string, content_hash string"
_C_FUNCTION = re.compile(r"^[A-Za-z_][\w\s*]*?\b([A-Za-z_]\w*)\s*\([^;{}()]*\)\s*\{", re.M)


# Strings and comments, whose brackets don't count, or a bracket.
_TOKEN = re.compile(
    r"""(?P<quote>\"{3}|\x27{3})(?:\\.|(?!(?P=quote)).)*(?P=quote)|\"(?:\\.|[^\"\\\n])*\"|\x27(?:\\.|[^\x27\\\n])*\x27|\#[^\n]*|(?P<open>[(\[{])|(?P<close>[)\]}])""", re.S
)
#: The fields of a statement that hold statements, in their order; expressions hold no definitions.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")
_DEF = re.compile(r"\s*(?:async\s+)?def\s+\w+\s*")


def parameters(source: str) -> str:
    """The parameters of a function that source begins with, from ( to its ), over as many lines as they have; () if there are none."""
    head, depth, opened = _DEF.match(source), 0, None
    for m in _TOKEN.finditer(source, head.end()) if head else ():
        if m["open"]:
            if not depth and m["open"] == "(":
                opened = m.start()
            depth += 1
        elif m["close"]:
            depth -= 1
            if not depth and opened is not None:
                return source[opened : m.end()]
    return "()"


def python_symbols(source: str, file: str) -> list[dict]:
    """Functions, methods and classes in order; a function in a class is a method. Source that doesn't parse has none.

    The signature of a function is its parameters as they stand, a class has none.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, found = source.split("\n"), []

    def walk(node: ast.AST, scope: list[tuple[str, str]]) -> None:
        for child in (c for block in _BLOCKS for c in getattr(node, block, ())):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if scope and scope[-1][1] == "class" else "function"
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                found.append({"name": child.name, "qualified_name": ".".join([*(s for s, _ in scope), child.name]), "kind": kind, "language": "python", "file": file, "start_line": first, "end_line": child.end_lineno, "signature": None if is_class else parameters("\n".join(lines[child.lineno - 1 : child.end_lineno])), "docstring": ast.get_docstring(child, clean=False)})
                walk(child, [*scope, (child.name, kind)])
            else:
                walk(child, scope)

    walk(tree, [])
    return found


def c_symbols(source: str, file: str) -> list[dict]:
    """H4: functions of C by pattern; braces are counted for the end. An approximation: there is no C grammar here."""
    found = []
    for m in _C_FUNCTION.finditer(source):
        depth, at = 0, m.end() - 1
        for at in range(m.end() - 1, len(source)):
            depth += (source[at] == "{") - (source[at] == "}")
            if not depth:
                break
        found.append({"name": m[1], "qualified_name": m[1], "kind": "function", "language": "c", "file": file, "start_line": source.count("\n", 0, m.start()) + 1, "end_line": source.count("\n", 0, at) + 1, "signature": m[0].rstrip("{ \n"), "docstring": None})
    return found


def symbols_of(source: str, file: str) -> list[dict]:
    suffix = file.rsplit(".", 1)[-1].lower()
    return python_symbols(source, file) if suffix in ("py", "pyi") else c_symbols(source, file) if suffix in ("c", "h") else []


def fill(lines: list[tuple[int, str]], most: int = CHUNK_CHARS) -> list[tuple[int, int, str]]:
    """(first line, last line, text): lines in order, as many in a part as fit; a line that is too long is a part alone."""
    parts: list[list[tuple[int, str]]] = []
    size = 0
    for number, line in lines:
        if not parts or size + len(line) + 1 > most:
            parts.append([])
            size = 0
        parts[-1].append((number, line))
        size += len(line) + 1
    return [(p[0][0], p[-1][0], "\n".join(x for _, x in p)) for p in parts]


def chunks_of(source: str, file: str, most: int = CHUNK_CHARS) -> list[dict]:
    """A chunk for each symbol, in parts if it is long, and the rest of the file as module chunks; no id twice."""
    lines, symbols = source.split("\n"), symbols_of(source, file)
    language = "python" if file.endswith((".py", ".pyi")) else "c" if file.endswith((".c", ".h")) else None
    out, seen, covered = [], set(), set()

    def add(name: str, kind: str, parts: list[tuple[int, int, str]]) -> None:
        for k, (first, last, text) in enumerate(parts, 1):
            key = f"{file}:{name}" + (f":p{k}" if len(parts) > 1 else "")
            if key not in seen:
                seen.add(key)
                out.append({"id": key, "symbol": name, "kind": kind, "file": file, "language": language, "start_line": first, "end_line": last, "part": k, "total": len(parts), "text": text, "content_hash": hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()})

    for s in symbols:
        first, last = max(1, s["start_line"]), min(len(lines), s["end_line"])
        covered.update(range(first, last + 1))
        if s["kind"] != "class" or not any(o["start_line"] > first and o["end_line"] <= last for o in symbols):
            add(s["qualified_name"], s["kind"], fill(list(enumerate(lines[first - 1 : last], first)), most))
        else:
            inner = {n for o in symbols if o is not s and first < o["start_line"] and o["end_line"] <= last for n in range(o["start_line"], o["end_line"] + 1)}
            add(s["qualified_name"], s["kind"], fill([(n, lines[n - 1]) for n in range(first, last + 1) if n not in inner], most))
    rest = [(n, x) for n, x in enumerate(lines, 1) if n not in covered and x.strip()]
    if rest:
        add("<module>", "module", fill(rest, most))
    return out


def passages_of(text: str | None, most: int = PASSAGE_CHARS) -> list[str]:
    """Sections by headers, each filled with paragraphs up to a size; a longer paragraph stays whole."""
    out = []
    for section in re.split(r"(?m)^(?=#{1,6} )", text or ""):
        size, parts = 0, []
        for paragraph in re.split(r"\n\s*\n", section.strip()):
            if parts and size + len(paragraph) + 2 > most:
                out.append("\n\n".join(parts))
                size, parts = 0, []
            parts.append(paragraph)
            size += len(paragraph) + 2
        if any(p.strip() for p in parts):
            out.append("\n\n".join(parts))
    return out


def outline_of(spans: list[tuple[int, int]], n_lines: int, visible: int = 50, limit: int = 100) -> list[tuple[int, int]]:
    """The bodies that stay folded: small ones are opened first until enough lines show, but none that breaks the limit."""
    outer, last = [], 0
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if b > last:
            outer.append((a, b))
            last = b
    shown = n_lines - sum(b - a for a, b in outer)
    folded = set(outer)
    for a, b in sorted(outer, key=lambda s: (s[1] - s[0], s)):
        if shown >= visible:
            break
        if shown + b - a <= limit:
            folded.discard((a, b))
            shown += b - a
    return sorted(folded)


def _rows(df: DataFrame, make, schema: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = _parse_datatype_string(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = to_arrow_schema(target)
        for batch in batches:
            columns: dict[str, list] = {f.name: [] for f in form}
            for file, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in make(source or "", file or ""):
                    for name, values in columns.items():
                        values.append(row[name])
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in form], schema=form)

    return df.mapInArrow(each, target)


def parse_symbols(files: DataFrame) -> DataFrame:
    """All symbols of files (file, source)."""
    return _rows(files.select("file", "source"), symbols_of, SYMBOL)


def chunk_files(files: DataFrame) -> DataFrame:
    """All chunks of files (file, source)."""
    return _rows(files.select("file", "source"), chunks_of, CHUNK)


def passages(reports: DataFrame) -> DataFrame:
    """(report, place, passage) of reports (report, text), report a string."""
    return _rows(reports.select("report", "text"), lambda text, report: [{"report": report, "place": k, "passage": p} for k, p in enumerate(passages_of(text))], "report string, place int, passage string")
