"""Symbols, imports and exports of source files: Python by its syntax tree, JavaScript and TypeScript by patterns.

Each file is parsed in a task, by a parser that its type names; more can be
registered. A file that can't be parsed, or of a type without a parser, has no symbols.
Python is parsed in pieces of whole statements, so that a long file's tree is never
held at once; the result is that of the whole.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SYMBOL = (
    "struct<name: string, symbol_type: string, line_start: int, line_end: int, column_start: int, column_end: int, documentation: string, signature: string, parameters: array<string>, "
    "return_type: string, visibility: string, is_async: boolean, is_static: boolean, is_exported: boolean, bases: array<string>>"
)
PARSED = f"symbols array<{SYMBOL}>, imports array<string>, exports array<string>, error string"
Parsed = tuple[list[dict], list[str], list[str]]


def _symbol(name: str, kind: str, start: int, end: int, column: int = 1, end_column: int = 1, **more) -> dict:
    base = {"documentation": None, "signature": None, "parameters": [], "return_type": None, "visibility": "private" if name.startswith("_") else "public", "is_async": False, "is_static": False, "is_exported": False, "bases": []}
    return {"name": name, "symbol_type": kind, "line_start": start, "line_end": end, "column_start": column, "column_end": end_column} | base | more


def _place(node: ast.AST) -> tuple[int, int, int, int]:
    return node.lineno, node.end_lineno, node.col_offset + 1, node.end_col_offset + 1


def _exports(tree: ast.Module) -> list[str]:
    """Names in a list or tuple assigned to __all__."""
    out: list[str] = []
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AugAssign | ast.AnnAssign) else []
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(node.value, ast.List | ast.Tuple):
            out += [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return out


#: Characters of a piece of a Python file, at least.
PIECE = 1 << 16
_STATEMENT = re.compile(r"\n(?=[^\s#)\]}])(?!(?:else|elif|except|finally)\b)")


def python_pieces(content: str, piece: int = PIECE) -> Iterator[tuple[ast.Module, int]]:
    """The trees of a file's pieces, with the lines before each.

    A piece ends before a line that begins a statement at the margin. Where that
    line is within a string, brackets or a statement that goes on, the piece alone
    is no valid text, and a longer one is tried.
    """
    at = before = 0
    while at < len(content) or not at:
        size = piece
        while True:
            end = _STATEMENT.search(content, at + size)
            text = content[at : end.end() if end else len(content)]
            try:
                tree = ast.parse(text)
                break
            except (SyntaxError, ValueError):
                if not end:
                    raise
                size *= 2
        yield tree, before
        at += len(text)
        before += text.replace("\r\n", "\n").replace("\r", "\n").count("\n")
        if not text:
            break


def _python_symbols(tree: ast.Module, before: int) -> tuple[list[list[dict]], list[tuple[int, str]]]:
    """The symbols of a piece (functions, classes, variables, imports), not marked as exported yet, and its imports."""
    inside = {id(n) for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for n in c.body}
    functions, classes, variables, imported, imports = [], [], [], [], []

    def place(node: ast.AST) -> tuple[int, int, int, int]:
        start, end, column, end_column = _place(node)
        return start + before, end + before, column, end_column

    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            a = node.args
            names = [x.arg for x in (*a.posonlyargs, *a.args)] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
            said = f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({ast.unparse(a)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
            functions.append(
                _symbol(
                    node.name, "method" if id(node) in inside else "function", *place(node), documentation=ast.get_docstring(node), signature=said, parameters=names, return_type=ast.unparse(node.returns) if node.returns else None,
                    is_async=isinstance(node, ast.AsyncFunctionDef), is_static=any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in node.decorator_list),
                )
            )
        elif isinstance(node, ast.ClassDef):
            classes.append(_symbol(node.name, "class", *place(node), documentation=ast.get_docstring(node), signature=f"class {node.name}", bases=[ast.unparse(b) for b in node.bases]))
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            target = target.elts[0] if isinstance(target, ast.Tuple) and target.elts else target
            if isinstance(target, ast.Name):
                variables.append(_symbol(target.id, "constant" if target.id.isupper() else "variable", *place(node)))
        elif isinstance(node, ast.Import | ast.ImportFrom):
            text = ast.unparse(node)
            imports.append((node.lineno + before, text))
            imported += [_symbol(n.asname or n.name, "import", *place(node), signature=text) for n in node.names]
    by_line = lambda s: (s["line_start"], s["column_start"])
    return [sorted(part, key=by_line) for part in (functions, classes, variables, imported)], imports


def _whole(content: str, take: Callable[[list[dict]], object], piece: int = PIECE) -> tuple[list[list], list[str], list[str]]:
    """Of each of the four kinds what ``take`` makes of a piece's symbols, piece by piece; imports; exports."""
    kinds, imports, exports = ([], [], [], []), [], []
    try:
        for tree, before in python_pieces(content, piece):
            exports += _exports(tree)
            parts, more = _python_symbols(tree, before)
            imports += more
            for kept, part in zip(kinds, parts):
                if part:
                    kept.append(take(part))
    except (SyntaxError, ValueError):
        ast.parse(content)  # says what is wrong, and where in the whole
        raise
    return list(kinds), [t for _, t in sorted(imports)], exports


def parse_python(content: str, piece: int = PIECE) -> Parsed:
    """Functions, methods (functions right in a class), classes, variables and constants at any depth, and imports, in this order of kinds."""
    kinds, imports, exports = _whole(content, list, piece)
    public = set(exports)
    symbols = [s for kept in kinds for part in kept for s in part]
    for s in symbols:
        s["is_exported"] = s["symbol_type"] != "import" and s["name"] in public
    return symbols, imports, exports


_JS = {
    "function": re.compile(r"^[ \t]*(export\s+)?(?:default\s+)?(async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(([^)]*)\)", re.M),
    "arrow": re.compile(r"^[ \t]*(export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(async\s+)?(?:function\b[^(]*)?\(([^)]*)\)\s*(?:=>|\{)", re.M),
    "class": re.compile(r"^[ \t]*(export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([\w$.]+))?", re.M),
    "method": re.compile(r"^[ \t]+(static\s+)?(async\s+)?(?!(?:if|for|while|switch|catch|function|return)\b)([A-Za-z_$][\w$]*)\s*\(([^)]*)\)\s*\{", re.M),
    "variable": re.compile(r"^[ \t]*(export\s+)?(const|let|var)\s+([A-Za-z_$][\w$]*)\s*=(?!=)", re.M),
    "import": re.compile(r"^[ \t]*import\s+[^;\n]+|\brequire\s*\(\s*['\"][^'\"]+['\"]\s*\)", re.M),
    "export": re.compile(r"^[ \t]*export\s*\{([^}]*)\}|^[ \t]*module\.exports\s*=\s*\{([^}]*)\}|^[ \t]*export\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class|const|let|var)\s+([A-Za-z_$][\w$]*)", re.M),
}


def _without_comments(content: str) -> str:
    """The text with comments blanked, so that places stay."""
    return re.sub(r"/\*.*?\*/|(?<![:'\"\\])//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), content, flags=re.S)


def parse_javascript(content: str) -> Parsed:
    """Functions, methods (within the braces of a class), classes with what they extend, variables (const: constants), imports and exports."""
    text = _without_comments(content)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def line(at: int) -> int:
        from bisect import bisect_right

        return bisect_right(starts, at)

    def block(at: int) -> int:
        """The place where the braces that open from a place on are closed."""
        depth = 0
        for m in re.compile(r"[{}]").finditer(text, at):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return m.start()
        return len(text) - 1 if text else 0

    def params(said: str) -> list[str]:
        return [re.split(r"[=:\s]", p.strip(), maxsplit=1)[0] for p in said.split(",") if p.strip()]

    def first(m: re.Match) -> int:
        return m.start() + len(m[0]) - len(m[0].lstrip())

    def document(at: int) -> str | None:
        before = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*$", content[:at], re.S)
        return " ".join(x.strip(" \t*") for x in before[1].splitlines() if x.strip(" \t*")) if before else None

    def made(m: re.Match, name: str, kind: str, end: int, **more) -> dict:
        at = first(m)
        return _symbol(name, kind, line(at), line(end), at - starts[line(at) - 1] + 1, end - starts[line(end) - 1] + 2, documentation=document(at), signature=text[at : m.end()].split("{")[0].strip(), **more)

    symbols, taken = [], set()
    for m in _JS["function"].finditer(text):
        symbols.append(made(m, m[3], "function", block(m.end()), parameters=params(m[4]), is_async=bool(m[2]), is_exported=bool(m[1])))
    for m in _JS["arrow"].finditer(text):
        taken.add(first(m))
        end = block(m.end() - 1) if text[m.end() - 1] == "{" or text[m.end() :].lstrip().startswith("{") else text.find("\n", m.end())
        symbols.append(made(m, m[2], "function", end if end >= 0 else len(text) - 1, parameters=params(m[4]), is_async=bool(m[3]), is_exported=bool(m[1])))
    for m in _JS["class"].finditer(text):
        end = block(m.end())
        symbols.append(made(m, m[2], "class", end, bases=[m[3]] if m[3] else [], is_exported=bool(m[1])))
        for k in _JS["method"].finditer(text, m.end(), end):
            symbols.append(made(k, k[3], "method", block(k.end() - 1), parameters=params(k[4]), is_async=bool(k[2]), is_static=bool(k[1])))
    for m in _JS["variable"].finditer(text):
        if first(m) not in taken:
            end = text.find("\n", m.end())
            symbols.append(made(m, m[3], "constant" if m[2] == "const" else "variable", end if end >= 0 else len(text) - 1, is_exported=bool(m[1])))
    imports = [m[0].strip() for m in _JS["import"].finditer(text)]
    exports = [n for m in _JS["export"].finditer(text) for n in ([x.strip().split(" as ")[0].split(":")[0].strip() for x in (m[1] or m[2]).split(",") if x.strip()] if m[1] or m[2] else [m[3]])]
    named = {s["name"] for s in symbols}
    for s in symbols:
        s["is_exported"] = s["is_exported"] or s["name"] in exports
    symbols += [_symbol(n, "export", 1, 1, is_exported=True) for n in exports if n not in named]
    return sorted(symbols, key=lambda s: (s["line_start"], s["column_start"], s["name"])), imports, exports


#: Parsers by file type; ``register`` adds to them before a job is made.
PARSERS: dict[str, Callable[[str], Parsed]] = {"python": parse_python, "javascript": parse_javascript, "typescript": parse_javascript}


def register(file_type: str, parser: Callable[[str], Parsed]) -> None:
    """Takes a parser for the files of a type."""
    PARSERS[file_type] = parser


def supported() -> list[str]:
    """File types that there is a parser for."""
    return sorted(PARSERS)


#: Files, symbols and characters that a task puts out at once; a file is never divided.
FLUSH_FILES, FLUSH_SYMBOLS, FLUSH_CHARACTERS = 1000, 20_000, 8 << 20


def _packed(parse: Callable[[str], Parsed], content: str, kind: pa.DataType) -> tuple[pa.Array, list[str], list[str]]:
    """A file's symbols as an Arrow array, made piece by piece where the parser works so."""
    if parse is not parse_python:
        symbols, imports, exports = parse(content)
        return pa.array(symbols, kind), imports, exports
    kinds, imports, exports = _whole(content, lambda part: pa.array(part, kind))
    symbols = pa.concat_arrays([x for kept in kinds for x in kept] or [pa.array([], kind)])
    if exports:
        public, at = set(exports), kind.get_field_index("is_exported")
        fields = symbols.flatten()
        names, types = (fields[kind.get_field_index(c)].to_pylist() for c in ("name", "symbol_type"))
        fields[at] = pa.array([t != "import" and n in public for n, t in zip(names, types)], pa.bool_())
        symbols = pa.StructArray.from_arrays(fields, fields=list(kind))
    return symbols, imports, exports


def parsed(files: DataFrame) -> DataFrame:
    """``files`` (with file_type and content) and their symbols, imports, exports, and what went wrong."""
    from pyspark.sql.pandas.types import to_arrow_type

    parsers = dict(PARSERS)
    symbol_kind = to_arrow_type(StructType.fromDDL(f"s {SYMBOL}")["s"].dataType)
    words = pa.list_(pa.string())

    def out(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        offsets = np.cumsum([0] + [len(r[0]) for r in rows])
        symbols = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays([r[0] for r in rows]))
        more = [symbols, *[pa.array([r[i] for r in rows], kind) for i, kind in ((1, words), (2, words), (3, pa.string()))]]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "symbols", "imports", "exports", "error"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = pa.array([], symbol_kind)
        for batch in batches:
            kinds, contents = batch.column("file_type"), batch.column("content")
            rows, first, symbols, characters = [], 0, 0, 0
            for i in range(batch.num_rows):
                kind, content = kinds[i].as_py(), contents[i].as_py() or ""
                try:
                    rows.append((*_packed(parsers[kind], content, symbol_kind), None) if kind in parsers else (nothing, [], [], None))
                except (SyntaxError, ValueError, RecursionError) as wrong:
                    rows.append((nothing, [], [], f"{type(wrong).__name__}: {wrong}"))
                symbols, characters = symbols + len(rows[-1][0]), characters + len(content)
                if i == batch.num_rows - 1 or len(rows) >= FLUSH_FILES or symbols >= FLUSH_SYMBOLS or characters >= FLUSH_CHARACTERS:
                    yield out(batch.slice(first, len(rows)), rows)
                    rows, first, symbols, characters = [], i + 1, 0, 0

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(work, f"{schema}, {PARSED}")
