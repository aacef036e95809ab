"""Code structure of one source text, in plain Python: definitions, identifier occurrences, skeletons.

Python is parsed by its own grammar; on a syntax error, and for other languages, comments and strings are masked and
definitions are found by their heads and matched braces (Ruby: by indentation of `end`). Offsets are code points.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
from dataclasses import dataclass

BRACED = ("javascript", "typescript", "tsx", "go", "rust", "java", "c", "cpp", "c_sharp", "php", "kotlin", "swift", "scala", "dart")
SUPPORTED = ("python", "ruby", *BRACED)
CONTAINERS = ("class", "struct", "interface", "module", "enum", "impl")
WORD = re.compile(r"[^\W\d]\w*")
OPENING = re.compile(r"[ \t]*\(")
INDENTED = re.compile(r"^([ \t]*)\S", re.M)


@dataclass
class Definition:
    name: str
    kind: str
    start: int
    end: int
    body: tuple[int, int] | None  # what a skeleton replaces
    depth: int = 0
    parent: int = -1
    ext: bool = False  # found beyond plain functions and types: arrow functions, Go types, Rust traits


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


# --- Python -------------------------------------------------------------------------------------------------------


def _offsets(text: str):
    """Code-point offset of (line, byte column)."""
    lines = text.split("\n")
    starts = line_starts(text)
    return lambda line, col: starts[line - 1] + len(lines[line - 1].encode()[:col].decode(errors="ignore"))


def _python(text: str) -> list[Definition]:
    at, out = _offsets(text), []

    def visit(node, parent: int, depth: int, inside: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = child.body[0]
                told = isinstance(first, ast.Expr) and isinstance(getattr(first, "value", None), (ast.Constant, ast.JoinedStr)) and isinstance(getattr(first.value, "value", ""), (str, bytes))
                start = at(first.end_lineno, first.end_col_offset) if told else at(first.lineno, first.col_offset)
                end = at(child.end_lineno, child.end_col_offset)
                out.append(Definition(child.name, "method" if inside == "class" else "function", at(child.lineno, child.col_offset), end, (start, end) if start < end else None, depth, parent))
                visit(child, len(out) - 1, depth + 1, "function")
            elif isinstance(child, ast.ClassDef):
                out.append(Definition(child.name, "class", at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset), None, depth, parent))
                visit(child, len(out) - 1, depth + 1, "class")
            else:
                visit(child, parent, depth, inside)

    visit(ast.parse(text), -1, 0, "")
    return out


def _python_by_indent(text: str) -> list[Definition]:
    masked, out, open_ = mask(text, "python"), [], []
    heads = list(re.finditer(r"^([ \t]*)(async[ \t]+def|def|class)[ \t]+(\w+)[^\n]*", masked, re.M))
    for m in heads:
        indent = len(m[1].expandtabs())
        end = len(text)
        for later in INDENTED.finditer(masked, m.end()):
            if len(later[1].expandtabs()) <= indent:
                end = later.start()
                break
        end = m.start() + len(text[m.start() : end].rstrip())
        while open_ and (open_[-1][0] >= indent or out[open_[-1][1]].end <= m.start()):
            open_.pop()
        parent = open_[-1][1] if open_ else -1
        kind = "class" if m[2] == "class" else "method" if parent >= 0 and out[parent].kind == "class" else "function"
        body = text.find(":", m.end() - 1, end)
        out.append(Definition(m[3], kind, m.start() + len(m[1]), end, (m.end() + 1, end) if kind != "class" and m.end() + 1 < end and body != -2 else None, len(open_), parent))
        open_.append((indent, len(out) - 1))
    return out


# --- other languages ----------------------------------------------------------------------------------------------

STRINGS = {"python": r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*", "ruby": r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|#[^\n]*", "rust": r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'|//[^\n]*|/\*.*?\*/"}
C_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/"
PHP_STRINGS = C_STRINGS + r"|#[^\n]*"


def mask(text: str, language: str) -> str:
    """The text with the insides of comments and strings blanked, all positions kept."""
    pattern = STRINGS.get(language, PHP_STRINGS if language == "php" else C_STRINGS)
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "new", "else", "do", "match", "sizeof", "using", "lock", "function", "fn", "when", "synchronized", "await", "throw"}
TYPES = r"\b(class|interface|struct|enum|namespace|trait|object|record|protocol|mod)\s+([A-Za-z_]\w*)[^;{}()=]*\{"
GENERIC = r"(?:^|[;{}\n])[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*((?:[\w<>\[\],:&*~?.]+[ \t\n]+[*&]*)+|)([A-Za-z_~]\w*)[ \t]*\((?:[^(){};]|\([^()]*\))*\)[^;{}()=]*(?:throws[^{;]*)?\{"
HEADS = {
    "go": [(r"\bfunc\s*(\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\([^{}]*?\{", None), (r"\btype\s+(\w+)\s+(struct|interface)\s*\{", "type")],
    "rust": [(r"\bfn\s+(\w+)[^;{}]*\{", "function"), (r"\bimpl(?:<[^>{]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)[^{;]*\{", "impl")],
    "php": [(r"\bfunction\s+&?(\w+)\s*\([^{};]*\{", "function")],
    "kotlin": [(r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\([^{};]*?\)\s*(?::\s*[\w<>?., ]+)?\s*\{", "function")],
    "swift": [(r"\bfunc\s+(\w+)[^{};]*\{", "function")],
    "javascript": [
        (r"\bfunction\s*\*?\s*(\w+)\s*\([^{};]*\)\s*(?::[^{;=]+)?\{", "function"),
        (r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^{};]*?\)|\w+)\s*(?::[^={;]+)?=>\s*\{", "arrow"),
        (r"(?:^|[;{}])[ \t\n]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+|\*\s*)*(#?\w+)\s*\((?:[^(){};]|\([^()]*\))*\)\s*(?::[^{;=()]+)?\{", "member"),
    ],
}
HEADS["typescript"] = HEADS["tsx"] = HEADS["javascript"]


def _closing(masked: str, opening: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, opening):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(masked)


def _braced(text: str, language: str) -> list[Definition]:
    masked = mask(text, language)
    found: dict[int, Definition] = {}

    def add(name: str, kind: str, start: int, brace: int, ext: bool = False) -> None:
        end = _closing(masked, brace)
        body = None if kind in (*CONTAINERS, "trait") or end - brace <= 2 else (brace + 1, end - 1)
        found.setdefault(brace, Definition(name, kind, start, end, body, ext=ext))

    for m in re.finditer(TYPES, masked):
        kind = {"namespace": "module", "mod": "module", "trait": "interface", "object": "class", "record": "class", "protocol": "interface"}.get(m[1], m[1])
        add(m[2], kind, m.start(), m.end() - 1, ext=m[1] in ("trait", "mod"))
    for pattern, kind in HEADS.get(language, [(GENERIC, "generic")]):
        at = 0
        while m := re.compile(pattern, re.M).search(masked, at):
            at = max(m.end() - 1, m.start() + 1)
            brace, group = m.end() - 1, 2 if kind in ("generic", None) else 1
            name, start = m[group], m.start(group)
            if kind == "generic":
                words = (m[1] or "").split()
                if name in NOT_NAMES or (words and words[-1] in NOT_NAMES) or (not words and language not in ("java", "c_sharp", "cpp", "dart")):
                    continue
                start = m.start(1) if words else start
                label = re.compile(r"\s*(?:public|private|protected)\s*:(?!:)").match(masked, start, brace)
                start = label.end() if label else start
                start += len(masked[start:brace]) - len(masked[start:brace].lstrip())
                noted = masked.find("@", m.start(), m.start(1))  # annotations belong to what they stand before
                start = noted if noted >= 0 else start
            elif kind == "member":
                if name in NOT_NAMES:
                    continue
            elif kind != "type":
                start = m.start()
            if kind == "type":
                add(m[1], m[2], m.start(), brace, ext=True)
            elif kind == "impl":
                add(name, "impl", m.start(), brace)
            else:
                add(name, "method" if kind is None and m[1] or kind == "member" else "function", start, brace, ext=kind == "arrow")
    return _nested(sorted(found.values(), key=lambda d: (d.start, -d.end)))


def _ruby(text: str) -> list[Definition]:
    masked, out = mask(text, "ruby"), []
    for m in re.finditer(r"^([ \t]*)(class|module|def)[ \t]+(?:self\.)?([A-Za-z_]\w*(?:::\w+)*[?!=]?)[^\n]*", masked, re.M):
        close = re.compile(rf"^{re.escape(m[1])}end\b", re.M).search(masked, m.end())
        end = close.end() if close else len(text)
        body = (m.end(), close.start()) if m[2] == "def" and close and masked[m.end() : close.start()].strip() else None
        out.append(Definition(m[3], "method" if m[2] == "def" else m[2], m.start() + len(m[1]), end, body))
    return _nested(out)


def _nested(found: list[Definition]) -> list[Definition]:
    """Parents and depths by containment; functions directly inside a container are methods."""
    open_: list[int] = []
    for i, d in enumerate(found):
        while open_ and found[open_[-1]].end <= d.start:
            open_.pop()
        d.parent, d.depth = (open_[-1] if open_ else -1), len(open_)
        if d.kind == "function" and open_ and found[open_[-1]].kind in ("class", "struct", "interface", "impl", "enum"):
            d.kind = "method"
        open_.append(i)
    return found


def definitions(text: str, language: str | None) -> list[Definition] | None:
    """In order of their start; None for a language that is not supported."""
    if language == "python":
        try:
            return _python(text)
        except (SyntaxError, ValueError, RecursionError):
            return _python_by_indent(text)
    if language == "ruby":
        return _ruby(text)
    return _braced(text, language) if language in BRACED else None


def symbols(text: str, language: str | None) -> list[tuple]:
    """(ord, name, kind, line, end_line, signature, full_signature, depth, parent_ord, ext, content_hash); impl blocks only give their methods."""
    starts, out = line_starts(text), []
    for i, d in enumerate(definitions(text, language) or []):
        if d.kind == "impl":
            continue
        line, end = bisect.bisect_right(starts, d.start), bisect.bisect_right(starts, max(d.start, d.end - 1))
        first = text[starts[line - 1] : starts[line] if line < len(starts) else len(text)].strip()
        head = text[d.start : d.body[0] if d.body else d.end]
        full = " ".join(re.split(r"[{\n]", head, maxsplit=1)[0].split()) if language != "python" else " ".join(head.split(":\n", 1)[0].split()).rstrip(":") + ":"
        out.append((i, d.name, d.kind, line, end, first, full.rstrip("{ ").strip(), d.depth, d.parent, d.ext, hashlib.sha256(text[d.start : d.end].encode()).hexdigest()[:16]))
    return out


def skeleton(text: str, language: str | None) -> str | None:
    """The text with the bodies of outermost functions replaced; Python docstrings stay. None for a language that is not supported."""
    found = definitions(text, language)
    if found is None:
        return None
    filler = {"python": "...", "ruby": "\n    ...\n  "}.get(language, "\n  ...\n")
    out, at = "", 0
    for start, end in sorted(d.body for d in found if d.body):
        if start < at:
            continue
        lead = ""
        if language == "python" and text[start - 1 : start] in ('"', "'"):
            lead = "\n" + " " * _indent(text, start)
        out += text[at:start] + lead + filler
        at = end
    return out + text[at:]


def _indent(text: str, at: int) -> int:
    """The indentation of the statement that ends at this place; of a docstring of many lines, of its first line."""
    for quote in ('"""', "'''"):
        if text[at - 3 : at] == quote:
            at = text.rfind(quote, 0, at - 3)
            break
    line = text[text.rfind("\n", 0, at) + 1 : at]
    return len(line) - len(line.lstrip())


def imports(text: str, language: str | None) -> int:
    """Import statements."""
    pattern = {
        "python": r"^[ \t]*(import|from)[ \t]", "rust": r"^[ \t]*(pub[ \t]+)?use[ \t]", "go": r"^[ \t]*import\b", "java": r"^[ \t]*import[ \t]", "kotlin": r"^[ \t]*import[ \t]",
        "c": r"^[ \t]*#[ \t]*include\b", "cpp": r"^[ \t]*#[ \t]*include\b", "c_sharp": r"^[ \t]*using[ \t]+[\w.]+[ \t]*;", "php": r"^[ \t]*(use|require|include)\b", "ruby": r"^[ \t]*require",
    }.get(language or "", r"^[ \t]*import\b|\brequire\(")
    return len(re.findall(pattern, text, re.M))


def occurrences(text: str, language: str | None) -> list[tuple]:
    """(ord, name, line, kind, snippet, is_def) of every identifier outside strings and comments.

    kind by the nearest that holds: an import line, a call (the name called, or inside its arguments), the bases of a
    class, else USAGE.
    """
    if language not in SUPPORTED:
        return []
    masked, starts = mask(text, language), line_starts(text)
    lines = text.split("\n")
    named = {}
    for d in definitions(text, language) or []:
        m = re.compile(rf"\b{re.escape(d.name)}").search(masked, d.start, d.end)
        if m:
            named[m.start()] = d
    bases = []
    for m in re.finditer(r"\bclass\s+\w+\s*\(([^)]*)\)" if language == "python" else r"\b(?:class|interface)\s+\w+(?:<[^>{]*>)?\s*((?:extends|implements|:)[^{]*)\{|\bclass\s+\w+\s*<\s*([\w:]+)", masked):
        group = 1 if m[1] is not None else 2
        bases.append(m.span(group))
    called: list[bool] = []
    events = sorted([*((m.start(), m[0]) for m in re.finditer(r"[()]", masked)), *((m.start(), "w" + m[0]) for m in WORD.finditer(masked))])
    out, before = [], (-1, "")
    for at, what in events:
        if what == "(":
            called.append(before[0] >= 0 and not masked[before[0] + len(before[1]) : at].strip() and before[1] not in KEYWORDS and before[0] not in named)
        elif what == ")":
            if called:
                called.pop()
            before = (-1, "")
        else:
            name, line = what[1:], bisect.bisect_right(starts, at)
            before = (at, name)
            if name in KEYWORDS:
                continue
            snippet = lines[line - 1].strip()
            if re.match(r"(import|from|use|using|#\s*include|require)\b", snippet):
                kind = "IMPORT"
            elif any(a <= at < b for a, b in bases):
                kind = "INHERITANCE"
            elif OPENING.match(masked, at + len(name)) and at not in named or any(called):
                kind = "CALL"
            else:
                kind = "USAGE"
            out.append((len(out), name, line, kind, snippet, at in named))
    return out


KEYWORDS = set(
    "def class return if elif else for while try except finally with as import from pass lambda yield raise in is not and or None True False self "
    "function const let var new this super async await export default extends implements interface public private protected static void int float double bool "
    "fn pub use mod struct enum impl trait mut match func package type end module require switch case break continue throw catch".split()
)
