"""Symbols of code with their line ranges, and chunks along them.

A text is read once: strings and comments are blanked, then a stack of open blocks
(braces, indents, or words like begin and end) gives every header the end of its block. A header is
told by its words; members count only directly inside of a type. This is no parser: it knows
where blocks begin and end, and what the words before them say.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.functions.ship import ship

from .chunking import CODE_CHARS, CODE_LINES, chunk_id, split_sentences

#: Lines of a bin of the overlap join.
BIN = 64
BRACES = ("javascript", "typescript", "tsx", "java", "csharp", "go", "c", "cpp", "rust", "kotlin")
LANGUAGES = (*BRACES, "python", "pascal")

# The names that declarations go by, for each language and kind.
DECLARATIONS = {
    "python": {"function": "function_definition", "class": "class_definition"},
    "javascript": {"function": "function_declaration", "method": "method_definition", "class": "class_declaration", "variable": "variable_declarator"},
    "java": {"method": "method_declaration", "class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"},
    "go": {"function": "function_declaration", "method": "method_declaration", "type": "type_declaration"},
    "csharp": {
        "class": "class_declaration", "method": "method_declaration", "constructor": "constructor_declaration", "interface": "interface_declaration", "property": "property_declaration",
        "enum": "enum_declaration", "struct": "struct_declaration", "record": "record_declaration", "namespace": "namespace_declaration",
    },
    "pascal": {"declared": "declProc", "function": "defProc", "class": "declType"},
}
DECLARATIONS |= {"typescript": DECLARATIONS["javascript"], "tsx": DECLARATIONS["javascript"]}

_QUOTES = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_BLANKED = {
    "python": re.compile(r"[rRbBfFuU]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))|#[^\n]*|" + _QUOTES, re.S),
    "pascal": re.compile(r"//[^\n]*|\{.*?(?:\}|\Z)|\(\*.*?(?:\*\)|\Z)|'[^'\n]*'", re.S),
    "csharp": re.compile(_SLASHES + r"|@\"(?:[^\"]|\"\")*\"|" + _QUOTES, re.S),
    "go": re.compile(_SLASHES + r"|`[^`]*`|" + _QUOTES, re.S),
    "rust": re.compile(_SLASHES + r"|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S),
}
_OTHERS = re.compile(_SLASHES + r"|`(?:\\.|[^`\\])*`|" + _QUOTES, re.S)
_NO_NAME = frozenset("if for foreach while switch catch return new using lock fixed throw else do try function await typeof sizeof when".split())
_TYPE_WORDS = ("class", "interface", "struct", "enum", "record", "namespace", "trait", "impl", "object", "type", "module")
_TYPE = re.compile(r"\b(namespace|class|interface|struct|enum|record|trait|impl|object|type|module)\s+(?:class\s+|struct\s+)?([\w.$]+)")
_FUNCTION = {
    "go": re.compile(r"^func\s+(\([^)]*\)\s*)?(\w+)", re.M),
    "rust": re.compile(r"\bfn\s+()(\w+)"),
    "kotlin": re.compile(r"\bfun\s+()(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"),
    "javascript": re.compile(r"\bfunction\b\s*\*?\s*()([\w$]+)"),
}
_VARIABLE = re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]*)?=\s*(?:async\s+)?(?:function\b|(?:\(.*\)|[\w$]+)\s*(?::[^=]*)?=>)", re.S)
# a word is tried once, from its first character
_CALLED = re.compile(r"(?<![\w$#~])([\w$#~]++)\s*+(?:<[^<>()]*+>\s*+)?+\(")
_BRACE, _ROUND, _ENDS = re.compile(r"[{}]"), re.compile(r"[();]"), re.compile(";")
_PROPERTY = re.compile(r"[\w>\]?]\s+(\w+)\s*(?:=>.*)?$", re.S)
_GO_TYPE = re.compile(r"^type\s+(\w+)[^\n{]*$", re.M)


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    parent: str | None = None


def blanked(text: str, language: str) -> str:
    """The text with spaces for strings and comments; lines and places stay."""
    return _BLANKED.get(language, _OTHERS).sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if "\n" in m[0] else " " * len(m[0]), text)


def _told(header: str, language: str, inside: str | None, owner: str | None, body: str | None) -> tuple[str, str, int] | None:
    """(kind, name, place of its first word) of what a header declares. body: what its block begins with, None if it ends without one."""
    family = "javascript" if language in ("javascript", "typescript", "tsx") else language
    # annotations say nothing
    bare = header
    if "[" in header or "@" in header:
        bare = re.sub(r"\[[^\[\]]*\]|@[\w.]+(?:\([^()]*\))?", lambda m: " " * len(m[0]) if not header[header.rfind("\n", 0, m.start()) + 1 : m.start()].strip() else m[0], header)
    m = None
    for word in _TYPE_WORDS if body is not None else ("record", "namespace"):
        if word in bare:
            m = next(reversed(list(_TYPE.finditer(bare))), None)
            break
    if m and "(" not in bare[: m.start()] and "=" not in bare[: m.start()] and (body is not None or m[1] in ("record", "namespace")):
        if family == "go" and m[1] != "type" or family == "javascript" and m[1] not in ("class", "interface", "enum"):
            m = None
        if m:
            return m[1], m[2], _first(bare, m.start())
    known = _FUNCTION.get(family)
    m = next(reversed(list(known.finditer(bare))), None) if known else None
    if m and (body is not None or family in ("rust", "kotlin")):
        return ("method" if m[1] or inside == "type" and family != "javascript" else "function"), m[2], _first(bare, m.start())
    if family == "javascript" and (m := next(reversed(list(_VARIABLE.finditer(bare))), None)):
        return "variable", m[1], _first(bare, m.start())
    if inside == "type" and family in ("javascript", "java", "csharp", "cpp", "c"):
        m = _called(bare)
        if m and m[1] not in _NO_NAME and "=" not in bare[: m.start()] and (body is not None or family in ("java", "csharp") and bare[: m.start()].strip()):
            made = family == "csharp" and m[1] == owner
            return ("constructor" if made else "method"), m[1], _first(bare, m.start())
        if family == "csharp" and "(" not in bare and (m := _PROPERTY.search(bare)):
            if body is None and "=>" in bare or body is not None and re.match(r"\s*(?:\w+\s+)?(?:get|set|init)\b", body):
                return "property", m[1], _first(bare, m.start())
    elif family in ("c", "cpp", "java", "csharp") and inside is None and body is not None:
        m = _called(bare)
        if m and m[1] not in _NO_NAME and "=" not in bare[: m.start()] and bare[: m.start()].strip():
            return "function", m[1], _first(bare, m.start())
    return None


def _called(header: str) -> re.Match | None:
    """The first word that a parenthesis follows."""
    head = header[: max(0, header.find("("))].rstrip()
    # most often the last word before the first one
    return _CALLED.search(header, max(head.rfind(" "), head.rfind("\n")) + 1 if head and (head[-1].isalnum() or head[-1] == "_") else 0)


def _first(header: str, at: int) -> int:
    """Where the line begins that holds a declaration's words."""
    line = header.rfind("\n", 0, at) + 1
    return len(header) - len(header[line:].lstrip())


def _ends(text: str, at: int, stop: int) -> list[int]:
    """Places of the semicolons outside of parentheses between two braces."""
    if text.find("(", at, stop) < 0:
        return [m.start() for m in _ENDS.finditer(text, at, stop)]
    depth, out = 0, []
    for m in _ROUND.finditer(text, at, stop):
        c = m[0]
        if c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(m.start())
    return out


def _in_braces(text: str, language: str) -> Iterator[tuple[str, str, int, int, str | None]]:
    go = language == "go"
    # where a statement without a block declares members of types only, but for what these words begin
    members = language in ("java", "csharp", "c", "cpp")
    # of each open block: its symbol, where that began; what was inside, of and owner around it
    stack: list[tuple] = []
    inside = of = owner = None
    last = 0
    done: list[tuple] = []
    for m in [*_BRACE.finditer(text), None]:
        stop = m.start() if m else len(text)
        ends = _ends(text, last, stop) if text.find(";", last, stop) >= 0 else []
        if m and m[0] == "}":
            ends.append(stop)
        for end in ends:
            header = text[last:end]
            if header.strip():
                if go:
                    # types without a block end with their line; the header's own line is told below
                    done += [("type", t[1], last + t.start(), last + t.end(), None) for t in _GO_TYPE.finditer(header)]
                if not members or inside == "type" or "record" in header or "namespace" in header:
                    told = _told(header, language, inside, of, None)
                    if told:
                        done.append((told[0], told[1], last + told[2], end, owner))
            last = end + 1
        if m and m[0] == "{":
            header = text[last:stop]
            if go and header.strip():
                done += [("type", t[1], last + t.start(), last + t.end(), None) for t in _GO_TYPE.finditer(header[: header.rfind("\n") + 1])]
            told = _told(header, language, inside, of, text[m.end() : m.end() + 80])
            stack.append(((told[0], told[1], last + told[2], owner) if told else None, inside, of, owner))
            inside = "other"
            if told:
                kind, owner = told[0], told[1]
                inside = "type" if kind in ("class", "interface", "struct", "enum", "record", "trait", "impl", "object", "type") else None if kind in ("namespace", "module") else "code"
                if kind not in ("function", "method", "namespace", "module"):
                    of = owner
            last = m.end()
        elif m and stack:
            s, inside, of, owner = stack.pop()
            if s:
                done.append((s[0], s[1], s[2], stop, s[3]))
    if go:
        done += [("type", t[1], last + t.start(), last + t.end(), None) for t in _GO_TYPE.finditer(text[last:])]
    done += [(s[0], s[1], s[2], len(text), s[3]) for s, *_ in stack if s]
    yield from done


def _indented(text: str, original: str) -> Iterator[tuple[str, str, int, int, str | None]]:
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    open_: list[tuple[int, tuple]] = []
    depth, end = 0, 0
    for at in starts:
        stop = text.find("\n", at)
        line = text[at : stop if stop >= 0 else len(text)]
        if line.strip() and not depth:
            indent = len(line.expandtabs()) - len(line.expandtabs().lstrip())
            while open_ and indent <= open_[-1][0]:
                yield (*open_.pop()[1][:3], end, open_[-1][1][1] if open_ else None)
            if m := re.match(r"[ \t]*(?:async[ \t]+)?(def|class)[ \t]+(\w+)", line):
                open_.append((indent, ("function" if m[1] == "def" else "class", m[2], at)))
        depth = max(0, depth + sum((c in "([{") - (c in ")]}") for c in line))
        if original[at : at + len(line)].strip():
            end = at + len(line)
    while open_:
        yield (*open_.pop()[1][:3], end, open_[-1][1][1] if open_ else None)


_PASCAL = re.compile(r"\b(begin|case|try|asm|end|implementation|procedure|function|constructor|destructor)\b|\b(\w+)\s*=\s*(?:packed\s+)?(class|record|object)\b(?!\s*(?:of\b|;))|(;)", re.I)


def _in_words(text: str) -> Iterator[tuple[str, str, int, int, str | None]]:
    stack: list[list] = []  # [word, symbol, where it began]
    told = None  # a routine whose body has not begun
    bodies = "implementation" not in text.lower()
    for m in _PASCAL.finditer(text):
        word = (m[1] or m[3] or m[4]).lower()
        in_type = any(s[0] == "type" for s in stack)
        if word == "implementation":
            bodies, told = True, None
        elif word in ("procedure", "function", "constructor", "destructor"):
            name = re.compile(r"\s+([A-Za-z_][\w.]*)").match(text, m.end())
            if name and not (text[: m.start()].rstrip().endswith(("=", ":", "to"))):
                owner = next((s[1] for s in reversed(stack) if s[1]), None)
                if told and bodies and not in_type:
                    stack.append(["routine", told[0], told[1]])  # a routine within it comes first
                told = (name[1], m.start(), owner)
        elif m[2]:
            stack.append(["type", m[2], m.start()])
        elif word == ";":
            if told and (in_type or not bodies or re.compile(r"\s*forward\b", re.I).match(text, m.end())):
                if text[told[1] : m.start()].count("(") == text[told[1] : m.start()].count(")"):
                    yield "declared", told[0], told[1], m.start(), told[2]
                    told = None
        elif word in ("begin", "case", "try", "asm"):
            if word == "begin" and told:
                stack.append(["body", told[0], told[1]])
                told = None
            elif word == "begin" and stack and stack[-1][0] == "routine":
                stack[-1][0] = "body"
            elif word != "case" or not in_type:
                stack.append([word, None, m.start()])
        elif word == "end" and stack:
            kind, name, at = stack.pop()
            if name:
                yield ("class" if kind == "type" else "function"), name, at, m.end() - 1, next((s[1] for s in reversed(stack) if s[1]), None)


def _placed(text: str, language: str) -> list[tuple[str, str, int, int, str | None]]:
    """(name, kind, first line, last line, parent) of the symbols of one text in order of their places."""
    if not text or language not in LANGUAGES:
        return []
    bare = blanked(text, language)
    found = _indented(bare, text) if language == "python" else _in_words(bare) if language == "pascal" else _in_braces(bare, language)
    lines = [m.start() for m in re.finditer("\n", text)]
    top = max(0, len(text) - 1)
    rows = sorted(found, key=lambda s: (s[2], -s[3]))
    return [(name, kind, bisect_right(lines, a - 1) + 1, bisect_right(lines, min(b, top) - 1) + 1, parent) for kind, name, a, b, parent in rows]


def read(text: str, language: str) -> list[Symbol]:
    """The symbols of one text in order of their places."""
    return [Symbol(*s) for s in _placed(text, language)]


def doc_comment(lines: list[str], declared: int) -> str | None:
    """The words of the /// lines right above a line (from 1), over attributes, without tags."""
    at, found = declared - 2, []
    while at >= 0 and (s := lines[at].strip()) and (s.startswith("///") or s.startswith("[")):
        if s.startswith("///"):
            found.append(s[3:])
        at -= 1
    text = " ".join(re.sub(r"<[^>]*>", " ", " ".join(reversed(found))).split())
    return text or None


def symbols(files: DataFrame) -> DataFrame:
    """(source, name, kind, declaration, start_line, end_line, parent, docstring) of files (source, text, language)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for source, text, language in zip(b["source"], b["text"], b["language"], strict=True):
                lines = (text or "").split("\n") if language == "csharp" else []
                names = DECLARATIONS.get(language, {})
                rows += [(source, s.name, s.kind, names.get(s.kind, s.kind), s.start, s.end, s.parent, doc_comment(lines, s.start) if lines else None) for s in read(text or "", language)]
            yield pd.DataFrame(rows, columns=["source", "name", "kind", "declaration", "start_line", "end_line", "parent", "docstring"])

    ship(files.sparkSession)
    kind = files.schema["source"].dataType.simpleString()
    return files.select("source", "text", "language").mapInPandas(run, f"source {kind}, name string, kind string, declaration string, start_line int, end_line int, parent string, docstring string")


def overlapping(chunks: DataFrame, found: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The chunks (key, source, start_line, end_line, ...) with the symbol that starts last in them, or else starts last of those that reach into them.

    An interval join: both sides are dealt to bins of BIN lines, meet in the first bin that they
    share, and there by their lines. Of symbols with one first line the shorter, then the smaller name counts.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / BIN), F.floor(b / BIN)))
    right = found.select("source", F.col("start_line").alias("__s"), F.col("end_line").alias("__e"), F.col("name").alias("__name"), F.col("kind").alias("__kind"))
    right = right.withColumn("__bin", bins(F.col("__s"), F.col("__e")))
    left = chunks.select(key, "source", "start_line", "end_line").withColumn("__bin", bins(F.col("start_line"), F.col("end_line")))
    met = left.join(right, ["source", "__bin"]).where("__s <= end_line and __e >= start_line")
    met = met.where(F.col("__bin") == F.floor(F.greatest("start_line", "__s") / BIN))
    best = F.min(F.struct((F.col("__s") < F.col("start_line")).alias("before"), (-F.col("__s")).alias("s"), F.col("__e").alias("e"), F.col("__name").alias("name"), F.col("__kind").alias("kind")))
    picked = met.groupBy(key).agg(best.alias("__b")).select(key, F.col("__b.name").alias("symbol_name"), F.col("__b.kind").alias("symbol_kind"))
    return chunks.join(picked, key, "left")


def packed(text: str, language: str, lines: int = CODE_LINES, chars: int = CODE_CHARS) -> list[tuple[int, int, str]]:
    """(first line, last line, text): whole blocks together while they fit; larger ones are cut at blocks within, then at lines, then within a line."""
    rows = text.split("\n")
    # a cut before a line costs the less the fewer symbols it goes through
    more = [0] * (len(rows) + 3)
    for _, _, start, end, _ in _placed(text, language):
        if start < end:
            more[start + 1] += 1
            more[end + 1] -= 1
    through = list(accumulate(more))
    out: list[tuple[int, int, str]] = []
    size = list(accumulate((len(r) + 1 for r in rows), initial=0))
    at = 1
    while at <= len(rows):
        last = max(at, min(len(rows), at + lines - 1, bisect_right(size, size[at - 1] + 1 + chars) - 1))
        if last < len(rows):
            # the latest of the cuts that go through the fewest symbols
            cuts = through[last + 1 : at : -1]
            last -= cuts.index(min(cuts))
        piece = "\n".join(rows[at - 1 : last])
        if len(piece) > chars:
            out += [(at, last, piece[i : i + chars]) for i in range(0, len(piece), chars)]
        elif piece.strip():
            out.append((at, last, piece))
        at = last + 1
    return out


def code_chunks(files: DataFrame, lines: int = CODE_LINES, chars: int = CODE_CHARS) -> DataFrame:
    """Chunks of code files (source, text, language) along their symbols; files of languages without symbols fall back to sentences, with no lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for source, text, language in zip(b["source"], b["text"], b["language"], strict=True):
                if language in LANGUAGES:
                    parts = packed(text or "", language, lines, chars)
                else:
                    whole = [p for p in split_sentences(text or "")]
                    parts = [(None, None, p[i : i + chars]) for p in whole for i in range(0, len(p), chars)]
                rows += [(source, language, i, len(parts), a, z, p) for i, (a, z, p) in enumerate(parts)]
            out = pd.DataFrame(rows, columns=["source", "language", "chunk_index", "total_chunks", "start_line", "end_line", "text"])
            yield out.astype({"start_line": "Int32", "end_line": "Int32"})

    ship(files.sparkSession)
    kind = files.schema["source"].dataType.simpleString()
    out = files.select("source", "text", "language").mapInPandas(run, f"source {kind}, language string, chunk_index int, total_chunks int, start_line int, end_line int, text string")
    return out.select(chunk_id(F.col("source").cast("string"), F.col("chunk_index")).alias("chunk_id"), "*")
