"""File types and programming languages, by path and by content."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and their languages.
LANGUAGE_OF = {
    ".py": "python", ".pyw": "python", ".pyi": "python",
    ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".kt": "kotlin", ".kts": "kotlin",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".java": "java", ".go": "go", ".rs": "rust", ".swift": "swift",
    ".cs": "csharp", ".csx": "csharp",
    ".pas": "pascal", ".pp": "pascal", ".lpr": "pascal", ".dpr": "pascal", ".dpk": "pascal",
}

# Formats read as documents.
DOCUMENT_SUFFIXES = (".txt", ".md", ".pdf", ".docx", ".html", ".rst")

# Named sets of patterns; "code" is all programming languages together.
PRESETS = {
    "python": ["*.py", "*.pyi", "*.pyw"],
    "javascript": ["*.js", "*.jsx", "*.mjs", "*.cjs"],
    "typescript": ["*.ts", "*.tsx"],
    "go": ["*.go"],
    "rust": ["*.rs"],
    "java": ["*.java"],
    "csharp": ["*.cs"],
    "pascal": ["*.pas", "*.pp", "*.lpr", "*.dpr", "*.dpk"],
    "object-pascal": ["*.pas", "*.pp", "*.lpr", "*.dpr", "*.dpk"],
    "c": ["*.c", "*.h"],
    "cpp": ["*.cpp", "*.hpp", "*.cc", "*.hh"],
    "web": ["*.html", "*.css", "*.scss", "*.jsx", "*.tsx"],
    "docs": ["*.md", "*.txt", "*.rst", "*.pdf"],
    "text": ["*.md", "*.txt", "*.rst"],
    "pdf": ["*.pdf"],
}
PRESETS["code"] = list(chain(*[PRESETS[p] for p in ("python", "javascript", "typescript", "go", "rust", "java", "csharp", "pascal", "c", "cpp")]))

# Folders that are never read.
EXCLUDES = [
    "**/node_modules/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/.git/**", "**/dist/**", "**/build/**", "**/target/**", "**/.next/**",
    "**/.nuxt/**", "**/coverage/**", "**/.pytest_cache/**", "**/.mypy_cache/**", "**/.tox/**", "**/egg-info/**", "**/*.egg-info/**", "**/.claude/**", "**/.claude-plugin/**",
]

# What hints at a language, line by line.
CONTENT_HINTS = {
    "python": [r"^\s*import\s+\w+", r"^\s*from\s+\w+\s+import", r"^\s*def\s+\w+\s*\(", r"^\s*class\s+\w+"],
    "javascript": [r"^\s*(const|let|var)\s+\w+\s*=", r"^\s*function\s+\w+\s*\(", r"^\s*=>\s*\{"],
    "typescript": [r"^\s*interface\s+\w+", r"^\s*type\s+\w+\s*=", r":\s*(string|number|boolean|any)"],
    "java": [r"^\s*public\s+class\s+\w+", r"^\s*package\s+\w+", r"^\s*import\s+java\."],
    "kotlin": [r"^\s*fun\s+\w+\s*\(", r"^\s*class\s+\w+", r":\s*(String|Int|Boolean)"],
    "cpp": [r"^\s*#include\s*<", r"^\s*using\s+namespace", r"^\s*std::"],
    "c": [r"^\s*#include\s*<", r"^\s*int\s+main\s*\(", r"^\s*printf\s*\("],
    "go": [r"^\s*package\s+\w+", r"^\s*import\s*\(", r"^\s*func\s+\w+\s*\("],
    "rust": [r"^\s*fn\s+\w+\s*\(", r"^\s*use\s+\w+::", r"^\s*let\s+(mut\s+)?\w+"],
    "swift": [r"^\s*import\s+Foundation", r"^\s*func\s+\w+\s*\(", r"^\s*class\s+\w+\s*:"],
    "csharp": [r"^\s*using\s+System", r"^\s*namespace\s+\w+", r"\{\s*get\s*;\s*(set\s*;)?\s*\}", r"\[[\w]+(\(.*\))?\]", r"^\s*public\s+(class|interface|struct|record|enum)\s+\w+"],
    "pascal": [r"^\s*(unit|program|library)\s+\w+\s*;", r"^\s*(procedure|function)\s+\w+", r"^\s*begin\b"],
}


def preset_patterns(names: list[str]) -> list[str]:
    """Patterns of several presets in order, each once."""
    unknown = [n for n in names if n not in PRESETS]
    if unknown:
        raise ValueError(f"unknown file type preset {unknown[0]!r}; known: {', '.join(sorted(PRESETS))}")
    return list(dict.fromkeys(chain(*[PRESETS[n] for n in names])))


def supported_languages() -> list[str]:
    return sorted(set(LANGUAGE_OF.values()))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def by_path(path: Column) -> Column:
    """The language of a path's suffix, or null."""
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return F.try_element_at(pairs, suffix(path))


def by_content(text: Column, top: int = 3) -> Column:
    """The likeliest languages as an array of (language, confidence): the mean over a language's hints of up to ten matches, in tenths."""
    scored = []
    for name, hints in CONTENT_HINTS.items():
        found = [F.least(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?m)" + h)) / F.lit(10.0), F.lit(1.0)) for h in hints]
        scored.append(F.struct((-sum(found[1:], found[0]) / len(hints)).alias("minus"), F.lit(name).alias("language")))
    best = F.filter(F.array_sort(F.array(*scored)), lambda s: s["minus"] < 0)
    return F.transform(F.slice(best, 1, top), lambda s: F.struct(s["language"].alias("language"), (-s["minus"]).alias("confidence")))


def detect(path: Column, text: Column, least: float = 0.1) -> Column:
    top = F.try_element_at(by_content(text, 1), F.lit(1))
    return F.coalesce(by_path(path), F.when(top["confidence"] > least, top["language"]))
