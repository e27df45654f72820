"""Tokens, stopwords and glob patterns as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of two or more letters, digits or underscores, in any script; the same in Spark and in DuckDB.
TOKEN = r"[\p{L}\p{N}_]{2,}"

#: English words that carry no meaning for keyword search.
STOPWORDS = (
    "an and are as at be but by for from had has have he her his how if in into is it its no nor not of on or our she so such that the their them then there these they "
    "this to was we were what when where which who will with you your"
).split()


def raw_tokens(text: Column) -> Column:
    """Lower-case tokens in order, repeats included; none for a null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    return F.filter(raw_tokens(text), lambda t: ~t.isin(*STOPWORDS))


def query_tokens(text: str) -> list[str]:
    """The driver's form of ``tokens``, repeats dropped."""
    found = [t for t in re.findall(r"\w{2,}", text.lower()) if t not in STOPWORDS]
    return list(dict.fromkeys(found))


def glob_regex(pattern: str) -> str:
    """A shell pattern in which ``*`` also crosses slashes, as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(p)) for p in patterns], F.lit(False))


def ignore_regex(pattern: str) -> str:
    """An ignore-file pattern relative to a root: ``**/`` is any depth, ``*`` stays within a name."""
    body = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "(?:/.*)?").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return "^" + body + "$"


def ignored(relative: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [relative.rlike(ignore_regex(p)) for p in patterns], F.lit(False))
