"""Entity and relationship names, and entity names in queries and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity types and relationships.
CODE_TYPES = ["Package", "Module", "Class", "Method", "Function", "Interface", "Enum"]
DOC_TYPES = ["DesignDoc", "UserDoc", "PRD", "Runbook", "README", "APIDoc"]
INFRA_TYPES = ["Service", "Endpoint", "Database", "ConfigFile"]
ENTITY_TYPES = CODE_TYPES + DOC_TYPES + INFRA_TYPES
RELATIONSHIPS = ["calls", "extends", "implements", "references", "depends_on", "imports", "contains", "defined_in"]

# Words of a question that name nothing.
QUESTION_WORDS = {"what", "where", "when", "which", "that", "this", "have", "does", "with", "from", "about", "into"}


def normalize_type(raw: str | None) -> str | None:
    return raw if raw is None else {t.lower(): t for t in ENTITY_TYPES}.get(raw.lower(), raw)


def normalized_type(raw: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for t in ENTITY_TYPES for x in (t.lower(), t)])
    return F.coalesce(F.try_element_at(pairs, F.lower(raw)), raw)


def query_entities(text: str, most: int = 10) -> list[str]:
    """Names in a query: first those written like names, then other long words."""
    bare = [w for w in (re.sub(r"[^\w]", "", w) for w in text.split()) if w]

    def named(w: str) -> bool:
        constant = len(w) > 2 and re.fullmatch(r"[A-Z_]+", w)
        camel = re.match(r"[A-Z][a-z]+[A-Z]", w)
        return bool(constant or camel or (w[0].isupper() and len(w) > 2) or ("_" in w and w.islower()))

    found = [w for w in bare if named(w)]
    known = {w.lower() for w in found}
    for w in (w.lower() for w in bare):
        if len(w) > 3 and w not in QUESTION_WORDS and w not in known:
            known.add(w)
            found.append(w)
    return found[:most]


def module_name(path: Column) -> Column:
    """A path's file name without its last suffix, other characters as underscores; null if none is left."""
    name = F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[^a-zA-Z0-9_]", "_")
    return F.when(bare != "", bare)
