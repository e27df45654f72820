"""Triples (subject, predicate, object) from chunk metadata, import statements, links and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.functions import entities

TRIPLE = "struct<subject:string,subject_type:string,predicate:string,object:string,object_type:string>"

# Import statements by language, with the type of what is imported.
IMPORTS = {
    "python": ([r"(?m)^import\s+([\w.]+)", r"(?m)^from\s+([\w.]+)\s+import"], "Module"),
    "javascript": ([r"""import\s+.*?\s+from\s+['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""], "Module"),
    "typescript": ([r"""import\s+.*?\s+from\s+['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""], "Module"),
    "java": ([r"(?m)^import\s+([\w.]+);"], "Class"),
    "go": ([r'import\s+"([^"]+)"'], "Package"),
}
GO_BLOCK = r"(?s)import\s*\((.*?)\)"


def triple(subject: Column, subject_type: Column, predicate: str, object_: Column, object_type: Column) -> Column:
    named = [x.alias(n) for x, n in zip((subject, subject_type, F.lit(predicate), object_, object_type), ("subject", "subject_type", "predicate", "object", "object_type"), strict=True)]
    return F.struct(*named).cast(TRIPLE)


def from_metadata(chunks: DataFrame) -> DataFrame:
    """Triples of code chunks: chunk_id, symbol_name, symbol_type, parent_symbol, class_name, source, imports."""
    module = entities.module_name(F.col("source"))
    name, parent, owner = (F.nullif(F.col(c), F.lit("")) for c in ("symbol_name", "parent_symbol", "class_name"))
    kind = entities.normalized_type(F.nullif(F.col("symbol_type"), F.lit("")))
    symbol = F.coalesce(kind, F.lit("Symbol"))
    imports = F.transform(
        F.filter(F.coalesce("imports", F.array().cast("array<string>")), lambda i: i.isNotNull() & (i != "")),
        lambda i: triple(F.coalesce(name, module, F.lit("unknown")), F.coalesce(kind, F.lit("Module")), "imports", i, F.lit("Module")),
    )
    holder = F.when(F.contains(parent, F.lit(".")), "Module").otherwise("Class")
    others = F.array(
        F.when(name.isNotNull() & parent.isNotNull(), triple(parent, holder, "contains", name, symbol)),
        F.when(name.isNotNull() & owner.isNotNull() & F.col("symbol_type").isin("method", "function") & (owner != name), triple(owner, F.lit("Class"), "contains", name, kind)),
        F.when(name.isNotNull() & module.isNotNull() & parent.isNull() & owner.isNull(), triple(module, F.lit("Module"), "contains", name, symbol)),
        F.when(name.isNotNull() & module.isNotNull(), triple(name, symbol, "defined_in", module, F.lit("Module"))),
    )
    return chunks.select(F.inline(F.concat(imports, F.array_compact(others))), F.col("chunk_id").alias("source_chunk_id"))


def from_imports(chunks: DataFrame) -> DataFrame:
    """Triples of import statements in texts: chunk_id, text, language, source."""
    module = F.coalesce(entities.module_name(F.col("source")), F.lit("unknown"))
    found = F.array().cast("array<struct<object:string,object_type:string>>")
    for language, (patterns, kind) in IMPORTS.items():
        every = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns])
        if language == "go":
            every = F.concat(every, F.regexp_extract_all(F.regexp_extract("text", GO_BLOCK, 1), F.lit('"([^"]+)"'), F.lit(1)))
        typed = F.transform(every, _typed(kind))
        found = F.when(F.col("language") == language, typed).otherwise(found)
    rows = chunks.select(F.col("chunk_id").alias("source_chunk_id"), module.alias("subject"), F.inline(found))
    return rows.select("subject", F.lit("Module").alias("subject_type"), F.lit("imports").alias("predicate"), "object", "object_type", "source_chunk_id")


def _typed(kind: str):
    return lambda o: F.struct(o.alias("object"), F.lit(kind).alias("object_type"))


def from_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A page references what its links point to."""
    links = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
    rows = pages.select(F.col(url).alias("subject"), F.explode(links).alias("object"), F.col(key).alias("source_chunk_id"))
    return rows.select("subject", F.lit("APIDoc").alias("subject_type"), F.lit("references").alias("predicate"), "object", F.lit("Endpoint").alias("object_type"), "source_chunk_id")


# The names under which an extraction may give each part, the first that is not empty wins.
PARTS = {"subject": ("subject", "head"), "predicate": ("predicate", "relation"), "object": ("object", "tail"), "subject_type": ("subject_type", "head_type"), "object_type": ("object_type", "tail_type")}


def from_extractions(answers: DataFrame, key: str = "chunk_id", text: str = "extractions", most: int = 10) -> DataFrame:
    """Triples of extractions: JSON lists of ``{"attributes": {...}}``, or of relations with the same names at the top and ``relation`` before ``predicate``.

    Parts that are missing, null, false, 0 or empty count as missing, and an extraction without
    subject, predicate or object is skipped, as is one whose attributes are no
    object. Of a chunk's attribute extractions the first ``most`` that count are kept; relations are not cut. Texts that are no JSON list give nothing.
    """
    each = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    rows = answers.select(F.col(key).alias("source_chunk_id"), F.posexplode(each).alias("at", "e"))
    attributes = F.try_variant_get("e", "$.attributes", "variant")
    flat = attributes.isNull()
    rows = rows.select("source_chunk_id", "at", flat.alias("flat"), F.coalesce(attributes, F.col("e")).alias("e"))

    def part(names: tuple[str, ...]) -> Column:
        options = []
        for n in names:
            value, kind = F.try_variant_get("e", f"$.{n}", "string"), F.schema_of_variant(F.try_variant_get("e", f"$.{n}", "variant"))
            options.append(F.when((kind == "STRING") & (value != ""), value).when((kind == "BOOLEAN") & (value == "true"), "True").when(~kind.isin("STRING", "BOOLEAN") & (value != "0"), value))
        return F.coalesce(*options)

    relation = F.when(F.col("flat"), part(PARTS["predicate"][::-1])).otherwise(part(PARTS["predicate"]))
    found = rows.select(
        part(PARTS["subject"]).alias("subject"),
        entities.normalized_type(part(PARTS["subject_type"])).alias("subject_type"),
        F.trim(F.lower(relation)).alias("predicate"),
        part(PARTS["object"]).alias("object"),
        entities.normalized_type(part(PARTS["object_type"])).alias("object_type"),
        "source_chunk_id",
        "at",
        "flat",
    ).where("subject is not null and predicate is not null and object is not null")
    nth = F.row_number().over(Window.partitionBy("source_chunk_id", "flat").orderBy("at"))
    return found.withColumn("__n", nth).where(F.col("flat") | (F.col("__n") <= most)).drop("__n", "at", "flat")


def from_answers(answers: DataFrame, key: str = "chunk_id", text: str = "answer", most: int = 10) -> DataFrame:
    """Lines ``subject | predicate | object`` or with types ``subject | type | predicate | object | type``; other lines are skipped."""
    lines = answers.select(F.col(key).alias("source_chunk_id"), F.posexplode(F.split(text, "\n")).alias("line", "l"))
    parts = lines.withColumn("p", F.transform(F.split("l", r"\|"), lambda x: F.trim(x)))
    parts = parts.where(F.size("p").isin(3, 5) & ~F.exists("p", lambda x: x == ""))
    long = F.size("p") == 5
    at = lambda i, j: F.when(long, F.try_element_at("p", F.lit(i))).otherwise(F.try_element_at("p", F.lit(j)) if j else None)
    rows = parts.select(
        at(1, 1).alias("subject"),
        entities.normalized_type(at(2, 0)).alias("subject_type"),
        F.lower(at(3, 2)).alias("predicate"),
        at(4, 3).alias("object"),
        entities.normalized_type(at(5, 0)).alias("object_type"),
        "source_chunk_id",
        F.struct("line").alias("__order"),
    )
    nth = F.row_number().over(Window.partitionBy("source_chunk_id").orderBy("__order"))
    return rows.withColumn("__n", nth).where(F.col("__n") <= most).drop("__order", "__n")
