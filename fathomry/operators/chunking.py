"""Chunks of texts and of code, their ids and their statistics."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomry.functions import text as tx
from fathomry.functions.ship import ship

SIZE, OVERLAP = 512, 50
CODE_LINES, CODE_OVERLAP, CODE_CHARS = 40, 15, 1500
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def chunk_id(source: Column, index: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.md5(F.concat_ws("_", source, index.cast("string")).cast("binary")), 1, 16))


def windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, source: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of ``size`` words that start every ``size - overlap`` words; texts without words have none."""
    step = size - overlap
    if step <= 0 or overlap < 0:
        raise ValueError("the overlap lies between 0 and the size")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = docs.select(F.col(source).alias("source"), words.alias("w")).where(F.size("w") > 0)
    # the last chunk is the first that reaches the end
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / F.lit(step)).cast("int"))
    # each chunk carries its own words only
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_index"), F.slice("w", i * step + 1, F.lit(size)).alias("part")))
    rows = rows.select("source", (last + 1).alias("total_chunks"), F.inline(parts))
    return rows.select(chunk_id(F.col("source").cast("string"), F.col("chunk_index")).alias("chunk_id"), "source", "chunk_index", "total_chunks", F.size("part").alias("token_count"), F.array_join("part", " ").alias("text"))


def split_sentences(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Whole sentences up to ``size`` words a chunk; the last sentences of a chunk, up to ``overlap`` words, start the next."""
    units: list[list[str]] = []
    for paragraph in text.split("\n\n"):
        for sentence in SENTENCE.split(paragraph):
            words = sentence.split()
            units += [words[i : i + size] for i in range(0, len(words), size)]
    out: list[str] = []
    held: list[list[str]] = []
    fresh = False
    for u in units:
        if fresh and sum(map(len, held)) + len(u) > size:
            out.append(" ".join(w for x in held for w in x))
            tail: list[list[str]] = []
            for x in reversed(held):
                if sum(map(len, tail)) + len(x) > min(overlap, size - len(u)):
                    break
                tail.insert(0, x)
            held = tail
        held.append(u)
        fresh = True
    if held:
        out.append(" ".join(w for x in held for w in x))
    return out


def sentences(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, source: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentence chunks, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, i, len(parts), p) for s, t in zip(b["source"], b["text"], strict=True) for parts in [split_sentences(t or "", size, overlap)] for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["source", "chunk_index", "total_chunks", "text"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(source).alias("source"), F.col(text).alias("text"))
    kind = rows.schema["source"].dataType.simpleString()
    out = rows.mapInPandas(run, f"source {kind}, chunk_index int, total_chunks int, text string")
    return out.select(chunk_id(F.col("source").cast("string"), F.col("chunk_index")).alias("chunk_id"), "source", "chunk_index", "total_chunks", F.size(F.split("text", " ")).alias("token_count"), "text")


def code_lines(files: DataFrame, lines: int = CODE_LINES, overlap: int = CODE_OVERLAP) -> DataFrame:
    """Chunks of ``lines`` lines with their line range: source, text, language."""
    step = lines - overlap
    rows = files.select("source", "language", F.split("text", "\n").alias("l")).where(F.trim("text") != "")
    last = F.greatest(F.lit(0), F.ceil((F.size("l") - lines) / F.lit(step)).cast("int"))
    # each chunk carries its own lines only
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_index"), F.slice("l", i * step + 1, F.lit(lines)).alias("part")))
    rows = rows.select("source", "language", (last + 1).alias("total_chunks"), F.inline(parts))
    first = F.col("chunk_index") * step
    return rows.select(chunk_id(F.col("source"), F.col("chunk_index")).alias("chunk_id"), "source", "language", "chunk_index", "total_chunks", (first + 1).alias("start_line"), (first + F.size("part")).alias("end_line"), F.array_join("part", "\n").alias("text"))


#: Definitions that start a line, by language; the first group is the kind's word, the second the name.
SYMBOLS = {
    "python": r"(?m)^[ \t]*(?:async[ \t]+)?(def|class)[ \t]+(\w+)",
    "javascript": r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(function|class)[ \t]+(\w+)",
    "typescript": r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+|async[ \t]+)?(function|class|interface|enum)[ \t]+(\w+)",
    "java": r"(?m)^[ \t]*(?:(?:public|private|protected|static|final|abstract)[ \t]+)*(class|interface|enum)[ \t]+(\w+)",
    "csharp": r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)[ \t]+)*(class|interface|struct|record|enum)[ \t]+(\w+)",
    "go": r"(?m)^(func|type)[ \t]+(?:\([^)]*\)[ \t]*)?(\w+)",
    "rust": r"(?m)^[ \t]*(?:pub[ \t]+)?(fn|struct|enum|trait)[ \t]+(\w+)",
    "pascal": r"(?mi)^[ \t]*(procedure|function)[ \t]+([\w.]+)",
}
KINDS = {"def": "function", "fn": "function", "func": "function", "procedure": "function", "struct": "class", "record": "class", "trait": "interface", "type": "class"}


def symbols(files: DataFrame) -> DataFrame:
    """(source, name, kind, start_line): definitions found by pattern, without a parser."""
    gaps = F.array().cast("array<struct<gap:string,m:string,kind:string,name:string>>")
    for language, pattern in SYMBOLS.items():
        found = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i)) for i in range(3)]
        zipped = F.arrays_zip(F.slice(F.split("text", pattern, -1), 1, F.size(found[0])).alias("gap"), found[0].alias("m"), found[1].alias("kind"), found[2].alias("name"))
        gaps = F.when(F.col("language") == language, zipped).otherwise(gaps)
    rows = files.select("source", F.posexplode(gaps).alias("i", "s"))
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    from pyspark.sql import Window

    before = Window.partitionBy("source").orderBy("i")
    rows = rows.withColumn("line", F.sum(newlines(F.col("s.gap")) + newlines(F.col("s.m"))).over(before) + 1)
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    word = F.lower("s.kind")
    return rows.select("source", F.col("s.name").alias("name"), F.coalesce(F.try_element_at(names, word), word).alias("kind"), F.col("line").cast("int").alias("start_line"))


def with_symbols(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Each code chunk with the symbol that starts last in it, or else the last one before it."""
    from pyspark.sql import Window

    right = found.withColumnRenamed("start_line", "symbol_line")
    joined = chunks.join(right, (chunks["source"] == right["source"]) & (right["symbol_line"] <= chunks["end_line"]), "left").drop(right["source"])
    inside = (F.col("symbol_line") >= F.col("start_line")).cast("int")
    best = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc_nulls_last(inside), F.desc_nulls_last("symbol_line")))
    return joined.withColumn("__n", best).where("__n = 1").drop("__n").withColumnsRenamed({"name": "symbol_name", "kind": "symbol_kind"})


def doc_comment(text: Column) -> Column:
    """The words of the first block of /// comment lines, without tags."""
    block = F.regexp_extract(text, r"(?m)((?:^[ \t]*///.*\n?)+)", 1)
    bare = F.regexp_replace(F.regexp_replace(block, r"(?m)^[ \t]*///[ \t]?", ""), "<[^>]*>", " ")
    return F.nullif(F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit(""))


def fallback_summary(text: Column) -> Column:
    """A docstring of over 10 characters, cut to 200; else a comment about a definition; else a first comment line; else nothing."""
    # The three patterns, which must find what the summaries are known to be made of.
    doc = F.regexp_extract(text, r'(?s)"""(.*?)"""', 1)
    cut = F.when(F.length(doc) > 200, F.concat(F.substring(doc, 1, 200), F.lit("..."))).when(F.length(doc) > 10, doc)
    about = F.regexp_extract(text, r"((?i)#.*(?:function|class|method|def))", 1)
    first = F.trim(F.regexp_extract(F.trim(text), r"^([^\n]*)", 1))
    lead = F.when(first.rlike(r"^(#|//|/\*)"), F.trim(F.regexp_replace(first, r"^[#/*]+", "")))
    return F.coalesce(cut, F.nullif(F.trim(F.regexp_replace(about, "^#+|#+$", "")), F.lit("")), lead, F.lit(""))


def stats(chunks: DataFrame) -> DataFrame:
    """One row of totals; zeros for no chunks."""
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    t = F.col("token_count")
    return chunks.agg(F.count("*").alias("total_chunks"), zero(F.round(F.avg(t), 6), "avg_tokens"), zero(F.min(t), "min_tokens"), zero(F.max(t), "max_tokens"), zero(F.sum(t), "total_tokens"), F.countDistinct("source").alias("unique_sources"))


def page_label(docs: DataFrame, source: str = "source") -> DataFrame:
    """A source that names a page of a file becomes its page label."""
    return docs.withColumn("page_label", F.when(F.col(source).rlike("^[0-9ivxlc]+$"), F.col(source)))


def token_proxy(text: Column) -> Column:
    return F.size(tx.raw_tokens(text))


#: Bytes of a vocabulary up to which it is sent to all tasks.
VOCABULARY = 32 << 20


def token_counts(rows: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``token_count``: tokens of a byte-level vocabulary, ``vocabulary`` being a file of ranks and ``pattern`` the expression that cuts a text.

    Strings that name special tokens count as ordinary text; null and empty texts have 0. The file is read by the driver and sent to the tasks, so it must not be over VOCABULARY bytes.
    """
    if Path(vocabulary).stat().st_size > VOCABULARY:
        raise ValueError(f"{vocabulary} is over {VOCABULARY} bytes")
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rest = [f for f in rows.schema.fields if f.name != "token_count"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield b[[f.name for f in rest]].assign(token_count=[len(coder.encode_ordinary(t)) if t else 0 for t in b[text]])

    return rows.mapInPandas(run, T.StructType([*rest, T.StructField("token_count", T.IntegerType())]))
