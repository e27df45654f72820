"""Reading folders of documents and code."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions import languages as lang
from fathomry.functions import text as tx

from . import docx

LARGEST = 10 * 1024 * 1024


def _placed(root: str, path: Column) -> tuple[Column, Column]:
    """(path, path below the root): local paths without a scheme, those of other stores as they are."""
    local = "://" not in root or root.startswith("file://")
    top = os.path.abspath(root.removeprefix("file://")) if local else root.rstrip("/")
    bare = F.regexp_replace(path, "^file:/*", "/") if local else path
    below = F.when(bare == top, F.regexp_extract(bare, "([^/]*)$", 1)).otherwise(F.substring(bare, len(top) + 2, 1 << 30))
    return bare, below


def _any_case(suffix: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, relative, size, modified): file listing only, no contents are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    path, relative = _placed(root, F.col("path"))
    return rows.select(F.col("path").alias("uri"), path.alias("path"), relative.alias("relative"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def wanted(path: Column, relative: Column, patterns: list[str] | None = None, include_code: bool = True, excludes: list[str] | None = None) -> Column:
    """By name: suffixes of the patterns, or else of documents (and code); never below an excluded folder."""
    if patterns:
        suffixes = [p.removeprefix("*").lower() for p in patterns if p.startswith("*.")]
    else:
        suffixes = [*lang.DOCUMENT_SUFFIXES, *(lang.LANGUAGE_OF if include_code else ())]
    return lang.suffix(path).isin(*suffixes) & ~tx.ignored(relative, lang.EXCLUDES if excludes is None else excludes)


def load(spark: SparkSession, root: str, recursive: bool = True, patterns: list[str] | None = None, include_code: bool = True, excludes: list[str] | None = None, within: tuple[float, float] | None = None) -> DataFrame:
    """Documents: text, source, file_name, file_path, file_size, source_type, language. PDF needs a reader of its own and is left out.

    Names are filtered in the listing, in any case; only files that stay are
    read. ``root`` may be one file. within: seconds from and to which a file was changed, others are not read.
    """
    suffixes = sorted({p.removeprefix("*.") for p in patterns if p.startswith("*.")} if patterns else {s[1:] for s in (*lang.DOCUMENT_SUFFIXES, *lang.LANGUAGE_OF)})
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(map(_any_case, suffixes)) + "}").load(root)
    if within is not None:
        rows = rows.where(F.col("modificationTime").between(*[F.timestamp_seconds(F.lit(t)) for t in within]))
    bare, relative = _placed(root, F.col("path"))
    keep = wanted(F.col("path"), relative, patterns, include_code, excludes) & (lang.suffix(F.col("path")) != ".pdf")
    packed = lang.suffix(F.col("path")) == ".docx"
    code = lang.by_path(bare)
    about = [
        bare.alias("source"),
        F.regexp_extract(bare, "([^/]*)$", 1).alias("file_name"),
        bare.alias("file_path"),
        F.col("length").alias("file_size"),
        F.when(code.isNotNull(), "code").otherwise("doc").alias("source_type"),
        F.coalesce(code, F.lit("markdown")).alias("language"),
    ]
    plain = rows.where(keep & ~packed).select(F.try_validate_utf8(F.col("content").cast("string")).alias("text"), *about)
    if "docx" not in suffixes:
        return plain
    return plain.unionByName(docx.with_text(rows.where(keep & packed).select("content", *about)))


def checksums(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """(file_path, checksum, mtime) of all files, for the manifest.

    manifest: what is known of them (file_path, checksum, mtime). Files whose
    time has not changed keep their checksum, however many there are; contents are read of
    files whose time lies within that of the changed ones.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.withColumns({"file_path": _placed(root, F.col("path"))[0], "mtime": F.col("modificationTime").cast("double")})
    if manifest is None:
        return rows.select("file_path", F.sha2("content", 256).alias("checksum"), "mtime")
    listed = rows.select("file_path", "mtime")
    same = listed.join(manifest.select("file_path", "checksum", F.col("mtime").alias("__then")), "file_path").where("mtime = __then").select("file_path", "checksum", "mtime")
    # the listing drops files by time before it reads contents; which of the rest count is for the join to say
    changed = listed.join(same, "file_path", "left_anti")
    span = changed.agg(F.min("mtime").alias("first"), F.max("mtime").alias("last")).first()
    if span["first"] is None:
        return same
    within = F.col("modificationTime").between(F.timestamp_seconds(F.lit(span["first"])), F.timestamp_seconds(F.lit(span["last"])))
    read = rows.where(within).select("file_path", F.sha2("content", 256).alias("checksum"), "mtime")
    return same.unionByName(read.join(same.select("file_path"), "file_path", "left_anti"))


@dataclass(frozen=True)
class Verdict:
    allowed: bool
    reason: str | None = None


def sandbox(path: str, roots: list[str], largest: int = LARGEST) -> Verdict:
    """Whether a file may be read: inside a root, not hidden, not through a link that leaves, not too large."""
    real = os.path.realpath(path)
    tops = [os.path.realpath(r) for r in roots]
    inside = lambda p: any(p == t or p.startswith(t + os.sep) for t in tops)
    if not inside(real):
        return Verdict(False, "symlink_escape" if inside(os.path.abspath(path)) else "outside_indexed_roots")
    top = max((t for t in tops if real == t or real.startswith(t + os.sep)), key=len)
    if any(part.startswith(".") for part in os.path.relpath(real, top).split(os.sep) if part != "."):
        return Verdict(False, "hidden_file")
    if os.path.exists(real) and os.path.getsize(real) > largest:
        return Verdict(False, "size_limit")
    return Verdict(True)
