"""Secret scans with an incremental blob ledger, with DataFrame functions only.

Every version of a text is a blob, addressed by its SHA-256. The ledger is a
Parquet table of (blob, rule, version, spans): what each rule version found in
each blob. A scan reads only blobs with a (rule, version) that the ledger does
not have, appends their findings, and joins the ledger back to all rows (paths)
that hold the blob, so copies and old versions are never scanned again. Rules are
applied where a text lies, to one row of each unseen blob, which a bitmap of the
chosen rows and rules (MARKS bits, broadcast) tells; only spans are exchanged. The
join back moves only rows whose blob may have a finding.

Match offsets come from running sums of the lengths of matches and of the gaps
between them, as ``regexp_extract_all`` and ``split`` find the same leftmost
non-overlapping matches.

Defined results: a null text is an empty blob; blobs without findings have a
ledger row with no spans; repeated rows each get the findings; an empty table
gives an empty result; columns named like the outputs are replaced, others kept;
a very long text is one row of the scan and takes memory in proportion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more. ``hint`` tells cheaply that a text has no match."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: tuple[str, ...] = ()
    hint_pattern: str = ""

    def may_match(self, text: Column) -> Column:
        if self.hint_pattern:
            return text.rlike(self.hint_pattern)
        low = F.lower(text) if self.kind == "assign" else text
        out = F.lit(not self.hint)
        for h in self.hint:
            out = out | F.contains(low, F.lit(h))
        return out


#: In the order in which spans with one start are listed. Runs of under 16 hex digits never hold a finding, so the pattern skips them.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"(AKIA[A-Z0-9]+)", 1, 18, ("AKIA",)),
    Rule("hex", 1, r"([0-9a-f]{16,})", 1, 16, (), "[0-9a-f]{16}"),
)
#: Bits of the bitmaps, as a power of two: at most 2^18 rows of 64 bits are broadcast.
MARKS = 24
LEDGER = "blob binary, rule string, version int, spans array<struct<start:int,end:int>>"


def _pieces(text: Column, rule: Rule) -> Column:
    """Per match: length of the gap before it, its length, whether it is a finding."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("g"),
        F.slice(F.split(text, rule.pattern, -1), 1, F.size(F.regexp_extract_all(text, pattern, F.lit(0)))).alias("gap"),
    )
    return F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("len"), (F.length(x["g"]) >= rule.least).alias("ok")))


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at a path, made empty if there is none."""
    fields = [f.strip().split(" ", 1) for f in LEDGER.split(", ")]
    spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in fields]).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(docs: DataFrame, text: str, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger has not seen yet and append it; returns the ledger of the given rule versions."""
    spark = docs.sparkSession
    known = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    raw = F.coalesce(F.col(text), F.lit(""))
    row = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind])
    blobs = docs.select(raw.alias("__t"), row.alias("__row")).withColumns({"blob": F.unhex(F.sha2("__t", 256))})
    seen = open_ledger(spark, path).select("blob", "rule", "version")
    unseen = blobs.groupBy("blob").agg(F.min("__row").alias("__row"))
    unseen = unseen.select("*", F.inline(known)).join(seen, ["blob", "rule", "version"], "left_anti")
    unseen = common.cut(unseen.select("blob", "__row", "rule"))
    # a rule is applied where one row of each unseen blob lies (several only if equal in all columns); texts don't move, spans do
    marked = common.marks(unseen, "blob", "__row", "rule", bits=MARKS)
    none = F.array().cast("array<struct<gap:int,len:int,ok:boolean>>")
    found = []
    for i, r in enumerate(rules):
        blobs = common.maybe(blobs.withColumn("rule", F.lit(r.kind)), marked, "blob", "__row", "rule", bits=MARKS).withColumnRenamed("__maybe", f"__todo{i}")
        pieces = F.when(r.may_match(F.col("__t")), _pieces(F.col("__t"), r)).otherwise(none)
        found.append(F.when(F.col(f"__todo{i}"), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), pieces.alias("pieces"))))
    some = F.greatest(*[F.col(f"__todo{i}") for i in range(len(rules))]) if len(rules) > 1 else F.col("__todo0")
    scanned = blobs.where(some).select("blob", "__row", F.inline(F.array_compact(F.array(*found))))
    # the bitmap may have let through pairs that the ledger knows
    scanned = scanned.join(unseen, ["blob", "__row", "rule"], "left_semi").dropDuplicates(["blob", "rule", "version"])
    pieces = scanned.select("blob", "rule", "version", F.posexplode_outer("pieces").alias("i", "p"))
    before = Window.partitionBy("blob", "rule", "version").orderBy("i")
    pieces = pieces.withColumn("end", F.sum(F.col("p.gap") + F.col("p.len")).over(before).cast("int"))
    span = F.when(F.col("p.ok"), F.struct((F.col("end") - F.col("p.len")).alias("start"), F.col("end").alias("end")))
    pieces.groupBy("blob", "rule", "version").agg(F.array_sort(F.collect_list(span)).alias("spans")).write.mode("append").parquet(path)
    rows = spark.read.schema(LEDGER).parquet(path)
    return rows.join(F.broadcast(spark.range(1).select(F.inline(known))), ["rule", "version"], "left_semi")


FINDING = "array<struct<start:int,ord:int,kind:string,end:int>>"


def _with_findings(docs: DataFrame, text: str, ledger: str | None, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds ``findings``, and ``__before``: for each of them where the ones before it end."""
    spark = docs.sparkSession
    current = update_ledger(docs, text, ledger or common.fresh_dir(spark, "blob-ledger"), rules)
    at = {r.kind: i for i, r in enumerate(rules)}
    order = F.create_map(*[F.lit(x) for kv in at.items() for x in kv])
    spans = current.where(F.size("spans") > 0).select("blob", F.col("rule").alias("kind"), order[F.col("rule")].alias("ord"), F.inline("spans"))
    ahead = Window.partitionBy("blob").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.max("end").over(ahead), F.lit(0)))
    per_blob = spans.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "kind", "end", "before"))).alias("__all"))
    per_blob = common.cut(per_blob)
    bare = F.transform("__all", lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["kind"].alias("kind"), x["end"].alias("end")))
    paths = docs.drop("findings").withColumn("__blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    per_blob = per_blob.withColumnRenamed("blob", "__blob")
    paths = common.maybe(paths, common.marks(per_blob, "__blob", bits=MARKS), "__blob", bits=MARKS)
    with_some = paths.where("__maybe").join(per_blob, "__blob", "left").drop("__blob", "__maybe")
    with_some = with_some.withColumns({"findings": F.coalesce(bare, F.array().cast(FINDING)), "__before": F.coalesce(F.col("__all.before"), F.array().cast("array<int>"))}).drop("__all")
    without = paths.where(~F.col("__maybe")).drop("__blob", "__maybe").withColumns({"findings": F.array().cast(FINDING), "__before": F.array().cast("array<int>")})
    return with_some.unionByName(without)


def scan(docs: DataFrame, text: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``findings``: array of (start, ord, kind, end) of every row's text, by start, then in the order of the rules.

    Offsets are code points, ends exclusive. ledger: path of the ledger to
    keep between scans; a new one in the shared folder if None.
    """
    return _with_findings(docs, text, ledger, rules).drop("__before")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", ledger: str | None = None) -> DataFrame:
    """Replaces every found span (overlapping spans as one) by ``mark``; other text and rows stay as they are."""
    out = _with_findings(docs, text, ledger, RULES)
    kept = F.transform(
        F.arrays_zip(F.col("findings.start").alias("start"), F.col("__before").alias("before")),
        lambda s: F.when(s["start"] >= s["before"], F.concat(F.substring(F.col(text), s["before"] + 1, s["start"] - s["before"]), F.lit(mark))).otherwise(F.lit("")),
    )
    rest = F.substring(F.col(text), F.array_max(F.col("findings.end")) + 1, F.length(text))
    return out.withColumn(text, F.when(F.size("findings") > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(F.col(text))).drop("findings", "__before")


def _listed(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [_count(r.kind).alias(f"n_{r.kind}") for r in RULES]
    return out.select("doc_id", *n, F.sha2(_listed(F.col("findings")), 256).alias("base_sha256"), _listed(F.col("findings")).alias("spans"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
rules(kind, ord, pat, least, grp) AS (VALUES
  ('assign', 0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 12, 1),
  ('access', 1, '(AKIA[A-Z0-9]+)', 18, 1),
  ('hex', 2, '([0-9a-f]+)', 16, 1)),
a AS (
  SELECT r, kind, ord, least,
    CASE kind WHEN 'assign' THEN regexp_extract_all(t, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 'access' THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]+') END AS m,
    CASE kind WHEN 'assign' THEN regexp_extract_all(t, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)
      WHEN 'access' THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]+') END AS g,
    CASE kind WHEN 'assign' THEN string_split_regex(t, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 'access' THEN string_split_regex(t, 'AKIA[A-Z0-9]+') ELSE string_split_regex(t, '[0-9a-f]+') END AS gap
  FROM d CROSS JOIN rules),
u AS (SELECT r, kind, ord, least, unnest(generate_series(1, len(m))) AS i, unnest(m) AS m, unnest(g) AS g, unnest(gap[1:len(m)]) AS gap FROM a WHERE len(m) > 0),
p AS (SELECT r, kind, ord, least, g, m, sum(length(gap) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM u),
f AS (SELECT r, kind, ord, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM p WHERE length(g) >= least),
x AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (r)
"""
