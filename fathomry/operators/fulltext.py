"""Web-style full-text search: words, OR, "phrases" and -exclusions, over weighted fields."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomry.functions import text as tx

#: Weights of a title, of a summary and of the body.
WEIGHTS = {"a": 1.0, "b": 0.4, "c": 0.2}


@dataclass(frozen=True)
class Clause:
    """Alternatives, each a run of words; ``wanted`` tells whether the clause must hold or must not."""

    alternatives: tuple[tuple[str, ...], ...]
    wanted: bool = True


def parse(query: str) -> list[Clause]:
    """Clauses that must all hold; stopwords outside phrases are left out."""
    out: list[Clause] = []
    joined = False
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)(\S+)', query):
        minus, body = (m[1], m[2]) if m[2] is not None else (m[3], m[4])
        if m[2] is None and body.upper() == "OR" and not minus:
            joined = bool(out)
            continue
        words = tuple(re.findall(r"\w{2,}", body.lower()))
        words = words if m[2] is not None else tuple(w for w in words if w not in tx.STOPWORDS)
        if not words:
            continue
        if joined and out[-1].wanted and not minus:
            out[-1] = Clause((*out[-1].alternatives, words))
        else:
            out.append(Clause((words,), not minus))
        joined = False
    return out


def _has(words: Column, run: tuple[str, ...]) -> Column:
    if len(run) == 1:
        return F.array_contains(words, run[0])
    # tokens hold no spaces, so a run of tokens is a substring between spaces
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(" " + " ".join(run) + " "))


def search(docs: DataFrame, query: str, k: int = 5, key: str = "doc_id", fields: dict[str, str] | None = None) -> DataFrame:
    """(id, score, rank): weighted term frequency over field length, as a share of the best. fields: column -> weight name."""
    fields = fields or {"text": "c"}
    clauses = parse(query)
    asked = sorted({w for c in clauses if c.wanted for run in c.alternatives for w in run})
    if not asked:
        raise ValueError("the query asks for nothing")
    names = {f: f"__w_{i}" for i, f in enumerate(fields)}
    rows = docs.select(F.col(key).alias("id"), *[tx.raw_tokens(F.col(f)).alias(n) for f, n in names.items()])
    everything = F.concat(*[F.col(n) for n in names.values()])
    holds = reduce(lambda a, b: a & b, [c if cl.wanted else ~c for cl in clauses for c in [reduce(lambda a, b: a | b, [_has(everything, run) for run in cl.alternatives])]])
    terms = F.array(*[F.lit(w) for w in asked])
    parts = []
    for f, n in names.items():
        hits = F.size(F.filter(F.col(n), lambda t: F.array_contains(terms, t)))
        parts.append(WEIGHTS[fields[f]] * hits / (1 + F.log1p(F.size(n).cast("double"))))
    found = rows.where(holds).select("id", reduce(lambda a, b: a + b, parts).alias("score"))
    best = F.max("score").over(Window.partitionBy())
    top = found.orderBy(F.desc("score"), "id").limit(k)
    by = Window.orderBy(F.desc("score"), "id")
    return top.withColumn("score", F.round(F.when(best > 0, F.col("score") / best).otherwise(0.0), 6)).withColumn("rank", F.row_number().over(by))


def headline_terms(headline: Column) -> Column:
    """Terms marked as <<<term>>>, lower-case, each once; null if there are none."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(headline, F.lit("<<<(.+?)>>>"), F.lit(1)), lambda t: F.lower(F.trim(t))))
    kept = F.filter(found, lambda t: t != "")
    return F.when(F.size(kept) > 0, kept)
