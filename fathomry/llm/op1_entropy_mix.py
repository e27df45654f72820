"""Mixing sources to target weights by entropy balancing.

Every source gets a token target. Within a source each band of document sizes
(doublings) gets its share, so the mix keeps the source's profile of short and
long documents. Of all rates r between 0 and ``CAP`` that meet a band's token
constraint, the one nearest in entropy to taking each document once is
r = CAP / (1 + exp(-dual * size)): an exponential tilt. The dual is solved for
all bands at once by guarded Newton steps over the (source, size) histogram,
distributed by source and band, until every constraint holds.

Rates become copies cell by cell, a cell being all documents of one source and
size, from a source's largest size to its smallest: a cell gets the whole number
of copies nearest to its rate, and the tokens that this misses are carried to
the next cell. So a source's taken tokens miss its target by no more than its
small documents can't make up for. Within a cell the documents with the smallest
(bucket, hash) get one copy more than the others; the bucket is a part of the
hash, always one of BUCKETS, so a hot cell is ranked in many tasks and no choice
depends on the size of the table. Sums of rates are of decimals, so reruns agree.

Defined results: null texts have size 0 and null sources form one source, last
in order; documents of size 0 take 0 words; an empty table gives an empty
result; repeated rows are separate documents; columns named like the outputs
are replaced. Sources are ranked in one task, with one row for each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomry.functions.ship import ship

from . import common

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
#: Parts of a cell that are ranked apart.
BUCKETS = 4096
EXACT = "decimal(38,12)"
STEPS, ROUNDS, CLOSE = 4, 12, 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)).cast("long"), F.lit(0).cast("long"))


def targets(hist: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """One row per source: its size and its target. ``hist``: __key, __size, __n.

    Sources in order weigh ``weights``, repeating. The level is the number of
    words per unit of weight at which uncapped sources use up the budget; with
    sources by the level at which they are full, it is the largest of the
    levels that treat just the sources before one as full.
    """
    own = hist.groupBy("__key").agg(F.sum(F.col("__size") * F.col("__n")).alias("source_size"))
    by_name = Window.orderBy("__key")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    own = own.withColumn("__w", weight).withColumn("__full", F.lit(CAP) * F.col("source_size"))
    ahead = Window.orderBy(F.col("__full") / F.col("__w"), "__key").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("__full") / F.col("__w"), "__key").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(F.sum("__full").over(ahead), F.lit(0))) / F.sum("__w").over(rest)
    own = own.withColumn("__level", level).withColumn("__level", F.max("__level").over(everything))
    return own.select("__key", "source_size", F.least(F.col("__full").cast("double"), F.col("__level") * F.col("__w")).alias("target"))


def _newton(hist: DataFrame) -> DataFrame:
    """Adds the rate of each (source, size). ``hist`` has __want: the target of the row's source and band."""
    band = Window.partitionBy("__key", "__band")
    x = F.col("__size") / F.pow(F.lit(2.0), F.col("__band"))
    mass = F.col("__n") * F.col("__size")
    total = F.sum(mass).over(band)
    share = F.try_divide("__want", "__all")
    logit = F.log(F.try_divide(share, F.lit(float(CAP)) - share))
    hist = hist.withColumns({"__x": x, "__all": total.cast("double")}).withColumn("__free", F.coalesce((share > 0) & (share < CAP * (1 - 1e-12)), F.lit(False)))
    # x lies in [1, 2), so the dual lies between half the logit of the band's share and all of it
    hist = hist.withColumns({"__lo": F.when(F.col("__free"), F.least(logit, logit / 2)), "__hi": F.when(F.col("__free"), F.greatest(logit, logit / 2))})
    hist = common.cut(hist.withColumn("__dual", (F.col("__lo") + F.col("__hi")) / 2))
    rate = F.lit(float(CAP)) / (1 + F.exp(-F.col("__dual") * F.col("__x")))
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            gap = F.sum((mass * rate).cast(EXACT)).over(band).cast("double") - F.col("__want")
            slope = F.sum((mass * rate * (1 - rate / CAP) * F.col("__x")).cast(EXACT)).over(band).cast("double")
            hist = hist.withColumns({"__gap": gap, "__slope": slope})
            hist = hist.withColumns({"__lo": F.when(F.col("__gap") > 0, F.col("__lo")).otherwise(F.col("__dual")), "__hi": F.when(F.col("__gap") > 0, F.col("__dual")).otherwise(F.col("__hi"))})
            step = F.col("__dual") - F.try_divide(F.col("__gap"), F.col("__slope"))
            inside = (step >= F.col("__lo")) & (step <= F.col("__hi"))
            hist = hist.withColumn("__dual", F.when(F.col("__free"), F.when(inside, step).otherwise((F.col("__lo") + F.col("__hi")) / 2)))
        hist = common.cut(hist)
        off = hist.where("__free").select((F.abs(F.sum((mass * rate).cast(EXACT)).over(band).cast("double") - F.col("__want")) / F.col("__want")).alias("off")).agg(F.max("off"))
        if (off.first()[0] or 0.0) <= CLOSE:
            break
    settled = F.when(F.col("__all") == 0, F.lit(1.0)).when(F.col("__want") <= 0, F.lit(0.0)).otherwise(F.lit(float(CAP)))
    return hist.withColumn("__rate", F.when(F.col("__free"), rate).otherwise(settled))


def _whole_copies(cells: pd.DataFrame) -> pd.DataFrame:
    """Adds the copies of each cell of one source."""
    cells = cells.sort_values("size", ascending=False, ignore_index=True)
    out = np.zeros(len(cells), np.int64)
    carried = 0.0
    for i, (size, n, rate) in enumerate(zip(cells["size"].tolist(), cells["__n"].tolist(), cells["rate"].tolist(), strict=True)):
        wanted = n * rate + (carried / size if size else 0.0)
        out[i] = min(CAP * n, max(0, int(wanted + 0.5)))
        carried += size * (n * rate - int(out[i]))
    return cells.assign(__copies=out)


def mix(docs: DataFrame, size: Column, source: str = "source", order_by: tuple[str, ...] = ("doc_id", "text"), weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """Adds size, source_size, target, rate, copies and taken to every document.

    size: its tokens; order_by: columns whose hash orders documents of one
    source and size. ``copies`` is how often the mix takes the document.
    """
    key = F.when(F.col(source).isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col(source)))
    base = docs.drop("source_size", "target", "rate", "copies", "taken").withColumns({"size": size, "__key": key, "__h": F.xxhash64(*order_by)})
    hist = common.cut(base.groupBy("__key", F.col("size").alias("__size")).agg(F.count("*").alias("__n")))
    goal = targets(hist, weights, budget)
    hist = hist.join(goal, "__key").withColumn("__band", F.when(F.col("__size") > 0, F.floor(F.log2("__size"))).otherwise(-1).cast("int"))
    # floor(log2) may round up just below a power of two
    hist = hist.withColumn("__band", F.col("__band") - (F.pow(F.lit(2.0), F.col("__band")) > F.col("__size")).cast("int") * (F.col("__size") > 0).cast("int"))
    part = F.sum(F.col("__size") * F.col("__n")).over(Window.partitionBy("__key", "__band"))
    hist = _newton(hist.withColumn("__want", F.coalesce(F.try_divide(F.col("target") * part, F.col("source_size")), F.lit(0.0))))
    cells = hist.select("__key", F.col("__size").alias("size"), "source_size", "target", F.col("__rate").alias("rate"), "__n")
    # a group holds one row for each size of a source
    ship(docs.sparkSession)
    cells = cells.groupBy("__key").applyInPandas(_whole_copies, T.StructType([*cells.schema.fields, T.StructField("__copies", T.LongType())]))
    base = base.withColumn("__bucket", F.pmod("__h", F.lit(BUCKETS)).cast("int"))
    in_cell = Window.partitionBy("__key", "size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    dealt = base.groupBy("__key", "size", "__bucket").agg(F.count("*").alias("__m"))
    dealt = dealt.select("__key", "size", "__bucket", F.coalesce(F.sum("__m").over(in_cell), F.lit(0)).alias("__skip"))
    cells = dealt.join(cells, ["__key", "size"])
    ranked = base.withColumn("__rank", F.row_number().over(Window.partitionBy("__key", "size", "__bucket").orderBy("__h", *order_by)))
    out = ranked.join(cells, ["__key", "size", "__bucket"])
    more = F.col("__skip") + F.col("__rank") <= F.col("__copies") % F.col("__n")
    out = out.withColumn("copies", (F.floor(F.col("__copies") / F.col("__n")) + more.cast("int")).cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("__key", "__h", "__bucket", "__rank", "__skip", "__copies", "__n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    docs = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("__text"))
    out = mix(docs, F.col("size"), order_by=("doc_id", "__text"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
