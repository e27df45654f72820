"""Toxicity by weak supervision.

Voters look at a text. Lexicon voters fire if the text has one of their terms:
every word of a short public list is a voter, and so is every family of mined
terms (whole words and word beginnings with the same first letters), once if
it occurs and once more if it occurs often. Pattern voters fire on a text's form.

A generative label model explains how the voters fire on all documents,
labelled or not:

  p(fired, toxic) ~ exp(prior * toxic + sum_j (bias_j + accuracy_j * toxic) fired_j
                        + sum over correlated i, j of (bias_ij + correlation_ij * toxic) fired_i fired_j)

The correlated pairs form a forest: of the pairs that voters independent given
the class explain worst, as many as have no circle, so all sums are exact and
their cost grows with the square of the number of voters. Expectation
maximisation passes over the table of distinct votes; sums are of integers, so
reruns agree. Labels tell where it starts and keep it in place: all documents
together weigh INFLUENCE of the labelled ones, which have the class that they
are labelled with. Without labels it starts from the guess that a text with a
public word is toxic. A voter may not speak against toxicity. The posteriors of
at most TRAIN documents, labelled or not, train a linear classifier over terms
and patterns, which scores each text from the text alone.

Labels are read only from rows whose crc32(id as text) mod 5 is not 0, and of
those at most SAMPLE, the ones with the smallest hash of their id.

Defined results: null and empty texts are scored by the classifier's constant;
null labels are left out and of repeated labels the largest counts; without
labels of both classes only the public list and the patterns vote; repeated
rows each get a score; an empty table gives an empty result; other columns are
kept, and columns named like the outputs are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled rows from which terms are mined, at most.
SAMPLE = 20_000
#: Documents with posterior labels on which the classifier is trained, at most.
TRAIN = 20_000
#: Mined terms, and the families of them that vote, at most.
TERMS, FAMILIES = 300, 64
LEAST_DOCS = 5
#: Uses of a family's words in one text that are often.
OFTEN = 3
BEGINNINGS = (4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+")
#: Insults in common use, in the languages of the corpus.
PUBLIC = tuple(
    "idiot moron stupid dumb loser trash scum worthless pathetic disgusting clown imbecile bastard asshole bitch retard "
    "idioten dummkopf arschloch abschaum trottel wichser connard salaud imbécile crétin ordure idiota estúpido imbécil basura cabrón".split()
)
#: Forms of a text that vote: shouted words, heaped marks, words with masked letters.
PATTERNS = (re.compile(r"(?:\b[A-ZÀ-Þ]{2,}\b\W+){4}"), re.compile(r"!{2,}|[?!]{3,}"), re.compile(r"\b[^\W\d_]+[*@#$]+[^\W\d_]"))
#: Least conditional information, in nats, of a correlated pair.
INFORMATION = 1e-5
ROUNDS = 6
#: What all documents together weigh beside the labelled ones.
INFLUENCE = 0.1
#: Distinct votes that a task sums up, about.
VOTES = 20_000
#: What each class is thought to have seen of a voter beforehand.
SMOOTH = np.array([0.01, 0.05])
ONE = 1 << 20


@dataclass
class Lexicon:
    """Terms by number: the patterns, then words and beginnings, then families that a text uses often; and the voter of each, or -1."""

    words: dict[str, int] = field(default_factory=dict)
    starts: dict[str, int] = field(default_factory=dict)
    often: dict[str, int] = field(default_factory=dict)
    voter_of: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, mined: list[tuple[str, bool]]) -> Lexicon:
        """Terms in order of how telling they are, and whether each is a beginning."""
        out = cls(voter_of=list(range(len(PATTERNS) + len(PUBLIC))))
        out.words = {w: len(PATTERNS) + i for i, w in enumerate(PUBLIC)}
        families: dict[str, int] = {}
        for term, start in mined:
            if not start and term in out.words:
                continue
            family = term[: BEGINNINGS[0]]
            if family not in families and len(families) < FAMILIES:
                families[family] = len(PATTERNS) + len(PUBLIC) + len(families)
            (out.starts if start else out.words)[term] = len(out.voter_of)
            out.voter_of.append(families.get(family, -1))
        for family, voter in families.items():
            out.often[family] = len(out.voter_of)
            out.voter_of.append(len(families) + voter)
        return out

    @property
    def n_voters(self) -> int:
        return max(self.voter_of) + 1

    @property
    def suspects(self) -> np.ndarray:
        """Voters whose vote alone makes a text suspect at first."""
        return np.array([v for t, v in enumerate(self.voter_of) if len(PATTERNS) <= t < len(PATTERNS) + len(PUBLIC) or t in self.often.values()])

    def finder(self):
        """Makes the function that gives a text's terms in order."""
        automaton = ahocorasick.Automaton()
        for term in {*self.words, *self.starts, *self.often}:
            automaton.add_word(term, (len(term) - 1, self.words.get(term, -1), self.starts.get(term, -1), self.often.get(term, -1)))
        automaton.make_automaton()

        def find(text: str) -> list[int]:
            low = text.lower()
            hits = {i for i, p in enumerate(PATTERNS) if p.search(text)}
            uses: dict[int, int] = {}
            last = len(low) - 1
            for end, (back, word, start, often) in automaton.iter(low):
                if end > back and low[end - back - 1].isalpha():
                    continue
                if start >= 0:
                    hits.add(start)
                if often >= 0:
                    uses[often] = uses.get(often, 0) + 1
                if word >= 0 and (end == last or not low[end + 1].isalpha()):
                    hits.add(word)
            hits.update(t for t, n in uses.items() if n >= OFTEN)
            return sorted(hits)

        return find


@dataclass
class Model:
    """A lexicon, what the label model found out about its voters, and the classifier's weights of the terms."""

    lexicon: Lexicon
    weights: np.ndarray
    constant: float
    accuracies: np.ndarray
    correlations: dict[tuple[int, int], float]


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _mine(sample: DataFrame) -> list[tuple[str, bool]]:
    """The most telling terms, and whether each is a beginning. ``sample``: distinct texts with labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in common.slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(LETTERS.findall((text or "").lower()))
                counts[toxic].update(words)
                counts[toxic].update({w[:n] + "*" for w in words for n in BEGINNINGS if len(w) >= n})
                counts[toxic][""] += 1
        terms = list(counts[0] | counts[1])
        for i in range(0, len(terms), 50_000):
            part = terms[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([c[t] for t in part], pa.int64()) for c in counts]], names=["term", "n0", "n1"])

    counted = common.map_batches(sample.select("text", "toxic"), run, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = common.cut(counted.where((F.col("n1") >= LEAST_DOCS) | (F.col("term") == "")))
    total = counted.where("term = ''").first()
    if total is None or not total["n0"] or not total["n1"]:
        return []
    p, n = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.log(p / (total["n1"] - F.col("n1") + 0.5)) - F.log(n / (total["n0"] - F.col("n0") + 0.5))
    sure = odds - 2 * F.sqrt(1 / p + 1 / n)
    best = counted.where("term <> ''").withColumn("s", F.round(sure, 9)).where("s > 1").orderBy(F.desc("s"), "term").limit(TERMS).collect()
    return [(r["term"].removesuffix("*"), r["term"].endswith("*")) for r in best]


def chosen_labels(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(key, toxic): at most SAMPLE rows, none of them held out."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
    return usable.groupBy(key).agg(F.max(label).cast("int").alias("toxic")).orderBy(F.xxhash64(key), key).limit(SAMPLE)


def mine(docs: DataFrame, chosen: DataFrame, text: str = "text", key: str = "doc_id") -> Lexicon:
    """The lexicon of the labelled rows. ``chosen``: as ``chosen_labels`` gives it."""
    # SAMPLE rows of an id and a label
    sample = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), key)
    # copies of a text count once
    return Lexicon.of(_mine(sample.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("h")))


def vote(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Adds ``hits`` to every row: the numbers of the terms and patterns that its text holds, in order."""
    kept = [c for c in docs.columns if c != "hits"]
    schema = docs.select(*kept).schema.add("hits", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = lexicon.finder()
        for batch in common.slices(batches):
            hits = pa.array([find(t.as_py() or "") for t in batch.column(text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], hits], names=schema.names)

    return common.map_batches(docs.select(*kept), run, schema)


def _fired(lexicon: Lexicon) -> Column:
    voter = F.array(*[F.lit(v) for v in lexicon.voter_of])
    return F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: F.get(voter, h)), lambda v: v >= 0)))


class LabelModel:
    """Log-odds of the toxic class: constant + votes @ single + pair terms; what it says of each class it keeps as counts."""

    def __init__(self, m: int):
        self.m, self.pairs = m, []
        self.constant, self.single, self.joint = 0.0, np.zeros(m), np.zeros(0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = self.constant + votes @ self.single
        for (i, j), c in zip(self.pairs, self.joint, strict=True):
            z = z + c * votes[:, i] * votes[:, j]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def suspect(self, voters: np.ndarray) -> None:
        """The guess without labels: each of these voters alone makes a text toxic."""
        self.pairs, self.joint, self.constant = [], np.zeros(0), -3.0
        self.single = np.zeros(self.m)
        self.single[voters] = 5.0

    def learn(self, total: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """From expected counts: documents by class, fired voters by class, fired pairs by class.

        Each voter's vote depends on the class and on its parent in the forest.
        A voter's odds are not allowed to speak against the class.
        """
        base = (total + 1) / (total.sum() + 2)
        self.constant = float(np.log(base[1] / base[0]))
        p = (one + SMOOTH[:, None]) / (total[:, None] + 1)
        p = np.clip(p, 1e-9, 1 - 1e-9)
        p[1] = np.maximum(p[1], p[0])
        self.single = np.log(p[1] / p[0]) - np.log((1 - p[1]) / (1 - p[0]))
        self.constant += float(np.log((1 - p[1]) / (1 - p[0])).sum())
        self.joint = np.zeros(len(self.pairs))
        for e, (i, j) in enumerate(self.pairs):
            # log p(i, j | class) - log p(i | class) p(j | class), by the four states of the pair
            cells = np.zeros((2, 2, 2))
            for y in (0, 1):
                n, a, b = total[y] + 1, p[y, i] * (total[y] + 1), p[y, j] * (total[y] + 1)
                both = np.clip(two[y, e] + 0.01 * min(a, b), max(1e-6 * min(a, b), a + b - n + 1e-6), min(a, b) * (1 - 1e-6))
                table = np.maximum(np.array([[n - a - b + both, b - both], [a - both, both]]) / n, 1e-12)
                cells[y] = np.log(table) - np.log(np.outer([1 - p[y, i], p[y, i]], [1 - p[y, j], p[y, j]]))
            c = np.clip(cells[1] - cells[0], -8, 8)
            self.constant += c[0, 0]
            self.single[i] += c[1, 0] - c[0, 0]
            self.single[j] += c[0, 1] - c[0, 0]
            self.joint[e] = c[1, 1] - c[1, 0] - c[0, 1] + c[0, 0]


def _expected(votes: DataFrame, model: LabelModel | None, weight: str, m: int, pairs: list[tuple[int, int]] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of the classes, of each voter and of each pair (all pairs, as a matrix, if ``pairs`` is None).

    weight: the column that says how many documents vote so; model: what tells
    their class, or None where the weight is that of the toxic ones and
    ``weight`` + "0" that of the others.
    """
    n_pairs = m * m if pairs is None else len(pairs)
    width = 1 + m + n_pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width), np.int64)
        for batch in common.slices(batches):
            lists = batch.column("fired")
            v = np.zeros((batch.num_rows, m))
            v[np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = 1
            n = batch.column(weight).to_numpy().astype(float)
            if model is None:
                each = (batch.column(weight + "0").to_numpy() * float(ONE), n * ONE)
            else:
                toxic = np.rint(model.posterior(v) * ONE)
                each = (n * (ONE - toxic), n * toxic)
            for y, w in enumerate(each):
                two = (v * w[:, None]).T @ v if pairs is None else np.array([(w * v[:, i] * v[:, j]).sum() for i, j in pairs])
                sums[y] += np.concatenate([[w.sum()], w @ v, two.ravel()]).astype(np.int64)
        y, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(y * width + at), pa.array(sums[y, at])], names=["cell", "w"])

    # one row for each count: of pairs, at most the square of the number of voters
    rows = common.map_batches(votes, run, "cell long, w long").groupBy("cell").agg(F.sum("w").alias("w")).collect()
    out = np.zeros(2 * width)
    for r in rows:
        out[r["cell"]] = r["w"] / ONE
    out = out.reshape(2, width)
    return out[:, 0], out[:, 1 : 1 + m], out[:, 1 + m :].reshape(2, m, m) if pairs is None else out[:, 1 + m :]


def forest(total: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of voters by how much they tell of one another given the class, without circles."""
    m = one.shape[1]
    every = max(total.sum(), 1e-9)
    information = np.zeros((m, m))
    for y in (0, 1):
        n = max(total[y], 1e-9)
        a, b = np.broadcast_to(one[y][:, None], (m, m)), np.broadcast_to(one[y][None, :], (m, m))
        for cell, x, z in ((two[y], a, b), (a - two[y], a, n - b), (b - two[y], n - a, b), (n - a - b + two[y], n - a, n - b)):
            cell = np.maximum(cell, 0)
            information += np.where(cell > 0, cell / every * np.log(np.maximum(cell * n, 1e-300) / np.maximum(x * z, 1e-300)), 0)
    root = list(range(m))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    out = []
    i, j = np.triu_indices(m, 1)
    info = np.round(information[i, j], 12)
    for e in np.lexsort((j, i, -info)):
        if info[e] < INFORMATION:
            break
        a, b = top(int(i[e])), top(int(j[e]))
        if a != b:
            root[a] = b
            out.append((int(i[e]), int(j[e])))
    return sorted(out)


def _of_pairs(two: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.array([[two[y][i, j] for i, j in pairs] for y in (0, 1)]).reshape(2, len(pairs))


def label_model(voted: DataFrame, chosen: DataFrame, lexicon: Lexicon, key: str = "doc_id") -> LabelModel:
    """Fitted to the votes on all documents. ``voted``: rows with ``hits``; ``chosen``: at most SAMPLE rows of an id and ``toxic``."""
    m = lexicon.n_voters
    marked = voted.select(key, _fired(lexicon).alias("fired")).join(F.broadcast(chosen), key, "left")
    known = [F.count_if(F.col("toxic") == y).alias(f"known{'0' * (1 - y)}") for y in (0, 1)]
    votes = common.cut(marked.groupBy("fired").agg(F.count("*").alias("n"), *known))
    # sums of a task are one row for each count: few rows of votes need few tasks
    votes = votes.coalesce(max(1, votes.count() // VOTES))
    sure = _expected(votes, None, "known", m, None)
    model = LabelModel(m)
    if sure[0].min() > 0:
        model.pairs = forest(*sure)
        model.learn(sure[0], sure[1], _of_pairs(sure[2], model.pairs))
    else:
        model.suspect(lexicon.suspects)
    for i in range(ROUNDS):
        regrow = i == ROUNDS // 2 or not model.pairs
        total, one, two = _expected(votes, model, "n", m, None if regrow else model.pairs)
        share = INFLUENCE * sure[0].sum() / max(1.0, total.sum()) if sure[0].sum() else 1.0
        total, one = sure[0] + share * total, sure[1] + share * one
        if regrow:
            two = sure[2] + share * two
            model.pairs = forest(total, one, two)
            two = _of_pairs(two, model.pairs)
        else:
            two = _of_pairs(sure[2], model.pairs) + share * two
        model.learn(total, one, two)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 12) -> tuple[np.ndarray, float]:
    """A linear classifier for soft labels, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
    return w[:-1], float(w[-1])


def train(voted: DataFrame, chosen: DataFrame, lexicon: Lexicon, key: str = "doc_id") -> Model:
    """The label model of all documents, and the classifier of its posteriors."""
    labeller = label_model(voted, chosen, lexicon, key)
    # at most TRAIN rows of at most as many numbers as there are terms
    rows = voted.select("hits").orderBy(F.xxhash64(key), key, "hits").limit(TRAIN).collect()
    x, v = np.zeros((len(rows), len(lexicon.voter_of))), np.zeros((len(rows), labeller.m))
    voter = np.array(lexicon.voter_of)
    for i, r in enumerate(rows):
        x[i, r["hits"]] = 1
        own = voter[r["hits"]] if r["hits"] else voter[:0]
        v[i, own[own >= 0]] = 1
    weights, constant = _logistic(x, labeller.posterior(v)) if rows else (np.zeros(x.shape[1]), -3.0)
    return Model(lexicon, weights, constant, labeller.single, dict(zip(labeller.pairs, labeller.joint.tolist(), strict=True)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Learns a model from all texts and from the labels of rows that are not held out."""
    chosen = common.cut(chosen_labels(labels, key, label))
    lexicon = mine(docs, chosen, text, key)
    return train(common.cut(vote(docs.select(key, text), lexicon, text).select(key, "hits")), chosen, lexicon, key)


def scored(voted: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` and ``predicted`` to rows with ``hits``."""
    weights = F.array(*[F.lit(float(w)) for w in model.weights])
    z = F.aggregate("hits", F.lit(model.constant), lambda acc, h: acc + F.get(weights, h))
    out = voted.withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0)))))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` and ``predicted`` to every row, from its text alone."""
    rest = docs.drop("score", "predicted")
    own = "hits" in rest.columns
    rest = rest.withColumnRenamed("hits", "__hits") if own else rest
    out = scored(vote(rest, model.lexicon, text), model).drop("hits")
    return out.withColumnRenamed("__hits", "hits") if own else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    chosen = common.cut(chosen_labels(common.table(spark, sf_dir, "labels")))
    lexicon = mine(docs, chosen)
    voted = common.cut(vote(docs, lexicon).select("doc_id", "hits"))
    out = scored(voted, train(voted, chosen, lexicon))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
