"""A toxicity classifier regularised by counterfactuals.

Features are the words of a text and, for longer words, their first letters, each counted once per text.
The weights are those of a logistic regression with two penalties: a ridge, and the squared change of the
score when the identity terms of a labelled text are swapped for others of their kind. The second
keeps the model from scoring the mention of a group. Labels are read from at most `MAX_TOXIC` toxic and `MAX_CLEAN`
other rows, those of least hash, which bounds what the driver holds; rows are weighted back to the
labels' own shares. Every text is then scored whole, with a dictionary of all features that tell the labels apart in these rows.

Null and empty texts have no features and get the score of the intercept alone. Labels that are null, or whose doc_id is
null or without a document, teach nothing; with no labels at all, or labels of one kind only, every score is the smoothed share of
toxic labels. Repeated label rows count as often as they are given; repeated documents are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import cut, map_arrow, slices, strings

MAX_TOXIC, MAX_CLEAN = 4_000, 8_000
#: A feature is kept if it occurs in so many labelled texts, and tells the labels apart by so many standard errors, at least.
LEAST_TEXTS, LEAST_STRENGTH = 4, 3.0
PREFIXES = (4, 5, 6)
RIDGE, COUNTERFACTUAL, STEPS = 2e-4, 1.0, 400
THRESHOLD = 0.3

#: Identity terms by kind; terms of one kind stand in for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "natives", "citizens", "foreigners"),
    ("mexican", "chinese", "indian", "american", "french", "german", "spanish", "japanese", "russian", "turkish"),
    ("blind", "deaf", "disabled", "paralyzed"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
SWAP = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, t in enumerate(kind)}

words_of = re.compile(r"[^\W_]+").findall


def features_of(words: set[str]) -> set[str]:
    found = set(words)
    for n in PREFIXES:
        found.update(f"{w[:n]}*" for w in words if len(w) > n)
    return found


def swapped(words: set[str]) -> set[str]:
    return {SWAP.get(w, w) for w in words}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


class Model(NamedTuple):
    weights: dict[str, float]
    intercept: float

    def score(self, text: str) -> float:
        w = self.weights
        words = set(words_of(text.lower()))
        seen = words.intersection(w)
        for n in PREFIXES:
            seen.update({f"{x[:n]}*" for x in words if len(x) > n}.intersection(w))
        return float(1 / (1 + np.exp(-(self.intercept + sum(w[f] for f in sorted(seen))))))


def sample(documents: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(doc_id, y, text) of the labelled rows of least hash, within the bounds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    ordered = known.withColumn("h", F.xxhash64("doc_id"))
    chosen = ordered.where("y = 1").orderBy("h", "doc_id").limit(max_toxic).union(ordered.where("y = 0").orderBy("h", "doc_id").limit(max_clean))
    # bounded by the two limits
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")


def texts_features(sampled: DataFrame) -> DataFrame:
    """(y, features, swapped): swapped is null for a text without identity terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        for part in slices(batches):
            sets = [set(words_of(t.lower())) for t in strings(part.column(1))]
            other = [None if s.isdisjoint(SWAP) else sorted(features_of(swapped(s))) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sorted(features_of(s)) for s in sets], kind), pa.array(other, kind)], names=["y", "features", "swapped"])

    return map_arrow(sampled.select("y", "text"), run, "y int, features array<string>, swapped array<string>")


def train(
    documents: DataFrame,
    labels: DataFrame,
    max_toxic: int = MAX_TOXIC,
    max_clean: int = MAX_CLEAN,
    counterfactual: float = COUNTERFACTUAL,
    ridge: float = RIDGE,
    steps: int = STEPS,
) -> Model:
    """Fit on the rows given: leave out of `labels` what must not be learnt from."""
    shares = {r["y"]: r["n"] for r in labels.select(F.col("toxic").cast("int").alias("y")).where("y in (0, 1)").groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1)
    constant = Model({}, float(np.log(prior / (1 - prior))))
    if len(shares) < 2:
        return constant
    data = cut(texts_features(sample(documents, labels, max_toxic, max_clean)))
    sizes = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return constant
    counts = data.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).where(F.col("pos") + F.col("neg") >= LEAST_TEXTS)
    # the difference of log shares in standard errors: what chance would hardly give
    difference = F.abs(F.log((F.col("pos") + 0.5) / (sizes[1] + 1)) - F.log((F.col("neg") + 0.5) / (sizes[0] + 1)))
    strength = difference / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    chosen = [r["f"] for r in counts.where(strength >= LEAST_STRENGTH).orderBy(F.desc(strength), "f").select("f").collect()]
    column = {f: i for i, f in enumerate(dict.fromkeys([*chosen, *SWAP]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        pick = lambda found: None if found is None else sorted(column[f] for f in found if f in column)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([pick(x) for x in part.column(k).to_pylist()], ints) for k in (1, 2))], names=["y", "x", "swapped"])

    rows = map_arrow(data, run, "y int, x array<int>, swapped array<int>").collect()
    y = np.array([r["y"] for r in rows], np.float64)
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    weight /= weight.sum()
    x = sparse([r["x"] for r in rows])
    changed = [r for r in rows if r["swapped"] is not None]
    pairs = (sparse([r["x"] for r in changed]), sparse([r["swapped"] for r in changed]), len(changed))
    w, b = descend(x, y, weight, pairs, len(column), float(np.log(prior / (1 - prior))), ridge, counterfactual, steps)
    return Model({f: float(w[i]) for f, i in column.items() if w[i]}, b)


def sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ones."""
    sizes = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), sizes), np.fromiter((c for r in rows for c in r), np.int64, sum(sizes))


def descend(x, y, weight, pairs, n_features, start, ridge, counterfactual, steps, rate=0.1):  # noqa: ANN001, ANN201
    """Adam on the weighted log loss with both penalties."""
    w, b = np.zeros(n_features), start
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    n, (own, other, n_pairs) = len(y), pairs
    for t in range(1, steps + 1):
        z = b + np.bincount(x[0], w[x[1]], n)
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g, gb = np.bincount(x[1], slope[x[0]], n_features) + 2 * ridge * w, slope.sum()
        if n_pairs:
            change = (np.bincount(own[0], w[own[1]], n_pairs) - np.bincount(other[0], w[other[1]], n_pairs)) * (2 * counterfactual / n_pairs)
            g += np.bincount(own[1], change[own[0]], n_features) - np.bincount(other[1], change[other[0]], n_features)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate / np.sqrt(1 - 0.999**t) * (1 - 0.9**t) ** -1 * (1 - 0.999**t)
        w -= step * m / (np.sqrt(v) + 1e-9)
        b -= step * mb / (np.sqrt(vb) + 1e-9)
    return w, b


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """`keep` and a double, `name`, for every whole text."""
    kept = documents.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [model.score(t) for t in strings(part.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(found, pa.float64())], names=[*keep, name])

    return map_arrow(kept, run, ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1]) + f", `{name}` double")


def judged(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from labels of rows that are not held out."""
    model = train(documents, labels.where(~held_out(F.col("doc_id"))), **options)
    return score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def not_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents below the threshold, with all their columns; all of them where the labels teach nothing."""
    model = train(documents, labels.where(~held_out(F.col("doc_id"))), **options)
    if not model.weights:
        return documents
    names = documents.columns
    if len(set(names)) < len(names):
        raise ValueError("documents has two columns of one name")
    scored = score(documents, model, keep=tuple(names), name="__score")
    return scored.where(F.col("__score") < THRESHOLD).select(*names)
