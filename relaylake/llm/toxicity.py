"""Toxicity by a counterfactually regularised linear classifier.

Features of a text are its words and their beginnings, hashed: that one occurs, and that it occurs again.
A logistic regression with an L1 penalty is fitted on labelled texts. Where a
labelled sentence names a group of people, its twin with the term of another
group is made, and the squared change of score between the two is penalised; so
are changes between neutral template sentences about any two groups. A mention
alone then moves no score.

Plan: labels are cut to a bounded sample by hash before anything else, so the
join is by broadcast of at most ``max_labelled`` rows. Features are extracted in
parallel, one task fits, and the model (at most SELECTED weights) goes to a map
over all texts.

SELECTED and SIGNIFICANT are parameters of the model, as is the penalty: the features that tell
the classes apart best, and by more than chance, have weights and the others none, in labelled
texts and in scored ones alike. The step of the descent comes from the largest curvature of the loss, found by
power iteration, so it converges for texts of any number of features.

Defined results: null labels and labels without a text are left out; of an id with
several texts the one with the least hash is learnt from, and all are scored; an id
that is labelled twice counts twice; without a text of either class, or a feature that tells them apart, nothing is toxic;
null and empty texts score as texts without features; a very long text is scored
whole; repeated rows and rows that repeat an id are scored each; the score lies in 0..1
and a text is toxic from ``threshold`` on, so a score equal to it is; labels that tie in
the order of the sample are equal; empty tables give no rows, or every score near 0 where
the labels are missing; a column called like the score gives way, others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import strings, text_batches
from .textscan import WORD_BYTES, buffers, chunks, lowered, prefix, range_hash, words

#: The bound of the labelled sample that the classifier is fitted on.
MAX_LABELLED = 20_000
#: Features have 31 bits: with fewer, very long texts, of 100,000 features and more, meet weights by collision.
DIM_BITS, PREFIXES, SELECTED, THRESHOLD = 31, (4, 5, 6, 7), 2048, 0.5
#: Features whose log odds between the classes are fewer standard errors from 0 have no weight: chance ones would add up in very long texts.
SIGNIFICANT = 3.0

#: Terms that are swapped with each other, by language.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"], ["gay", "straight"], ["lesbian", "heterosexual"], ["transgender", "cisgender"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["immigrants", "citizens", "refugees"], ["black", "white", "asian", "latino"], ["african", "european", "american", "arab", "chinese", "mexican"], ["disabled", "deaf", "blind", "elderly"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["frauen", "männer"], ["muslime", "christen", "juden"], ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"],
]
TEMPLATES = ["I am a {} person.", "My neighbours are {}.", "The {} people of this town met yesterday.", "She wrote a book about {} history.", "We invited {} friends."]
_SWAPS = {t: group[(k + 1) % len(group)] for group in IDENTITY_TERMS for k, t in enumerate(group)}
_TERM = re.compile(r"(?<!\w)(" + "|".join(sorted(_SWAPS, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


@dataclass(frozen=True)
class Model:
    """Feature numbers in order, their weights, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and word beginning."""
    hashes, start, end, bounds = words(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    shift = np.uint64(64 - DIM_BITS)
    texts, features = [text], [(hashes >> shift).astype(np.int64)]
    if len(hashes):
        sums = prefix(WORD_BYTES[data])
        for size in PREFIXES:
            long = np.flatnonzero(end - start > size)
            beginning = range_hash(sums, start[long], start[long] + size) * np.uint64(2 * size + 1)
            texts.append(text[long])
            features.append((beginning >> shift).astype(np.int64))
    return np.concatenate(texts), np.concatenate(features)


def again(feature: np.ndarray) -> np.ndarray:
    """The number of the feature "this feature occurs more than once"."""
    return (feature * 0x5851F42D + 0x14057B7E) & ((1 << DIM_BITS) - 1)


class Places:
    """Places of features in a sorted array; a table over their leading bits rules most others out."""

    SHIFT = DIM_BITS - 20

    def __init__(self, chosen: np.ndarray):
        self.chosen = chosen
        self.near = np.zeros(1 << 20, bool)
        self.near[chosen >> self.SHIFT] = True

    def may(self, feature: np.ndarray) -> np.ndarray:
        """Whether each can be among them."""
        return self.near[feature >> self.SHIFT]

    def of(self, feature: np.ndarray) -> np.ndarray:
        """The place of each, -1 where it is not among them."""
        out = np.full(len(feature), -1, np.int32)
        some = np.flatnonzero(self.may(feature))
        if len(some):
            at = np.minimum(np.searchsorted(self.chosen, feature[some]), len(self.chosen) - 1)
            hit = self.chosen[at] == feature[some]
            out[some[hit]] = at[hit]
        return out


def distinct_features(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct features of each text."""
    text, feature = occurrences(*buffers(lowered(strings(pa.array(texts, pa.string())))))
    key, count = np.unique((text << DIM_BITS) | feature, return_counts=True)
    twice = key[count > 1]
    key = np.unique(np.concatenate([key, (twice >> DIM_BITS << DIM_BITS) | again(twice)]))
    cut = np.searchsorted(key >> DIM_BITS, np.arange(len(texts) + 1))
    return [key[a:b] & ((1 << DIM_BITS) - 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def swapped(sentence: str) -> str:
    """The sentence with every identity term replaced by the next of its group."""
    return _TERM.sub(lambda m: _SWAPS[m.group(0).lower()], sentence)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, features, twin): labelled texts, and with ``twin`` pairs of sentences."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            yield _labelled(batch.slice(at, 128))


def _labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, labels = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
    rows = [(label, f, None) for label, f in zip(labels, distinct_features(texts), strict=True)]
    for text in texts:
        if _TERM.search(text):
            said = [s for s in _SENTENCE.split(text) if _TERM.search(s)]
            both = distinct_features([*said, *map(swapped, said)])
            rows += [(0, a, b) for a, b in zip(both[: len(said)], both[len(said) :], strict=True)]
    kinds = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kinds), pa.array([r[2] for r in rows], kinds)], names=["toxic", "features", "twin"])


def curvature(hessian, size: int, rounds: int = 60) -> float:
    """The largest eigenvalue of a positive semidefinite map, by power iteration, with a margin."""
    v, found = 1 + np.arange(size) % 7 / 7, 0.0
    for _ in range(rounds):
        v = v / np.sqrt(v @ v)
        after = hessian(v)
        found = max(found, float(v @ after), float(np.sqrt(after @ after)))
        if not after.any():
            break
        v = after
    return 1.05 * found + 1e-9


def fit(labels: np.ndarray, rows: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], *, l1: float = 2e-4, l2: float = 2e-4, fairness: float = 1.0, steps: int = 1000, tolerance: float = 1e-4) -> Model:
    """Proximal gradient descent with momentum on the selected features, until no weight moves by more than ``tolerance``.

    The loss is the mean of the classes' mean logistic losses, plus ``fairness`` times
    the mean squared change of score over the pairs, plus ``l1`` times the weights' sizes
    and half of ``l2`` times their squares.
    """
    none = Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    toxic = labels > 0
    if not toxic.any() or toxic.all():
        return none
    feature = np.concatenate(rows)
    text = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    (bad, p), (good, n) = (np.unique(feature[x[text]], return_counts=True) for x in (toxic, ~toxic))
    every = np.union1d(bad, good)
    counts = np.zeros((2, len(every)), np.int64)
    counts[0, np.searchsorted(every, bad)], counts[1, np.searchsorted(every, good)] = p, n
    often = counts.sum(0) >= 3
    every, p, n = every[often].astype(np.int64), *counts[:, often]
    many, few = toxic.sum(), (~toxic).sum()
    odds = np.log((p + 0.5) / (many - p + 0.5)) - np.log((n + 0.5) / (few - n + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5) + 1 / (many - p + 0.5) + 1 / (few - n + 0.5))
    best = np.sort(np.lexsort((every, -z))[:SELECTED])
    chosen = every[best[z[best] >= SIGNIFICANT]]
    if not len(chosen):
        return none
    places = Places(chosen)
    feature = places.of(feature)
    keep = feature >= 0
    text, feature = text[keep], feature[keep]
    neutral = [distinct_features([t.format(x) for x in group for t in TEMPLATES]) for group in IDENTITY_TERMS]
    pairs = pairs + [(g[i], g[i + len(TEMPLATES)]) for g in neutral for i in range(len(g) - len(TEMPLATES))]
    pair, changed, sign = [], [], []
    for k, (a, b) in enumerate(pairs):
        for only, s in ((np.setdiff1d(a, b), 1.0), (np.setdiff1d(b, a), -1.0)):
            only = places.of(only)
            only = only[only >= 0]
            pair.append(np.full(len(only), k))
            changed.append(only)
            sign.append(np.full(len(only), s))
    pair, changed, sign = (np.concatenate(x) for x in (pair, changed, sign))
    share = np.where(toxic, 0.5 / many, 0.5 / few)
    y, width = toxic.astype(float), len(chosen)

    def spread(v: np.ndarray) -> np.ndarray:
        return v[-1] + np.bincount(text, v[feature], len(rows))

    def gather(slip: np.ndarray, v: np.ndarray) -> np.ndarray:
        grad = np.append(np.bincount(feature, slip[text], width) + l2 * v[:-1], slip.sum())
        if len(pair):
            moved = np.bincount(pair, sign * v[changed], len(pairs))
            grad[:-1] += fairness * 2 / len(pairs) * np.bincount(changed, sign * moved[pair], width)
        return grad

    rate = 1 / curvature(lambda v: gather(0.25 * share * spread(v), v), width + 1)
    w = v = np.zeros(width + 1)
    moment = 1.0
    for _ in range(steps):
        score = spread(v)
        new = v - rate * gather(share * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y), v)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * l1, 0)
        if (v - new) @ (new - w) > 0:  # the momentum points uphill
            moment = 1.0
        after = (1 + np.sqrt(1 + 4 * moment**2)) / 2
        v = new + (moment - 1) / after * (new - w)
        still = np.abs(new - w).max() <= tolerance
        w, moment = new, after
        if still:
            break
    live = np.flatnonzero(w[:-1])
    return Model(chosen[live], w[live], float(w[-1]))


def _fitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, rows, pairs = [], [], []
    for batch in batches:
        for toxic, features, twin in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            mine = features.values.to_numpy()
            if twin.is_valid:
                pairs.append((mine, twin.values.to_numpy()))
            else:
                labels.append(toxic)
                rows.append(mine)
    if rows:
        m = fit(np.array(labels), rows, pairs)
        yield pa.RecordBatch.from_arrays([pa.array([*m.features.tolist(), -1], pa.int64()), pa.array([*m.weights.tolist(), m.intercept], pa.float64())], names=["feature", "weight"])


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_id: str = "doc_id", label_column: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on the first ``max_labelled`` labels in order of a hash of their id."""
    text_batches(docs.sparkSession)
    key, label = F.col(f"`{label_id}`").cast("bigint"), F.col(f"`{label_column}`").cast("int")
    sample = labels.where(key.isNotNull() & label.isNotNull()).select(key.alias("k"), label.alias("toxic")).orderBy(F.xxhash64("k"), "k", "toxic").limit(max_labelled)
    texts = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("k"), F.col(f"`{text_column}`").alias("text")).join(F.broadcast(sample.select("k").distinct()), "k")
    # One text for each id, so that a repeated id does not lift the bound.
    rows = texts.groupBy("k").agg(F.min_by("text", F.xxhash64("text")).alias("text")).join(F.broadcast(sample), "k")
    # Sorted, so that the sums of the fit do not depend on the order in which tasks end.
    made = rows.select("toxic", "text").mapInArrow(_extract, "toxic int, features array<int>, twin array<int>")
    found = made.repartition(1).sortWithinPartitions("toxic", F.xxhash64("features"), "twin").mapInArrow(_fitter, "feature bigint, weight double").collect()
    weights = sorted((r.feature, r.weight) for r in found)
    if not weights:
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    return Model(np.array([f for f, _ in weights[1:]], np.int64), np.array([w for _, w in weights[1:]]), weights[0][1])


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """Score of each text of an Arrow string array."""
    places, out = Places(model.features), []
    for first, last, data, offsets in chunks(lowered(strings(column))):
        text, feature = occurrences(data, offsets)
        live = places.may(feature) | places.may(again(feature))
        key, count = np.unique((text[live] << DIM_BITS) | feature[live], return_counts=True)
        twice = key[count > 1]
        key = np.unique(np.concatenate([key, (twice >> DIM_BITS << DIM_BITS) | again(twice)]))
        at = places.of(key & ((1 << DIM_BITS) - 1))
        key, at = key[at >= 0], at[at >= 0]
        sums = np.bincount(key >> DIM_BITS, model.weights[at], last - first) if len(key) else np.zeros(last - first)
        out.append(1 / (1 + np.exp(-np.clip(model.intercept + sums, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def with_scores(docs: DataFrame, model: Model, *, text_column: str = "text", score_column: str = "toxicity", keep: tuple[float, float] = (0.0, 1.1)) -> DataFrame:
    """``docs`` with a score; only rows with keep[0] <= score < keep[1]. An input column of that name gives way."""
    names = [c for c in docs.columns if c.lower() != score_column.lower()]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = next(k for k, c in enumerate(names) if c.lower() == text_column.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(batch.column(at), model)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, score_column])
            yield out.filter(pa.array((found >= keep[0]) & (found < keep[1])))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_column, T.DoubleType())]))


def toxic_documents(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxicity) of every document that the classifier rejects."""
    model = train(docs, labels, id_column=id_column, text_column=text_column)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    return with_scores(rows, model, keep=(threshold, 1.1)).select("doc_id", F.round("toxicity", 6).alias("toxicity"))
