"""Toxicity by a classifier chain of linear models.

Features are the presence of hashed words and of hashed runs of five bytes inside words, so
words that share a stem share features. Categories are predicted in order: the model of a later
category also gets the earlier categories' probabilities. So that it learns from probabilities
as uncertain as those it will meet, its training rows carry out-of-fold ones: each row's come
from a model fitted on the other folds.

Training uses a bounded sample (``sample`` labelled rows, by md5 of the id), so its broadcast,
its copy in the shared folder and the design matrix on the driver have a size that does not grow
with the data. Every row of the corpus is then scored over its whole text, where it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstar.llm.common import _IS_WORD, _LOWER, add_columns, mix, stage, table, text_slices, word_hashes

SAMPLE = 20_000
N_FEATURES = 512
FOLDS = 5
GRAM = 5
BITS = 18
RIDGE = 0.3
#: chi-square below which a feature may be chance, with so many buckets
MIN_CHI = 20.0
#: category -> SQL condition over the labels table, in chain order
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of every feature of some texts; a place tells the text by its offsets."""
    mask = np.uint64((1 << BITS) - 1)
    parts_at, parts = [], []
    n = len(data)
    if n >= GRAM:
        b = _LOWER[data]
        ok = _IS_WORD[b]
        inside = ok[: n - GRAM + 1].copy()
        code = b[: n - GRAM + 1].astype(np.uint64)
        for k in range(1, GRAM):
            inside &= ok[k : n - GRAM + 1 + k]
            code = (code << np.uint64(8)) | b[k : n - GRAM + 1 + k]
        for e in off[1:-1]:  # a run does not reach over the end of a text
            inside[max(0, e - GRAM + 1) : e] = False
        at = np.flatnonzero(inside)
        parts_at.append(at)
        parts.append(mix(code[at] + np.uint64(1)) & mask)
    h, where = word_hashes(data, off)
    parts_at.append(np.repeat(off[:-1], np.diff(where)))
    parts.append(mix(h) & mask)
    return np.concatenate(parts_at), np.concatenate(parts).astype(np.int64)


@dataclass
class Chain:
    """Per category: its features, weights (features, earlier probabilities, constant) and threshold."""

    names: tuple[str, ...]
    lookup: np.ndarray  # bucket -> feature or -1
    n_features: int
    own: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def matrix(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        x = np.zeros((len(off) - 1, self.n_features), np.uint8)
        at, b = buckets(data, off)
        f = self.lookup[b]
        hit = f >= 0
        x[np.searchsorted(off, at[hit], side="right") - 1, f[hit]] = 1
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for own, w in zip(self.own, self.weights):
            out = np.column_stack([out, linear(x[:, own], out, w)])
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def design(x: np.ndarray, more: np.ndarray, chunk: int = 2048) -> Iterator[tuple[slice, np.ndarray]]:
    """Row blocks of (presence columns, more columns, constant) as doubles, so that only presence bytes are held whole."""
    for lo in range(0, len(x), chunk):
        at = slice(lo, lo + chunk)
        yield at, np.column_stack([x[at], more[at], np.ones(len(x[at]))])


def fit_linear(x: np.ndarray, more: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 20) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the constant is not shrunk."""
    n = x.shape[1] + more.shape[1] + 1
    w, shrink = np.zeros(n), np.full(n, ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        hessian, slope = np.diag(shrink), -shrink * w
        for at, d in design(x, more):
            p = sigmoid(d @ w)
            hessian += (d * (p * (1 - p))[:, None]).T @ d
            slope += d.T @ (y[at] - p)
        step = np.linalg.solve(hessian, slope)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def linear(x: np.ndarray, more: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[sigmoid(d @ w) for _, d in design(x, more)]])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Cut with the best F1 on out-of-fold probabilities; the middle one of equally good cuts.

    Cuts that flag all rows, or no more right rows than wrong ones, do not count; without another
    nothing is flagged.
    """
    order = np.argsort(-p, kind="stable")
    s, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    f1[2 * hits <= np.arange(1, len(s) + 1)] = -1
    f1[:-1][s[:-1] == s[1:]] = -1
    f1[-1] = -1
    if f1.max() < 0:
        return 2.0
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    at = best[len(best) // 2]
    return float((s[at] + s[at + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str]] = CATEGORIES, sample: int = SAMPLE, n_features: int = N_FEATURES, folds: int = FOLDS) -> Chain:
    """Fit on at most ``sample`` labelled documents. A row without the label of a category is left
    out of that category. A category without both classes always gets its base rate and is never flagged."""
    names = tuple(n for n, _ in categories)
    flags = labels.select("doc_id", *[F.expr(f"cast({c} as int)").alias(f"y{i}") for i, (_, c) in enumerate(categories)])
    flags = flags.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])
    # the bounded sample: this many rows of a few bytes each are broadcast
    chosen = flags.withColumn("k", F.md5(F.col("doc_id").cast("string").cast("binary"))).orderBy("k").limit(sample).drop("k")
    rows = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxic-sample")

    ys = [f"y{i}" for i in range(len(names))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + 2 * len(ys), 1 << BITS), np.int64)  # rows, then per category labelled and positive
        for batch in batches:
            y = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ys]
            for i, j, data, off in text_slices(batch, "text"):
                at, b = buckets(data, off)
                d = np.searchsorted(off, at, side="right") - 1
                pair = np.unique(d.astype(np.int64) << BITS | b)
                d, b = pair >> BITS, pair & ((1 << BITS) - 1)
                total[0] += np.bincount(b, minlength=1 << BITS)
                for k, v in enumerate(y):
                    v = v[i:j][d]
                    total[1 + 2 * k] += np.bincount(b[~np.isnan(v)], minlength=1 << BITS)
                    total[2 + 2 * k] += np.bincount(b[v == 1], minlength=1 << BITS)
        seen = np.flatnonzero(total[0])
        for lo in range(0, len(seen), 50_000):
            part = seen[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(t[part]) for t in total]], ["b", *[f"c{i}" for i in range(len(total))]])

    schema = "b long, " + ", ".join(f"c{i} long" for i in range(1 + 2 * len(ys)))
    sums = rows.mapInArrow(count, schema).groupBy("b").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(1 + 2 * len(ys))])
    base = rows.agg(*[f(F.col(y)).alias(f"{n}_{y}") for y in ys for n, f in (("n", F.count), ("p", F.sum))]).first()
    picked: list[list[int]] = []
    for k, y in enumerate(ys):
        n, p = base[f"n_{y}"] or 0, base[f"p_{y}"] or 0
        picked.append([])
        if not 0 < p < n:
            continue
        a, c = F.col(f"c{2 + 2 * k}"), F.col(f"c{1 + 2 * k}")
        gap = a * F.lit(float(n)) - c * F.lit(float(p))
        chi = gap * gap * n / (c * (F.lit(float(n)) - c) * float(p) * float(n - p))
        top = sums.filter(c < n).select("b", chi.alias("chi")).filter(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "b").limit(n_features)
        picked[-1] = sorted(r["b"] for r in top.collect())  # n_features rows
    chosen_buckets = sorted({b for own in picked for b in own})
    lookup = np.full(1 << BITS, -1, np.int32)
    lookup[chosen_buckets] = np.arange(len(chosen_buckets))
    chain = Chain(names, lookup, len(chosen_buckets), [lookup[own] for own in picked])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_slices(batch, "text"):
                x = chain.matrix(data, off)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[part.column(c) for c in ys], pa.array([np.flatnonzero(r).astype(np.int32) for r in x], pa.list_(pa.int32()))],
                    ["doc_id", *ys, "f"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(features, f"doc_id {kind}, " + ", ".join(f"{y} int" for y in ys) + ", f array<int>").toArrow()  # <= sample rows
    got = got.sort_by([("doc_id", "ascending")])
    x = np.zeros((len(got), chain.n_features), np.uint8)
    for i, f in enumerate(got["f"]):
        x[i, f.values.to_numpy()] = 1
    fold = np.arange(len(x)) % folds
    earlier = np.zeros((len(x), 0))  # out-of-fold probabilities
    for y, own in zip(ys, chain.own):
        v = got[y].to_numpy().astype(float)
        known = ~np.isnan(v)
        rate = float(v[known].mean()) if known.any() else 0.0
        mine = x[:, own]
        flat = np.zeros(len(own) + earlier.shape[1] + 1)
        flat[-1] = np.log((rate + 1e-9) / (1 - rate + 1e-9))
        if not 0 < rate < 1:
            chain.weights.append(flat)
            chain.thresholds.append(2.0)
            earlier = np.column_stack([earlier, np.full(len(x), rate)])
            continue
        oof = np.full(len(x), rate)
        for f in range(folds):
            train = known & (fold != f)
            if 0 < v[train].sum() < train.sum():
                w = fit_linear(mine[train], earlier[train], v[train])
                oof[fold == f] = linear(mine[fold == f], earlier[fold == f], w)
        chain.weights.append(fit_linear(mine[known], earlier[known], v[known]))
        chain.thresholds.append(best_threshold(oof[known], v[known]))
        earlier = np.column_stack([earlier, oof])
    return chain


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Every row with ``p_<category>`` and ``is_<category>`` of each category, over its whole text.

    Null and empty texts have no features, so they get the models' constants. Input columns of
    these names are replaced, others pass through; repeated rows are scored alike.
    """
    new = [T.StructField(f"p_{n}", T.DoubleType()) for n in chain.names] + [T.StructField(f"is_{n}", T.BooleanType()) for n in chain.names]
    taken = {f.name.lower() for f in new}
    keep = [c for c in docs.columns if c.lower() not in taken]
    body = f"c{keep.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_slices(batch, body):
                p = chain.predict(chain.matrix(data, off))
                part = batch.slice(i, j - i)
                columns = list(part.columns)
                columns += [pa.array(p[:, k]) for k in range(len(chain.names))]
                columns += [pa.array(p[:, k] >= chain.thresholds[k]) for k in range(len(chain.names))]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *[f"new{k}" for k in range(len(new))]])

    return add_columns(docs, keep, new, run)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, chain).drop("text").withColumnsRenamed({"is_toxic": "toxic", "is_low_quality": "low_quality"})
