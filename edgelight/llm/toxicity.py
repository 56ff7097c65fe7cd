"""Toxicity by a classifier chain: linear models in turn, each fed the probabilities of the ones before it."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .common import documents, free_column

#: Labelled rows of each class that a model is fitted on, at most; features that a model keeps, at most.
SAMPLE_ROWS, FEATURES = 6000, 4096
FOLDS, STEM = 5, 5
#: Standard errors by which the shares of a word in two classes must differ for it to be a feature.
SIGNIFICANT = 3.5

_WORDS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> np.ndarray:
    """Hashes of the words of a whole text, lower case, each once, and of the first letters of the longer ones."""
    words = set(_WORDS.findall((text or "").lower()))
    words |= {"^" + w[:STEM] for w in words if len(w) > STEM}
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words))


@dataclass
class Rows:
    """A sparse 0/1 matrix by rows, and a dense part beside it."""

    ids: np.ndarray
    starts: np.ndarray
    width: int
    dense: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray], vocabulary: np.ndarray, dense: np.ndarray) -> Rows:
        kept = []
        for x in lists:
            at = np.searchsorted(vocabulary, x)
            inside = at < len(vocabulary)
            at, x = at[inside], x[inside]
            kept.append(np.unique(at[vocabulary[at] == x]))
        return cls(np.concatenate([*kept, np.zeros(0, np.int64)]).astype(np.int64), np.cumsum([0, *map(len, kept)]), len(vocabulary), dense)

    def take(self, rows: np.ndarray) -> Rows:
        parts = [self.ids[self.starts[r] : self.starts[r + 1]] for r in rows]
        return Rows(np.concatenate([*parts, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, parts)]), self.width, self.dense[rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[: self.width][self.ids])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]] + self.dense @ w[self.width :]

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.ids, np.repeat(r, np.diff(self.starts)), self.width), self.dense.T @ r])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_linear(x: Rows, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Logistic regression with a ridge, by gradient steps with momenta (Adam); the last coefficient is the intercept."""
    w = np.zeros(x.width + x.dense.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        g = x.transposed_times((sigmoid(x.times(w)) - y) * weight)
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 / (1 + t / 50) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def choose_features(lists: list[np.ndarray], targets: list[np.ndarray], most: int) -> np.ndarray:
    """The hashes that tell the classes apart best: largest difference of document shares, in standard errors."""
    flat = np.concatenate([*lists, np.zeros(0, np.uint32)])
    words, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    score = np.zeros(len(words))
    for y in targets:
        if 0 < y.sum() < len(y):
            share = np.bincount(inverse, y[row], len(words)) / y.sum()
            rest = np.bincount(inverse, 1 - y[row], len(words)) / (len(y) - y.sum())
            p = n / len(y)
            score = np.maximum(score, np.abs(share - rest) / np.sqrt(p * (1 - p) * (1 / y.sum() + 1 / (len(y) - y.sum())) + 1e-12))
    score[(n < 2) | (score < SIGNIFICANT)] = 0
    return np.sort(words[np.argsort(-score, kind="stable")[: min(most, int((score > 0).sum()))]])


@dataclass
class Chain:
    names: list[str]
    vocabulary: np.ndarray
    coefficients: list[np.ndarray]
    thresholds: list[float]
    out_of_fold: list[np.ndarray] = field(default_factory=list)

    def scores(self, texts: pd.Series) -> np.ndarray:
        """A column of probabilities per category; a text without words is 0 in all."""
        lists = [features(t) for t in texts]
        x = Rows.of(lists, self.vocabulary, np.ones((len(lists), 1)))
        done: list[np.ndarray] = []
        for w in self.coefficients:
            x.dense = np.column_stack([*done, np.ones(len(lists))])
            done.append(sigmoid(x.times(w)))
        out = np.column_stack(done)
        out[[not len(f) for f in lists]] = 0
        return out


def fit_chain(lists: list[np.ndarray], targets: dict[str, np.ndarray], weight: np.ndarray, most: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Fits the models in the order of targets.

    The model of a category sees, beside the words, the probabilities of the categories before it. In training these are
    out-of-fold ones: what a model says of rows it was not fitted on, as it will be for new texts. They also choose the
    threshold of each category, the one with the best F1; it is infinite for a category that lacks one of its classes.
    """
    names, ys = list(targets), list(targets.values())
    vocabulary = choose_features(lists, ys, most)
    # Texts of the same words must not be on both sides of a fold: the words choose it. Nor may a row choose the features of
    # the model that judges it.
    fold = np.array([zlib.crc32(np.sort(x).tobytes()) for x in lists], np.int64) % folds
    parts = []
    for k in range(folds):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(outside) and len(inside):
            own = choose_features([lists[i] for i in inside], [y[inside] for y in ys], most)
            parts.append((inside, outside, Rows.of(lists, own, np.ones((len(lists), 1)))))
    done: list[np.ndarray] = []
    coefficients, thresholds = [], []
    for y in ys:
        x = Rows.of(lists, vocabulary, np.column_stack([*done, np.ones(len(lists))]))
        coefficients.append(fit_linear(x, y, weight) if len(y) else np.zeros(len(vocabulary) + len(done) + 1))
        held_out = np.zeros(len(lists))
        for inside, outside, own in parts:
            own.dense = x.dense
            held_out[outside] = sigmoid(own.take(outside).times(fit_linear(own.take(inside), y[inside], weight[inside])))
        thresholds.append(best_threshold(held_out, y, weight) if y.any() and not y.all() else float("inf"))
        done.append(held_out)
    return Chain(names, vocabulary, coefficients, thresholds, done)


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    best, at = -1.0, 0.5
    for t in sorted(np.linspace(0.1, 0.9, 17), key=lambda t: abs(t - 0.5)):
        hit, said, true = (weight * y)[p >= t].sum(), weight[p >= t].sum(), (weight * y).sum()
        f1 = 2 * hit / (said + true) if said + true else 0.0
        if f1 > best + 1e-9:
            best, at = f1, float(t)
    return at


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int, seed: int, id_column: str, text_column: str) -> tuple[DataFrame, dict[int, float]]:
    """(_text, _id, _class, _y0, ...): at most rows labelled documents of each class of the last category, chosen by a hash of the id, and how
    many rows each stands for. Labels with a null in a category are left out before anything else is looked at."""
    columns = [c.cast("double").alias(f"_y{i}") for i, c in enumerate(categories.values())]
    labels = labels.select(F.col(id_column).alias("_id"), list(categories.values())[-1].cast("int").alias("_class"), *columns).dropna()
    totals = {r["_class"]: r["count"] for r in labels.groupBy("_class").count().collect()}
    order = [F.xxhash64(F.lit(seed), F.col("_id")), F.col("_id"), *[F.col(f"_y{i}") for i in range(len(columns))]]
    parts = [labels.where(F.col("_class") == c).orderBy(*order).limit(rows) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    # The sample has 2 * rows rows at most, whatever the input: small enough for every executor.
    texts = docs.select(F.col(id_column).alias("_of"), F.col(text_column).alias("_text")).where("_text is not null")
    found = texts.join(F.broadcast(chosen), F.col("_of") == F.col("_id")).drop("_of")
    return found, {c: totals.get(c, 0) / max(1, min(rows, totals.get(c, 0))) for c in (0, 1)}


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = SAMPLE_ROWS, seed: int = 3, id_column: str = "doc_id", text_column: str = "text") -> Chain:
    """A chain over categories (name: 0/1 column of labels, in order), fitted on a bounded sample of labelled documents.

    The sample has at most rows documents of each class of the last category; executors turn the whole texts of those, and of
    no others, into hashed features and only these come to the driver. Rows with a null id, label or text are left out, repeated
    labels or documents count each; the order of rows, of equal ones as well, makes no difference. Other columns of docs and
    labels are not read. With no labelled rows (an empty table is such a case), or none of a class, a category's
    probability is the same for all texts and its threshold is not passed.
    """
    found, stands_for = labelled_sample(docs, labels, categories, rows, seed, id_column, text_column)

    @F.pandas_udf(BinaryType())
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.sort(features(t)).tobytes() for t in texts])

    ys = [f"_y{i}" for i in range(len(categories))]
    got = found.select("_id", "_class", *ys, hashed("_text").alias("_x")).toPandas()
    got = got.sort_values(["_id", "_class", *ys, "_x"], kind="stable")
    lists = [np.frombuffer(x, np.uint32) for x in got["_x"]]
    weight = np.array([stands_for[c] for c in got["_class"]], float)
    return fit_chain(lists, {n: got[y].to_numpy(float) for n, y in zip(categories, ys, strict=True)}, weight)


def score_columns(docs: DataFrame, names: list[str]) -> dict[str, str]:
    """What score() calls its columns: p_<category> and is_<category>, with underscores in front where docs has such a column."""
    return {f"{kind}_{n}": free_column(docs, f"{kind}_{n}") for n in names for kind in ("p", "is")}


def score(docs: DataFrame, chain: Chain, text_column: str = "text") -> DataFrame:
    """docs with p_<category> double and is_<category> boolean for each category of the chain (see score_columns).

    A null text, an empty one and one without letters are 0 and false in all. Each row is judged by its whole text alone, however
    long: equal texts have equal scores, and null ids, ties and repeated rows need no care. All columns of docs stay as they are;
    an empty table gives an empty result.
    """
    schema = StructType([StructField(n, DoubleType()) for n in chain.names])

    @F.pandas_udf(schema)
    def scored(texts: pd.Series) -> pd.DataFrame:
        # A few hundred texts at a time keep memory low however long the batch is.
        parts = [chain.scores(texts.iloc[i : i + 256]) for i in range(0, len(texts), 256)]
        return pd.DataFrame(np.concatenate([*parts, np.zeros((0, len(chain.names)))]), columns=chain.names)

    at, called = free_column(docs, "_scores"), score_columns(docs, chain.names)
    out = docs.withColumn(at, scored(F.col(text_column)))
    parts = [(F.col(at)[n].alias(called[f"p_{n}"]), (F.col(at)[n] >= F.lit(t)).alias(called[f"is_{n}"])) for n, t in zip(chain.names, chain.thresholds, strict=True)]
    return out.select(*docs.columns, *[c for pair in parts for c in pair])


def categories() -> dict[str, Column]:
    """What the labels tell of: poor writing first, as it often comes with abuse, then toxicity."""
    return {"low_quality": F.lit(1) - F.col("quality"), "toxic": F.col("toxic")}


def op8_toxicity_chain(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = fit(docs, labels, categories())
    return score(docs.select("doc_id", "text"), chain).select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))
