"""Toxicity by classifier chains.

The categories are predicted one after the other. Each has a logistic model over
words, word beginnings and a few shares of characters; a later model also gets
the probabilities of the earlier categories. For training those come from models
that have not seen the row (out-of-fold), so the later models learn to trust
them as much as they deserve.

The models are fitted on a bounded sample of labelled rows (``max_labelled``);
choosing the features counts all of that sample in Spark. Scoring reads every
whole text once, where it lies, without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, mapped, table

#: ASCII punctuation and control characters part words; A-Z are lower-cased.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_BLANK = np.array([b in b" \t\n\v\f\r" for b in range(256)])
#: Lengths in bytes of the word beginnings that are features (0: the word itself).
STEMS = (0, 4, 5)
SHARES = ("log_words", "distinct", "letters", "upper", "digits", "marks")


def features(text: str | None) -> tuple[list[set[bytes]], list[float]]:
    """The distinct words and beginnings of a whole text, and its shares; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_TO_WORDS).split()
    own = set(words)
    data = np.frombuffer(raw, np.uint8)
    n = max(1, len(data))
    letters, blank, digits = (int(np.count_nonzero(t[data])) for t in (_LETTER, _BLANK, _DIGIT))
    shares = [math.log1p(len(words)) / 10, len(own) / max(1, len(words)), letters / n, int(np.count_nonzero(_UPPER[data])) / n, digits / n, (len(data) - letters - blank - digits) / n]
    return [{w[:k] for w in own if len(w) > k} if k else own for k in STEMS], shares


@dataclass
class ChainModel:
    """Weights of each category: one a feature, one a share, one an earlier category, and the constant."""

    labels: list[str]
    names: list[dict[bytes, int]] = field(default_factory=lambda: [{} for _ in STEMS])
    weights: list[np.ndarray] = field(default_factory=list)

    @property
    def n_names(self) -> int:
        return sum(map(len, self.names))

    def present(self, text: str | None) -> tuple[list[int], list[float]]:
        found, shares = features(text)
        return [names[w] for names, own in zip(self.names, found, strict=True) for w in names.keys() & own], shares

    def scores(self, text: str | None) -> list[float]:
        at, shares = self.present(text)
        n, out = self.n_names, []
        for w in self.weights:
            z = float(w[at].sum() + np.dot(w[n : n + len(SHARES)], shares) + np.dot(w[n + len(SHARES) : -1], out) + w[-1])
            out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
        return out


# ------------------------------------------------------------------ fitting


class _Rows:
    """A sparse 0/1 matrix beside a dense one and a column of ones."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n_cols: int, dense: np.ndarray) -> None:
        self.row, self.col, self.n_cols, self.dense = row, col, n_cols, dense

    def take(self, keep: np.ndarray) -> _Rows:
        new = np.cumsum(keep) - 1
        inside = keep[self.row]
        return _Rows(new[self.row[inside]], self.col[inside], self.n_cols, self.dense[keep])

    def with_column(self, x: np.ndarray) -> _Rows:
        return _Rows(self.row, self.col, self.n_cols, np.column_stack([self.dense, x]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        n = self.n_cols
        return np.bincount(self.row, w[:n][self.col], len(self.dense)) + self.dense @ w[n:-1] + w[-1]

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, r[self.row], self.n_cols), self.dense.T @ r, [r.sum()]])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: _Rows, y: np.ndarray, penalty: float = 1.0, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Weights of an L2-penalised logistic model (the constant is free), by L-BFGS. One class only: its constant."""
    w = np.zeros(x.n_cols + x.dense.shape[1] + 1)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = math.log(rate / (1 - rate))
    if len(np.unique(y)) < 2:
        return w
    # A feature that one class hardly has may weigh more: its penalty is divided by its squared log-odds ratio.
    ones, n = np.bincount(x.col, y[x.row], x.n_cols), np.bincount(x.col, minlength=x.n_cols)
    odds = np.log((ones + 0.5) / (y.sum() + 1)) - np.log((n - ones + 0.5) / (len(y) - y.sum() + 1))
    free = np.full(len(w), penalty)
    free[: x.n_cols] /= np.maximum(odds * odds, 0.01)
    free[-1] = 0

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(w)
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (free * w * w).sum()), x.t_dot(_sigmoid(z) - y) + free * w

    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, used = -slope, []
        for s, d in reversed(past):
            a = (s @ way) / (s @ d)
            used.append(a)
            way = way - a * d
        if past:
            s, d = past[-1]
            way = way * ((s @ d) / (d @ d))
        else:
            way = way / max(1.0, np.linalg.norm(slope))
        for (s, d), a in zip(past, reversed(used), strict=True):
            way = way + (a - (d @ way) / (s @ d)) * s
        step = 1.0
        while step > 1e-8:
            new_value, new_slope = loss(w + step * way)
            if new_value <= value + 1e-4 * step * (slope @ way):
                break
            step /= 2
        s, d = step * way, new_slope - slope
        if s @ d > 1e-12:
            past = [*past[-memory + 1 :], (s, d)]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        w, value, slope = w + s, new_value, new_slope
        if done:
            break
    return w


def fit_chain(x: _Rows, ys: list[np.ndarray], fold: np.ndarray) -> list[np.ndarray]:
    """One model a category; what the later ones see of the earlier ones is out-of-fold."""
    weights = []
    for i, y in enumerate(ys):
        weights.append(fit_logistic(x, y))
        if i + 1 < len(ys):
            seen = np.zeros(len(y))
            for k in np.unique(fold):
                held = fold == k
                seen[held] = _sigmoid(x.take(held).dot(fit_logistic(x.take(~held), y[~held])))
            x = x.with_column(seen)
    return weights


def _significance(n: np.ndarray, ones: np.ndarray, total: int, total_ones: int) -> np.ndarray:
    """Pearson's chi-square of a feature's presence against the label."""
    a, b = ones.astype(float), (n - ones).astype(float)
    c, d = total_ones - a, total - total_ones - b
    low = np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    return total * (a * d - b * c) ** 2 / low


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("junk", "toxic"), id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000, max_features: int = 1024, folds: int = 5) -> ChainModel:
    """A chain over labels' 0/1 columns `categories`, in that order.

    Of the labelled ids the max_labelled with the smallest hashes are used; of
    documents that share an id one is. A row with a null label is left out; an id labelled more than once
    counts as 1 in a category if any of its rows does. max_features are chosen
    for each category. Without labelled rows the model gives 0 throughout, and
    with one class only that class's rate.
    """
    names = list(categories)
    sample = checkpoint(
        labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(names)]).dropna()
        .groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])
        .orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )
    n_y = len(names)
    ys = [f"y{i}" for i in range(n_y)]
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # at most max_labelled ids
    # One text for each id, so the bound holds, dealt to many tasks.
    rows = checkpoint(text.groupBy("id", *ys).agg(F.min("text").alias("text")).select(F.xxhash64("id").alias("key"), *ys, "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [[Counter() for _ in range(n_y + 1)] for _ in STEMS]

        def flush() -> Iterator[pa.RecordBatch]:
            for stem, counts in enumerate(seen):
                words = list(counts[0])
                yield pa.RecordBatch.from_arrays([pa.array([stem] * len(words), pa.int32()), pa.array(words, pa.binary()), *[pa.array([c[w] for w in words], pa.int64()) for c in counts]], names=["stem", "word", *[f"n{i}" for i in range(n_y + 1)]])
                for c in counts:
                    c.clear()

        for batch in batches:
            truth = [batch.column(1 + i).to_pylist() for i in range(n_y)]
            for r, x in enumerate(batch.column(n_y + 1)):
                for own, counts in zip(features(x.as_py())[0], seen, strict=True):
                    counts[0].update(own)
                    for i in range(n_y):
                        if truth[i][r]:
                            counts[i + 1].update(own)
                if sum(len(counts[0]) for counts in seen) > 200_000:
                    yield from flush()
        yield from flush()

    model = ChainModel(names)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y{i}").alias(f"y{i}") for i in range(n_y)]).first()
    if not totals["n"]:
        return model
    counted = rows.transform(mapped, count, "stem int, word binary, " + ", ".join(f"n{i} long" for i in range(n_y + 1))).groupBy("stem", "word").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n_y + 1)]).filter("n0 >= 3")
    schema = T.StructType([*counted.schema.fields, *[T.StructField(f"s{i}", T.DoubleType()) for i in range(n_y)]])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False)
            more = [pa.array(_significance(n, batch.column(3 + i).to_numpy(zero_copy_only=False), totals["n"], totals[f"y{i}"])) for i in range(n_y)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    judged = checkpoint(counted.transform(mapped, judge, schema))
    chosen = {(r["stem"], bytes(r["word"])) for i in range(n_y) for r in judged.filter(F.col(f"s{i}") > 10).orderBy(F.desc(f"s{i}"), "stem", "word").select("stem", "word").limit(max_features).collect()}
    for at, (stem, word) in enumerate(sorted(chosen)):
        model.names[stem][word] = at

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.present(x.as_py()) for x in batch.column(n_y + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n_y + 1], pa.array([sorted(a) for a, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64()))], names=["key", *[f"y{i}" for i in range(n_y)], "at", "shares"])

    own = rows.transform(mapped, present, "key long, " + "".join(f"y{i} int, " for i in range(n_y)) + "at array<int>, shares array<double>").toArrow()  # at most max_labelled rows
    own = own.take(pa.compute.sort_indices(own, [("key", "ascending")])).combine_chunks()  # a key is a hash of an id, which the sample has once
    lists = own.column("at").chunk(0)
    x = _Rows(np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy().astype(np.int64), model.n_names, own.column("shares").chunk(0).flatten().to_numpy().reshape(len(own), -1))
    fold = own.column("key").to_numpy() % folds
    model.weights = fit_chain(x, [own.column(f"y{i}").to_numpy().astype(float) for i in range(n_y)], fold)
    return model


# ------------------------------------------------------------------ scoring


def score(docs: DataFrame, model: ChainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category> for each category): a row for each row of docs. Null texts count as empty."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(f"p_{c}", T.DoubleType()) for c in model.labels]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            p = np.array([own.scores(x.as_py()) or [0.0] * len(own.labels) for x in batch.column(1)], float).reshape(-1, len(own.labels))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, i]) for i in range(p.shape[1])]], names=schema.names)

    return docs.select(id_col, text_col).transform(mapped, run, schema)


def reject(docs: DataFrame, model: ChainModel, category: str = "toxic", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose probability of category is threshold or more; columns as they were."""
    at, which = docs.columns.index(text_col), model.labels.index(category)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            keep = [not own.weights or own.scores(x.as_py())[which] < threshold for x in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.transform(mapped, run, docs.schema)


def categories(labels: DataFrame) -> DataFrame:
    """The label table's categories: junk (quality 0) comes before toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Each document's probabilities of junk and of toxic, and whether it is toxic (0.5 or more); a null text counts as empty."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, categories(table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", "p_junk", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))
