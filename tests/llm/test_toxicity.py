import math
import random

import numpy as np
from pyspark.sql import functions as F

from rosterlake.llm import toxicity


def test_held_out_accuracy(spark, sf_dir):
    sf = f"{sf_dir}/../sf0.1"  # sf0.001 has too few labels
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = toxicity.categories(spark.read.parquet(f"{sf}/labels.parquet"))
    model = toxicity.train(docs, labels.filter("doc_id % 4 <> 1"))
    got = toxicity.score(docs, model).join(labels.filter("doc_id % 4 = 1"), "doc_id").select("toxic", "p_toxic", "junk", "p_junk").toPandas()
    hit = (got.p_toxic >= 0.5) == (got.toxic == 1)
    assert len(got) > 300 and hit.mean() > 0.95
    assert ((got.p_toxic >= 0.5)[got.toxic == 1]).mean() > 0.9 and ((got.p_toxic >= 0.5)[got.toxic == 0]).mean() < 0.02
    assert ((got.p_junk >= 0.5) == (got.junk == 1)).mean() > 0.8


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(1)
    n = 2000
    first = (rng.random(n) < 0.5).astype(float)
    seen = rng.random(n) < 0.9
    col = np.where(seen, first, 1 - first).astype(int)
    second = (first + (rng.random(n) < 0.05) > 0.5).astype(float)
    x = toxicity._Rows(np.arange(n), col, 2, np.zeros((n, 1)))
    w = toxicity.fit_chain(x, [first, second], np.arange(n) % 5)
    assert len(w[1]) == len(w[0]) + 1 and w[1][-2] > 0.1


def test_rows_nulls_repeats_and_none(spark):
    rng = random.Random(2)
    rows = [(i, ("vile nasty " if i % 3 == 0 else "kind gentle ") + " ".join(rng.choice(["a", "b", "c"]) for _ in range(9)), i) for i in range(300)] + [(None, "vile nasty words", 0), (3, "vile nasty again", 0), (999, None, 0), (998, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y0 int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(200)] + [(0, None, 1)], "doc_id long, toxic int, junk int")
    model = toxicity.train(docs, labels, ("junk", "toxic"))
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    left = [r.text for r in kept.collect()]
    assert not any("vile" in (t or "") for t in left) and None in left and "" in left and len(left) == 202
    assert toxicity.score(docs, model).count() == len(rows)
    none = toxicity.train(docs, labels.filter("false"), ("junk", "toxic"))
    assert toxicity.reject(docs, none).count() == len(rows)
    assert toxicity.reject(docs.filter("false"), model).count() == 0
    few = toxicity.train(docs, labels, ("junk", "toxic"), max_labelled=20)
    assert len(few.weights) == 2


def plain_features(text):
    """(words and their beginnings of four and five bytes, six shares) by the definition."""
    raw = (text or "").encode()
    words = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in raw).lower().split()
    found = {(0, w) for w in words} | {(k, w[:n]) for k, n in ((1, 4), (2, 5)) for w in words if len(w) > n}
    n = max(1, len(raw))
    letters, digits, blank = sum(b >= 128 or chr(b).isalpha() for b in raw), sum(48 <= b <= 57 for b in raw), sum(chr(b).isspace() and b < 33 and b not in (28, 29, 30, 31) for b in raw)
    return found, [math.log1p(len(words)) / 10, len(set(words)) / max(1, len(words)), letters / n, sum(65 <= b <= 90 for b in raw) / n, digits / n, (len(raw) - letters - digits - blank) / n]


def plain_fit(x, y, penalties):
    """The minimum of the penalised log-loss, by Newton's method on a dense matrix."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalties) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + penalties * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def test_the_chain_like_a_plain_version(spark):
    rng = random.Random(9)
    mild, foul, spam = ["tree", "stone", "river", "morning", "people"], ["vilest", "nastiness", "wretched"], ["buy now!!", "FREE 100 OFFER", "click"]
    rows = []
    for i in range(400):
        junk, toxic = rng.random() < 0.4, rng.random() < 0.3
        words = [rng.choice(mild) for _ in range(rng.randint(3, 25))] + [rng.choice(spam) for _ in range(3 * junk + (rng.random() < 0.1))] + [rng.choice(foul) for _ in range(2 * toxic + (rng.random() < 0.05))]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(junk), int(toxic or (junk and rng.random() < 0.3))))
    df = spark.createDataFrame(rows, "doc_id long, text string, junk int, toxic int").repartition(3)
    labelled = df.filter("doc_id < 300")
    model = toxicity.train(df.select("doc_id", "text"), labelled.select("doc_id", "junk", "toxic"))
    got = {r.doc_id: (r.p_junk, r.p_toxic) for r in toxicity.score(df, model).collect()}

    fold = {r.doc_id: r.k % 5 for r in df.select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    rows.sort()
    own = [plain_features(r[1]) for r in rows]
    fitted = slice(0, 300)
    counts = {}
    for found, _ in own[fitted]:
        for f in found:
            counts[f] = counts.get(f, 0) + 1
    chosen = set()
    for c in (2, 3):
        ones = sum(r[c] for r in rows[fitted])
        for f, n in counts.items():
            a = sum(r[c] for r, (found, _) in zip(rows[fitted], own[fitted], strict=True) if f in found)
            table = np.array([[a, n - a], [ones - a, 300 - ones - n + a]], float)
            expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / 300
            if n >= 3 and (expected > 0).all() and ((table - expected) ** 2 / expected).sum() > 10:
                chosen.add(f)
    names = sorted(chosen)
    assert {(k, w) for k, of in enumerate(model.names) for w in of} == chosen and len(names) > 3
    x = np.array([[float(f in found) for f in names] + shares + [1.0] for found, shares in own])
    at, earlier = len(names), None
    for c in (2, 3):
        y = np.array([r[c] for r in rows], float)
        if earlier is not None:
            x = np.insert(x, -1, earlier, axis=1)

        def fit(keep, x=x, y=y):
            ones, n, seen = x[keep][y[keep] == 1][:, :at].sum(axis=0), x[keep][:, :at].sum(axis=0), keep.sum()
            odds = np.log((ones + 0.5) / (y[keep].sum() + 1)) - np.log((n - ones + 0.5) / (seen - y[keep].sum() + 1))
            return plain_fit(x[keep], y[keep], np.concatenate([1 / np.maximum(odds**2, 0.01), np.ones(x.shape[1] - at - 1), [0.0]]))

        chance = lambda w, x=x: 1 / (1 + np.exp(-x @ w))
        train = np.arange(len(rows)) < 300
        p = chance(fit(train))
        assert np.abs(p - [got[r[0]][c - 2] for r in rows])[300:].max() < 0.02  # where all of them see what the first model says
        earlier = p.copy()  # of rows that were not fitted on, and out-of-fold for the others
        for k in range(5):
            held = train & np.array([fold[r[0]] == k for r in rows])
            earlier[held] = chance(fit(train & ~held))[held]


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(i, ("vile nasty " if i % 2 else "kind gentle ") * 3) for i in range(60)] + [(99, "kind words " * 300_000 + "vile nasty")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, toxic int, junk int"))
    assert toxicity.score(docs, model).count() == 61
