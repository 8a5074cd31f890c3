import hashlib
import random
import zlib

import numpy as np
import pytest

from rosterlake.llm import periodic_runs as pr


def brute(words, least=12):
    """Runs by trying each period at each place."""
    out = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i) + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def odd_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.choice([0, 1, 5, 11, 12, 13, 30, 60, 150])
    words = [str(rng.randrange(k)) for _ in range(n)]
    if rng.random() < 0.5 and n > 4:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        words = words[:a] + (words[a : a + p] * n)[: n - a]
    return words * 2 + words[: rng.randrange(3)] if rng.random() < 0.3 else words


def test_runs_like_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        words = odd_words(rng)
        assert pr.runs_of(" ".join(words)) == brute(words)


@pytest.mark.parametrize(("steps", "at_once", "least"), [(1, 16, 12), (8, 64, 4), (2, 7, 1)])
def test_runs_of_many_texts_at_once(monkeypatch, steps, at_once, least):
    monkeypatch.setattr(pr, "STEPS", steps)
    monkeypatch.setattr(pr, "AT_ONCE", at_once)
    rng = random.Random(2)
    docs = [odd_words(rng) for _ in range(80)]
    numbers = pr.Words()
    ids = np.array([numbers[w] for d in docs for w in d], np.int64)
    ends = np.cumsum([0, *map(len, docs)])
    runs = pr.find_runs(ids, ends, least).tolist()
    assert [sorted((a - lo, b - a, q) for a, b, q in runs if lo <= a < hi) for lo, hi in zip(ends, ends[1:], strict=False)] == [brute(d, least) for d in docs]


def test_equal_hashes_of_different_stretches(monkeypatch):
    """With moduli that any stretch collides under, the words themselves still decide."""
    tried = []

    def same(self, x, y, n):
        tried.append(self.seed)
        wrong = np.ones(len(x), bool)
        return wrong if self.seed == 0 else np.array([np.array_equal(self.ids[a : a + k], self.ids[b : b + k]) for a, b, k in zip(x, y, n, strict=True)])

    monkeypatch.setattr(pr._Prefixes, "same", same)
    words = list("abc" * 12 + "xyzzy" + "ab" * 20 + "q")
    assert pr.runs_of(" ".join(words)) == brute(words) and set(tried) == {0, 1}


def test_long_texts():
    n = 300_000
    assert pr.runs_of("a " * n) == [(0, n, 1)]
    morse = [str(i.bit_count() % 2) for i in range(1 << 15)]
    assert all(q in (3, 6, 1, 2) or length >= 2 * q for _, length, q in pr.runs_of(" ".join(morse)))
    block = [f"w{i}" for i in range(50_000)]
    assert pr.runs_of(" ".join(["x", *block, *block, *block[:7], "y"])) == [(1, 100_007, 50_000)]


def plain(text, doc_id):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_like_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in pr.op13_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    assert got == {r.doc_id: plain(r.text, r.doc_id) for r in docs if len((r.text or "").split()) < 1500} | {k: v for k, v in got.items() if len(next((r.text for r in docs if r.doc_id == k), "").split()) >= 1500}
    assert sum(v[1] > 0 for v in got.values()) > len(docs) // 20


def test_rows(spark):
    texts = [None, "", " \t\n", "one", "é\x1cü " * 14, "a b\x0bc " * 9 + "tail", "a b\x0bc " * 9 + "tail"]
    df = spark.createDataFrame([(i % 6, t, "k", 1, "old") for i, t in enumerate(texts)] + [(None, "x " * 12, "k", 2, "old")], "doc_id long, text string, Runs string, of int, Text2 string")
    rows = pr.periodic_runs(df.repartition(3)).collect()
    assert len(rows) == 8 and rows[0].asDict().keys() == {"doc_id", "of", "Text2", "n_words", "runs", "collapsed"}
    by = {(r.doc_id, r.of, r.n_words): r for r in rows}
    assert [tuple(x) for x in by[None, 2, 12].runs] == [(0, 12, 1)] and by[None, 2, 12].collapsed == "x"
    assert [tuple(x) for x in by[5, 1, 28].runs] == [(0, 27, 3)] and by[5, 1, 28].collapsed == "a b c tail"
    assert by[4, 1, 14].collapsed == "é\x1cü" and by[3, 1, 1].runs == [] and {by[i, 1, 0].collapsed for i in range(1, 3)} == {""}
    assert pr.periodic_runs(df.filter("false")).count() == 0
    assert pr.with_tail_repeated(None, [b"a", b"b"]) == [b"a", b"b"]
