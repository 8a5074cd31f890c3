import itertools
import math
import time
from collections import Counter

import numpy as np
import pytest

from rosterlake.llm import sentencepiece_ffbs as sp

P = sp.Pieces.load()


def ways(s):
    if not s:
        yield ()
    for i, t in enumerate(P.text):
        if t and s.startswith(t) and b" " not in t.lstrip(b" ") and not (len(t) == 1 and i == P.bytes_id[t[0]]) and np.isfinite(P.logp[i]):
            for rest in ways(s[len(t) :]):
                yield (i, *rest)


def test_draws_follow_the_lattice():
    n = 8000
    keys = np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    pieces, count = P.encode(["the cat"] * n, keys)
    ends = [0, *itertools.accumulate(count.tolist())]
    got = Counter(tuple(pieces[a:b].tolist()) for a, b in itertools.pairwise(ends))
    weight = {z: math.exp(sum(P.logp[i] for i in z)) for z in ways(b" the cat")}
    total = sum(weight.values())
    assert set(got) <= set(weight)
    for z, w in weight.items():
        share = w / total
        assert abs(got[z] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-3


def drawn(text, key):
    """One text's pieces, by the recursion as it is defined, over all of it at once."""
    data = b" " + text.encode()
    of = {t: i for i, t in enumerate(P.text) if t and b" " not in t.lstrip(b" ") and i != P.bytes_id[t[0]] and np.isfinite(P.logp[i])}
    starts = [i for i in range(len(data)) if data[i] & 0xC0 != 0x80] + [len(data)]
    edges = {e: [] for e in range(1, len(data) + 1)}
    for a, b in itertools.pairwise(starts):
        for e in range(a + 1, min(len(data), a + P.levels) + 1):
            if data[a:e] in of:
                edges[e].append((a, of[data[a:e]]))
        if data[a:b] not in of:
            for i in range(a, b):
                edges[i + 1].append((i, int(P.bytes_id[data[i]])))
    total = {0: 0.0}
    for e in range(1, len(data) + 1):
        if edges[e]:
            edges[e].sort(reverse=True)
            total[e] = np.logaddexp.reduce([P.logp[i] + total[a] for a, i in edges[e]])
    at, out = len(data), []
    while at:
        u = float(P._uniform(np.array([key], np.uint64), np.array([at]))[0])
        share = np.cumsum([math.exp(P.logp[i] + total[a] - total[at]) for a, i in edges[at]])
        at, piece = edges[at][min(int(np.searchsorted(share, u, "right")), len(share) - 1)]
        out.append(piece)
    return out[::-1]


MIXED = ["", "plain words here", "日本語のテキストは空白なしで続きます。" * 20, "w" * 900, "aGVsbG8gd29ybGQ" * 40 + " x", "ab" * 100 + " " * 300 + "ñandú", "😀🎉" * 60, "x" * 129, "don't  stop\n\tnow", "https://example.org/" + "a1b2/" * 60]


def encoded(texts, keys):
    pieces, count = P.encode(texts, np.array(keys, np.uint64))
    ends = [0, *itertools.accumulate(count.tolist())]
    return [pieces[a:b].tolist() for a, b in itertools.pairwise(ends)]


def test_rows_like_the_recursion_over_the_whole_text():
    keys = [17 * i + 3 for i in range(len(MIXED))]
    assert encoded(MIXED, keys) == [drawn(x, k) for x, k in zip(MIXED, keys, strict=True)]


def test_pieces_are_the_same_alone_and_among_many(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["the", "cat", "Straße", "日本語", "aaaaaaaa", "12345", "x" * 200, "naïve"]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(10_000)] + MIXED
    keys = rng.integers(0, 1 << 62, len(texts))
    many = encoded(texts, keys)
    for i in [*range(0, 10_000, 97), *range(10_000, len(texts))]:
        assert encoded(texts[i : i + 1], keys[i : i + 1]) == [many[i]]
    for name in ("WINDOW", "AT_ONCE"):
        monkeypatch.setattr(sp, name, 70)
    assert encoded(texts[-400:], keys[-400:]) == many[-400:]


@pytest.mark.parametrize("text", ["日本語のテキスト" * 45_000, "w" * 1_000_000, "".join(f"{i * 7919:x}" for i in range(180_000)), "😀ﷺ☃" * 100_000, "a-b_" * 250_000], ids=range(5))
def test_a_million_bytes_without_spaces(text):
    seconds = []
    for part in (text[: len(text) // 2], text):
        began = time.process_time()
        pieces, count = P.encode([part], np.array([5], np.uint64))
        seconds.append(time.process_time() - began)
    assert seconds[1] < 4 * seconds[0] + 0.3
    assert P.decode(pieces.astype(np.int64), count) == [text]


def test_round_trip_and_repeatable(spark):
    texts = [None, "", " ", "a", "  two  spaces ", "tab\tline\nend\r\n", "日本語 テキスト", "😀🎉 ﷽", "\x00\x01", "é" * 3000, "w" * 20000, "same", "same", "▁ marker ▁▁", "x y " * 5000]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(1, "same", "k"), (1, "same", "k"), (None, "null id", "k")], "doc_id long, text string, Decoded string").repartition(3)
    rows = sp.decode(sp.encode(df, seed=7)).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        assert r.decoded == r.text
        assert (r.piece_ids is None) == (r.text is None)
    again = {(r.doc_id, r.text): r.piece_ids for r in sp.encode(df.repartition(1), seed=7, slice_chars=100).collect()}
    assert all(again[r.doc_id, r.text] == r.piece_ids for r in rows)
    other = {(r.doc_id, r.text): r.piece_ids for r in sp.encode(df, seed=8).collect()}
    assert any(other[r.doc_id, r.text] != r.piece_ids for r in rows)
    assert sp.decode(sp.encode(df.filter("false"))).count() == 0


def test_query(spark, sf_dir):
    got = sp.op5_sentencepiece(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.lossless and len(r.piece_ids) == r.n_pieces for r in got)
