import math
import os
from collections import Counter, defaultdict

import pytest

from rosterlake.llm import kneser_ney as kn

TEXTS = ["the cat sat on the mat", "The cat ate", "the dog sat", None, "", "a dog ate the cat on the mat", "the cat sat on the mat", "x y  z\tthe\ncat", "mat mat mat", "the cat the dog the mat"]


def discounts(counts):
    n = Counter(min(c, 5) for c in counts)
    n1, n2, n3, n4 = (sum(1 for c in counts if c == i) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    assert n is not None
    return [0.0, *(d if 0 < d < i else i / 2 for i, d in enumerate(raw, 1))]


def brute(train, texts):
    """The model by its definition, with dictionaries."""
    split = lambda x: ["<s>", *(x or "").lower().split(), "</s>"]
    bi = Counter(p for x in train for p in zip(split(x), split(x)[1:], strict=False))
    uni, cont, follow = Counter(), Counter(), defaultdict(list)
    for (a, b), c in bi.items():
        uni[b] += c
        cont[b] += 1
        follow[a].append(c)
    n, v, total = sum(uni.values()), len(uni), sum(cont.values())
    d2, d1 = discounts(list(bi.values())), discounts(list(cont.values()))
    rest = sum(d1[min(c, 3)] for c in cont.values())

    def p1(w):
        return (cont[w] - d1[min(cont[w], 3)] + rest / (v + 1)) / total

    def p2(a, w):
        if a not in follow:
            return p1(w)
        c, t = bi[a, w], sum(follow[a])
        return (c - d2[min(c, 3)]) / t + sum(d2[min(x, 3)] for x in follow[a]) / t * p1(w)

    out = []
    for x in texts:
        s = split(x)
        out.append((len(s) - 1, sum(uni[w] > 0 for w in s[1:]), sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in s[1:]), sum(math.log10(p2(a, w)) for a, w in zip(s, s[1:], strict=False))))
    assert abs(sum(p2("the", w) for w in [*uni, "?"]) - 1) < 1e-9
    return out


@pytest.mark.parametrize(("bucket", "partition_bits"), [(1 << 40, 14), (8, 14), (8, 2)])
def test_like_brute_force(spark, monkeypatch, bucket, partition_bits):
    monkeypatch.setattr(kn, "PARTITION_BITS", partition_bits)
    monkeypatch.setattr(kn, "BIGRAM_BUCKET", bucket)
    monkeypatch.setattr(kn, "WORD_BUCKET", bucket)
    train = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    tried = [*TEXTS, "unknown words here", "the unknown cat", "w" * 5000]
    model = kn.train(train)
    got = kn.score(spark.createDataFrame(list(enumerate(tried)), "doc_id long, text string"), model, ["doc_id"]).orderBy("doc_id").collect()
    for r, want in zip(got, brute(TEXTS, tried), strict=True):
        assert (r.n_tokens, r.n_known) == want[:2]
        assert r.base_score == pytest.approx(want[2], abs=1e-9)
        assert r.score == pytest.approx(want[3], abs=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-want[3] / want[0]))


def test_ranges_of_a_bucket_hold_each_pair_once(monkeypatch):
    monkeypatch.setattr(kn, "PAIRS", 50)
    rng = kn.np.random.default_rng(1)
    want, blobs, bits = Counter(), [], 3
    for _ in range(5):
        before, token = rng.integers(0, 30, (2, 400)).astype(kn.np.uint64)
        inside = kn._bucket(kn.pair_hash(before, token), bits) == 5
        before, token, k = before[inside], token[inside], rng.integers(1, 9, inside.sum()).astype(kn.np.uint32)
        for a, b, n in zip(before.tolist(), token.tolist(), k.tolist(), strict=True):
            want[a, b] += n
        blobs += [(0, blob) for _, blob in kn._packed(kn.np.full(len(k), 5), before, token, k)]
    parts = list(kn._pair_ranges(blobs, bits))
    assert len(parts) > 1
    key, before, token, k = (kn.np.concatenate(c) for c in zip(*parts, strict=True))
    assert (kn.np.diff(key.astype(object)) > 0).all()
    assert dict(zip(zip(before.tolist(), token.tolist(), strict=True), k.tolist(), strict=True)) == want


def test_word_sums_are_added_up_as_they_come(monkeypatch):
    monkeypatch.setattr(kn, "SUMS", 100)
    one = [kn.np.array([1, 2], kn.np.uint64), *[kn.np.array([3, 4])] * 2]
    two = [kn.np.array([2, 9], kn.np.uint64), *[kn.np.array([5, 6])] * 4]
    blob = lambda c: b"".join(x.tobytes() for x in c)
    rows = [(b, side, blob(c), None) for b in (0, 1) for side, c in ((0, one), (1, two)) * 7]
    found = [(b, dict(kn._word_sums(held))) for b, held, _ in kn._by_bucket([kn._rows(rows[:9]), kn._rows(rows[9:])], kn._word_sums)]
    assert [b for b, _ in found] == [0, 1]
    for _, sides in found:
        assert [c.tolist() for c in kn._unpacked(sides[0], kn._SIDES[0])] == [[1, 2], [21, 28], [21, 28]]
        assert [c.tolist() for c in kn._unpacked(sides[1], kn._SIDES[1])] == [[2, 9], *[[35, 42]] * 4]


def test_counts_split_over_flushes(spark, monkeypatch):
    monkeypatch.setattr(kn, "HELD", 3)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    model = kn.train(docs)
    assert model.tokens == sum(len((x or "").split()) + 1 for x in TEXTS)


@pytest.mark.parametrize(("kind", "column"), [("bigrams", "hash"), ("bigrams", "count"), ("words", "hash"), ("words", "cont")])
def test_a_lost_bucket_is_an_error(spark, monkeypatch, kind, column):
    monkeypatch.setattr(kn, "BIGRAM_BUCKET", 64)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model = kn.train(docs)
    texts = kn.pa.array(TEXTS, kn.pa.string())
    model.score(texts)
    for bucket in model.held[kind]:
        os.remove(f"{model.folder}/{kind}/{bucket}/{column}.npy")
    with pytest.raises(FileNotFoundError):
        model.score(texts)
    with pytest.raises(Exception, match="is gone"):
        kn.score(docs, model, ["doc_id"]).collect()


def test_a_bucket_cut_short_is_an_error(spark):
    model = kn.train(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    at = f"{model.folder}/bigrams/0/hash.npy"
    kn.np.save(at, kn.np.load(at)[:-1])
    with pytest.raises(ValueError, match="in place of"):
        model.score(kn.pa.array(TEXTS, kn.pa.string()))


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = kn.train(none)
    assert kn.score(none, model, ["doc_id"]).count() == 0
    one = kn.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model, ["doc_id"]).first()
    assert (one.n_tokens, one.n_known, one.score) == (3, 0, 0.0)


def test_query_beats_base_on_held_out(spark, sf_dir):
    got = kn.op9_lm_scoring(spark, sf_dir).toPandas()
    held = got[got.held_out]
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert held.score.sum() > held.base_score.sum()
