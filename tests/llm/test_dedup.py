import hashlib
import random
import time

import numpy as np
import pytest
import xxhash

from rosterlake.llm import decontaminate, exact_dedup, simhash


def test_exact_groups_hot_null_repeats_and_names(spark):
    rows = [(i, "hot", 1) for i in range(400)] + [(i, f"t{i // 2}", 1) for i in range(400, 700)] + [(700, None, 2), (701, "", 2), (None, "hot", 3), (5, "hot", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Kept int").repartition(5)
    got = exact_dedup.exact_groups(df).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t, _ in rows:
        by.setdefault(t or "", []).append(i)
    for r in got:
        group = by[r.text or ""]
        assert (r.keep_id, r.group_size) == (max(x for x in group if x is not None), len(group))
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert sum(r.kept for r in got) == len(by)
    assert sorted(str(r.text or "") for r in exact_dedup.deduplicate(df).collect()) == sorted(by)
    assert exact_dedup.exact_groups(df.filter("false")).count() == 0
    full = exact_dedup.exact_groups(df, max_bits=1 << 16, bits_per_row=1, ways=3)  # a filter that is too small changes nothing
    assert sum(r.kept for r in full.collect()) == len(by)
    parts = exact_dedup.exact_groups(df, max_bits=1 << 14)  # rows dealt into four parts, a filter for each
    assert sorted(map(str, parts.drop("kept").collect())) == sorted(map(str, exact_dedup.exact_groups(df).drop("kept").collect()))
    assert sum(r.kept for r in parts.collect()) == len(by)


def test_exact_groups_of_rows_that_are_equal_throughout(spark):
    df = spark.createDataFrame([(7, "same")] * 50 + [(None, "same")] * 5 + [(None, "other")] * 3 + [(1, "x" * 2_000_000)] * 2, "doc_id long, text string").repartition(7)
    for options in ({}, {"max_bits": 1 << 15}):
        kept = exact_dedup.deduplicate(df, **options).collect()
        assert sorted((str(r.doc_id), r.text[:9]) for r in kept) == [("1", "xxxxxxxxx"), ("7", "same"), ("None", "other")]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("cap", [2048, 4])
def test_near_groups_like_brute_force(spark, cap):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(30)]
    texts = [t for b in base for t in (b, b + " x", b.upper(), b[:-3])] + [None, "", "one", "one two", "é  ü\tß\n"] + ["same text here now"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    fps = [brute_fingerprint(t) for t in texts]
    got = {r.doc_id: r for r in simhash.near_groups(df, cap=cap).collect()}
    want = brute_components(fps)
    for i in range(len(texts)):
        assert got[i].fp & (1 << 64) - 1 == fps[i] and got[i].component_id == want[i]
    kept = simhash.keep_one(df, cap=cap)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == ["doc_id", "text"]
    assert simhash.near_groups(df.filter("false")).count() == 0


def test_near_groups_of_long_texts_and_clashing_names(spark):
    long = " ".join(f"w{i * i % 7919}" for i in range(200_000))
    rows = [(1, long, "a", 1), (2, long + " end", "b", 2), (3, "z" * 3_000_000, "c", 3), (4, " \t " * 100_000, "d", 4), (5, None, "e", 5), (None, long, "f", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, FP string, component_id int").repartition(3)
    got = {(r.doc_id, r.component_id) for r in simhash.near_groups(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (None, 1)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.FP for r in kept.collect()) == ["a", "c", "d", "f"]


def test_gray_index_finds_every_link():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), replace=False))) for b in base for _ in range(12)]
    fps = np.unique(np.array([*base, *near], np.uint64))
    index = simhash.GrayIndex(fps)
    assert sorted(index.fps.tolist()) == fps.tolist()
    found = {(i, j) for a, b in index.links() for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(index.fps[i]) ^ int(index.fps[j])).bit_count() <= 3}
    assert found == want


def test_contamination_like_brute_force(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(500)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, make(rng.randrange(5, 60))) for i in range(40)] + [(100, "too short"), (101, None), (102, items_text := make(30)), (103, items_text)]
    docs = [(i, make(200) + " " + (items[i % 40][1].upper() if i % 3 == 0 else "") + "\n" + make(100)) for i in range(90)]
    docs += [(500 + i, " ".join(w if rng.random() > 0.03 else "zz" for w in items[i][1].split())) for i in range(40)] + [(900, None), (901, ""), (None, items_text)]
    want = set()
    for d, t in docs:
        for i, x in items:
            own, s = decontaminate.shingles(t), decontaminate.shingles(x)
            if s and len(own & s) >= 0.8 * len(s) - 1e-9:
                want.add((d, i, len(own & s), len(s)))
    ddf = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    idf = spark.createDataFrame(items, "item_id long, text string")
    for block in (16 << 20, 500):
        got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.contaminated_pairs(ddf, idf, block_bytes=block).collect()}
        assert got == want
    left = decontaminate.decontaminate(ddf, idf)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in {w[0] for w in want})
    assert decontaminate.contaminated_pairs(ddf.filter("false"), idf).count() == 0 and decontaminate.decontaminate(ddf, idf.filter("false")).count() == len(docs)


def test_contamination_beside_long_words_and_blank_runs(spark):
    item = " ".join(f"v{i}" for i in range(20))
    docs = [(0, "x" * 2000), (1, f"clean words {item} and more"), (2, "a" + " " * 2000 + "b"), (3, f"{'y' * 2000} {item}"), (4, "nothing of it here at all"), (5, f"{' ' * 2000}{item}")]
    ddf = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    for items in ([(9, item)], [(9, item), (10, f"{item} {'z' * 3000}")]):
        idf = spark.createDataFrame(items, "item_id long, text string")
        got = {(r.doc_id, r.n_shared) for r in decontaminate.contaminated_pairs(ddf, idf).collect() if r.item_id == 9}
        assert got == {(i, 16) for i in (1, 3, 5)}
        assert sorted(r.doc_id for r in decontaminate.decontaminate(ddf, idf).collect()) == [0, 2, 4]


def test_a_phrase_that_many_items_and_a_document_repeat(monkeypatch):
    phrase = "all rights to this text are reserved by us"
    items = [(i, f"item {i} asks {phrase} of number {i} and {i + 1}") for i in range(2000)]
    index = decontaminate.ItemIndex.build(items, 5, 0.8)
    docs = [f"{phrase}. " * 3000, "nothing here", None, f"{phrase} " * 10 + items[7][1] + f" {phrase}" * 10, items[1999][1].upper()]
    seconds = {}
    for n in (1500, 3000):
        began = time.process_time()
        found = index.search(decontaminate.pa.array([f"{phrase}. " * n, *docs[1:]], decontaminate.pa.string()))
        seconds[n] = time.process_time() - began
    assert seconds[3000] < 4 * seconds[1500] + 0.3
    assert [(int(r), int(i)) for r, i, _ in zip(*found, strict=True)] == [(3, 7), (4, 1999)]
    monkeypatch.setattr(decontaminate, "_AT_ONCE", 3)
    again = index.search(decontaminate.pa.array(docs, decontaminate.pa.string()))
    assert [x.tolist() for x in again] == [x.tolist() for x in found]
    assert len(index.kept) <= decontaminate._KEPT


def test_items_of_all_sizes_beside_long_documents():
    rng = random.Random(4)
    make = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(n, make(n)) for n in (*range(5, 40), 64, 127, 128, 129, 500, 3000)]
    index = decontaminate.ItemIndex.build(items, 5, 0.8)
    docs = [make(2000) + " " + x + " " + make(20_000) for _, x in items] + [x for _, x in items] + [" ".join(x.split()[: int(n * 0.75)]) for n, x in items]
    of_items = [decontaminate.shingles(x) for _, x in items]
    want = {(d, i) for d, t in enumerate(docs) for own in [decontaminate.shingles(t)] for i, x in enumerate(of_items) if len(own & x) >= 0.8 * len(x) - 1e-9}
    row, item, _ = index.search(decontaminate.pa.array(docs))
    assert set(zip(row.tolist(), item.tolist(), strict=True)) == want and len(want) >= 2 * len(items)


def test_blocks_are_bounded_and_names_may_clash(spark):
    items = spark.createDataFrame([(i, "one two three four five six seven " * (i % 3)) for i in range(60)], "ID long, text string").repartition(3)
    sizes = [sum(len(t or "") + 64 for t in b.value.texts) for b in decontaminate._blocks(items, "ID", "text", 5, 0.8, 500)]
    assert len(sizes) > 5 and max(sizes) <= 500
    docs = spark.createDataFrame([(1, "x one two three four five six seven one two y", "z")], "id long, text string, item_id string")
    got = decontaminate.contaminated_pairs(docs, items, "id", "text", "ID", "text", block_bytes=500)
    assert got.columns == ["id", "item_ID", "n_shared", "n_shingles", "containment"] and {r.item_ID for r in got.collect()} == {i for i in range(60) if i % 3 == 1}


def test_token_hashes_are_equal_anywhere():
    far = "w" * 2500
    texts = ["one two", far, "one two", "one" + " " * 1500 + "two", "  one two", far + "x " + far]

    def hashes(rows):
        return decontaminate.token_hashes(*decontaminate.string_parts(decontaminate.pa.array(rows)))[0].tolist()

    assert hashes(texts) == [h for t in texts for h in hashes([t])]
    one, two, long, *rest = hashes(texts)
    assert rest == [one, two] * 3 + [rest[6], long] and rest[6] not in (one, two, long)


def test_exact_groups_keep_columns_of_any_name(spark):
    names = ["_best", "_n", "_sha", "_salt", "best", "n", "salt", "tie", "maybe", "whole_text", "of_sha", "of_salt", "Part"]
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in enumerate(["a", "a", "b", None, "", "a"])]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{c} string" for c in names]]))
    for options in ({}, {"max_bits": 1 << 14}):
        got = {r.doc_id: r for r in exact_dedup.exact_groups(df, **options).collect()}
        assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {0: (5, 3, False), 1: (5, 3, False), 2: (2, 1, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 3, True)}
        assert all(r[c] == f"{c}{i}" for i, r in got.items() for c in names)
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(df).collect()) == [2, 4, 5] and exact_dedup.deduplicate(df).columns == df.columns
