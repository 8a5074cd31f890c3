import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from rosterlake.llm import decontaminate, sentencepiece_ffbs  # noqa: E402
from tests.llm.test_dedup import brute_components, brute_fingerprint  # noqa: E402


def test_stages_like_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    at = dict(pipeline.STAGES)

    clean = [tuple(r) for r in at["toxicity"](spark, docs, sf_dir).collect()]
    assert set(clean) <= set(rows) and 0 < len(clean) < len(rows)
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic}
    gone = {r[0] for r in rows} - {r[0] for r in clean}
    assert len(gone & toxic) > 0.5 * len(toxic & {r[0] for r in rows})

    step = lambda name, kept: [tuple(r) for r in at[name](spark, spark.createDataFrame(kept, docs.schema), sf_dir).collect()]
    unique = step("exact_dedup", clean)
    last = {}
    for r in clean:
        last[r[1]] = max(last.get(r[1], r[0]), r[0])
    assert sorted(r[0] for r in unique) == sorted(last.values())

    unique.sort()
    apart = step("simhash_near_dedup", unique)
    roots = brute_components([brute_fingerprint(r[1]) for r in unique])
    assert sorted(r[0] for r in apart) == sorted({unique[i][0] for i in roots})

    left = step("benchmark_decontamination", apart)
    sets = [s for s in map(decontaminate.shingles, items) if s]
    bad = [r[0] for r in apart if any(len(decontaminate.shingles(r[1]) & s) >= 0.8 * len(s) for s in sets)]
    assert sorted(r[0] for r in left) == sorted({r[0] for r in apart} - set(bad))

    out = pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "piece_ids", "decoded"]
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in left) and all(r.text == r.decoded for r in got)
    assert sentencepiece_ffbs.MODEL


@pytest.mark.parametrize("empty", [True, False])
def test_odd_documents(spark, sf_dir, tmp_path, empty):
    item = " ".join(f"v{i}" for i in range(40))
    texts = [] if empty else [None, "", "", "one", f"before {item.upper()} after", "a clean text of its own here", "a clean text of its own here", "x" * 400_000, "word " * 60_000, "日本語" * 3000]
    rows = [(i, t, None, "hot", 1) for i, t in enumerate(texts)] + ([] if empty else [(5, "a clean text of its own here", None, "hot", 1), (None, "no id", None, None, None)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Tie int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([] if empty else [(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "piece_ids", "decoded"]
    got = out.collect()
    assert all(r.decoded == r.text for r in got)
    # The clean rows stay once each (the empty ones share a fingerprint); of two equal texts the larger id; item 1 takes document 4.
    kept = sorted(str(r.doc_id) for r in got if (r.text or "").strip())
    assert kept == ([] if empty else ["3", "6", "7", "8", "9", "None"])
