import random
import re
from itertools import permutations

import duckdb

from rosterlake.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """Each order over each part, document by document. docs: (id, text, source)."""
    first, parts, kinds = {}, {}, {"good": set(), "toxic": set()}
    for i, good, toxic in labels:
        for kind, value in (("good", good), ("toxic", toxic)):
            if value == 1 and i is not None:
                kinds[kind].add(i)
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        failed = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), re.search(r"[#$%&*|]", text) is not None, i is not None and first[text] < i]
        parts.setdefault(source or "", []).append((i, {x for x, f in zip("ABCDE", failed, strict=True) if f}))
    out = []
    for part, rows in parts.items():
        gone = {x: 0 for x in "ABCDE"}
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for n, x in enumerate(order):
                taken = [r for r in left if x in r[1]]
                kept = [r for r in left if x not in r[1]]
                gone[x] += len(taken)
                earlier = sum(x in f and bool(f & set(order[:n])) for _, f in rows)
                steps.append((part, order, n + 1, len(kept), len(taken), earlier, sum(f == {x} for _, f in rows), *(sum(i in kinds[k] for i, _ in taken) for k in ("good", "toxic"))))
                left = kept
        out += [(*s, gone[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_query_like_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = fa.op12_filter_audit(spark, sf_dir)
    found = con.execute(fa.ORACLE)
    assert [d[0] for d in found.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


def test_odd_rows_like_plain(spark):
    rng = random.Random(3)
    say = lambda n, k: " ".join(rng.choice(["Word", "x", "ok", "it's", "é", "A"]) + (str(rng.randrange(k)) if k else "") for _ in range(n))
    texts = [None, "", "  \t ", "a # b", "ABC", " ".join("a" * 250), *(say(rng.choice([1, 199, 200, 201, 400]), rng.choice([0, 50, 5000])) for _ in range(40)), "w " * 30_000]
    docs = [(rng.randrange(60), rng.choice(texts), rng.choice([None, "", "s", "s", "t"])) for _ in range(300)] + [(None, texts[7], "s"), (None, texts[7], "s"), (7, texts[7], "s"), (7, texts[7], "s"), (7, texts[7], "t"), (-3, "ABC", "u")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 50, 3)] + [(3, 1, 0), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, source string, Part string, h int").repartition(3)
    of = spark.createDataFrame(labels, "id long, q int, t int").selectExpr("id", "q = 1 AS good", "t = 1 AS toxic")
    got = fa.audit(fa.combination_counts(fa.failures(df, task_bytes=50_000), of))
    assert sorted(map(tuple, got.collect())) == plain(docs, labels)
    none = fa.audit(fa.combination_counts(fa.failures(df)))
    assert {(r.good_lost, r.toxic_lost) for r in none.collect()} == {(0, 0)}
    assert fa.audit(fa.combination_counts(fa.failures(df.filter("false")), of)).count() == 0
    assert fa.failures(df).count() == len(docs)
