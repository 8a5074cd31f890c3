import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlake.llm import pii


def brute(text):
    """Base spans as the rules say, one kind after the other."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m[0].split("."))) <= 255:
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


TEXTS = [
    None, "", "nothing here", "mail a.b@c.example.com now", "ä é 4111 1111 1111 1111 and 4111111111111112", "ip 1.2.3.4.5 or 300.1.1.1 256.2.3.4", "+1 (555) 010-2030 and +12",
    "contact joe [at] mail (dot) example (dot) com please", "call (555) 234-5678 today", "order 555-234-5678", "credit card 378282246310005 was charged", "from 2001:db8:85a3:0:0:8a2e:370:7334 came",
    "1 " * 30000, "@" * 5000, "x@y.z@q.org", "+1 (743) 555-3824" * 3, "a@b.c_d@e.f", "1.1.1." + "0" * 3996, "a" * 3000 + " x@y.org " + "1" * 3000, "+1 2 192.168.10.11",
]


def rows(spark):
    texts = TEXTS * 2 + [f"phone: (555) 234-{i:04d}, mail bob{i}@example.org, ip 10.1.2.{i}, card 4111111111111111" for i in range(100, 200)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)


def test_base_spans_like_brute_force_and_method_adds(spark):
    df = rows(spark)
    texts = {r.doc_id: r.text for r in df.collect()}
    added = 0
    for r in pii.personal_data(df).collect():
        base = [(s.kind, s.start, s.end) for s in r.spans if s.base]
        assert base == brute(texts[r.doc_id])
        added += len(r.spans) - len(base)
        if texts[r.doc_id] == "call (555) 234-5678 today":
            assert [(s.kind, s.start, s.end) for s in r.spans] == [("phone", 5, 19)]
        if texts[r.doc_id] == "nothing here":
            assert not r.spans
    assert added >= 100


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.6
    right = [0.95, 0.9, 0.6, 0.85]
    found = np.stack([np.where(rng.random(4000) < r, truth, ~truth).astype(int) for r in right], axis=1)
    found[rng.random(found.shape) < 0.1] = pii.ABSTAIN
    shares, p = pii.reliabilities(found, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.95
    sure = shares[:, 1, 1] / (1 - shares[:, 1, 2])
    assert np.abs(sure - right).max() < 0.05


def test_query_repeats_nulls_none(spark, sf_dir):
    got = {r.doc_id: r for r in pii.op1_pii(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = brute(d.text)
        assert got[d.doc_id].base_sha256 == pii.digest(want)
        assert [got[d.doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
    odd = spark.createDataFrame([(None, "a@b.org", 1), (None, "a@b.org", 1)], "doc_id long, text string, spans int")
    assert [len(r.spans) for r in pii.personal_data(odd).collect()] == [1, 1]
    assert pii.personal_data(odd.filter("false")).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1.2@-_%+ 0():", max_size=40))
def test_linear_patterns_match_the_stated_ones(text):
    for kind, stated in enumerate(pii.STATED):
        assert [m.span() for m in pii.base_matches(kind, text)] == [m.span() for m in re.finditer(stated, text)]


@pytest.mark.parametrize(
    "text",
    ["a" * 1_000_000 + " @ x@y.org", "1" * 1_000_000 + " @ +", "1." * 500_000 + "+", "1 " * 500_000, "a." * 500_000 + "@", "+" + "1 " * 500_000, "@a" * 500_000, "0:" * 500_000, "ab" * 400_000 + ": [at] ::", "a@" + "b" * 1_000_000 + "1"],
    ids=range(10),
)
def test_long_runs_take_linear_time(text):
    """Twice the text takes twice the time, whatever the machine."""

    def seconds(part):
        began = time.process_time()
        for c in pii.candidates(part):
            pii.votes(part, *c)
        return time.process_time() - began

    assert min(seconds(text) for _ in range(2)) < 4 * min(seconds(text[: len(text) // 2]) for _ in range(2)) + 0.3


def test_long_zeros_are_an_address():
    text = "see 1.1.1." + "0" * 3996 + " and 256.1.1.1"
    assert [(k, s, e) for k, s, e, b in pii.candidates(text) if b and k == 1] == [(1, 4, 4006)]


def test_redact(spark):
    df = spark.createDataFrame([(1, "to a@b.org and +1 555 010 2030.", "x"), (2, None, "y"), (1, "at +1 2 192.168.10.11 now", "z"), (None, "", "w")], "doc_id long, text string, spans string")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert {r.spans: r.text for r in got.collect()} == {"x": "to [email] and [phone].", "y": None, "z": "at [phone] now", "w": ""}
