"""Personal data by weak supervision.

Candidates are found in each whole text by patterns: strict ones, whose valid
matches are the base spans, and loose ones (spelt-out e-mail addresses, national
telephone numbers, shorter cards, IPv6). Labelers of three kinds, regex,
gazetteer and context, vote on each candidate or abstain. Expectation
maximisation (Dawid and Skene's model, one for each kind) estimates from the
votes alone how reliable each labeler is. A logistic classifier over votes and
shape is then trained on the resulting probabilities; it decides on the loose
candidates. Base spans stay whatever it says.

A candidate's votes and shape are one small number, its pattern. Spark counts
the patterns of all documents; the driver fits both models on the counts. There
are at most some thousand patterns, however large the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, mapped, table, temp_name

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base spans, as they are stated.
STATED = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
# The same matches in linear time: a run of a class is tried once, from its beginning, and never given back.
# (Which place of a run a match begins at changes nothing of whether there is one; the leftmost is the run's first.)
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]++", r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
BASE = (
    re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}{_DOMAIN}"),
    re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: An e-mail address may begin right where the one before ends, within a run.
_NEXT_EMAIL = re.compile(_LOCAL + _DOMAIN)
_AT, _DOT = r"\s?[\[({]\s?at\s?[\])}]\s?", r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
LOOSE = (
    re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+", re.I),
    re.compile(r"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f]{1,4}:)[0-9A-Fa-f:]++(?![0-9A-Za-z:])"),
    None,
    re.compile(r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[ .-]|\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
)
#: What must be in a text for a pattern to be tried; loose[2] are base matches of 13 to 15 digits.
_HINT = ("@", None, None, "+"), (re.compile(r"[\[({]\s?at\s?[\])}]", re.I), re.compile(r":[0-9A-Fa-f]{0,4}:"), None, re.compile(r"[0-9]{3}[ .-][0-9]{4}"))
_V6 = re.compile(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}")

# Gazetteers. Top-level domains of two letters are countries by rule; these are the common others.
GENERIC = frozenset("com org net edu gov int mil info biz name pro aero coop museum jobs mobi travel tel cat asia post app dev xyz online site shop store tech blog cloud design agency email company group global media news live life world today space website digital solutions services systems network academy center school university health care law finance bank money fund capital africa london berlin paris tokyo nyc".split())
FILE_ENDS = frozenset("png jpg jpeg gif svg webp bmp ico js ts css html htm php py rb sh md txt pdf doc docx xls xlsx ppt zip gz tar xml json yaml yml csv log exe dll mp3 mp4 avi mov".split())
# The country codes of the numbering plan. Of one digit, of two, and the first two digits of those of three.
ONE_DIGIT = frozenset("1 7".split())
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
OF_THREE = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
ISSUER = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|35|6011|64|65|62")
CONTEXT = (
    re.compile(r"\b(?:e-?mail|mail|contact|write to|reach|address)\b", re.I),
    re.compile(r"\b(?:ip|host|server|address|client|from|remote|login|peer)\b", re.I),
    re.compile(r"\b(?:card|credit|debit|visa|mastercard|amex|payment|charged|cc)\b", re.I),
    re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|dial|whatsapp|sms)\b", re.I),
)
AGAINST = (
    re.compile(r"\b(?:ratio|image|src|package|version)\b", re.I),
    re.compile(r"\b(?:version|release|section|chapter|firmware|v)\b", re.I),
    re.compile(r"\b(?:isbn|serial|order|invoice|tracking|token|hash|id|sku|ticket)\b", re.I),
    re.compile(r"\b(?:isbn|serial|order|invoice|tracking|version|id|sku|ticket|part)\b", re.I),
)
LABELERS = ("regex", "gazetteer", "context", "shape", "edges")
YES, NO, ABSTAIN = 1, 0, 2
WINDOW = 48


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _octets(span: str) -> list[int]:
    """The parts of a dotted number, 256 for those above 255; leading zeros count for nothing, whatever their number."""
    bare = (p.lstrip("0") or "0" for p in span.split("."))
    return [min(256, int(p)) if len(p) < 4 else 256 for p in bare]


def known_code(digits: str) -> bool:
    """Whether digits begin with a country's calling code."""
    return digits[:1] in ONE_DIGIT or digits[:2] in TWO_DIGITS or digits[:2] in OF_THREE and len(digits) > 2


def valid(kind: int, m: re.Match) -> bool:
    """Whether a match of a base pattern is a base span."""
    if kind == 0:
        return True
    if kind == 1:
        return max(_octets(m[0])) <= 255
    if kind == 2:
        return 16 <= len(m[0]) - m[0].count(" ") - m[0].count("-") <= 19 and luhn(digits_of(m[0]))
    return 8 <= sum(map(m[0].count, "0123456789")) <= 15


def base_matches(kind: int, text: str) -> Iterator[re.Match]:
    """The leftmost non-overlapping matches of STATED[kind], valid or not, in time linear in the text."""
    if kind:
        yield from BASE[kind].finditer(text)
        return
    m = BASE[0].search(text)
    while m:
        yield m
        m = _NEXT_EMAIL.match(text, m.end()) or BASE[0].search(text, m.end())


def candidates(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, base) in code points, by kind and start; loose ones never overlap base ones of any kind."""
    base: list[tuple[int, int, int]] = []
    loose: list[tuple[int, int, int]] = []
    for kind in range(len(KINDS)):
        if _HINT[0][kind] is None or _HINT[0][kind] in text:
            for m in base_matches(kind, text):
                if valid(kind, m):
                    base.append((kind, *m.span()))
                elif kind == 2 and len(m[0]) < 30 and 13 <= len(d := digits_of(m[0])) <= 15 and luhn(d):
                    loose.append((kind, *m.span()))
        if LOOSE[kind] is not None and _HINT[1][kind].search(text):
            loose += [(kind, *m.span()) for m in LOOSE[kind].finditer(text) if kind != 1 or _V6.fullmatch(m[0])]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    for kind, s, e in loose:
        i = int(np.searchsorted(starts, e))
        if not i or reach[i - 1] <= s:
            base.append((kind, s, e))
    of_base = {(kind, s, e) for kind, s, e in base[: len(taken)]}
    for c in sorted(base):
        yield (*c, c in of_base)


def votes(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """The labelers' votes on a candidate."""
    span, digits = text[start:end], digits_of(text[start:end])
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW // 3]
    out = []
    if kind == 0:
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        out.append(YES if len(last) > 1 and last[-2:].isalpha() and ".." not in span else NO)
        out.append(NO if last in FILE_ENDS else YES if last in GENERIC or len(last) == 2 and last.isalpha() else ABSTAIN)
        shape = NO if len(span) > 100 or span[0] in ".-%+" else YES
    elif kind == 1:
        v6 = ":" in span
        out.append(YES if (re.search(r"[0-9]", span) if v6 else not re.search(r"(?:^|\.)0[0-9]", span)) else NO)
        parts = [1] if v6 else _octets(span)
        first = parts[0]
        out.append(ABSTAIN if v6 else NO if first == 0 or first >= 240 else YES)
        shape = (YES if len(span) > 10 else ABSTAIN) if v6 else NO if max(parts) < 20 else YES
    elif kind == 2:
        out.append(YES if re.fullmatch(r"[0-9]+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{3,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}", span) else NO)
        out.append(YES if ISSUER.match(digits) else NO)
        shape = NO if len(set(digits)) < 4 else YES
    else:
        out.append(YES if span[0] == "+" and 10 <= len(digits) <= 13 else ABSTAIN if base or span[0] == "(" else NO)
        code = digits[2:] if span.startswith("00") else digits
        known = span[0] == "+" or span.startswith("00")
        out.append((YES if known_code(code) else NO) if known else YES if digits[0] not in "01" and digits[3] not in "01" else NO)
        shape = NO if len(set(digits)) < 3 or span.count("(") != span.count(")") else YES
    near = bool(CONTEXT[kind].search(before))
    against = bool(AGAINST[kind].search(before))
    out.append(YES if near and not against else NO if against and not near else ABSTAIN)
    out.append(shape)
    touching = (before[-1:].isalnum() or before[-1:] in ("_", "=", "/")) or (after[:1].isalnum() or after[:1] == "_")
    out.append(NO if touching else YES)
    return out


#: A pattern is kind, base, five votes and a length class, as digits of a mixed radix.
RADIX = (len(KINDS), 2, *(3,) * len(LABELERS), 4)


def pattern_of(kind: int, base: bool, found: list[int], length: int) -> int:
    code = 0
    for value, radix in zip((kind, int(base), *found, min(3, length // 10)), RADIX, strict=True):
        code = code * radix + value
    return code


def unpack(patterns: np.ndarray) -> np.ndarray:
    """A row of digits for each pattern."""
    out = []
    for radix in reversed(RADIX):
        patterns, digit = np.divmod(patterns, radix)
        out.append(digit)
    return np.stack(out[::-1], axis=1)


# ----------------------------------------------------------------- models


def reliabilities(found: np.ndarray, n: np.ndarray, rounds: int = 60, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote rows found, each seen n times: (table[labeler, truth, vote], probability that each row is true)."""
    p = (1 + (found == YES).sum(axis=1)) / (2 + (found != ABSTAIN).sum(axis=1))  # majority to begin with
    shares = np.zeros((found.shape[1], 2, 3))
    hit = np.stack([found == v for v in range(3)], axis=2).astype(float)
    for _ in range(rounds):
        for truth, w in enumerate((n * (1 - p), n * p)):
            shares[:, truth] = (hit * w[:, None, None]).sum(axis=0) + smooth
        shares /= shares.sum(axis=2, keepdims=True)
        prior = ((n * p).sum() + 1) / (n.sum() + 2)
        odds = np.log(prior / (1 - prior)) + np.log(np.einsum("rlv,lv->rl", hit, shares[:, 1]) / np.einsum("rlv,lv->rl", hit, shares[:, 0])).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return shares, p


def _design(digits: np.ndarray) -> np.ndarray:
    """Votes and length class one-hot, kind one-hot, and a constant."""
    kind, rest = digits[:, 0], digits[:, 2:]
    columns = [kind == k for k in range(len(KINDS))] + [rest[:, j] == v for j in range(rest.shape[1]) for v in range(RADIX[2 + j])]
    return np.stack([*columns, np.ones(len(digits), bool)], axis=1).astype(float)


@dataclass
class Tagger:
    """table[kind][labeler, truth, vote] as EM found it, and the classifier's weights."""

    tables: dict[str, np.ndarray]
    weights: np.ndarray

    def probability(self, patterns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(unpack(patterns)) @ self.weights, -40, 40)))


def fit(patterns: np.ndarray, n: np.ndarray, rounds: int = 50, penalty: float = 1.0) -> Tagger:
    """EM for each kind, then a logistic classifier on the probabilities that it gives (Newton's method)."""
    width = len(_design(np.zeros((1, len(RADIX)), np.int64))[0])
    tables, w = {}, np.zeros(width)
    if not len(patterns):
        return Tagger(tables, w)
    digits = unpack(patterns)
    target = np.zeros(len(patterns))
    for k, name in enumerate(KINDS):
        own = digits[:, 0] == k
        if own.any():
            tables[name], target[own] = reliabilities(digits[own, 2 : 2 + len(LABELERS)], n[own].astype(float))
    x = _design(digits)
    weight = n / n.sum() * 1000.0  # so that the penalty means the same at every size
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (p - target)) + penalty * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(width)
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Tagger(tables, w)


# ------------------------------------------------------------------- rows

_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("pattern", T.IntegerType())]))


def find_candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, candidates) for each row of df, from the whole text; null counts as empty."""
    schema = T.StructType([df.schema[id_col], T.StructField("candidates", _SPANS)])
    kind_ = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                text = x.as_py() or ""
                out.append([{"kind": k, "start": s, "end": e, "base": b, "pattern": pattern_of(k, b, votes(text, k, s, e, b), e - s)} for k, s, e, b in candidates(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind_)], names=schema.names)

    return df.select(id_col, text_col).transform(mapped, run, schema)


def train(found: DataFrame) -> Tagger:
    """A tagger from the candidates of all documents."""
    counts = found.select(F.explode("candidates.pattern").alias("p")).groupBy("p").count().collect()  # patterns, not candidates
    counts.sort()
    return fit(np.array([r["p"] for r in counts], np.int64), np.array([r["count"] for r in counts], np.int64))


def tag(found: DataFrame, tagger: Tagger, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(id, spans): array of (kind, start, end, base, probability), by kind as listed, then start."""
    schema = T.StructType([found.schema[id_col], T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("probability", T.DoubleType())])))])
    kind_ = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            seen = np.array(sorted({c["pattern"] for r in rows for c in r}), np.int64)
            p = dict(zip(seen.tolist(), tagger.probability(seen).tolist(), strict=True)) if len(seen) else {}
            out = [[{"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"], "base": c["base"], "probability": p[c["pattern"]]} for c in r if c["base"] or p[c["pattern"]] >= threshold] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind_)], names=schema.names)

    return found.transform(mapped, run, schema)


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, spans) for each row of df: all base spans and what the trained classifier adds.

    Every row gives a row, without personal data an empty array; rows that
    repeat an id stay apart. Null texts count as empty. Only the two columns are
    used. Offsets are code points, the end is exclusive. No rows give no rows.
    """
    found = checkpoint(find_candidates(df, id_col, text_col))
    return tag(found, train(found), id_col, threshold)


def _replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each run of overlapping spans replaced by the kind of its longest one, in brackets."""
    out, at, i = [], 0, 0
    spans = sorted(spans, key=lambda s: (s[1], -s[2]))
    while i < len(spans):
        start, end, longest = spans[i][1], spans[i][2], spans[i]
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            longest = max(longest, spans[i], key=lambda s: s[2] - s[1])
            i += 1
        out += [text[at:start], f"[{longest[0]}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """df with each span of text_col replaced by its kind in brackets; of overlapping spans nothing stays.

    The models are fitted as for personal_data, then each text is read again
    where it lies: nothing is shuffled, all other columns and repeated rows
    stay as they are, and a null text stays null.
    """
    key = temp_name(df, "row")
    tagger = train(find_candidates(df.select(F.lit(0).alias(key), text_col), key, text_col))
    shared = df.sparkSession.sparkContext.broadcast(tagger)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(at):
                text = x.as_py()
                found = [(k, s, e, b, pattern_of(k, b, votes(text, k, s, e, b), e - s)) for k, s, e, b in candidates(text or "")]
                p = shared.value.probability(np.array([f[4] for f in found], np.int64)) if found else ()
                taken = [(KINDS[k], s, e) for (k, s, e, b, _), q in zip(found, p, strict=True) if b or q >= threshold]
                out.append(_replaced(text, taken) if taken else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.string()))

    return df.transform(mapped, run, df.schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, numbers of base spans by kind, their digest, all spans and their number, of each row of documents.

    A null or empty text has no spans; rows that repeat a doc_id give a row each.
    """
    spans = personal_data(table(spark, sf_dir, "documents"))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = [F.expr(f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *count, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The SHA-256 of spans written kind:start:end and joined by commas."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
