"""Periodic runs of words, found by divide and conquer at midpoints (Main and Lorentz).

A run is a stretch of words that repeats itself with its smallest period q at
least twice, has 12 words or more, and can't be made longer with that period. A
document is halved again and again; a run lies in one half or crosses the
midpoint m. One that crosses, with period p, either holds word m and word m - p,
or word m - 1 and word m - 1 + p, and these are equal. How far the text agrees
with itself from such a pair on, forwards and backwards, is what the Z-functions
of the two halves say; the pair gives a repetition if both add up to p or more,
and extended over the document these are the ends of the run. The halves of one
size of all documents of a batch are handled together in numpy.

Where a text agrees with itself for more than a few words, the end is found by
bisection over hashes of prefixes; every run is compared word by word before it
is given out, so that no collision can show in a result. Pairs within a run
that is known already, a multiple of its period apart, would give that run
again and are left out, so a document that says one thing only takes no more
than n log n steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, table

#: The least number of words of a run.
LEAST = 12
#: Words compared one by one before hashes are taken, and pairs of places looked at together.
STEPS, AT_ONCE = 8, 1 << 20
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)


class Words(dict):
    """The number of each word, given when it is first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Prefixes:
    """Hashes of all prefixes by two moduli; made when a long agreement is first looked for."""

    def __init__(self, ids: np.ndarray, seed: int) -> None:
        self.ids, self.seed, self.sums = ids, seed, None

    def _make(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.sums, self.powers = [], []
        for prime in _PRIMES:
            p = np.uint64(prime)
            values = rng.integers(1, prime, int(self.ids.max()) + 1, np.uint64)[self.ids]
            powers = np.ones(len(self.ids) + 1, np.uint64)
            base, done = np.uint64(rng.integers(1 << 20, prime)), 1
            while done < len(powers):  # powers of the base, twice as many each time
                more = min(done, len(powers) - done)
                powers[done : done + more] = powers[:more] * base % p
                base, done = base * base % p, done + more
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:-1] % p)]))
            self.powers.append(powers)

    def same(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from x on are those from y on (x < y)."""
        if self.sums is None:
            self._make()
        out = np.ones(len(x), bool)
        for prime, sums, powers in zip(_PRIMES, self.sums, self.powers, strict=True):
            p = np.uint64(prime)
            out &= (sums[x + n] - sums[x]) % p * powers[y - x] % p == (sums[y + n] - sums[y]) % p
        return out


def _agreement(ids: np.ndarray, hashes: _Prefixes, x: np.ndarray, y: np.ndarray, room: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words from x and y on agree: forwards with x and y among them, or backwards before them; at most room."""
    n = np.zeros(len(x), np.int64)
    active = np.arange(len(x))
    for t in range(STEPS):
        active = active[room[active] > t]
        off = t if ahead else -1 - t
        active = active[ids[x[active] + off] == ids[y[active] + off]]
        n[active] += 1
    active = active[room[active] > STEPS]
    if len(active):
        xs, ys = x[active], y[active]
        low, high = np.full(len(active), STEPS), room[active].copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = hashes.same(xs, ys, mid) if ahead else hashes.same(xs - mid, ys - mid, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        n[active] = low
    return n


def _pairs(ids: np.ndarray, mid: np.ndarray, half: int, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, x, y), x < y: equal words of which one stands at a node's midpoint and the other in the half before it, or one before it and the other in the half after."""
    if half <= 2048:
        step = max(1, AT_ONCE // (2 * half))
        span = np.arange(half)
        for lo in range(0, len(mid), step):
            m, end = mid[lo : lo + step], last[lo : lo + step]
            before = (m - half)[:, None] + span
            node, at = np.nonzero(ids[before] == ids[m][:, None])
            after = np.minimum(m[:, None] + span, end[:, None] - 1)
            node2, at2 = np.nonzero((ids[after] == ids[m - 1][:, None]) & (m[:, None] + span < end[:, None]))
            yield np.concatenate([node, node2]) + lo, np.concatenate([before[node, at], m[node2] - 1]), np.concatenate([m[node], after[node2, at2]])
        return
    for i, (m, end) in enumerate(zip(mid.tolist(), last.tolist(), strict=True)):
        for lo in range(m - half, m, AT_ONCE):
            x = lo + np.flatnonzero(ids[lo : min(m, lo + AT_ONCE)] == ids[m])
            yield np.full(len(x), i), x, np.full(len(x), m)
        for lo in range(m, min(end, m + half), AT_ONCE):
            y = lo + np.flatnonzero(ids[lo : min(end, m + half, lo + AT_ONCE)] == ids[m - 1])
            yield np.full(len(y), i), np.full(len(y), m - 1), y


def find_runs(ids: np.ndarray, offsets: np.ndarray, least: int = LEAST, seed: int = 0) -> np.ndarray:
    """Rows (start, end, period), sorted, of all runs; document i holds ids[offsets[i]:offsets[i+1]] and no run leaves its document."""
    empty = np.zeros((0, 3), np.int64)
    if not len(ids):
        return empty
    first, ends = offsets[:-1], offsets[1:]
    sizes = ends - first
    hashes = _Prefixes(ids, seed)
    cover = np.full(len(ids), -1, np.int64)  # a run known to hold this word
    known: dict[tuple[int, int], int] = {}
    numbers: list[int] = []  # the period of each known run
    half = 1 << max(0, (least - 1).bit_length() - 1)
    while half < sizes.max():
        count = (sizes + half - 1) // (2 * half)
        doc = np.repeat(np.arange(len(sizes)), count)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        mid = first[doc] + place * 2 * half + half
        for node, x, y in _pairs(ids, mid, half, ends[doc]):
            of = cover[x]
            if numbers:
                again = (of >= 0) & (of == cover[y])
                again[again] = (y - x)[again] % np.array(numbers)[of[again]] == 0
                node, x, y = node[~again], x[~again], y[~again]
            p = y - x
            fits = np.maximum(2 * p, least) <= sizes[doc[node]]
            node, x, y, p = node[fits], x[fits], y[fits], p[fits]
            ahead = _agreement(ids, hashes, x, y, ends[doc[node]] - y, True)
            back = _agreement(ids, hashes, x, y, x - first[doc[node]], False)
            good = (ahead + back >= p) & (ahead + back + p >= least)
            if not good.any():
                continue
            found = np.stack([(x - back)[good], (y + ahead)[good], p[good]], 1)
            found = found[np.lexsort(found.T[::-1])]
            new = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])
            for a, b, q in found[new].tolist():
                if q < known.get((a, b), q + 1):
                    known[a, b] = q
                    cover[a:b] = len(numbers)
                    numbers.append(q)
        half *= 2
    if not known:
        return empty
    of = np.searchsorted(ends, np.array([a for a, _ in known]), "right")
    for (a, b), q, d in zip(known, known.values(), of.tolist(), strict=True):
        exact = np.array_equal(ids[a : b - q], ids[a + q : b]) and (a == first[d] or ids[a - 1] != ids[a - 1 + q]) and (b == ends[d] or ids[b] != ids[b - q])
        if not exact:  # two different stretches had equal hashes
            return find_runs(ids, offsets, least, seed + 1)
    return np.array(sorted((a, b, q) for (a, b), q in known.items()), np.int64)


def runs_of(text: str | None, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, by start, then period."""
    numbers = Words()
    ids = np.fromiter(map(numbers.__getitem__, (text or "").encode().split()), np.int64)
    return sorted((a, b - a, q) for a, b, q in find_runs(ids, np.array([0, len(ids)]), least).tolist())


_RUNS = T.ArrayType(T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")]), False)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, least: int = LEAST) -> DataFrame:
    r"""df without its text, with n_words, runs and collapsed.

    Words are what lies between runs of the six characters [\x20\x09-\x0D].
    runs: an array of (start, length, period), counted in words, by start, then
    period. collapsed: the words joined by one space without those that any run
    holds after its first period. rewrite may change the words of a document
    (it gets the id and the words) before anything is looked for. One row for each
    row, repeated ones and null ids too; a null or empty text has no words, no
    runs and the empty text. Other columns are kept, whatever their names,
    unless they are named like the three results, which replace them.
    """
    results = ("n_words", "runs", "collapsed")
    kept = [c for c in df.columns if c != text_col and (c.lower() not in results or c == id_col)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("n_words", T.LongType(), False), T.StructField("runs", _RUNS, False), T.StructField("collapsed", T.StringType(), False)])
    n, at = len(kept), kept.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = Words()
            texts = [(x.as_py() or "").encode().split() for x in batch.column(n)]
            if rewrite is not None:
                texts = [rewrite(i.as_py(), w) for i, w in zip(batch.column(at), texts, strict=True)]
            ends = np.cumsum([0, *map(len, texts)])
            ids = np.fromiter((numbers[w] for words in texts for w in words), np.int64, int(ends[-1]))
            runs = find_runs(ids, ends, least)
            of = np.searchsorted(ends, runs[:, 0], "right") - 1
            start, length, period = runs[:, 0] - ends[of], runs[:, 1] - runs[:, 0], runs[:, 2]
            order = np.lexsort((period, start, of))
            step = np.zeros(len(ids) + 1, np.int64)
            np.add.at(step, runs[:, 0] + period, 1)
            np.add.at(step, runs[:, 1], -1)
            stays = np.cumsum(step[:-1]) == 0
            joined = []
            repeats = np.bincount(of, minlength=len(texts))
            for i, words in enumerate(texts):
                if repeats[i]:
                    words = [words[j] for j in np.flatnonzero(stays[ends[i] : ends[i + 1]]).tolist()]
                joined.append(b" ".join(words))
            lists = pa.StructArray.from_arrays([pa.array(x[order]) for x in (start, length, period)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(repeats)]), pa.int32()), lists)
            columns = [pa.array(np.diff(ends)), lists, pa.array(joined, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=schema.names)

    return df.select(*kept, text_col).transform(mapped, run, schema)


def with_tail_repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the query takes them: in a tenth of the documents, chosen by the id's CRC-32, the tail repeats its first p words. A null id changes nothing."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Each document's number of runs, its longest one (ties: smallest start, then period), and digests of all runs and of the collapsed text; without a run the longest one's four numbers are null."""
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=with_tail_repeated)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("longest", longest).withColumn("lines", F.array_join(lines, ""))
    start, length, period = -F.col("longest.start"), F.col("longest.length"), -F.col("longest.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
