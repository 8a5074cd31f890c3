"""An interpolated modified Kneser-Ney bigram model, counted in Spark, kept in sorted hash arrays.

Counting. Each task sums its bigrams (A-Z lower-cased words, a start and an end
for each text) by hash, and sends a packed array to each of the buckets, which
are ranges of the bigram hash: a frequent word or pair fills no bucket, for a
task sends a pair once. A bucket writes its bigrams as a sorted array of hashes
beside an array of counts, and passes on what its bigrams add to their words
(count, continuation count, and the totals and counts of counts of a context).
These sums go to buckets by word hash and are written in the same form.

Scoring. Workers map the arrays into memory; the questions of a batch of texts
are sorted, so that each array is read from front to back. Nothing is loaded
whole, and the arrays grow with the corpus without any cut-off.

The model's folder is below spark.checkpoint.dir and must be a path in a file
system that all executors mount (file:), as memory mapping asks for that.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path
from .common import mapped, mix64, slices, string_parts, sums_by_key, table, token_hashes

START, END = (np.uint64(xxhash.xxh64_intdigest(b"", seed)) for seed in (1, 2))
#: What a word's array holds beside its hash: its count, its continuation count (distinct words before it), and as a context its total and its followers seen once, twice, and more often.
WORD_COLUMNS = ("count", "cont", "total", "n1", "n2", "n3")
#: Bytes of text for each bucket of bigrams, and for each bucket of words.
BIGRAM_BUCKET, WORD_BUCKET = 24 << 20, 96 << 20
#: A task sums and sends its bigrams when it holds so many tokens.
HELD = 2 << 20
#: Pairs of a bucket that are sorted and summed at a time; a bucket with more is handled in ranges of its hashes.
PAIRS = 1 << 19
#: Bytes of text that are counted or scored at a time, and bytes of word sums that are held before they are added up.
SLICE, SUMS = 2 << 20, 16 << 20
#: Arrays that a worker keeps mapped.
MAPPED = 4096
#: Partitions of a shuffle are 2 to this at most; beyond that several buckets lie in one, in order, and are handled one after the other.
PARTITION_BITS = 14


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * np.uint64(0x9E3779B97F4A7C15) + mix64(second))


def token_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, token, tokens per text), as hashes: each word of a text, then its end."""
    words, row = token_hashes(*string_parts(texts))
    count = np.bincount(row, minlength=len(texts)) + 1
    ends = np.cumsum(count)
    token = np.empty(count.sum(), np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[ends - 1] = True
    token[is_end] = END
    token[~is_end] = words
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - count] = START
    return before, token, count


def _text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about SLICE bytes; a longer text is a run of its own."""
    sizes = pa.compute.binary_length(texts).fill_null(0).to_pylist()
    for lo, hi in slices(sizes, SLICE):
        yield texts.slice(lo, hi - lo)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _distinct(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each distinct key, in the order of the keys; how often it is there, or its sum of n)."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return order[first], np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n[order], first)


def _bits(size: int, each: int) -> int:
    return max(0, (max(1, size) // each).bit_length())


def _packed(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, its part of each column end to end), for rows in the order of their buckets."""
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[lo]), b"".join(c[lo:hi].tobytes() for c in columns)


def _unpacked(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    """What _packed laid end to end; kinds: the columns' types."""
    n = len(blob) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _rows(rows: list[tuple[int, int, bytes | None, list[int] | None]]) -> pa.RecordBatch:
    b, side, blob, stats = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(side, pa.int32()), pa.array(blob, pa.binary()), pa.array(stats, pa.list_(pa.int64()))], names=["bucket", "side", "blob", "stats"])


_SCHEMA = "bucket int, side int, blob binary, stats array<long>"
#: Columns of the blobs: of pairs (word before, token, count), and of what a bucket's pairs add to a word as a token (side 0) and as a word before (side 1).
_PAIR = (np.uint64, np.uint64, np.uint32)
_SIDES = ((np.uint64, *[np.int64] * 2), (np.uint64, *[np.int64] * 4))


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all; a task that runs twice writes the same."""
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{uuid.uuid4().hex}.npy"
    if array.dtype != np.uint64:
        array = array.astype(np.uint32 if not len(array) or array.max() < 1 << 32 else np.uint64)
    np.save(own, array)
    os.replace(own, f"{folder}/{name}.npy")


def _by_bucket(batches: Iterator[pa.RecordBatch], add: Callable[[list], list] | None = None) -> Iterator[tuple[int, list | None, list[int] | None]]:
    """(bucket, its (side, blob)s, None) for rows sorted by bucket, and (-1, None, stats) for rows that carry sums.

    add: makes fewer of what is held of a bucket, each time that SUMS bytes have come.
    """
    at, held, size = -1, [], 0
    for batch in batches:
        for b, side, blob, stats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if blob is None:
                yield -1, None, stats
                continue
            if b != at and held:
                yield at, held, None
                held, size = [], 0
            at = b
            held.append((side, blob))
            size += len(blob)
            if add is not None and size > SUMS:
                held, size = add(held), 0
    if held:
        yield at, held, None


def _pair_ranges(blobs: list[tuple[int, bytes]], bits: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hashes in order, words before, tokens, counts) of a bucket's distinct pairs, in ranges of about PAIRS rows each."""
    parts = [_unpacked(blob, _PAIR) for _, blob in blobs]
    hashes = [pair_hash(before, token) for before, token, _ in parts]
    more = min(_bits(sum(map(len, hashes)), PAIRS), 64 - bits)
    for r in range(1 << more):
        if more:
            place = [(h << np.uint64(bits)) >> np.uint64(64 - more) if bits < 64 else h for h in hashes]
            own = [np.flatnonzero(p == np.uint64(r)) for p in place]
            del place
        else:
            own = [np.arange(len(h)) for h in hashes]
        key = np.concatenate([h[o] for h, o in zip(hashes, own, strict=True)])
        if not len(key):
            continue
        before, token, k = (np.concatenate([p[i][o] for p, o in zip(parts, own, strict=True)]) for i in range(3))
        pick, k = _distinct(key, k.astype(np.int64))
        yield key[pick], before[pick], token[pick], k


def _word_parts(before: np.ndarray, token: np.ndarray, k: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """What distinct pairs with counts k add to their tokens (count, cont) and to their words before (total, n1, n2, n3)."""
    of_token = sums_by_key(token, k, np.ones(len(k), np.int8))
    of_before = sums_by_key(before, k, k == 1, k == 2, k >= 3)
    return of_token, of_before


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return sums_by_key(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _word_sums(held: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The same sums in one blob for each side."""
    out = []
    for i, kinds in enumerate(_SIDES):
        own = [_unpacked(blob, kinds) for side, blob in held if side == i]
        if own:
            out.append((i, b"".join(c.tobytes() for c in _merged(own))))
    return out


def _ranks(n: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, and 3 or more."""
    return [int(np.count_nonzero(n == i)) for i in (1, 2, 3, 4)] + [int(np.count_nonzero(n >= 3))]


def _discounts(n: list[int]) -> list[float]:
    """What is taken off counts of 0, 1, 2, and 3 or more; where counts of counts are lacking, 0.5, 1, 1.5."""
    n1, n2, n3, n4 = n[:4]
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [0.0, *(d if 0 < d < i else i / 2 for i, d in enumerate(raw, 1))]


@dataclass
class Model:
    """Where the arrays are, and the few sums that scoring needs."""

    folder: str
    bigram_bits: int
    word_bits: int
    tokens: int = 0
    vocabulary: int = 0
    d2: list[float] = field(default_factory=lambda: [0.0] * 4)
    d1: list[float] = field(default_factory=lambda: [0.0] * 4)
    conts: int = 0
    cont_ranks: list[int] = field(default_factory=lambda: [0] * 5)
    #: How many keys each bucket holds, by kind; a bucket that is not listed is empty.
    held: dict[str, dict[int, int]] = field(default_factory=lambda: {"bigrams": {}, "words": {}})

    def array(self, kind: str, bucket: int, column: str, mapped: dict) -> np.ndarray:
        """A bucket's column, mapped into memory. Raises where it is missing or not of the length that training noted."""
        at = f"{self.folder}/{kind}/{bucket}/{column}.npy"
        if at not in mapped:
            if len(mapped) >= MAPPED:
                mapped.clear()
            if not os.path.exists(at):
                raise FileNotFoundError(f"{at} is gone, or spark.checkpoint.dir is not mounted here; without it scores would be wrong")
            mapped[at] = np.load(at, mmap_mode="r")
            if len(mapped[at]) != self.held[kind][bucket]:
                raise ValueError(f"{at} holds {len(mapped[at])} keys in place of {self.held[kind][bucket]}")
        return mapped[at]

    def find(self, kind: str, keys: np.ndarray, columns: tuple[str, ...], mapped: dict | None = None) -> list[np.ndarray]:
        """The columns of sorted, distinct keys; 0 where a key is not there. mapped: arrays that are open already."""
        bits = self.bigram_bits if kind == "bigrams" else self.word_bits
        mapped = {} if mapped is None else mapped
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        of = _bucket(keys, bits)
        for b in np.unique(of).tolist():
            if b not in self.held[kind]:
                continue
            lo, hi = np.searchsorted(of, [b, b + 1])
            hashes = self.array(kind, b, "hash", mapped)
            place = np.minimum(np.searchsorted(hashes, keys[lo:hi]), len(hashes) - 1)
            there = np.flatnonzero(hashes[place] == keys[lo:hi])
            for o, c in zip(out, columns, strict=True):
                o[lo + there] = self.array(kind, b, c, mapped)[place[there]]
        return out

    def score(self, texts: pa.Array, mapped: dict | None = None) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        _, token, count = token_pairs(texts)
        at = np.cumsum(count) - count
        distinct, of = np.unique(np.append(token, START), return_inverse=True)
        by = np.append(of[-1], of[:-2])  # the word before each token: its neighbour, or the start
        by[at] = of[-1]
        of = of[:-1]
        c, cont, total, n1, n2, n3 = self.find("words", distinct, WORD_COLUMNS, mapped)
        pairs, pair_of = np.unique(by * len(distinct) + of, return_inverse=True)
        keys = pair_hash(distinct[pairs // len(distinct)], distinct[pairs % len(distinct)])
        order = np.argsort(keys)
        seen = np.empty(len(pairs), np.int64)
        seen[order] = self.find("bigrams", keys[order], ("count",), mapped)[0]
        seen = seen[pair_of]

        d1, d2 = np.array(self.d1), np.array(self.d2)
        ranks = self.cont_ranks
        rest = d1[1] * ranks[0] + d1[2] * ranks[1] + d1[3] * ranks[4]
        uniform = 1 / (self.vocabulary + 1)
        p1 = (cont - d1[np.minimum(cont, 3)] + rest * uniform) / self.conts if self.conts else np.full(len(cont), uniform)
        sum_by = np.maximum(total, 1)
        back = (d2[1] * n1 + d2[2] * n2 + d2[3] * n3) / sum_by
        p = np.where(total[by] > 0, (seen - d2[np.minimum(seen, 3)]) / sum_by[by] + back[by] * p1[of], p1[of])
        base = np.log10((c + 1) / (self.tokens + self.vocabulary + 1))[of]
        add = lambda x: np.add.reduceat(x, at) if len(x) else x
        return count, add((c > 0)[of].astype(np.int64)), add(base), add(np.log10(p))


def train(df: DataFrame, text_col: str = "text") -> Model:
    """A model of all rows' whole texts; a null text counts as empty (its end is a token).

    Equal rows count as often as they occur. Only text_col is used. With no rows
    the model gives each token the probability 1.
    """
    spark = df.sparkSession
    parts = urlparse(shared_path(spark, "ngrams"))
    if parts.scheme not in ("", "file"):
        raise ValueError("memory-mapped arrays need spark.checkpoint.dir on a mounted file system (file:)")
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    model = Model(parts.path, _bits(size, BIGRAM_BUCKET), _bits(size, WORD_BUCKET))
    bits, word_bits, folder = model.bigram_bits, model.word_bits, model.folder

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            before, token = (np.concatenate([h[i] for h in held]) for i in range(2))
            held.clear()
            pick, k = _distinct(pair_hash(before, token))
            before, token, k = before[pick], token[pick], k.astype(np.uint32)
            # By bucket, and within it by the word before: its repeats are close together and compress.
            pick = np.argsort(before)
            before, token, k = before[pick], token[pick], k[pick]
            bucket = _bucket(pair_hash(before, token), bits).astype(np.uint16 if bits <= 16 else np.int64)
            by = np.argsort(bucket, kind="stable")
            return _rows([(b, 0, blob, None) for b, blob in _packed(bucket[by], before[by], token[by], k[by])])

        for batch in batches:
            for texts in _text_slices(batch.column(0)):
                before, token, _ = token_pairs(texts)
                held.append((before, token))
                n += len(token)
                if n >= HELD:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs, _ in _by_bucket(batches):
            keys, counts, sides = [], [], ([], [])
            for key, before, token, k in _pair_ranges(blobs, bits):
                keys.append(key)
                counts.append(k.astype(np.uint32) if k.max() < 1 << 32 else k.astype(np.uint64))
                for side, part in zip(sides, _word_parts(before, token, k), strict=True):
                    side.append(part)
            blobs.clear()
            count = np.concatenate(counts)
            _save(f"{folder}/bigrams/{b}", "count", count)
            ranks = _ranks(count)
            del counts, count
            key = np.concatenate(keys)
            _save(f"{folder}/bigrams/{b}", "hash", key)
            n = len(key)
            del keys, key
            for i, side in enumerate(sides):
                found = _merged(side)
                side.clear()
                yield _rows([(w, i, blob, None) for w, blob in _packed(_bucket(found[0], word_bits), *found)])
            yield _rows([(0, 0, None, [2, b, n, *ranks])])

    def word_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs, stats in _by_bucket(batches, _word_sums):
            if stats is not None:
                yield _rows([(0, 0, None, stats)])
                continue
            sides = {i: _unpacked(blob, _SIDES[i]) for i, blob in _word_sums(blobs)}
            blobs.clear()
            tokens, befores = (sides.get(i, [np.zeros(0, k) for k in _SIDES[i]]) for i in range(2))
            keys = np.union1d(tokens[0], befores[0])
            columns = []
            for own, *sums in (tokens, befores):
                at = np.searchsorted(keys, own)
                for c in sums:
                    columns.append(np.zeros(len(keys), np.int64))
                    columns[-1][at] = c
            for name, c in zip(WORD_COLUMNS, columns, strict=True):
                _save(f"{folder}/words/{b}", name, c)
            _save(f"{folder}/words/{b}", "hash", keys)
            c, cont = columns[:2]
            yield _rows([(0, 0, None, [1, b, len(keys), *_ranks(cont), int(cont.sum()), int(c.sum()), int(np.count_nonzero(c))])])

    def dealt(rows: DataFrame, bits: int) -> DataFrame:
        used = min(bits, PARTITION_BITS)
        return rows.repartitionById(1 << used, F.shiftright("bucket", bits - used)).sortWithinPartitions("bucket")

    sent = dealt(df.select(text_col).transform(mapped, pairs, _SCHEMA), bits)
    sent = dealt(sent.transform(mapped, bigrams, _SCHEMA), word_bits)
    sums = {1: np.zeros(8, np.int64), 2: np.zeros(5, np.int64)}
    for r in sent.transform(mapped, word_sums, _SCHEMA).select("stats").collect():  # a few sums for each bucket
        order, b, n, *found = r["stats"]
        sums[order] += np.array(found, np.int64)
        model.held["words" if order == 1 else "bigrams"][b] = n
    one, two = (x.tolist() for x in (sums[1], sums[2]))
    model.d2, model.d1 = _discounts(two), _discounts(one)
    model.cont_ranks, model.conts, model.tokens, model.vocabulary = one[:5], one[5], one[6], one[7]
    return model


def score(df: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols, n_tokens, n_known, base_score, score (log10) and perplexity for each row of df; a null text counts as empty."""
    names = ["n_tokens", "n_known", "base_score", "score", "perplexity"]
    schema = T.StructType([*(df.schema[c] for c in id_cols), *(T.StructField(n, T.LongType() if n[:2] == "n_" else T.DoubleType()) for n in names)])
    n = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: dict = {}
        for batch in batches:
            lo = 0
            for texts in _text_slices(batch.column(n)):
                count, known, base, log = model.score(texts, arrays)
                found = [count, known, base, log, np.power(10.0, -log / count)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, len(texts)) for c in batch.columns[:n]), *map(pa.array, found)], names=schema.names)
                lo += len(texts)

    return df.select(*id_cols, text_col).transform(mapped, run, schema)


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Each document's scores by a model of those whose crc32(doc_id as text) mod 7 is not 2.

    A null doc_id counts as the empty text there, a null text as an empty one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)
    model = train(docs.filter(~F.col("held_out")))
    scored = score(docs, model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
