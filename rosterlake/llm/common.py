"""Helpers that the text operators share: tables, checkpoints, and token hashing in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: The characters that part words: space and \t \n \v \f \r.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through reliable files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def temp_name(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of df's (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows and bytes of a batch that goes to Python; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of bounded size, so that long texts don't add up in a task's memory.

    The bounds are settings of the session, read when the plan runs; they are
    lowered to BATCH_ROWS and BATCH_BYTES where they are above, and left alone
    where the session has lower ones.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = _bytes(conf.get(f"spark.sql.execution.arrow.{name}"))
        if not 0 < now <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", most)
    return df.mapInArrow(run, schema)


def _bytes(setting: str) -> int:
    """A setting in bytes; 0 where it is not a plain number or has a unit that is not known."""
    found = re.fullmatch(r"(-?[0-9]+)([bkmg]?)b?", setting.strip().lower())
    return int(found[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[found[2]] if found and int(found[1]) > 0 else 0


def spread(key: Column, ways: int) -> Column:
    """A salt from 0 to ways-1 that depends on the row's key alone."""
    return F.pmod(F.xxhash64(key), F.lit(ways)).cast("int")


# ---------------------------------------------------------------- numpy side

_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_weights(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(n, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & _MASK)) | np.uint64(1)


_W = odd_weights(1024, 1)
_W_FAR = odd_weights(1024, 2)
_W_FAR[0] = 1  # the first 1024 places have one weight, whatever else lies in the piece
_G = odd_weights(16, 3)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def _pieces(data: np.ndarray, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts of about step bytes at white space (or anywhere in a run without any)."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + step)
        while end < n:
            near = np.flatnonzero(_IS_SPACE[data[end : end + step]])
            if len(near):
                end += int(near[0])
                break
            end = min(n, end + step)
        yield at, end
        at = end


def token_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of each white-space token of the rows laid end to end in data.

    A token's hash is a sum of its bytes, each times an odd random weight of its
    place, then mixed; A-Z count as a-z. Equal tokens have equal hashes anywhere.
    """
    out_h, out_at = [], []
    cuts = np.unique(offsets)
    for lo, hi in _pieces(data):
        part = data[lo:hi]
        space = _IS_SPACE[part]
        inner = cuts[np.searchsorted(cuts, lo, "right") : np.searchsorted(cuts, hi, "left")] - lo
        first = ~space
        begins = first.copy()
        begins[1:] &= space[:-1]
        begins[inner] = first[inner]
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        token = np.cumsum(begins) - 1
        token[token < 0] = 0
        place = np.arange(len(part)) - starts[token]
        value = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
        value[space] = 0
        value *= _W[place & 1023]
        if place.max() > 1023:
            value *= _W_FAR[(place >> 10) & 1023]
        length = np.add.reduceat(first.astype(np.int64), starts).astype(np.uint64)
        out_h.append(mix64(np.add.reduceat(value, starts) + length * np.uint64(0x9E3779B97F4A7C15)))
        out_at.append(starts + lo)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.concatenate(out_at)
    return np.concatenate(out_h), np.searchsorted(offsets, at, "right") - 1


def ngram_hashes(tokens: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of n tokens that lies within one row."""
    count = len(tokens) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total += tokens[j : j + count] * _G[j]
    whole = rows[:count] == rows[n - 1 :]
    return mix64(total[whole]), rows[:count][whole]


def ascii_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased, parted at the six SPACES."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def sums_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and each column of values summed by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], *(np.add.reduceat(v[order], first, dtype=np.int64) if len(keys) else v.astype(np.int64) for v in values))


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about limit; a larger row is a run of its own."""
    lo, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= limit:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)
