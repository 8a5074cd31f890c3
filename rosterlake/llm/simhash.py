"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprints that differ in at most three bits agree on at least one of four
disjoint blocks of their bits. A node of the index is such a shared masked bit
pattern: the upper nodes hold the pattern of one 16-bit block, and a node with
more than ``cap`` fingerprints is parted again by the patterns of four blocks of
its free bits, until it is small or has so few free bits that it must be. These
upper nodes are rows of a DataFrame, dealt out by (mask, pattern), so that no
task holds more than one small node at a time, whatever the sizes of the groups.

Within a node the distinct fingerprints are sorted by Gray rank and a tree is
built over them: each inner node keeps the bits that all fingerprints below
share and that no node above has kept. A search adds up the differences on the
way down and leaves whole groups out once the sum exceeds three.

A node yields a path through each of its connected classes in place of all its
links; paths of all nodes together connect exactly what the links connect.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_words, checkpoint, mapped, spread, table, temp_name

MAX_DIFFERENCES = 3
#: Free bits of a node that is never parted: it holds 2^15 fingerprints at most.
LEAF_BITS = 15
_ALL = (1 << 64) - 1


# ------------------------------------------------------------ fingerprints


def fingerprint(words: list[bytes], width: int = 3) -> int:
    """64 bits; one is set if it is set in over half of the shingles' XXH64 (seed 42), repeats included.

    Fewer words than width: the whole sequence is the one shingle. No words: 0.
    """
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, 42)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    hashes = np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :], strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """df with its texts' fingerprints as a signed long; the text column itself goes. A null text has fingerprint 0."""
    kept = [c for c in df.columns if c != text_col]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            found = np.array([fingerprint(ascii_words(x.as_py())) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found.view(np.int64))], names=[*kept, out])

    return df.select(*kept, text_col).transform(mapped, run, schema)


# ----------------------------------------------------------- within a node


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray sequence."""
    x = x.astype(np.uint64, copy=True)
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A tree over fingerprints in Gray order, with the shared bits factored into upper nodes."""

    def __init__(self, fps: np.ndarray, leaf: int = 8, fan: int = 8) -> None:
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.fan, self.leaf = fan, leaf
        mask, bits, levels = np.full(len(fps), _ALL, np.uint64), self.fps, []
        while len(mask) > 1:
            width = leaf if not levels else fan
            at = np.arange(0, len(mask), width)
            both = np.bitwise_and.reduceat(mask, at)
            ones, some = np.bitwise_and.reduceat(bits, at), np.bitwise_or.reduceat(bits, at)
            levels.append((mask, bits, width))
            mask = both & ~(ones ^ some)
            bits = ones & mask
        levels.append((mask, bits, 1))
        #: From the root down: (bits kept here and not above, pattern, children per node of the level above).
        self.levels, above = [], None
        for mask, bits, width in reversed(levels):
            own = mask.copy()
            if above is not None:
                own &= ~np.repeat(above, width)[: len(mask)]
            self.levels.append((own, bits & own))
            above = mask
        self.widths = [w for _, _, w in reversed(levels)]

    def links(self, most: int = MAX_DIFFERENCES, step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (i < j, in Gray order) at most `most` bits apart, in blocks."""
        for lo in range(0, len(self.fps), step):
            query = np.arange(lo, min(lo + step, len(self.fps)))
            node = np.zeros(len(query), np.int64)
            sums = np.zeros(len(query), np.int64)
            for depth, (own, pattern) in enumerate(self.levels):
                if depth:
                    width = self.widths[depth]
                    node = (node[:, None] * width + np.arange(width)).ravel()
                    query, sums = np.repeat(query, width), np.repeat(sums, width)
                    inside = node < len(own)
                    query, node, sums = query[inside], node[inside], sums[inside]
                sums = sums + np.bitwise_count((self.fps[query] ^ pattern[node]) & own[node])
                near = sums <= most
                query, node, sums = query[near], node[near], sums[near]
            later = node > query
            yield query[later], node[later]


def _classes(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place reachable from each of n places."""
    label = np.arange(n)
    for a, b in links:
        while True:
            la, lb = label[a], label[b]
            low = np.minimum(la, lb)
            np.minimum.at(label, la, low)
            np.minimum.at(label, lb, low)
            while (jump := label[label] != label).any():
                label[jump] = label[label[jump]]
            if (label[a] == label[b]).all():
                break
    return label


def _paths(fps: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between neighbours of each class, in the order of the values."""
    order = np.lexsort((fps.view(np.int64), label))
    same = label[order[1:]] == label[order[:-1]]
    return fps[order[:-1][same]], fps[order[1:][same]]


def node_paths(values: np.ndarray, ends: np.ndarray, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Paths through the classes of many nodes; node i holds values[ends[i-1]:ends[i]] (distinct)."""
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    node = np.repeat(np.arange(len(ends)), sizes)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    little = sizes[node] <= small
    fps, of = values[little], node[little]

    def shifted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in range(1, min(small, len(fps))):
            a = np.flatnonzero(of[s:] == of[:-s])
            if not len(a):
                return
            near = a[np.bitwise_count(fps[a] ^ fps[a + s]) <= MAX_DIFFERENCES]
            yield near, near + s

    if len(fps):
        out.append(_paths(fps, _classes(len(fps), shifted())))
    for i in np.flatnonzero(sizes > small):
        index = GrayIndex(values[starts[i] : ends[i]])
        out.append(_paths(index.fps, _classes(len(index.fps), index.links())))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


# ------------------------------------------------------------- upper nodes


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def child_masks(mask: int) -> list[int]:
    """The mask with each of four blocks of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // (MAX_DIFFERENCES + 1) for i in range(MAX_DIFFERENCES + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _children(rows: DataFrame, masks: list[int]) -> tuple[DataFrame, list[int]]:
    """Rows (mask, fp) parted by the masks' children: (mask, pattern, fp)."""
    parted = {m: child_masks(m) for m in masks}
    table_ = F.create_map(*[F.lit(x) for m, kids in parted.items() for x in (_signed(m), [_signed(k) for k in kids])])
    out = rows.select(F.explode(table_[F.col("mask")]).alias("mask"), "fp").select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("pattern"), "fp")
    return out, sorted({k for kids in parted.values() for k in kids})


def linked_fingerprints(fps: DataFrame, cap: int = 2048) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints at most three bits apart.

    fps: one column fp, distinct. No node with more than cap fingerprints is
    handled whole; it is parted by four blocks of its free bits instead, so the
    links stay the same for any cap.
    """
    rows, masks = _children(fps.select(F.lit(0).cast("long").alias("mask"), "fp"), [0])
    found: list[DataFrame] = []
    while True:
        last = 64 - masks[0].bit_count() <= LEAF_BITS
        hot = None
        if not last:
            hot = rows.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).drop("n")
            hot = None if hot.isEmpty() else checkpoint(hot)
        part = rows if hot is None else rows.join(hot, ["mask", "pattern"], "left_anti")
        found.append(part.groupBy("mask", "pattern").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps"))
        if hot is None:
            break
        rows, masks = _children(rows.join(hot, ["mask", "pattern"], "left_semi").select("mask", "fp"), masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            a, b = node_paths(values.astype(np.int64).view(np.uint64), np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.transform(mapped, run, "a long, b long")


# -------------------------------------------------------------- components


def lookup(df: DataFrame, key: str, values: DataFrame, row_key: str, ways: int = 32) -> DataFrame:
    """df left-joined with values (key, ...; keys unique), in a way that no key is hot.

    Each key meets its values once for each of the salts that its rows have;
    the rows then meet them by (key, salt).
    """
    salt = temp_name(df, "salt")
    rows = df.withColumn(salt, spread(F.col(row_key), ways))
    pairs = rows.select(key, salt).distinct().join(values, key)
    return rows.join(pairs, [key, salt], "left").drop(salt)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b), for each node with a link.

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label; it ends when nothing changes. Rounds are cut by
    checkpoints. A node must not have very many links (paths give it two from
    each node of the index); labels may be shared by any number of nodes.
    """
    both = checkpoint(links.filter("a <> b").select("a", "b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        low = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("at"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        step = lookup(low, "at", jump, "node").select("node", "was", F.least("at", "beyond").alias("root"))
        step = checkpoint(step)
        labels = step.select("node", "root")
        if step.filter("root <> was").isEmpty():
            return labels


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = 2048) -> DataFrame:
    """(id, fp, component_id) for each row of df.

    Rows whose fingerprints differ in at most three bits are linked; component_id
    is the smallest id reachable over links, a row's own included. Empty and
    null texts have fingerprint 0 and are linked like any other. Equal ids count
    as one node of the graph. Rows with a null id get the component of their
    fingerprint's other rows (null if it has none) and link nothing. Only the
    id and text columns are used. An empty table gives an empty result.
    """
    docs = checkpoint(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))))
    nodes = checkpoint(docs.groupBy("fp").agg(F.min("id").alias("rep")))
    links = linked_fingerprints(nodes.filter("rep IS NOT NULL").select("fp"), cap)
    named = links.join(nodes.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    roots = components(named.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    of = nodes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return lookup(docs, "fp", of, "id").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without the rows of each component but the one with the smallest id.

    Rows with a null id stay. Rows that repeat an id stay or go together.
    """
    gone = near_groups(df, id_col, text_col, **options).filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return df.join(gone, id_col, "left_anti").select(*df.columns)


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Each document's fingerprint in hex and the smallest doc_id of its component; a text without words has fingerprint zero."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
