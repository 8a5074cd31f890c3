"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors have a cosine of c or more if they lie at most eps = sqrt(2 - 2c)
apart. Equal vectors are made one first. The others are laid on a grid over
their leading principal dimensions and sorted by their cells, which gives a
sequence whose intervals are boxes in these dimensions. Two intervals whose
boxes are over eps apart hold no link at all, for a projection never lengthens
a distance. So the join starts from the whole sequence beside itself and goes on
with the parts of each pair of intervals that is not provably distant: first as
joins of DataFrames, down to blocks of a bounded size, then within a task, down
to leaves of some dozen vectors, whose cosines are computed.

The principal dimensions only decide what can be skipped; they are fitted on a
bounded sample (SAMPLE_BYTES). Every vector is joined, and every link is decided
by the cosine in double precision.

A block gives the number of links of each of its vectors and one link for each
to the first of its connected class; a pair of blocks gives such numbers and one
link for each class that meets one of the other block. These connect exactly
what all links connect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, mapped, table, temp_name
from .simhash import components, lookup

#: Leading principal dimensions of the grid, and cells of it in one eps.
DIMENSIONS, CELLS = 8, 4
#: Bytes of the sample that the principal dimensions are fitted on, and its vectors.
SAMPLE_BYTES, SAMPLE_ROWS = 16 << 20, 4096
#: Bytes of the vectors of a block; vectors of a leaf; parts of an interval.
BLOCK_BYTES, LEAF, FAN = 4 << 20, 64, 8
#: What rounding may add to a distance of unit vectors in their projection.
SLACK = 1e-6
#: Products computed at once.
_AT_ONCE = 1 << 20


# ------------------------------------------------------------------ in numpy


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; rows are neither zero nor non-finite."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    """From sums without rounding."""
    x, y = x.astype(np.float64).tolist(), y.astype(np.float64).tolist()
    dot = lambda a, b: math.fsum(p * q for p, q in zip(a, b, strict=True))
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def principal(sample: list[np.ndarray], dimensions: int) -> np.ndarray:
    """Orthonormal columns: the directions in which the sample's unit vectors differ most; shorter vectors end in zeros."""
    width = max(map(len, sample), default=1)
    rows = np.zeros((len(sample), width))
    for i, v in enumerate(sample):
        rows[i, : len(v)] = unit(v[None])[0]
    rows -= rows.mean(0) if len(rows) else 0
    _, _, directions = np.linalg.svd(rows, full_matrices=False)
    return directions[:dimensions].T


def coordinates(units: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Places on the basis of unit vectors, which may be longer or shorter than its columns."""
    n = min(units.shape[1], len(basis))
    return units[:, :n] @ basis[:n]


def _boxes(at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.minimum.reduceat(at, starts, axis=0), np.maximum.reduceat(at, starts, axis=0)


class Interval:
    """A sorted run of vectors with the boxes of its parts; levels from the root down to the leaves."""

    def __init__(self, vectors: np.ndarray, basis: np.ndarray) -> None:
        self.vectors, self.units = vectors, unit(vectors)
        self.small = self.units.astype(np.float32)
        at, n = coordinates(self.units, basis), len(vectors)
        self.cuts = np.append(np.arange(0, n, LEAF), n)
        low, high = _boxes(at, np.diff(self.cuts))
        self.levels = [(low, high)]
        while len(low) > 1:
            starts = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)
            self.levels.insert(0, (low, high))

    def beside(self, other: Interval, eps: float) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, leaves of other) that are not provably distant, from the roots down."""
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        depth = max(len(self.levels), len(other.levels))
        mine, its = ([x.levels[0]] * (depth - len(x.levels)) + x.levels for x in (self, other))
        for step in range(depth):
            if step:  # the parts of both; the shallower one waits at its root
                for i, (x, levels) in enumerate(((self, mine), (other, its))):
                    if step > depth - len(x.levels):
                        n = len(levels[step][0])
                        one = ((a, b)[i][:, None] * FAN + np.arange(FAN)).ravel()
                        rest = np.repeat((b, a)[i], FAN)[one < n]
                        a, b = (one[one < n], rest) if i == 0 else (rest, one[one < n])
            if self is other:
                a, b = a[a <= b], b[a <= b]
            (low, high), (low2, high2) = mine[step], its[step]
            near = np.zeros(len(a), bool)
            for lo in range(0, len(a), _AT_ONCE // 8):
                s = slice(lo, lo + _AT_ONCE // 8)
                gap = np.maximum(np.maximum(low[a[s]] - high2[b[s]], low2[b[s]] - high[a[s]]), 0)
                near[s] = (gap * gap).sum(1) <= (eps + SLACK) ** 2
            a, b = a[near], b[near]
            if not len(a):
                return
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        for lo, hi in zip(starts, np.append(starts[1:], len(a)), strict=True):
            yield int(a[lo]), b[lo:hi]

    def links(self, other: Interval, least: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places with a cosine of least or more, in bounded steps; of an interval beside itself each pair once."""
        margin = (self.units.shape[1] + 8) * 2.0**-23  # of products in single precision
        most = max(1, _AT_ONCE // (LEAF * LEAF))
        for leaf, leaves in self.beside(other, eps):
            x = slice(self.cuts[leaf], self.cuts[leaf + 1])
            for lo in range(0, len(leaves), most):
                cols = np.concatenate([np.arange(other.cuts[i], other.cuts[i + 1]) for i in leaves[lo : lo + most]])
                i, j = np.nonzero(self.small[x] @ other.small[cols].T >= np.float32(least - margin))
                i, j = i + x.start, cols[j]
                if self is other:
                    i, j = i[i < j], j[i < j]
                for at in range(0, len(i), 1 << 14):
                    a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                    cosine = np.einsum("ij,ij->i", self.units[a], other.units[b])
                    sure = cosine >= least + 1e-12
                    for k in np.flatnonzero(~sure & (cosine >= least - 1e-12)).tolist():
                        sure[k] = exact_cosine(self.vectors[a[k]], other.vectors[b[k]]) >= least
                    yield a[sure], b[sure]


def _join(a: Interval, b: Interval, copies_a: np.ndarray, copies_b: np.ndarray, label: np.ndarray, least: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of a's vectors, links of b's). label holds the first place of each vector's class, of a followed by b if these are two, and is brought up to date."""
    n = len(copies_a)
    found = np.zeros(n, np.int64), np.zeros(len(copies_b), np.int64)
    shift = 0 if a is b else n
    for i, j in a.links(b, least, eps):
        np.add.at(found[0], i, copies_b[j])
        np.add.at(found[0] if a is b else found[1], j, copies_a[i])
        j = j + shift
        while True:
            li, lj = label[i], label[j]
            apart = li != lj
            if not apart.any():
                break
            i, j, li, lj = i[apart], j[apart], li[apart], lj[apart]
            np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
            while (jump := label[label] != label).any():
                label[jump] = label[label[jump]]
    return found


def _by_length(vecs: bytes, sizes: bytes, basis: np.ndarray, kind: type) -> dict[int, tuple[Interval, slice]]:
    """The vectors of each length and their places in the block; the sequence is sorted by length first, so each is a run of it."""
    values, each = np.frombuffer(vecs, kind), np.frombuffer(sizes, np.int32).astype(np.int64)
    starts, out = np.cumsum(each) - each, {}
    for size in np.unique(each).tolist():
        of = np.flatnonzero(each == size)
        out[size] = Interval(values[starts[of[0]] : starts[of[-1]] + size].reshape(-1, size), basis), slice(int(of[0]), int(of[-1]) + 1)
    return out


# ------------------------------------------------------------ on DataFrames


def _packed(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, type]:
    """(id, vec) with the vector's bytes, null where it links with nothing, and the kind of number in them."""
    single = df.schema[vector_col].dataType.elementType == T.FloatType()
    kind = np.float32 if single else np.float64
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("vec", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                v = x.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0) if x.is_valid and len(x.values) and not x.values.null_count else None  # adding 0 makes one zero of two
                out.append(v.tobytes() if v is not None and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    vector = F.col(vector_col).cast(T.ArrayType(T.FloatType() if single else T.DoubleType()))
    return df.select(F.col(id_col).alias("id"), vector.alias("vec")).transform(mapped, run, schema), kind


def _placed(nodes: DataFrame, basis: np.ndarray, kind: type, eps: float) -> DataFrame:
    """nodes (key, vec, copies) with their cell, as bytes that sort like the grid's order."""
    schema = T.StructType([*nodes.schema.fields, T.StructField("cell", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for x in batch.column(1):
                v = np.frombuffer(x.as_py(), kind)
                cell = np.floor(coordinates(unit(v[None]), basis)[0] * (CELLS / eps)).astype(np.int64) + (1 << 15)
                cells.append(len(v).to_bytes(4, "big") + np.clip(cell, 0, (1 << 16) - 1).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], names=schema.names)

    return nodes.transform(mapped, run, schema)


def sequence(rows: DataFrame, order: list[str], tasks: int) -> DataFrame:
    """rows with a column place, 0, 1, ... in the order of the columns (which tell all rows apart), numbered by many tasks."""
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    part, number = temp_name(rows, "part"), temp_name(rows, "number")
    fixed = checkpoint(dealt.withColumn(part, F.spark_partition_id()).withColumn(number, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = fixed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # a row for each task
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return fixed.join(sizes.select(part, before.alias("before")), part).withColumn("place", F.col("before") + F.col(number)).drop(part, number, "before")


def _blocks(placed: DataFrame, basis: np.ndarray, kind: type, rows: int, least: float, eps: float) -> DataFrame:
    """A row for each block of `rows` neighbours in the sequence, joined with itself.

    block, its box low, high, its vectors end to end, their lengths and copies,
    the first place of each one's class in the block, and its links there.
    """
    schema = "block long, low array<double>, high array<double>, vecs binary, sizes binary, copies binary, label binary, near binary"

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")  # at most `rows` rows
        vecs = [np.frombuffer(v.as_py(), kind) for v in group.column("vec")]
        at = np.stack([_place(v, basis) for v in vecs])
        body, sizes = b"".join(v.tobytes() for v in vecs), np.array([len(v) for v in vecs], np.int32).tobytes()
        copies = group.column("copies").to_numpy().astype(np.int64)
        label, near = np.arange(len(vecs)), np.zeros(len(vecs), np.int64)
        for own, of in _by_length(body, sizes, basis, kind).values():
            part = np.arange(len(own.units))
            near[of], _ = _join(own, own, copies[of], copies[of], part, least, eps)
            label[of] = part + of.start
        columns = [[group.column("block")[0].as_py()], [at.min(0)], [at.max(0)], [body], [sizes], *([x.tobytes()] for x in (copies, label, near))]
        return pa.table(dict(zip(["block", "low", "high", "vecs", "sizes", "copies", "label", "near"], columns, strict=True)))

    return placed.select(F.expr(f"place div {rows}").alias("block"), "place", "vec", "copies").groupBy("block").applyInArrow(pack, schema)


def _place(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The number of components, which keeps vectors of different lengths apart, and the place on the basis."""
    return np.concatenate([[len(v)], coordinates(unit(v[None]), basis)[0]])


def _near(low: str, high: str, low2: str, high2: str, eps: float) -> Column:
    """Whether two boxes are at most eps apart."""
    gaps = F.zip_with(F.zip_with(low, high2, lambda a, b: a - b), F.zip_with(low2, high, lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= (eps + SLACK) ** 2


def block_pairs(blocks: DataFrame, n: int, eps: float, width: int) -> DataFrame:
    """(a, b), a <= b: blocks that are not provably distant, out of n, by parting pairs of intervals again and again.

    An interval of a level holds FAN of the level below; its box has `width` sides.
    """
    low, high = (lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(width)]).alias(c)), ("low", "high")
    levels = [blocks.select("block", *high)]
    while n > 1:
        n = -(-n // FAN)
        up = levels[-1].groupBy(F.expr(f"block div {FAN}").alias("block")).agg(low(F.min, "low"), low(F.max, "high"))
        levels.append(checkpoint(up))
    pairs = None
    for level in reversed(levels):
        side = lambda x, level=level: level.select(F.col("block").alias(x), F.expr(f"block div {FAN}").alias(f"{x}_up"), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}"))
        if pairs is None:  # the whole sequence, beside itself
            pairs = level.select(F.col("block").alias("a"), F.col("block").alias("b"))
            continue
        both = pairs.withColumnsRenamed({"a": "a_up", "b": "b_up"}).join(side("a"), "a_up").join(side("b"), "b_up")
        pairs = checkpoint(both.filter((F.col("a") <= F.col("b")) & _near("low_a", "high_a", "low_b", "high_b", eps)).select("a", "b"))
    return pairs


def _within(blocks: DataFrame, rows: int) -> DataFrame:
    """(x, y, n) of what _blocks found within each block: a link of each vector to the first of its class, and its number of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, label, near in zip(*batch.columns, strict=True):
                label, near = (np.frombuffer(x.as_py(), np.int64) for x in (label, near))
                yield from _found(np.arange(len(label)) + block.as_py() * rows, np.flatnonzero(label != np.arange(len(label))), label, near)

    return blocks.select("block", "label", "near").transform(mapped, run, "x long, y long, n long")


def _found(places: np.ndarray, linked: np.ndarray, label: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
    some, names = np.flatnonzero(near), ["x", "y", "n"]
    yield pa.RecordBatch.from_arrays([pa.array(places[linked]), pa.array(places[label[linked]]), pa.nulls(len(linked), pa.int64())], names=names)
    yield pa.RecordBatch.from_arrays([pa.array(places[some]), pa.nulls(len(some), pa.int64()), pa.array(near[some])], names=names)


def _between(pairs: DataFrame, blocks: DataFrame, n: int, rows: int, basis: np.ndarray, kind: type, least: float, eps: float) -> DataFrame:
    """(x, y, n) of pairs of different blocks: links (x, y) that join classes of the two, and numbers of links n of a place x.

    Of a class within a block one link is given for all, so that a group of near
    copies that fills many blocks gives one link for each pair of these.
    """
    # One of the two blocks travels to the other; which one changes from pair to pair, and few blocks get several salts.
    ways = max(1, 256 // max(1, n))
    turned = (F.col("a") + F.col("b")) % 2 == 1
    asked = pairs.filter("a < b").select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("y"))
    body = ["vecs", "sizes", "copies", "label"]
    sent = asked.join(blocks.select(F.col("block").alias("x"), *body), "x").withColumn("salt", F.col("x") % ways)
    stays = blocks.select(F.col("block").alias("y"), *[F.col(c).alias(f"{c}_y") for c in body], F.explode(F.expr(f"sequence(0L, {ways - 1}L)")).alias("salt"))
    both = sent.join(stays, ["y", "salt"]).select("x", "y", *body, *[f"{c}_y" for c in body])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, *sides in zip(*batch.columns, strict=True):
                sides = [s.as_py() for s in sides]
                mine, its = _by_length(*sides[0:2], basis, kind), _by_length(*sides[4:6], basis, kind)
                copies, label, copies2, label2 = (np.frombuffer(s, np.int64) for s in (*sides[2:4], *sides[6:8]))
                for size in mine.keys() & its.keys():
                    (a, at), (b, at2) = mine[size], its[size]
                    was = np.concatenate([label[at] - at.start, label2[at2] - at2.start + len(a.units)])
                    now = was.copy()
                    near = np.concatenate(_join(a, b, copies[at], copies2[at2], now, least, eps))
                    places = np.concatenate([np.arange(at.start, at.stop) + x.as_py() * rows, np.arange(at2.start, at2.stop) + y.as_py() * rows])
                    heads = np.flatnonzero((was == np.arange(len(was))) & (now != was))
                    yield from _found(places, heads, now, near)

    return both.transform(mapped, run, "x long, y long, n long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, dimensions: int = DIMENSIONS, block_bytes: int = BLOCK_BYTES, block_rows: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of df (ids that sort, vectors as arrays of numbers).

    Rows link if the cosine of their vectors is `least` or more (0 < least <= 1).
    n_links is the number of other rows that a row links with, component_id the
    smallest id reachable over links, the row's own included, and kept says that
    the two ids are equal. A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing, nor do vectors of different lengths
    with each other. Rows that repeat an id are rows of their own. A row with a
    null id links with nothing and is kept, its component null. Only the id and
    vector columns are used. An empty table gives an empty result.
    """
    spark = df.sparkSession
    eps = math.sqrt(2 - 2 * least)
    packed, kind = _packed(df, id_col, vector_col)
    vec = F.when(F.col("id").isNotNull(), F.col("vec"))
    fixed = checkpoint(packed.select("id", vec.alias("vec")).withColumn("key", F.unhex(F.sha2("vec", 256))))
    rows = fixed.select("id", "key")
    nodes = checkpoint(fixed.filter("key IS NOT NULL").groupBy("key").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep")))
    n, bytes_, longest = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("vec")), F.lit(0)), F.coalesce(F.max(F.octet_length("vec")), F.lit(1))).first()
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_links", T.LongType()), T.StructField("component_id", df.schema[id_col].dataType), T.StructField("kept", T.BooleanType())])
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    sampled = nodes.orderBy("key").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // longest))).select("vec").collect()  # at most SAMPLE_BYTES; the keys are hashes
    basis = principal([np.frombuffer(r[0], kind) for r in sampled], dimensions)
    if block_rows is None:  # at least 16 blocks of a table that is not tiny, none above the bound
        block_rows = max(1, min(block_bytes * n // bytes_, max(1024, n // 16)))
    placed = sequence(_placed(nodes.select("key", "vec", "copies"), basis, kind, eps), ["cell", "key"], max(1, -(-bytes_ // (4 * block_bytes)), spark.sparkContext.defaultParallelism))
    blocks = checkpoint(_blocks(placed, basis, kind, block_rows, least, eps))
    count = -(-n // block_rows)
    pairs = block_pairs(blocks, count, eps, basis.shape[1] + 1)
    found = checkpoint(_within(blocks, block_rows).unionByName(_between(pairs, blocks, count, block_rows, basis, kind, least, eps)))
    links = found.filter("x IS NOT NULL AND y IS NOT NULL").select(F.col("x").alias("a"), F.col("y").alias("b"))
    near = found.filter("n IS NOT NULL").groupBy(F.col("x").alias("place")).agg(F.sum("n").alias("near"))
    of = placed.select("key", "place", "copies").join(near, "place", "left").join(components(links).withColumnRenamed("node", "place"), "place", "left")
    of = checkpoint(of.select("key", F.coalesce("near", F.lit(0)).alias("near"), "copies", F.coalesce("root", "place").alias("root")).join(nodes.select("key", "rep"), "key"))
    smallest = of.groupBy("root").agg(F.min("rep").alias("smallest"))
    named = lookup(of, "root", smallest, "key").select("key", (F.col("near") + F.col("copies") - 1).alias("n_links"), "smallest")
    out = lookup(rows, "key", named, "id")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))).select(*schema.names)


def keep_one(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """df without the rows of each component but those with its smallest id; rows with a null id stay."""
    gone = near_vectors(df, id_col, vector_col, **options).filter(~F.col("kept")).select(id_col).distinct()
    return df.join(gone, id_col, "left_anti").select(*df.columns)


def op11_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Each vector's number of links at a cosine of 0.95 or more, the smallest vec_id of its component, and whether it is that one."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
