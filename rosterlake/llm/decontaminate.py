"""Size-partitioned MinHash containment search: short test items inside long documents.

A document contains an item if it has at least 80 % of the item's distinct
five-word shingles (A-Z lower-cased, words parted at white space). Items are
partitioned by size (powers of two); an item of a partition whose sizes end at
u is sketched by its floor(0.2 u) + 1 smallest shingle hashes under a hash that
serves as the random order (a bottom-k MinHash). At most floor(0.2 u) of an
item's shingles can be missing from a document that contains it, so at least
one of the sketch is present: the search over sketches loses nothing. A document
with fewer shingles than 80 % of a partition's least size is not searched for
that partition's items. What is found is verified by exact shingle containment,
on the words themselves.

Documents are never shuffled: each batch is searched where it is read. Items
are a stated query set, collected in blocks of bounded size; each block is
broadcast and searched in a pass of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import ascii_words, mapped, mix64, ngram_hashes, string_parts, table, token_hashes

WIDTH, THRESHOLD = 5, 0.8
_SLACK = 1e-9


def shingles(text: str | None, width: int = WIDTH) -> set[bytes]:
    words = ascii_words(text)
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _needed(size: int, threshold: float) -> int:
    """How many of an item's shingles a document must have."""
    return math.ceil(threshold * size - _SLACK)


def sketch_size(size: int, threshold: float = THRESHOLD) -> int:
    """For an item of that many shingles: what its size partition needs, so that one of the sketch must be present."""
    top = (1 << size.bit_length()) - 1
    return min(size, math.floor((1 - threshold) * top + _SLACK) + 1)


#: (row, item) candidates that are counted at a time, and items whose shingles a worker keeps.
_AT_ONCE, _KEPT = 1 << 21, 256


@dataclass
class Partition:
    """Items of sizes from 2^p to 2^(p+1)-1: the fewest shingles a document must have, and the items' sketches."""

    least: int
    sketch: np.ndarray


@dataclass
class ItemIndex:
    """The items of a block: sketches by size for the search, (shingle hash, item) for counting, texts for verifying."""

    ids: list
    texts: list[str | None]
    sizes: np.ndarray
    need: np.ndarray
    parts: list[Partition]
    near: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    width: int
    kept: dict[int, set[bytes]] = field(default_factory=dict)

    @classmethod
    def build(cls, rows: list[tuple], width: int, threshold: float) -> ItemIndex:
        sketch: dict[int, list[np.ndarray]] = {}
        hashes, item, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], []
        for i, (_, text) in enumerate(rows):
            sizes.append(len(shingles(text, width)))
            tokens, of = token_hashes(*string_parts(pa.array([text or ""])))
            h = np.unique(ngram_hashes(tokens, of, width)[0])
            if len(h):
                own = h[np.argsort(mix64(h ^ np.uint64(0x5DEECE66D)))[: sketch_size(len(h), threshold)]]
                sketch.setdefault(len(h).bit_length() - 1, []).append(own)
                hashes.append(h)
                item.append(np.full(len(h), i, np.int32))
        parts = [Partition(_needed(1 << p, threshold), np.unique(np.concatenate(s))) for p, s in sorted(sketch.items())]
        near = np.zeros(1 << 20, bool)
        for part in parts:
            near[(part.sketch >> np.uint64(44)).astype(np.int64)] = True
        all_, of_ = np.concatenate(hashes), np.concatenate(item)
        order = np.argsort(all_, kind="stable")
        need = np.array([_needed(n, threshold) for n in sizes], np.int64)
        return cls([r[0] for r in rows], [r[1] for r in rows], np.array(sizes, np.int64), need, parts, near, all_[order], of_[order], width)

    def shingles_of(self, item: int) -> set[bytes]:
        if item not in self.kept:
            if len(self.kept) >= _KEPT:
                self.kept.clear()
            self.kept[item] = shingles(self.texts[item], self.width)
        return self.kept[item]

    def _rows_hit(self, grams: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Whether each of n rows holds a sketched shingle of an item that it is large enough for."""
        count = np.bincount(rows, minlength=n)
        taken = np.zeros(n, bool)
        maybe = np.flatnonzero(self.near[(grams >> np.uint64(44)).astype(np.int64)])
        grams, rows = grams[maybe], rows[maybe]
        for part in self.parts:
            large = count[rows] >= part.least
            g, r = grams[large], rows[large]
            at = np.minimum(np.searchsorted(part.sketch, g), len(part.sketch) - 1)
            taken[r[part.sketch[at] == g]] = True
        return taken

    def _counted(self, grams: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, item) pairs that share as many distinct shingle hashes as the item needs, in the order of rows."""
        if not len(grams):
            return
        order = np.lexsort((grams, rows))
        grams, rows = grams[order], rows[order]
        fresh = np.append(True, (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1]))
        grams, rows = grams[fresh], rows[fresh]  # a phrase that a document repeats counts once
        lo = np.searchsorted(self.hashes, grams, "left")
        n = np.searchsorted(self.hashes, grams, "right") - lo
        grams, rows, lo, n = (x[n > 0] for x in (grams, rows, lo, n))
        if not len(rows):
            return
        ends = np.append(np.flatnonzero(rows[1:] != rows[:-1]) + 1, len(rows))  # of each row
        upto = np.cumsum(n)
        begin = 0
        while begin < len(rows):
            done = upto[begin - 1] if begin else 0
            i = int(np.searchsorted(upto[ends - 1], done + _AT_ONCE, "right")) - 1
            end = int(ends[max(i, int(np.searchsorted(ends, begin, "right")))])  # a row at least; it has no more pairs than the block has shingles
            k = n[begin:end]
            where = np.repeat(lo[begin:end] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            pair, shared = np.unique(np.repeat(rows[begin:end], k) * len(self.ids) + self.item[where], return_counts=True)
            row, item = np.divmod(pair, len(self.ids))
            enough = shared >= self.need[item]
            yield row[enough], item[enough]
            begin = end

    def search(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shared shingles) for each item contained in a row's text."""
        out, last, own = [], -1, set()
        if self.parts:
            tokens, of = token_hashes(*string_parts(column))
            grams, rows = ngram_hashes(tokens, of, self.width)
            inside = self._rows_hit(grams, rows, len(column))[rows]
            for found in self._counted(grams[inside], rows[inside]):
                for row, item in zip(*(x.tolist() for x in found), strict=True):
                    if row != last:
                        last, own = row, shingles(column[row].as_py(), self.width)
                    exact = len(own & self.shingles_of(item))
                    if exact >= self.need[item]:
                        out.append((row, item, exact))
        return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def _blocks(items: DataFrame, id_col: str, text_col: str, width: int, threshold: float, block_bytes: int) -> Iterator[Broadcast]:
    """Broadcast indexes over the items, each of at most block_bytes of text (or of one longer item); one at least."""
    share = items.sparkSession.sparkContext.broadcast
    rows, size = [], 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        more = len((r["text"] or "").encode("utf-8", "surrogatepass")) + 64
        if rows and size + more > block_bytes:
            yield share(ItemIndex.build(rows, width, threshold))
            rows, size = [], 0
        rows.append((r["id"], r["text"]))
        size += more
    yield share(ItemIndex.build(rows, width, threshold))


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, block_bytes: int = 16 << 20) -> DataFrame:
    """(id, item id, n_shared, n_shingles, containment): each document that contains an item.

    Null texts count as empty. Items of fewer words than width have no shingles
    and are found nowhere; documents of fewer words contain nothing. Rows that
    repeat a document or an item give a row each. Only the id and text columns
    of either side are used; if both ids have one name, the item's gets "item_"
    before it. Empty tables give an empty result.
    """
    named = item_id if item_id.lower() != id_col.lower() else f"item_{item_id}"
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(named, items.schema[item_id].dataType), T.StructField("n_shared", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("containment", T.DoubleType())])
    ids = to_arrow_type(schema.fields[1].dataType)
    out = None
    for index in _blocks(items, item_id, item_text, width, threshold, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            block = index.value
            for batch in batches:
                row, item, shared = block.search(batch.column(1))
                if len(row):
                    sizes = block.sizes[item]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([block.ids[i] for i in item], ids), pa.array(shared), pa.array(sizes), pa.array(shared / sizes)], names=schema.names)

        part = docs.select(id_col, text_col).transform(mapped, run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, block_bytes: int = 16 << 20) -> DataFrame:
    """docs without the rows that contain an item; columns and texts as they were, no shuffle.

    Null and short texts contain nothing and stay, as do all rows where there are no items.
    """
    out, at = docs, docs.columns.index(text_col)
    for index in _blocks(items, item_id, item_text, width, threshold, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[index.value.search(batch.column(at))[0]] = False
                yield batch.filter(pa.array(keep))

        out = out.transform(mapped, run, docs.schema)
    return out


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Each document that contains a benchmark item, with the item and how much of it.

    A null text contains nothing; without documents or items there are no rows.
    """
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
b AS (SELECT item_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM d WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM p JOIN n USING (item_id) WHERE n_shared * 10 >= n_shingles * 8
"""
