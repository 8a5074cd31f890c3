"""Edit-aware token counts.

A document's text is cut into segments at places where no pre-token can cross:
before a single space that follows one visible character and precedes another.
Segments therefore have token counts of their own, and these add up to the count
of the text. A segment tree over them keeps, for each node, the characters and
the tokens below it.

An edit descends the tree to the segments that it touches. These, and a
neighbour whose cut hangs on a changed character, are cut and encoded again;
the sums on their paths are updated. Everything else is left as it is.

The state is a table (id, text, chars, tokens, parts): the two arrays hold the
tree level by level, leaves last, and parts the sizes and counts of the segments
within each leaf, so that a tree keeps its shape when a leaf grows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, mapped, slices, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern takes it, in a run that is too long for it.
_BLANK = re.compile(r"[^\S\x1c-\x1f]{10000,}")
#: A place where a segment may begin: a space between two characters that are not white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a segment before the next cut is taken.
SEGMENT = 512
#: Segments in a leaf before the tree gets a leaf for each of them.
LEAF = 64
#: How far from a cut a changed character can matter.
CONTEXT = 2


class Encoder:
    """Token counts of strings; made from the vocabulary file where it is first used."""

    def __init__(self, path: str = RANKS, raw: bytes | None = None) -> None:
        import tiktoken

        with_lines = raw if raw is not None else open(path, "rb").read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, with_lines.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})  # a text is one pre-token

    def count(self, text: str) -> int:
        """Tokens of a text.

        The pattern steps back through a run of white space, which a long run
        makes too deep. Such a run is a pre-token of its own but for its last
        character, which goes on with what follows; so it is encoded by itself,
        without the pattern.
        """
        total = at = 0
        for run in _BLANK.finditer(text):
            a, b = run.span()
            b -= b < len(text)
            total += len(self.encoding.encode_ordinary(text[at:a])) + len(self.whole.encode_ordinary(text[a:b]))
            at = b
        return total + len(self.encoding.encode_ordinary(text[at:] if at else text))


def cuts(text: str, size: int = SEGMENT) -> list[int]:
    """Where the segments of a text end: at the first cut after each size characters, and at its end."""
    out, at, n = [], 0, len(text)
    while n - at > size:
        m = _CUT.search(text, max(at + 1, at + size - 1))
        if m is None:
            break
        at = m.start()
        out.append(at)
    if at < n:
        out.append(n)
    return out


@dataclass
class Tree:
    """chars and tokens: heap order, the root at 1, leaf i at width + i. parts: (characters, tokens) of each leaf's segments."""

    text: str
    width: int
    chars: np.ndarray
    tokens: np.ndarray
    parts: list[list[tuple[int, int]]]
    encoded: int = 0

    @classmethod
    def build(cls, text: str, encoder: Encoder) -> Tree:
        ends = cuts(text)
        parts = [[(b - a, encoder.count(text[a:b]))] for a, b in zip([0, *ends], ends, strict=False)]
        return cls.of(text, parts or [[]])

    @classmethod
    def of(cls, text: str, parts: list[list[tuple[int, int]]]) -> Tree:
        width = 1 << max(0, len(parts) - 1).bit_length()
        parts = parts + [[] for _ in range(width - len(parts))]
        sums = np.zeros((2, 2 * width), np.int64)
        sums[:, width : width + len(parts)] = np.array([[sum(x[i] for x in p) for p in parts] for i in range(2)], np.int64)
        level = width
        while level > 1:
            half = level // 2
            sums[:, half:level] = sums[:, level : 2 * level : 2] + sums[:, level + 1 : 2 * level : 2]
            level = half
        return cls(text, width, sums[0], sums[1], parts)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds the character at place; the last one with text for the end."""
        node, start = 1, 0
        place = min(place, max(0, len(self.text) - 1))
        while node < self.width:
            left = int(self.chars[2 * node])
            if place < start + left:
                node = 2 * node
            else:
                node, start = 2 * node + 1, start + left
        return node - self.width, start

    def _spans(self, leaf: int, start: int) -> Iterator[tuple[int, int, int]]:
        for i, (n, _) in enumerate(self.parts[leaf]):
            yield i, start, start + n
            start += n

    def edit(self, start: int, end: int, new: str, encoder: Encoder) -> None:
        """Replaces text[start:end] by new (start and end are clipped to the text)."""
        size = len(self.text)
        start = min(max(0, start), size)
        end = min(max(start, end), size)
        first, first_at = self.leaf_at(max(0, start - CONTEXT))
        last, last_at = self.leaf_at(min(end + CONTEXT, size))
        # The first and the last segment to be encoded again, within their leaves.
        head = next((i for i, a, b in self._spans(first, first_at) if b > start - CONTEXT), 0)
        tail = next((i for i, a, b in self._spans(last, last_at) if b > end + CONTEXT), len(self.parts[last]) - 1)
        lo = first_at + sum(n for n, _ in self.parts[first][:head])
        hi = last_at + sum(n for n, _ in self.parts[last][: tail + 1])
        region = self.text[lo:start] + new + self.text[end:hi]
        self.text = self.text[:start] + new + self.text[end:]
        self.encoded += len(region)
        ends = cuts(region)
        found = [(b - a, encoder.count(region[a:b])) for a, b in zip([0, *ends], ends, strict=False)]
        after = self.parts[last][tail + 1 :]
        self.parts[first] = self.parts[first][:head] + found + (after if last == first else [])
        if last != first:
            self.parts[last] = after
        for leaf in range(first + 1, last):
            self.parts[leaf] = []
        if len(self.parts[first]) > LEAF:
            wider = Tree.of(self.text, [[x] for p in self.parts for x in p])
            self.width, self.chars, self.tokens, self.parts = wider.width, wider.chars, wider.tokens, wider.parts
        else:
            self._update(first, last)

    def _update(self, first: int, last: int) -> None:
        lo, hi = self.width + first, self.width + last
        for leaf in range(first, last + 1):
            self.chars[self.width + leaf] = sum(n for n, _ in self.parts[leaf])
            self.tokens[self.width + leaf] = sum(k for _, k in self.parts[leaf])
        while lo > 1:
            lo, hi = lo // 2, hi // 2
            for sums in (self.chars, self.tokens):
                sums[lo : hi + 1] = sums[2 * lo : 2 * hi + 2 : 2] + sums[2 * lo + 1 : 2 * hi + 2 : 2]


# ------------------------------------------------------------------- rows

_PARTS = T.ArrayType(T.ArrayType(T.LongType()))
_STATE = [T.StructField("chars", T.ArrayType(T.LongType())), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("parts", _PARTS), T.StructField("n_tokens", T.LongType()), T.StructField("encoded_chars", T.LongType())]
_ARROW = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.int64(), pa.int64()]


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:  # read on the driver, sent to the tasks
        return f.read()


def _columns(trees: list[Tree | None]) -> list[pa.Array]:
    rows = [None if t is None else (t.chars, t.tokens, [[x for p in leaf for x in p] for leaf in t.parts], t.total, t.encoded) for t in trees]
    return [pa.array([None if r is None else r[i] for r in rows], kind) for i, kind in enumerate(_ARROW)]


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """(id, text, chars, tokens, parts, n_tokens, encoded_chars): a tree for each row of df, whole texts.

    A null text counts as empty (no tokens). Only the two columns are used.
    """
    raw = df.sparkSession.sparkContext.broadcast(_vocabulary(ranks))
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("text", T.StringType()), *_STATE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(raw=raw.value)
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for lo, hi in slices([len(x) for x in texts], 4 << 20):
                trees = [Tree.build(x, encoder) for x in texts[lo:hi]]
                for t in trees:
                    t.encoded = len(t.text)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(texts[lo:hi], pa.string()), *_columns(trees)], names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(mapped, run, schema)


def _apply(rows: DataFrame, ranks: str) -> DataFrame:
    """rows: a state with a column todo, an array of (seq, start, end, new), at its end."""
    raw = rows.sparkSession.sparkContext.broadcast(_vocabulary(ranks))
    schema = T.StructType(rows.schema.fields[:-1])
    names = schema.names
    n = 2 + len(_STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            sizes = batch.column(1).to_pylist()
            for lo, hi in slices([len(x) for x in sizes], 4 << 20):
                part = batch.slice(lo, hi - lo)
                trees = []
                columns = [part.column(names.index(c)).to_pylist() for c in ("text", "chars", "tokens", "parts", "encoded_chars")]
                for text, chars, tokens, parts, encoded, todo in zip(*columns, part.columns[-1].to_pylist(), strict=True):
                    tree = Tree(text, len(chars) // 2, np.array(chars, np.int64), np.array(tokens, np.int64), [list(zip(p[::2], p[1::2], strict=True)) for p in parts], encoded)
                    for e in sorted(todo or [], key=lambda e: e["seq"]):
                        encoder = encoder or Encoder(raw=raw.value)
                        tree.edit(e["start"], e["end"], e["new"] or "", encoder)
                    trees.append(tree)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.text for t in trees], pa.string()), *_columns(trees), *part.columns[n:-1]], names=names)

    return rows.transform(mapped, run, schema)


def apply_edits(state: DataFrame, edits: DataFrame, ranks: str = RANKS, per_round: int = 1000) -> DataFrame:
    """The state after edits (id, seq, start, end, new), applied to each document in the order of seq.

    Places are code points of the text as the edits before have left it; they are
    clipped to it. seq may be any number, such as a time; edits of one id with
    equal seq are applied in the order of start, end and new. At most per_round
    edits of a document meet in one row; more take further rounds, each cut by a
    checkpoint. A null new text counts as empty. Edits of unknown or null ids do
    nothing; documents without edits stay as they are. encoded_chars counts what
    these edits made encode again. Rows that repeat an id all get its edits.
    """
    order = Window.partitionBy("id").orderBy("seq", "start", "end", "new")  # sorted, not held; it spills
    placed = checkpoint(edits.filter(F.col("id").isNotNull()).select("id", (F.row_number().over(order) - 1).alias("seq"), "start", "end", "new"))
    last = placed.agg(F.max("seq")).first()[0]
    state = state.withColumn("encoded_chars", F.lit(0).cast("long"))
    names = state.columns
    for lo in range(0, 0 if last is None else last + 1, per_round):
        if lo:
            state = checkpoint(state)
        part = placed.filter((F.col("seq") >= lo) & (F.col("seq") < lo + per_round))
        todo = part.groupBy("id").agg(F.collect_list(F.struct("seq", "start", "end", "new")).alias("todo"))
        state = _apply(state.join(todo, "id", "left").select(*names, "todo"), ranks)
    return state


def sample_edits(key: Column, chars: Column) -> Column:
    """A deletion, an insertion and a replacement at places that a hash of the key decides: array of (seq, start, end, new).

    The edits of a production run come from its change log; these stand in for
    one where there is none.
    """
    each = []
    for seq, (length, new) in enumerate(((25, ""), (0, " revised 2 times"), (12, "an edited passage,\n"))):
        start = F.pmod(F.xxhash64(key, F.lit(seq)), chars.cast("long") + 1)
        each.append(F.struct(F.lit(seq).alias("seq"), start.alias("start"), (start + length).alias("end"), F.lit(new).alias("new")))
    return F.array(*each)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Each document's tokens before and after three edits, and the characters that these made it encode again."""
    before = build(table(spark, sf_dir, "documents"))
    rows = before.withColumn("encoded_chars", F.lit(0).cast("long")).withColumn("n_before", F.col("n_tokens"))
    # These edits hang on the row alone, so they are put beside it and nothing is shuffled.
    after = _apply(rows.withColumn("todo", sample_edits(F.col("id"), F.char_length("text"))), RANKS)
    return after.select(F.col("id").alias("doc_id"), F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.col("encoded_chars").alias("n_reencoded_chars"), F.char_length("text").cast("long").alias("n_chars_edited"))
