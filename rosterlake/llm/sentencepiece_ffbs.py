"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The pieces of a public model span a lattice over a text. A forward pass sums the
probabilities of all ways to reach each place; a backward pass then draws one
segmentation, piece by piece, in proportion to its probability. The draws depend
on the row's key, the seed and the place in the text alone, so a segmentation
is the same wherever and whenever the row is encoded.

No piece runs from other text into a space, so the lattice falls apart at the
beginnings of runs of spaces. Units that are still long fall apart again wherever
no piece crosses, as in scripts without spaces. The forward pass is made once for
each distinct unit of a slice of rows, the backward pass for all units at once.
A unit that stays long (a run of one character, say) is passed through from
window to window. What is drawn hangs on the unit alone, never on its neighbours.

A model of the BPE kind holds merge ranks, not probabilities; a piece of rank r
gets a probability in proportion to 1 / (r + 50) (Zipf's law). Characters
without a piece are spelt in byte pieces. As in the model's own normal form, a
space is put before the text (decoding takes it away) and nothing else changes,
so decode(encode(x)) = x for every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, mix64, slices, table, _W, _W_FAR

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_R = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)
#: Bytes: of a unit that is long, of the windows for long ones, and of distinct units that are handled at a time.
LONG, WINDOW, AT_ONCE = 128, 1 << 16, 1 << 20


def _char_starts(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


@dataclass
class Pieces:
    """A piece vocabulary; byte strings with a plain space for the marker of a space."""

    text: list[bytes]
    bytes_id: np.ndarray
    logp: np.ndarray
    levels: int
    slot_keys: np.ndarray
    slot_ids: np.ndarray

    @classmethod
    def load(cls, model: str = MODEL, alpha: float = 1.0) -> Pieces:
        """From a model file, read on the driver; alpha < 1 evens the probabilities out."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        text, bytes_id, logp = [b""] * len(sp), np.full(256, -1, np.int32), np.full(len(sp), -np.inf)
        prefixes: list[dict[bytes, int]] = []
        for i in range(len(sp)):
            piece = sp.id_to_piece(i)
            rank = -sp.get_score(i)
            logp[i] = -alpha * np.log(max(0.0, rank) + 50)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                text[i], bytes_id[value] = bytes([value]), i
                logp[i] = -alpha * np.log(1e6)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text[i] = piece.replace("▁", " ").encode()
                if b" " in text[i].lstrip(b" "):
                    continue  # would run from other text into a space; text[i] still decodes
                for n in range(1, len(text[i]) + 1):
                    if len(prefixes) < n:
                        prefixes.append({})
                    prefixes[n - 1].setdefault(text[i][:n], -1)
                prefixes[len(text[i]) - 1][text[i]] = i
        # All prefixes of pieces in one open hash table; a prefix that is no piece has id -1, an empty slot -2.
        known = {cls._hash(p): i for level in prefixes for p, i in level.items()}
        size = 1 << max(10, (8 * len(known)).bit_length())
        slot_keys, slot_ids = np.zeros(size, np.uint64), np.full(size, -2, np.int32)
        for h, i in known.items():
            at = (h ^ h >> 32) & size - 1
            while slot_ids[at] != -2:
                at = at + 1 & size - 1
            slot_keys[at], slot_ids[at] = h, i
        return cls(text, bytes_id, logp, len(prefixes), slot_keys, slot_ids)

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """The id of each hash, -1 for a mere prefix, -2 for what is neither."""
        last = len(self.slot_keys) - 1
        at = ((h ^ h >> np.uint64(32)) & np.uint64(last)).astype(np.int64)
        found = self.slot_ids[at]
        other = np.flatnonzero((self.slot_keys[at] != h) & (found != -2))
        while len(other):
            at[other] = at[other] + 1 & last
            found[other] = self.slot_ids[at[other]]
            other = other[(self.slot_keys[at[other]] != h[other]) & (found[other] != -2)]
        return found

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_R) + b + 1) & ((1 << 64) - 1)
        return h

    # -- the lattice over units laid end to end

    def edges(self, data: np.ndarray, unit_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece that fits, shorter ones first, each length in the order of the text; unit_end: for each byte, where its unit ends."""
        at, h = np.arange(len(data)), np.zeros(len(data), np.uint64)
        found = []
        for n in range(1, self.levels + 1):
            inside = at + n <= unit_end[at]
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * _R + (data[at + n - 1].astype(np.uint64) + _ONE)
            piece = self._look_up(h)
            known = piece > -2
            at, h, piece = at[known], h[known], piece[known]
            own = piece >= 0
            found.append((at[own], at[own] + n, piece[own]))
        start, end, piece = (np.concatenate([f[i] for f in found]) for i in range(3)) if found else (np.zeros(0, np.int64),) * 3
        # Characters without a piece of their own are spelt in bytes.
        first = _char_starts(data)
        if len(data):
            first[0] = True
        of = np.cumsum(first) - 1
        begin = np.flatnonzero(first)
        stop = np.append(begin[1:], len(data))
        covered = np.zeros(len(begin), bool)
        c = of[start] if len(start) else start
        covered[c[(begin[c] == start) & (stop[c] == end)]] = True
        spelt = np.flatnonzero(~covered[of]) if len(data) else np.zeros(0, np.int64)
        return np.concatenate([spelt, start]), np.concatenate([spelt + 1, end]), np.concatenate([self.bytes_id[data[spelt]].astype(np.int64), piece])

    def sample(self, data: np.ndarray, starts: np.ndarray, unit: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segmentations of occurrences of units of at most LONG bytes.

        data, starts: the distinct units laid end to end. unit, key, place: for
        each occurrence its unit, its row's key and its place in the row.
        Returns (pieces of all occurrences in order, pieces per occurrence).
        """
        ends = np.append(starts[1:], len(data))
        of_byte = np.repeat(np.arange(len(starts)), ends - starts)
        start, end, piece = self.edges(data, ends[of_byte])
        base = starts[of_byte[end - 1]]
        depth = end - base
        # By depth, end and length: runs in the order of end are merged, then a depth (at most LONG) is a small number.
        order = np.argsort(end, kind="stable")
        order = order[np.argsort(depth[order].astype(np.uint8), kind="stable")]
        start, end, piece, base, depth = start[order], end[order], piece[order], base[order], depth[order]
        weight = self.logp[piece]
        group = np.concatenate([[True], end[1:] != end[:-1]])
        begins = np.flatnonzero(group)
        of_group = np.cumsum(group) - 1
        # Forward: the log-sum over all ways to each place, one depth after the other.
        forward = np.zeros(len(data) + 1)
        ways = np.empty(len(end))
        group_depth = depth[begins]
        cut = np.searchsorted(group_depth, np.arange(1, group_depth[-1] + 2))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if lo == hi:
                continue
            a, b = begins[lo], begins[hi] if hi < len(begins) else len(end)
            ways[a:b] = weight[a:b] + np.where(start[a:b] == base[a:b], 0.0, forward[start[a:b]])
            forward[end[begins[lo:hi]]] = np.logaddexp.reduceat(ways[a:b], begins[lo:hi] - a)
        # The shares of what ends at a place are summed within the place: no other unit's rounding comes in.
        up_to = np.exp(ways - forward[end])
        rank = (np.arange(len(end)) - begins[of_group]).astype(np.uint8)
        for r in range(1, int(rank.max()) + 1):
            later = np.flatnonzero(rank == r)
            up_to[later] += up_to[later - 1]
        last = np.append(begins[1:], len(end)) - 1
        group_at = np.full(len(data) + 1, -1)
        group_at[end[begins]] = np.arange(len(begins))
        # Backward: draw the last piece of each occurrence, then the one before it.
        at = ends[unit].copy()
        who = np.arange(len(unit))
        steps = []
        while len(who):
            g = group_at[at[who]]
            u = self._uniform(key[who], place[who] + at[who] - starts[unit[who]])
            e, stop = begins[g], last[g]
            more = np.flatnonzero((e < stop) & (up_to[e] <= u))
            while len(more):  # a place has few pieces that end there
                e[more] += 1
                more = more[(e[more] < stop[more]) & (up_to[e[more]] <= u[more])]
            steps.append((who, piece[e].astype(np.int32)))
            at[who] = start[e]
            who = who[start[e] > starts[unit[who]]]
        count = np.zeros(len(unit), np.int64)
        for i, (who, _) in enumerate(steps):
            count[who] = i + 1
        out = np.empty(count.sum(), np.int32)
        end_of = np.cumsum(count)
        for i, (who, p) in enumerate(steps):
            out[end_of[who] - 1 - i] = p
        return out, count

    # -- long units

    def cuts(self, data: np.ndarray, unit_end: np.ndarray) -> np.ndarray:
        """The places in units laid end to end that no piece crosses."""
        out, margin = [], self.levels + 4
        for lo in range(0, len(data), AT_ONCE):
            hi = min(len(data), lo + AT_ONCE)
            a, b = max(0, lo - margin), min(len(data), hi + margin)
            start, end, _ = self.edges(data[a:b], np.minimum(unit_end[a:b], b) - a)
            crossing = np.cumsum(np.bincount(start + 1, minlength=b - a + 2) - np.bincount(end, minlength=b - a + 2))
            out.append(np.flatnonzero(crossing[lo - a : hi - a] == 0) + lo)
        return np.concatenate(out)

    def _window(self, data: np.ndarray, lo: int, hi: int) -> tuple[list, list, list, list]:
        """(start, end, piece, log-probability) of the pieces of a unit that end in (lo, hi], by end and length."""
        margin = self.levels + 4
        a, b = max(0, lo - margin), min(len(data), hi + margin)
        start, end, piece = self.edges(data[a:b], np.full(b - a, b - a))
        start, end = start + a, end + a
        own = np.flatnonzero((end > lo) & (end <= hi))
        own = own[np.argsort(end[own] << 6 | end[own] - start[own])]
        return start[own].tolist(), end[own].tolist(), piece[own].tolist(), self.logp[piece[own]].tolist()

    def forward(self, data: np.ndarray) -> list[float]:
        """For each place of a long unit the log-sum over all ways to it."""
        sums = [0.0] * (len(data) + 1)
        for lo in range(0, len(data), WINDOW):
            start, end, _, weight = self._window(data, lo, min(len(data), lo + WINDOW))
            for at, own in groupby(range(len(end)), end.__getitem__):
                ways = [weight[i] + sums[start[i]] for i in own]
                top = max(ways)
                sums[at] = top if len(ways) == 1 else top + log(sum(exp(w - top) for w in ways))
        return sums

    def backward(self, data: np.ndarray, sums: list[float], key: np.uint64, place: int) -> list[int]:
        """A long unit's pieces, drawn from its end on."""
        at, out = len(data), []
        for lo in range((len(data) - 1) // WINDOW * WINDOW, -1, -WINDOW):
            hi = min(len(data), lo + WINDOW)
            start, end, piece, weight = self._window(data, lo, hi)
            where = dict(zip(reversed(end), range(len(end) - 1, -1, -1), strict=True))  # the first piece that ends at a place
            draws = self._uniform(np.full(hi - lo, key), place + np.arange(lo + 1, hi + 1)).tolist()
            while at > lo:
                i, up_to, u = where[at], 0.0, draws[at - lo - 1]
                while True:
                    up_to += exp(weight[i] + sums[start[i]] - sums[at])
                    if u < up_to or i + 1 == len(end) or end[i + 1] != at:
                        break
                    i += 1
                out.append(piece[i])
                at = start[i]
        return out[::-1]

    @staticmethod
    def _uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A number from 0 to 1 for each key and place."""
        return (mix64(key + place.astype(np.uint64) * _R) >> np.uint64(11)).astype(np.float64) * 2.0**-53

    # -- rows

    def encode(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all texts in order, pieces per text); null texts have none. keys: a 64-bit key for each."""
        rows = [b"" if x is None else b" " + x.encode("utf-8", "surrogatepass") for x in texts]
        sizes = np.array([len(r) for r in rows], np.int64)
        data = np.frombuffer(b"".join(rows), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        row_start = np.cumsum(sizes) - sizes
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[row_start[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        lengths = np.append(starts[1:], len(data)) - starts
        if (lengths > LONG).any():
            at, n = starts[lengths > LONG], lengths[lengths > LONG]
            take = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
            begins[take[self.cuts(data[take], np.repeat(np.cumsum(n), n))]] = True
            starts = np.flatnonzero(begins)
            lengths = np.append(starts[1:], len(data)) - starts
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        value = (data.astype(np.uint64) + _ONE) * _W[place & 1023]
        if place.max() > 1023:
            value *= _W_FAR[(place >> 10) & 1023]
        hashes = mix64(np.add.reduceat(value, starts) + lengths.astype(np.uint64) * _R)
        del place, value
        _, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
        row = np.searchsorted(row_start + sizes, starts, "right")
        key, place = keys.astype(np.uint64)[row], starts - row_start[row]

        # Distinct units in groups of about AT_ONCE bytes; long ones by themselves.
        unit_len, unit_at = lengths[first], starts[first]
        short = np.flatnonzero(unit_len <= LONG)
        group = np.full(len(first), -1)
        group[short] = np.cumsum(unit_len[short]) // AT_ONCE
        count = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # occurrences and their pieces end to end
        for g in range(int(group.max()) + 1):
            own = np.flatnonzero(group == g)
            among = np.flatnonzero(group[unit] == g)
            n = unit_len[own]
            at = np.cumsum(n) - n
            take = np.repeat(unit_at[own] - at, n) + np.arange(n.sum())
            new = np.zeros(len(first), np.int64)
            new[own] = np.arange(len(own))
            pieces, count[among] = self.sample(data[take], at, new[unit[among]], key[among], place[among])
            found.append((among, pieces))
        for u in np.flatnonzero(group < 0):
            own = data[unit_at[u] : unit_at[u] + unit_len[u]]
            sums = self.forward(own)
            for i in np.flatnonzero(unit == u):
                pieces = np.array(self.backward(own, sums, key[i], int(place[i])), np.int32)
                count[i] = len(pieces)
                found.append((np.array([i]), pieces))
        if len(found) == 1:
            out = found[0][1]
        else:
            begin, out = np.cumsum(count) - count, np.empty(count.sum(), np.int32)
            for among, pieces in found:
                n = count[among]
                out[np.repeat(begin[among] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = pieces
        return out, np.bincount(row, count, len(texts)).astype(np.int64)

    def decode(self, pieces: np.ndarray, count: np.ndarray) -> list[str]:
        """The texts of pieces laid end to end, count of them each."""
        sizes = np.array([len(t) for t in self.text], np.int64)
        heap = np.frombuffer(b"".join(self.text), np.uint8)
        heap_start = np.cumsum(sizes) - sizes
        n = sizes[pieces]
        begin = np.cumsum(n) - n
        data = heap[np.repeat(heap_start[pieces] - begin, n) + np.arange(n.sum())].tobytes()
        ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(count))]
        return [data[a + 1 : b].decode("utf-8", "surrogatepass") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, model: str = MODEL, alpha: float = 1.0, out: str = "piece_ids", slice_chars: int = 1 << 18) -> DataFrame:
    """df with an array<int> column out: a sampled segmentation of each whole text.

    The draws are keyed by (seed, id), whatever the id's type; rows that repeat
    an id and text get the same pieces. A null text gives a null array, an
    empty one the piece of the leading space. A column named out is replaced,
    all others stay.
    """
    df = df.drop(*[c for c in df.columns if c.lower() == out.lower()])
    shared = df.sparkSession.sparkContext.broadcast(Pieces.load(model, alpha))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    n, at = len(df.columns), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keys = mix64(batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64))
            for lo, hi in slices([len(x or "") for x in texts], slice_chars):
                pieces, count = shared.value.encode(texts[lo:hi], keys[lo:hi])
                null = pa.array([x is None for x in texts[lo:hi]])
                offsets = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(pieces), mask=null)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:n]), lists], names=schema.names)

    return df.select("*", F.xxhash64(F.col(id_col), F.lit(seed))).transform(mapped, run, schema)


def decode(df: DataFrame, pieces_col: str = "piece_ids", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """df with a string column out: the text that the pieces spell, null for a null array."""
    df = df.drop(*[c for c in df.columns if c.lower() == out.lower()])
    shared = df.sparkSession.sparkContext.broadcast(Pieces.load(model))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    at = df.columns.index(pieces_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists = part.column(at)
                count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = shared.value.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), count)
                texts = [t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.transform(mapped, run, schema)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Each document's sampled pieces, and whether decoding them gives the text back."""
    coded = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))
