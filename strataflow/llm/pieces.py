"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The words of a batch are told apart by hash; distinct words of equal byte length advance together,
place by place. At each place every possible last piece is probed by the hash of its substring in the
sorted hashes of all pieces, and the best is stored as a backpointer.

For a unigram model the best is the greatest sum of scores. A BPE model has no such sum: its encoding
is what merging pairs in order of rank gives. But that encoding is the only division of a word whose
neighbouring pieces all stay apart when merged on their own, and each prefix of a word has one last
piece that its predecessor tolerates. So for BPE the same recursion runs with a score that asks only
whether the two pieces stay apart, and its result is exactly that of merging.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import table
from strataflow.llm.textnp import U64, buffers, powers, release, sized, slices, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BAR = "▁"
#: Bytes of text that are encoded together: more share more words, and take more memory.
SLICE = 5 << 18
#: Longer words, and words of the rare kinds below, are merged one by one.
LONGEST = 64
#: Unigram models score a character that they don't have so much below their worst piece.
UNKNOWN_PENALTY = 10.0


def protobuf(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message, in order."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    kind: int
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    unknown: int
    byte_ids: np.ndarray  # of each byte, -1 without byte fallback
    hashes: np.ndarray = field(default=None)  # sorted, of pieces with spaces for bars
    hash_ids: np.ndarray = field(default=None)
    filter: np.ndarray = field(default=None)
    longest: int = 0
    lonely: np.ndarray = field(default=None)  # ASCII bytes that no longer piece has
    left: np.ndarray = field(default=None)
    right: np.ndarray = field(default=None)
    rank: np.ndarray = field(default=None)  # 0 for what isn't made by a merge
    pair_keys: np.ndarray = field(default=None)
    pair_ranks: np.ndarray = field(default=None)
    flat: np.ndarray = field(default=None)  # the bytes of all pieces as decoded
    flat_at: np.ndarray = field(default=None)

    def merges(self) -> dict[str, tuple[float, int]]:
        return {p: (-float(s), i) for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types, strict=True)) if t in (NORMAL, USER)}


def merge(text: str, known: dict[str, tuple[float, int]]) -> list[str]:
    """The pieces of one word by merging: the best-ranked pair first, the leftmost of equals."""
    parts: list[str | None] = list(text)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if i >= 0 and j < len(parts) and (found := known.get(parts[i] + parts[j])):
            heapq.heappush(heap, (found[0], i, j, parts[i] + parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, j, whole = heapq.heappop(heap)
        if parts[i] is None or after[i] != j or parts[j] is None or parts[i] + parts[j] != whole:
            continue
        parts[i], parts[j], after[i] = whole, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


def load(data: bytes) -> Model:
    """A model from its file's bytes. Models that rewrite text before encoding it are refused."""
    pieces, scores, types, kind, settings, charsmap = [], [], [], UNIGRAM, {3: 1, 4: 1, 5: 1}, b""
    for number, value in protobuf(data):
        if number == 1:
            entry = dict(protobuf(value))
            pieces.append(entry[1].decode())
            scores.append(np.frombuffer(entry.get(2, b"\0\0\0\0"), "<f4")[0])
            types.append(entry.get(3, NORMAL))
        elif number == 2:
            kind = dict(protobuf(value)).get(3, kind)
        elif number == 3:
            for n, v in protobuf(value):
                if n == 2:
                    charsmap = v
                elif n in settings:
                    settings[n] = v
    if charsmap or settings != {3: 1, 4: 0, 5: 1} or kind not in (UNIGRAM, BPE):
        raise ValueError("only models that keep text as it is, with a dummy prefix, are supported")
    types = np.array(types)
    byte_ids = np.full(256, -1)
    for i in np.flatnonzero(types == BYTE):
        byte_ids[int(pieces[i][3:5], 16)] = i
    unknown = int(np.flatnonzero(types == UNKNOWN)[0])
    m = Model(kind, pieces, np.array(scores, np.float64), types, unknown, byte_ids)
    usable = np.flatnonzero((types == NORMAL) | (types == USER))
    raw = [pieces[i].replace(BAR, " ").encode() for i in usable]
    if any(b" " in r.lstrip(b" ") for r in raw):
        raise ValueError("a piece crosses words")
    joined, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
    h = span_hashes(joined, ends - np.array([len(r) for r in raw]), ends)
    order = np.argsort(h)
    m.hashes, m.hash_ids = h[order], usable[order]
    m.filter = np.zeros(1 << 21, bool)
    m.filter[(h >> U64(43)).astype(np.int64)] = True
    m.longest = max(map(len, raw))
    m.lonely = np.zeros(256, bool)
    m.lonely[:128] = True
    for r in raw:
        if len(r) > 1:
            m.lonely[list(r)] = False
    m.lonely[32] = False
    decoded = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(BAR, " ").encode() for p, t in zip(pieces, types, strict=True)]
    m.flat = np.frombuffer(b"".join(decoded), np.uint8)
    m.flat_at = np.concatenate([[0], np.cumsum([len(d) for d in decoded])])
    if kind == BPE:
        spines(m)
    return m


def spines(m: Model) -> None:
    """How each piece is made by its last merge, and the rank of every pair that merges into a piece."""
    known = m.merges()
    n = len(m.pieces)
    m.left, m.right, m.rank = np.arange(n), np.arange(n), np.zeros(n)
    keys, ranks = [], []
    for p, (rank, i) in known.items():
        if len(p) == 1:
            continue
        m.rank[i] = rank + 1  # ranks begin above 0, which is for characters
        for cut in range(1, len(p)):
            a, b = known.get(p[:cut]), known.get(p[cut:])
            if a and b:
                keys.append(a[1] * n + b[1])
                ranks.append(rank + 1)
        parts = merge(p, {q: r for q in substrings(p) if q != p and (r := known.get(q))})
        if len(parts) == 2:
            m.left[i], m.right[i] = known[parts[0]][1], known[parts[1]][1]
        else:
            m.rank[i] = np.inf  # merging never makes it
    order = np.argsort(keys)
    m.pair_keys, m.pair_ranks = np.array(keys, np.int64)[order], np.array(ranks)[order]


def substrings(p: str) -> set[str]:
    return {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)}


def apart(m: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether neighbours a, b stay apart. Looking back in time, the later made of the two at the border
    is undone again and again; they'd have merged if, at some stage, their own merge came before the next
    merge of either. Of equal ranks the merge further left comes first."""
    ok = np.ones(len(a), bool)
    live = np.flatnonzero((a != m.unknown) & (b != m.unknown))
    x, y = a[live].copy(), b[live].copy()
    next_x, next_y = np.full(len(live), np.inf), np.full(len(live), np.inf)
    while len(live):
        key = x * len(m.pieces) + y
        at = np.minimum(np.searchsorted(m.pair_keys, key), len(m.pair_keys) - 1)
        r = np.where(m.pair_keys[at] == key, m.pair_ranks[at], np.inf)
        merged = (r < np.inf) & (r < next_x) & (r <= next_y)
        ok[live[merged]] = False
        undo_x = m.rank[x] > m.rank[y]
        undo_y = ~undo_x & (m.rank[y] > 0)
        go = ~merged & (undo_x | undo_y)
        next_x, next_y = np.where(undo_x, m.rank[x], next_x)[go], np.where(undo_y, m.rank[y], next_y)[go]
        x, y, live = np.where(undo_x, m.right[x], x)[go], np.where(undo_y, m.left[y], y)[go], live[go]
    return ok


class Encoder:
    """A model with what one worker has learned: which pairs of pieces stay apart."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.known = model.merges() if model.kind == BPE else {}
        self.keys, self.apart = np.full(1 << 21, -1), np.zeros(1 << 21, bool)

    def tolerated(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each b may follow each a. Answers are kept in a table by a hash of the pair; a pair whose
        place another one holds is worked out again."""
        key = a * len(self.m.pieces) + b
        place = ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.keys.size.bit_length() + 1)).astype(np.int64)
        out = self.apart[place]
        miss = np.flatnonzero(self.keys[place] != key)
        if len(miss):
            out[miss] = apart(self.m, a[miss], b[miss])
            self.keys[place[miss]] = key[miss]
            # Of pairs that meet in one place the one whose key stayed is the one whose answer counts.
            kept = miss[self.keys[place[miss]] == key[miss]]
            self.apart[place[kept]] = out[kept]
        return out

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words of one length, a row of bytes each: all ids, word by word, and how many of each word.
        A character without a piece is one unknown id at the place of each of its bytes' first."""
        m = self.m
        n, size = words.shape
        up, down = powers(size)
        sums = np.zeros((n, size + 1), U64)
        np.cumsum((words.astype(U64) + U64(1)) * up[:size], axis=1, out=sums[:, 1:])
        inner = (words & 0xC0) == 0x80  # bytes inside a character
        last, length = np.full((n, size + 1), -1), np.zeros((n, size + 1), np.int64)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        for end in range(1, size + 1):
            for span in range(1, min(end, m.longest) + 1):
                start = end - span
                rows = np.flatnonzero(best[:, start] > -np.inf)
                if not len(rows):
                    continue
                h = sized((sums[rows, end] - sums[rows, start]) * down[start], U64(span))
                maybe = m.filter[(h >> U64(43)).astype(np.int64)]
                rows, h = rows[maybe], h[maybe]
                at = np.minimum(np.searchsorted(m.hashes, h), len(m.hashes) - 1)
                hit = m.hashes[at] == h
                rows, ids = rows[hit], m.hash_ids[at[hit]]
                if not len(rows):
                    continue
                if m.kind == BPE:
                    score = np.zeros(len(rows))
                    before = last[rows, start]
                    old = np.flatnonzero(before >= 0)
                    score[old] = np.where(self.tolerated(before[old], ids[old]), 0.0, -np.inf)
                    score[m.rank[ids] == np.inf] = -np.inf
                else:
                    score = best[rows, start] + m.scores[ids]
                better = score > best[rows, end]
                rows = rows[better]
                best[rows, end], last[rows, end], length[rows, end] = score[better], ids[better], span
            border = np.ones(n, bool) if end == size else ~inner[:, end]
            low = m.scores[m.types == NORMAL].min() - UNKNOWN_PENALTY if m.kind != BPE else 0.0
            for span in range(1, min(end, 4) + 1):  # the character that ends here, where no piece does
                lead = border & ~inner[:, end - span] & (inner[:, end - span + 1 : end].all(axis=1) if span > 1 else True)
                rows = np.flatnonzero(lead & (best[:, end - span] > -np.inf) & ((best[:, end] == -np.inf) if m.kind == BPE else (best[:, end - span] + low > best[:, end])))
                if len(rows):
                    best[rows, end] = best[rows, end - span] + low
                    last[rows, end], length[rows, end] = m.unknown, span
        ids, count, at = np.full((n, size), -1), np.zeros(n, np.int64), np.full(n, size)
        every = np.arange(n)
        while (at > 0).any():
            go = every[at > 0]
            start = at[go] - length[go, at[go]]
            ids[go, start] = last[go, at[go]]
            count[go] += 1
            at[go] = start
        return ids, count

    def one(self, word: bytes) -> list[tuple[int, int]]:
        """(piece id, place of its first byte) of a single word, by merging."""
        out, at = [], 0
        for part in merge(word.decode("utf-8").replace(" ", BAR), self.known):
            found = self.known.get(part)
            out.append((found[1] if found else self.m.unknown, at))
            at += len(part.replace(BAR, " ").encode())
        return out

    def distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the words data[start:end], all different: the ids one word after another, and offsets."""
        m, size = self.m, ends - starts
        counts, chunks = np.zeros(len(starts), np.int64), []
        spaced = np.zeros(len(starts), bool)
        inside = size > 1
        spaced[inside] = data[starts[inside] + 1] == 32  # two spaces in front: equal ranks, merged one by one
        rare = ((size > LONGEST) | spaced) & (m.kind == BPE)
        for length in np.unique(size[~rare]):
            of = np.flatnonzero((size == length) & ~rare)
            for some in np.array_split(of, -(-len(of) * int(length) // 400_000)):
                words = data[starts[some][:, None] + np.arange(length)]
                ids, _ = self.viterbi(words)
                chunks.append(self.settled(words, ids, some, counts))
        for w in np.flatnonzero(rare):
            words = data[starts[w] : ends[w]][None]
            ids = np.full(words.shape, -1)
            for i, at in self.one(words.tobytes()):
                ids[0, at] = i
            chunks.append(self.settled(words, ids, np.array([w]), counts))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(offsets[-1], np.int32)
        for some, flat in chunks:
            c = counts[some]
            out[np.repeat(offsets[some], c) + np.arange(len(flat)) - np.repeat(np.cumsum(c) - c, c)] = flat
        return out, offsets

    def settled(self, words: np.ndarray, ids: np.ndarray, some: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as the ids of their bytes, and the counts set."""
        m = self.m
        if m.byte_ids.min() >= 0 and (ids == m.unknown).any():
            lost = ids == m.unknown
            for _ in range(3):  # an unknown character's other bytes have no id of their own yet
                lost[:, 1:] |= lost[:, :-1] & (ids[:, 1:] < 0) & ((words[:, 1:] & 0xC0) == 0x80)
            ids = np.where(lost, m.byte_ids[words], ids)
        counts[some] = (ids >= 0).sum(1)
        return some, ids[ids >= 0]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and offsets. Whole texts; an empty one has none."""
        data, offsets = unbarred(data, offsets)
        full = np.diff(offsets) > 0
        moved = offsets + np.concatenate([[0], np.cumsum(full)])
        text = np.full(moved[-1], 32, np.uint8)  # a space goes in front of every text that isn't empty
        text[np.arange(len(data)) + np.repeat(np.cumsum(full), np.diff(offsets))] = data
        space, alone = text == 32, self.m.lonely[text]
        start = np.zeros(len(text), bool)
        start[moved[:-1][full]] = True
        if len(text):
            start[1:] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(text)) if len(starts) else starts
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        h = span_hashes(text, starts, ends)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        ids, at = self.distinct(text, starts[first], ends[first])
        count = np.diff(at)[back]
        total = np.concatenate([[0], np.cumsum(count)])
        out = ids[np.repeat(at[back], count) + np.arange(total[-1]) - np.repeat(total[:-1], count)]
        return out, total[np.searchsorted(starts, moved)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts of these ids, and offsets; the space in front of each is taken off."""
        m = self.m
        size = (m.flat_at[1:] - m.flat_at[:-1])[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        text = m.flat[np.repeat(m.flat_at[:-1][ids], size) + np.arange(total[-1]) - np.repeat(total[:-1], size)]
        at = total[offsets]
        full = at[1:] > at[:-1]
        keep = np.ones(len(text), bool)
        front = at[:-1][full]
        keep[front] = text[front] != 32
        dropped = np.concatenate([[0], np.cumsum(~keep)])
        return text[keep], at - dropped[at]


def unbarred(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with spaces for the mark of a space, which the format can't tell from one."""
    mark = BAR.encode()
    at = np.flatnonzero(data[:-2] == mark[0]) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[(data[at + 1] == mark[1]) & (data[at + 2] == mark[2])]
    if not len(at):
        return data, offsets
    keep = np.ones(len(data), bool)
    keep[at + 1] = keep[at + 2] = False
    text = data.copy()
    text[at] = 32
    return text[keep], offsets - np.concatenate([[0], np.cumsum(~keep)])[offsets]


_encoders: dict[int, Encoder] = {}


def encoded(df: DataFrame, text: str, model: Model) -> DataFrame:
    """df with `ids array<int>`, `n_pieces long` and `round_trip boolean`, whether decoding the ids gives
    the text's bytes again; it fails only for texts that hold the model's own mark of a space. Columns of
    these names are replaced. Null is encoded like an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # the size of a vocabulary
    added = ("ids", "n_pieces", "round_trip")
    kept = [c for c in df.columns if c not in added or c == text]
    names = [f"c{i}" for i in range(len(kept))]
    flat = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if id(model) not in _encoders:
            _encoders.clear()
            _encoders[id(model)] = Encoder(model)
        encoder = _encoders[id(model)]
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            for i, j in slices(offsets, SLICE):
                part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, cuts = encoder.encode(part, bounds)
                back, ends = encoder.decode(ids, cuts)
                same = np.diff(ends) == np.diff(bounds)
                differs = np.zeros(j - i, bool)
                if same.all():
                    wrong = np.flatnonzero(back != part)
                    differs[np.searchsorted(bounds, wrong, "right") - 1] = True
                else:
                    for k in np.flatnonzero(same):
                        differs[k] = not np.array_equal(back[ends[k] : ends[k + 1]], part[bounds[k] : bounds[k + 1]])
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                columns = [c[i:j] for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(np.diff(cuts)), pa.array(same & ~differs)], names=[*names, "i", "n", "r"])
            release()

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, flat.schema, strict=True)) + ", i array<int>, n long, r boolean"
    out = flat.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], *[F.col(n).alias(c) for n, c in zip("inr", added, strict=True)])


def model_at(path: str = MODEL) -> Model:
    with open(path, "rb") as f:
        return load(f.read())


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as piece ids, decoded again and compared."""
    docs = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", model_at())
    return docs.select("doc_id", "n_pieces", "ids", "round_trip")
