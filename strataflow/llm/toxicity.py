"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to embeddings; filters of several widths slide over a text's words, and each filter's
largest response over the whole text feeds a logistic output. Gradients flow through the places of
these maxima only. Thresholds are calibrated on rows kept out of the fit, for each language as guessed
from the text's own words, and moved to 0.5 in the score. The words that tell a language are learned as
well: those that most of its texts hold and others' texts don't.

`trained` learns from every labelled row, whole, in tasks: counts pick the words that go with a label, tasks
train on their share of the rows and are averaged after each epoch, thresholds are the best over all rows kept
for them. `fit` learns from lists in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import cut, dropped, table
from strataflow.llm.langid import held_out
from strataflow.llm.textnp import LOWER, U64, buffers, release, slices, span_hashes, word_bounds

#: Hash slots of words; embeddings are kept for the slots that the sample trained.
SLOTS = 1 << 22
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Labelled rows of each label that `sample` takes for `fit`, at most, and characters of one; `trained` has no such bounds.
SAMPLE = {1: 2000, 0: 4000}
LONGEST = 16_384
#: Every so many rows of the sample are kept for calibration; a language needs so many positives for a threshold of its own.
CALIBRATION = 4
LEAST_POSITIVES = 25
#: Words that tell a language, at most, and the rows it must have in the sample to be told.
TELLING = 16
LEAST_ROWS = 20
#: `trained` has embeddings for the words whose share of toxic texts is told from that of others: by this log-likelihood ratio
#: (one in a thousand by chance) and by this factor either way.
LEAST_RATIO = 10.83
LEAST_FACTOR = 2.0
#: Rows that a task trains on by itself between two averages, about, and epochs.
SHARE = 4096
EPOCHS = 10
#: Parts of one in which tasks tell sums, so that the order of addition has no say.
UNIT = 1 << 32

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b".,;:!?\"'()[]")] = True


@dataclass
class Model:
    rows: np.ndarray  # of each slot: its row in `words`, 0 for none
    words: np.ndarray  # row 0 is all zero
    filters: list[np.ndarray]  # of each width: width x SIZE x FILTERS
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: np.ndarray  # of each guessed language, and of none
    telling: np.ndarray  # slots of the words that tell a language, in order
    tells: np.ndarray  # which


@dataclass
class Squares:
    """Adagrad's sums of squared gradients."""

    words: np.ndarray
    filters: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    base: float


def word_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slot and full hash of every word, and the texts' offsets in them. Case and outer punctuation don't count."""
    low = LOWER[data]
    starts, ends, at = word_bounds(data, offsets)
    for _ in range(3):
        ends = ends - ((ends - starts > 1) & PUNCTUATION[low[ends - 1]])
        starts = starts + ((ends - starts > 1) & PUNCTUATION[low[starts]])
    hashes = span_hashes(low, starts, ends)
    return slots_of(hashes), hashes, at


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def telling_words(slots: np.ndarray, at: np.ndarray, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray, int]:
    """Word slots in order, which language each tells, and the number of languages."""
    counts: dict[str, int] = {}
    for name in langs:
        if name is not None:
            counts[name] = counts.get(name, 0) + 1
    names = sorted(n for n, c in counts.items() if c >= LEAST_ROWS)
    if len(names) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    place = {n: i for i, n in enumerate(names)}
    lang = np.array([place.get(x, -1) if x is not None else -1 for x in langs])
    words, word = np.unique(slots, return_inverse=True)
    text = np.repeat(np.arange(len(langs)), np.diff(at))
    pairs = np.unique(text * len(words) + word)
    text, word = pairs // len(words), pairs % len(words)
    share = np.zeros((len(names), len(words)))
    for i, n in enumerate(names):
        share[i] = np.bincount(word[lang[text] == i], minlength=len(words)) / counts[n]
    top = np.sort(share, axis=0)
    own = share.argmax(0)
    gap = top[-1] - top[-2]
    chosen = np.concatenate([np.flatnonzero(own == i)[np.argsort(-gap[own == i], kind="stable")[:TELLING]] for i in range(len(names))])
    chosen = np.sort(chosen[gap[chosen] > 0.1])
    return words[chosen], own[chosen], len(names)


def guesses(model: Model, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text the language whose telling words it has most of; the number of languages for none."""
    return guessed(model, slots_of(hashes), at)


def guessed(model: Model, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(model.thresholds) - 1
    if not len(model.telling):
        return np.full(len(at) - 1, n)
    place = np.minimum(np.searchsorted(model.telling, slots), len(model.telling) - 1)
    hit = np.flatnonzero(model.telling[place] == slots)
    doc = np.searchsorted(at, hit, "right") - 1
    counts = np.bincount(doc * n + model.tells[place[hit]], minlength=(len(at) - 1) * n).reshape(-1, n)
    return np.where(counts.max(1) > 0, counts.argmax(1), n)


def responses(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What the filters of one width answer at each word; x ends in rows of zeros for the last places."""
    n = len(x) - len(w) + 1
    out = x[:n] @ w[0]
    for o in range(1, len(w)):
        out += x[o : o + n] @ w[o]
    return out


def logits(model: Model, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The outputs for texts of word rows. A window without a known word answers 0, as does the space
    after a text; so only windows that touch a known word are computed, and 0 is the least maximum."""
    n = len(at) - 1
    top = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    known = np.flatnonzero(rows)
    if len(known):
        doc = np.searchsorted(at, known, "right") - 1
        first, last = at[doc], at[doc + 1]
        docs, cuts = np.unique(doc, return_index=True)
        padded = np.append(rows, 0)
        for k, w in enumerate(model.filters):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            for shift in range(len(w)):
                start = known - shift
                r = np.zeros((len(known), FILTERS), np.float32)
                for o in range(len(w)):
                    place = start + o
                    r += model.words[np.where((place >= first) & (place < last), padded[np.clip(place, 0, len(rows))], 0)] @ w[o]
                r[start < first] = 0
                top[docs, part] = np.maximum(top[docs, part], np.maximum.reduceat(r, cuts, axis=0))
    return np.maximum(top + model.bias, 0) @ model.out + model.base


def forward(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of word rows: each filter's largest response, the place of it in the texts put one after another, and those."""
    room = max(WIDTHS)
    ids = np.concatenate([np.append(d, np.zeros(room, d.dtype)) for d in docs])
    at = np.cumsum([0, *[len(d) + room for d in docs]])
    x = model.words[ids]
    tops, places = np.zeros((len(docs), FILTERS * len(WIDTHS))), np.zeros((len(docs), FILTERS * len(WIDTHS)), int)
    for k, w in enumerate(model.filters):
        part, r = slice(k * FILTERS, (k + 1) * FILTERS), responses(x, w)
        for b in range(len(docs)):
            own = r[at[b] : at[b + 1] - len(w) + 1]
            best = own.argmax(0)
            tops[b, part], places[b, part] = own[best, np.arange(FILTERS)], at[b] + best
    return tops, places, ids


def gradients(model: Model, tops: np.ndarray, places: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
    """Of the weighted mean cross entropy and a small penalty on `out`: gradients of out, bias, base, the filters, and of the
    word rows named beside them, which may repeat."""
    h = np.maximum(tops + model.bias, 0)
    z = h @ model.out + model.base
    dz = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    dh = dz[:, None] * model.out * (tops + model.bias > 0)
    of_filters, rows, of_words = [], [], []
    for k, w in enumerate(model.filters):
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        b, f = np.nonzero(dh[:, part])
        g = dh[:, part][b, f]
        span = ids[places[:, part][b, f][:, None] + np.arange(len(w))]
        total = np.zeros((FILTERS, *w.shape[:2]))
        np.add.at(total, f, g[:, None, None] * model.words[span])
        of_filters.append(total.transpose(1, 2, 0))
        rows.append(span.ravel())
        of_words.append((g[:, None, None] * w.transpose(2, 0, 1)[f]).reshape(-1, w.shape[1]))
    return h.T @ dz + 1e-4 * model.out, dh.sum(0), dz.sum(), of_filters, np.concatenate(rows), np.concatenate(of_words)


def fit(texts: list[str], labels: list[int], langs: list[str | None] | None = None, seed: int = 11, epochs: int = 10) -> Model:
    """Adagrad over small batches in an order that only the rows decide. langs, where known, say what tells a language."""
    langs = langs or [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i], langs[i] or ""))
    texts, y, langs = [texts[i] for i in order], np.array([labels[i] for i in order], float), [langs[i] for i in order]
    rng = np.random.default_rng(seed)
    slots, hashes, at = [], [], [0]
    data, offsets = buffers(pa.array(texts, pa.string()))
    for i, j in slices(offsets):
        s, h, a = word_slots(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        slots.append(s)
        hashes.append(h)
        at.extend(a[1:] + at[-1])
    slots, at = np.concatenate(slots) if slots else np.zeros(0, np.int64), np.array(at)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    used, rows = np.unique(slots, return_inverse=True)
    rows = rows + 1
    held = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
    model = started(used, *telling_words(slots, at, langs), rng)
    if not len(y) or y.min() == y.max():
        return settled(model, len(y) and y.max() > 0)
    learn = np.flatnonzero(~held)
    weight = np.where(y == 1, min(4.0, (y == 0).sum() / max(1, (y == 1).sum())), 1.0)
    docs, squares = [rows[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], first_squares(model)
    for epoch in range(epochs):
        descend(model, squares, docs, y, weight, rng.permutation(learn), epoch / epochs)
    calibrate(model, rows, at, y, guesses(model, hashes, at), held)
    return pruned(model, used)


def started(used: np.ndarray, telling: np.ndarray, tells: np.ndarray, n_langs: int, rng: np.random.Generator) -> Model:
    """An untrained model that knows the words of these slots."""
    n_filters = FILTERS * len(WIDTHS)
    model = Model(
        np.zeros(SLOTS, np.int32),
        (rng.standard_normal((len(used) + 1, SIZE)) * 0.05).astype(np.float32),
        [(rng.standard_normal((w, SIZE, FILTERS)) * 0.5 / w).astype(np.float32) for w in WIDTHS],
        np.full(n_filters, 0.05),
        np.abs(rng.standard_normal(n_filters)) * 0.5 * np.where(np.arange(n_filters) % 4 == 3, -1, 1),
        -2.0,
        np.zeros(n_langs + 1),
        telling,
        tells,
    )
    model.words[0] = 0
    model.rows[used] = np.arange(1, len(used) + 1)
    return model


def settled(model: Model, toxic: bool) -> Model:
    """A model of rows of one label, or of none: it says that label, or 0, of all."""
    model.base, model.out[:] = (20.0 if toxic else -20.0), 0
    return model


def first_squares(model: Model) -> Squares:
    n = len(model.out)
    return Squares(np.full(len(model.words), 1e-3), [np.full(w.shape, 1e-2) for w in model.filters], np.full(n, 1e-2), np.full(n, 1e-2), 1e-2)


def descend(model: Model, squares: Squares, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, order: np.ndarray, done: float) -> None:
    """Adagrad over the rows in this order, sixteen at a time; done is the share of epochs that are over."""
    rate = 0.15 * (1 - 0.7 * done)
    for batch in np.array_split(order, max(1, len(order) // 16)):
        found = forward(model, [docs[d] for d in batch])
        dout, dbias, dbase, of_filters, ids, of_words = gradients(model, *found, y[batch], weight[batch])
        squares.out += dout**2
        squares.bias += dbias**2
        squares.base += dbase**2
        model.out -= rate * dout / np.sqrt(squares.out)
        model.bias -= rate * 0.3 * dbias / np.sqrt(squares.bias)
        model.base -= rate * dbase / np.sqrt(squares.base)
        for k, g in enumerate(of_filters):
            squares.filters[k] += g**2
            model.filters[k] -= (rate * 0.5 * g / np.sqrt(squares.filters[k])).astype(np.float32)
        if len(ids):
            one, back = np.unique(ids, return_inverse=True)
            total = np.zeros((len(one), SIZE))
            np.add.at(total, back, of_words)
            squares.words[one] += (total**2).sum(1)
            model.words[one] -= (rate * total / np.sqrt(squares.words[one])[:, None]).astype(np.float32)
            model.words[0] = 0


def pruned(model: Model, used: np.ndarray, least: float = 0.3) -> Model:
    """Without the rows that training left small: such words count as unknown."""
    big = np.abs(model.words).max(1) >= least
    big[0] = True
    place = np.cumsum(big) - 1
    model.rows[used] = np.where(big[1:], place[1:], 0)
    model.words = np.ascontiguousarray(model.words[big])
    return model


def calibrate(model: Model, rows: np.ndarray, at: np.ndarray, y: np.ndarray, guess: np.ndarray, held: np.ndarray) -> None:
    """Thresholds with the best F1 on the held rows, for each guessed language with positives enough and for all."""
    norm = np.abs(model.words).max(1)
    kept = np.where(norm[rows] >= 0.3, rows, 0)
    z = np.concatenate([logits(model, kept[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(at, 1 << 16)]) if len(at) > 1 else np.zeros(0)

    def best(sel: np.ndarray) -> float:
        zs, ys = z[sel], y[sel]
        order = np.argsort(-zs, kind="stable")
        hits = np.cumsum(ys[order])
        f1 = 2 * hits / (np.arange(1, len(zs) + 1) + ys.sum())
        last = np.append(zs[order][1:] < zs[order][:-1], True)  # a threshold can't part equal scores
        k = np.flatnonzero(last)[np.argmax(f1[last])]
        low = zs[order][k + 1] if k + 1 < len(zs) else zs[order][k] - 1
        return (zs[order][k] + low) / 2

    whole = best(held) if y[held].sum() else 0.0
    model.thresholds[:] = whole
    for k in range(len(model.thresholds)):
        if y[sel := held & (guess == k)].sum() >= LEAST_POSITIVES:
            model.thresholds[k] = best(sel)


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of every text, over all of its words; the batch is worked on in slices of whole texts."""
    out = np.zeros(len(offsets) - 1)
    for i, j in slices(offsets, 1 << 20):
        slots, hashes, at = word_slots(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        z = logits(model, model.rows[slots], at) - model.thresholds[guesses(model, hashes, at)]
        out[i:j] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return out


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, lang: str | None = None) -> tuple[list[str], list[int], list[str | None]]:
    """Texts, labels and languages of at most SAMPLE rows a label, chosen by a hash of the key among all labelled rows; texts
    of more than LONGEST characters are left out. A key with both labels may be in it with both."""
    rows = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "k"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, min(1.0, 0.95 * SAMPLE[1] / max(1, sizes.get(1, 0)))).otherwise(min(1.0, 0.95 * SAMPLE[0] / max(1, sizes.get(0, 0))))
    picked = rows.where(draw < share).distinct().limit(SAMPLE[0] + SAMPLE[1])
    known = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), (F.col(f"`{lang}`") if lang else F.lit(None).cast("string")).alias("l"))
    # The limit bounds what is sent to every task.
    found = known.where(F.coalesce(F.length("t"), F.lit(0)) <= LONGEST).join(F.broadcast(picked), "k").select("t", "y", "l").limit(2 * (SAMPLE[0] + SAMPLE[1])).collect()
    return [r["t"] or "" for r in found], [r["y"] for r in found], [r["l"] for r in found]


def packed(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Lists of numbers as int32 in binary values."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat, np.int32))])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of such lists, one list after another, and n + 1 offsets."""
    if not len(column):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), np.int32), (offsets - offsets[0]) // 4


def labelled_words(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, lang: str | None) -> DataFrame:
    """k, l, w and y of every labelled row: its key, language, the slots of all its words, and label. A key with both labels
    is there with both; a null text has no words. Tables of any size are dealt by key: a task holds no more than its share of
    the labels, and small tables cost in proportion to large ones."""
    rows = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).distinct()
    known = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("k"), (F.col(f"`{lang}`").cast("string") if lang else F.lit(None).cast("string")).alias("l"), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for i, j in slices(offsets):
                slots, _, at = word_slots(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:2], packed(slots, at)], names=["k", "l", "w"])
        release()

    return known.mapInArrow(run, f"k {known.schema['k'].dataType.simpleString()}, l string, w binary").join(rows.hint("merge"), "k")


def word_counts(rows: DataFrame) -> DataFrame:
    """l, s, n0 and n1: of each language and slot, how many rows of either label hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = unpacked(batch.column(1))
            names = batch.column(0).dictionary_encode()
            lang = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            kind = lang * 2 + batch.column(2).to_numpy(zero_copy_only=False)
            names = pa.concat_arrays([names.dictionary, pa.nulls(1, pa.string())])
            for i, j in slices(at):
                pairs = np.unique(np.repeat(np.arange(i, j), np.diff(at[i : j + 1])) * SLOTS + flat[at[i] : at[j]])
                found, n = np.unique(kind[pairs // SLOTS] * SLOTS + pairs % SLOTS, return_counts=True)
                k, s = found // SLOTS, found % SLOTS
                yield pa.RecordBatch.from_arrays([names.take(pa.array(k // 2)), pa.array(s), pa.array(n * (1 - k % 2)), pa.array(n * (k % 2))], names=["l", "s", "n0", "n1"])
        release()

    return rows.select("l", "w", "y").mapInArrow(run, "l string, s long, n0 long, n1 long").groupBy("l", "s").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def associated(counts: DataFrame, totals: tuple[int, int]) -> np.ndarray:
    """Slots in order whose share among the rows of one label is told from that of the other, by all rows."""
    n0, n1 = (F.col(c).cast("double") for c in ("n0", "n1"))
    ratio = F.lit(0.0)
    for n, t in ((n0, totals[0]), (n1, totals[1])):
        for seen, size in ((n, n0 + n1), (F.lit(float(t)) - n, F.lit(float(sum(totals))) - n0 - n1)):
            ratio += F.when(seen > 0, 2 * seen * F.log(seen * sum(totals) / (size * t))).otherwise(0.0)
    factor = ((n1 + 0.5) / (totals[1] + 1)) / ((n0 + 0.5) / (totals[0] + 1))
    sums = counts.groupBy("s").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = sums.where((ratio >= LEAST_RATIO) & ((factor >= LEAST_FACTOR) | (factor <= 1 / LEAST_FACTOR))).select("s").toArrow()
    return np.sort(found.column(0).to_numpy())


def telling_counts(counts: DataFrame, sizes: dict[str, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """As `telling_words`, of counted words and the rows of each language."""
    names = sorted(n for n, c in sizes.items() if c >= LEAST_ROWS)
    if len(names) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    of = F.broadcast(counts.sparkSession.createDataFrame([(n, i, sizes[n]) for i, n in enumerate(names)], "l string, i int, size long"))
    shares = counts.join(of, "l").groupBy("s").agg(F.sort_array(F.collect_list(F.struct(((F.col("n0") + F.col("n1")) / F.col("size")).alias("p"), (-F.col("i")).alias("i"))), False).alias("p"))
    second = F.when(F.size("p") > 1, F.col("p")[1]["p"]).otherwise(0.0)
    found = shares.select("s", (F.col("p")[0]["p"] - second).alias("gap"), (-F.col("p")[0]["i"]).alias("i")).where("gap > 0.1").toArrow()
    s, gap, own = (found.column(c).to_numpy() for c in ("s", "gap", "i"))
    order = np.lexsort((s, -gap))
    chosen = np.concatenate([order[own[order] == i][:TELLING] for i in range(len(names))])
    chosen = chosen[np.argsort(s[chosen])]
    return s[chosen].astype(np.int64), own[chosen].astype(np.int64), len(names)


def short(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of word rows with runs of unknown words cut to as many as a filter can reach over: every window that holds
    a known word stays, so every filter's largest response does."""
    place = np.arange(len(rows))
    since = np.maximum(np.maximum.accumulate(np.where(rows > 0, place + 1, 0)), np.repeat(at[:-1], np.diff(at)))
    kept = (rows > 0) | (place - since < max(WIDTHS) - 1)
    return rows[kept], np.concatenate([[0], np.cumsum(kept)])[at]


def known_words(rows: DataFrame, model: Model) -> DataFrame:
    """k, y, g and w: key, label, guessed language and the rows of the words that the model knows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = unpacked(batch.column(2))
            for i, j in slices(at):
                own, cuts = flat[at[i] : at[j]], at[i : j + 1] - at[i]
                guess = guessed(shared.value, own, cuts)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:2], pa.array(guess.astype(np.int32)), packed(*short(shared.value.rows[own], cuts))], names=["k", "y", "g", "w"])
        release()

    return rows.select("k", "y", "w").mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, y int, g int, w binary")


def flat_values(model: Model, squares: Squares) -> np.ndarray:
    """All that is learned but the words."""
    return np.concatenate([*[w.ravel() for w in model.filters], model.out, model.bias, [model.base], *[w.ravel() for w in squares.filters], squares.out, squares.bias, [squares.base]]).astype(float)


def put_values(model: Model, squares: Squares, values: np.ndarray) -> None:
    at = 0

    def take(like: np.ndarray) -> np.ndarray:
        nonlocal at
        at += like.size
        return values[at - like.size : at].reshape(like.shape).astype(like.dtype)

    for to in (model, squares):
        to.filters, to.out, to.bias = [take(w) for w in to.filters], take(to.out), take(to.bias)
        to.base = float(take(np.zeros(1))[0])


def shared_out(rows: DataFrame, n: int) -> DataFrame:
    """The rows in shares of about SHARE, a row a share: b, and in binary the labels, sizes and words of its texts in an order
    that only they decide."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("w", "ascending"), ("y", "ascending")])
        words, at = unpacked(pa.concat_arrays(t.column("w").chunks))
        return pa.table({"b": t.column("b").slice(0, 1), "y": [t.column("y").to_numpy().astype(np.int8).tobytes()], "at": [at.tobytes()], "w": [words.tobytes()]})

    bucket = F.pmod(F.xxhash64(F.lit("share"), "k"), F.lit(max(1, -(-n // SHARE)))).cast("int")
    return rows.select(bucket.alias("b"), "y", "w").groupBy("b").applyInArrow(pack, "b int, y binary, at binary, w binary")


def averaged(shares: DataFrame, model: Model, squares: Squares, heavy: float, epoch: int, seed: int, tasks: int = 1) -> None:
    """An epoch: every share is trained on alone, from the same model, which then moves by the mean of what they learned; a word
    by the mean over the shares that hold it. The shares are dealt to so many tasks, or one for each core if that is more."""
    sc = shares.sparkSession.sparkContext
    start = sc.broadcast((replace(model, rows=np.zeros(0, np.int32)), squares))
    columns = [f"v{i}" for i in range(SIZE + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b, y, at, words = (batch.column(c)[row].as_py() for c in ("b", "y", "at", "w"))
                old, old_squares = start.value
                own = replace(old, words=old.words.copy(), filters=[w.copy() for w in old.filters], out=old.out.copy(), bias=old.bias.copy())
                sq = replace(old_squares, words=old_squares.words.copy(), filters=[w.copy() for w in old_squares.filters], out=old_squares.out.copy(), bias=old_squares.bias.copy())
                y, at, words = np.frombuffer(y, np.int8).astype(float), np.frombuffer(at, np.int64), np.frombuffer(words, np.int32)
                order = np.random.default_rng([seed, epoch, b]).permutation(len(y))
                descend(own, sq, [words[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], y, np.where(y == 1, heavy, 1.0), order, epoch / EPOCHS)
                held = np.unique(words[words > 0])
                moved = np.column_stack([own.words[held].astype(float) - old.words[held], sq.words[held] - old_squares.words[held]])
                rest = flat_values(own, sq) - flat_values(old, old_squares)
                rest = np.append(rest, np.zeros(-len(rest) % (SIZE + 1))).reshape(-1, SIZE + 1)
                whole = np.rint(np.vstack([moved, rest]) * UNIT).astype(np.int64)
                ids = np.concatenate([held.astype(np.int64), -1 - np.arange(len(rest))])
                yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(np.ascontiguousarray(whole[:, i])) for i in range(SIZE + 1)]], names=["i", *columns])
        release()

    spread = shares.repartition(max(tasks, sc.defaultParallelism), F.col("b"))
    found = spread.mapInArrow(run, "i long, " + ", ".join(f"{c} long" for c in columns)).groupBy("i").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns]).toArrow()
    start.destroy()
    ids = found.column("i").to_numpy()
    moved = np.column_stack([found.column(c).to_numpy() for c in columns]) / UNIT / found.column("n").to_numpy()[:, None]
    words, rest = ids >= 0, np.flatnonzero(ids < 0)
    model.words[ids[words]] += moved[words, :SIZE].astype(np.float32)
    squares.words[ids[words]] += moved[words, SIZE]
    if len(rest):
        values = flat_values(model, squares)
        put_values(model, squares, values + moved[rest[np.argsort(-ids[rest])]].ravel()[: len(values)])


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """g, z, y and n: of every guessed language and output the toxic rows and all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(replace(model, rows=np.zeros(0, np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = unpacked(batch.column(2))
            for i, j in slices(at, 1 << 16):
                z = logits(shared.value, flat[at[i] : at[j]].astype(np.int64), at[i : j + 1] - at[i])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:2], pa.array(z + 0.0)], names=["g", "y", "z"])
        release()

    return rows.select("g", "y", "w").mapInArrow(run, "g int, y int, z double").groupBy("g", "z").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))


def best_thresholds(table: DataFrame, n_langs: int) -> np.ndarray:
    """Thresholds with the best F1 over all rows, for each guessed language with positives enough and for the rest.

    Outputs are counted in steps of their value; only inside steps that could hold a better threshold than their ends are
    finer ones counted, down to single outputs. So little is collected, however many rows there are.
    """
    sizes = {r["g"]: r["y"] for r in table.groupBy("g").agg(F.sum("y").alias("y")).collect()}
    every = sum(sizes.values())
    if not every:
        return np.zeros(n_langs + 1)
    kinds = [None, *[g for g in sorted(sizes) if sizes[g] >= LEAST_POSITIVES]]
    best = {k: (-1.0, 0.0) for k in kinds}
    open_steps, outer = None, F.lit(0.0)  # of each kind: step -> toxic rows and all rows above it
    for power in (6, 12, 20, 30, None):
        step = F.floor(F.col("z") * float(1 << power)).cast("double") if power is not None else F.col("z")
        part = table.withColumns({"outer": outer, "step": step})
        outer = step
        if open_steps is not None:
            asked = [(float(s),) for s in sorted({s for o in open_steps.values() for s in o})]
            if not asked:
                break
            part = part.join(F.broadcast(table.sparkSession.createDataFrame(asked, "outer double")), "outer")
        rows = part.groupBy("g", "outer", "step").agg(F.sum("y").alias("y"), F.sum("n").alias("n"), F.min("z").alias("low"), F.max("z").alias("high")).toArrow()
        g, up, at, y, n, low, high = (rows.column(c).to_numpy() for c in ("g", "outer", "step", "y", "n", "low", "high"))
        following = {}
        for k in kinds:
            following[k] = {}
            positives = every if k is None else sizes[k]
            mine = np.ones(len(g), bool) if k is None else g == k
            found = []
            for o, (hits, said) in (open_steps[k] if open_steps is not None else {0.0: (0, 0)}).items():
                sel = np.flatnonzero(mine & (up == o))
                steps, back = np.unique(-at[sel], return_inverse=True)
                ys, ns = np.bincount(back, y[sel], len(steps)), np.bincount(back, n[sel], len(steps))
                lows, highs = np.full(len(steps), np.inf), np.full(len(steps), -np.inf)
                np.minimum.at(lows, back, low[sel])
                np.maximum.at(highs, back, high[sel])
                h, m = hits + np.cumsum(ys), said + np.cumsum(ns)
                f1 = 2 * h / (m + positives)
                after = np.append(highs[1:], lows[-1:] - 2)
                if open_steps is not None:
                    f1[-1:] = -1  # the end of the wider step, counted there
                for i in np.flatnonzero(f1 == f1.max(initial=-1))[:1]:
                    if f1[i] > best[k][0]:
                        best[k] = (f1[i], (lows[i] + after[i]) / 2)
                found.append((-steps, h - ys, m - ns, ys, lows < highs))
            for steps, h, m, ys, wide in found:
                most = 2 * (h + ys) / (m + ys + positives)  # if the step's toxic rows came first
                for i in np.flatnonzero(wide & (most > best[k][0])):
                    following[k][steps[i]] = (h[i], m[i])
        open_steps = following
    out = np.full(n_langs + 1, best[None][1])
    for k in kinds[1:]:
        out[k] = best[k][1]
    return out


def trained(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, lang: str | None = None, seed: int = 11) -> Model:
    """A model learned from every labelled row and all of its text. Only sums, the words that go with a label and what is learned
    come to the driver; the order and partitions of the rows have no say."""
    rows = cut(labelled_words(docs, labels, key, text, label, lang), "toxicity-words")
    sizes = rows.groupBy("l", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    totals = tuple(sum(r["n"] for r in sizes if r["y"] == y) for y in (0, 1))
    langs: dict[str, int] = {}
    for r in sizes:
        if r["l"] is not None:
            langs[r["l"]] = langs.get(r["l"], 0) + r["n"]
    rng = np.random.default_rng(seed)
    if not all(totals):
        dropped(rows)
        return settled(started(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, rng), totals[1] > 0)
    counts = cut(word_counts(rows), "toxicity-counts")
    model = started(associated(counts, totals), *telling_counts(counts, langs), rng)
    known = cut(known_words(rows, model).withColumn("held", F.pmod(F.xxhash64(F.lit("calibrate"), "k"), F.lit(CALIBRATION)) == CALIBRATION - 1), "toxicity-known")
    dropped(rows, counts)
    learned = sum(totals) * (CALIBRATION - 1) // CALIBRATION
    shares = cut(shared_out(known.where("not held"), learned), "toxicity-shares")
    squares = first_squares(model)
    for epoch in range(EPOCHS):
        averaged(shares, model, squares, min(4.0, totals[0] / totals[1]), epoch, seed, learned // (4 * SHARE))
    outputs = cut(scored(known.where("held"), model), "toxicity-outputs")
    model.thresholds = best_thresholds(outputs, len(model.thresholds) - 1)
    dropped(known, shares, outputs)
    return model


def classify(df: DataFrame, key: str, text: str, model: Model, extra: list[str] | None = None) -> DataFrame:
    """key, `extra`, score and predicted of every row, and no other column.

    A null text is an empty one; it gets the score of no words. Every row is scored alone, so repeated rows get equal scores;
    a text takes some forty times its bytes of memory meanwhile. A score of exactly 0.5 is predicted 1. An empty table gives an empty one. A model
    fitted on no rows, or on rows of one label, says that label or 0 of all.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size follows SLOTS and the sample, not the input
    kept = [key, *(extra or [])]
    flat = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*kept, text])])
    names = flat.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(shared.value, *buffers(batch.column(len(names))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "s", "p"])

    schema = ", ".join(f"{n} {flat.schema[n].dataType.simpleString()}" for n in names) + ", s double, p int"
    out = flat.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)], F.col("s").alias("score"), F.col("p").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored; labels are learned from all rows whose crc32(doc_id) mod 5 is not 0. The language label of
    these rows says which words tell a language; no score reads one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 5, 0)
    model = trained(docs.where(~out), table(spark, sf_dir, "labels").where(~out), "doc_id", "text", "toxic", "lang")
    return classify(docs.select("doc_id", "text").withColumn("held_out", out), "doc_id", "text", model, ["held_out"])
