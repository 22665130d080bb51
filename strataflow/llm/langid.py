"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. One linear classifier over hashed byte n-grams predicts
each bit; a text's language is the codeword with the least loss, summed over the bits and weighted by
how well each bit was predicted in training. Near ties are flagged as ambiguous. Texts without a
letter are `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import table
from strataflow.llm.textnp import LOWER, buffers, release, slices

#: n-grams of these many bytes are hashed to so many buckets each.
GRAMS = (1, 2, 3)
BUCKETS = 1 << 14
#: Rows that the classifiers are fitted on, at most, and of one language; one at least of every language, as far as these
#: rows go, those with the most rows first. Of a longer text they are fitted on so many characters in a row, at a place that its key decides.
SAMPLE = 4000
SAMPLE_LANGUAGE = 800
EXCERPT = 16_384
#: Bytes of texts that are worked on together.
SLICE = 1 << 18
#: Below this score a prediction is flagged as ambiguous.
LEAST_SCORE = 0.15


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # len(GRAMS) * BUCKETS x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1. Up to 6 languages all distinct splits; beyond, the best of random draws."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = [c for k in range(n - 1) for c in combinations(range(1, n), k)]
        return np.array([[1 if i == 0 or i in c else -1 for c in splits] for i in range(n)], float)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, bits))
        d = (bits - m @ m.T) / 2 + np.eye(n) * bits
        if np.all(np.abs(m.sum(0)) < n) and d.min() > most:
            best, most = m, d.min()
    return best if best is not None else m


def gram_ids(low: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte but the last n - 1."""
    m = max(0, len(low) - n + 1)
    key = low[:m].astype(np.uint32)
    for i in range(1, n):
        key = key * np.uint32(257) + low[i : i + m]
    key *= np.uint32(2654435761)
    return key >> np.uint32(32 - BUCKETS.bit_length() + 1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' n-gram buckets, each once a text, the square roots of their shares of the text's bytes, and whose they are.

    The n-grams of a slice are sorted by text and bucket, so a run is a bucket's count; those over a text's end are left out.
    """
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    left = np.repeat(offsets[1:], size) - np.arange(len(data))  # bytes up to the text's end
    low = LOWER[data]
    ids, values, rows = [], [], []
    for base, n in enumerate(GRAMS):
        at = gram_ids(low, n)
        key = (row[: len(at)] * np.uint64(BUCKETS) + at)[left[: len(at)] >= n]
        if len(size) * BUCKETS < 1 << 32:
            key = key.astype(np.uint32)
        key.sort()
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        of = (key[start] // BUCKETS).astype(np.int64)
        ids.append((key[start] % BUCKETS).astype(np.int64) + base * BUCKETS)
        values.append(np.sqrt(np.diff(np.append(start, len(key))) / size[of]))
        rows.append(of)
    return np.concatenate(ids), np.concatenate(values), np.concatenate(rows)


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Column sums by row; equal rows of one n-gram size stand together."""
    out = np.zeros((n, values.shape[1]))
    if len(rows):
        start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        np.add.at(out, rows[start], np.add.reduceat(values, start, axis=0))
    return out


def fit(texts: list[str], langs: list[str], seed: int = 3, epochs: int = 12, size: int = 64) -> Model:
    """Logistic classifiers, one a bit, by adaptive gradient steps over shuffled batches.

    The rows are put in an order that only they decide, so equal samples give equal models.
    """
    rows = sorted(zip(langs, texts, strict=True))
    languages = sorted({lang for lang, _ in rows})
    codes = codewords(len(languages))
    bits, buckets = codes.shape[1], len(GRAMS) * BUCKETS
    w, b = np.zeros((buckets, bits)), np.zeros(bits)
    if len(languages) < 2:
        return Model(languages, codes, w.astype(np.float32), b + 1, np.ones(bits))
    data, offsets = buffers(pa.array([t for _, t in rows]))
    held = [[a.astype(t) for a, t in zip(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), (np.int32, np.float32, np.int32), strict=True)] for i, j in slices(offsets, SLICE)]
    first = np.cumsum([0, *[j - i for i, j in slices(offsets, SLICE)]])
    ids, values, of = (np.concatenate([h[k] + (f if k == 2 else 0) for h, f in zip(held, first, strict=False)]) for k in range(3))
    order = np.argsort(of, kind="stable")
    ids, values, cuts = ids[order], values[order], np.searchsorted(of[order], np.arange(len(rows) + 1))
    code_of = {lang: code for lang, code in zip(languages, codes, strict=True)}
    target = np.array([code_of[lang] for lang, _ in rows])
    rng, squares, hits = np.random.default_rng(seed), np.full((buckets, bits), 1e-6), np.zeros(bits)
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // size)):
            part = np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in batch])
            many = cuts[batch + 1] - cuts[batch]
            at, v = ids[part], values[part]
            z = summed(np.repeat(np.arange(len(batch)), many), w[at] * v[:, None], len(batch)) + b
            t = target[batch]
            g = -t / (1 + np.exp(np.clip(t * z, -30, 30))) / len(batch)
            spread = np.repeat(g, many, axis=0)
            for k in range(bits):
                grad = np.bincount(at, spread[:, k] * v, buckets)
                squares[:, k] += grad**2
                w[:, k] -= 0.15 * grad / np.sqrt(squares[:, k])
            b -= 0.1 * g.sum(0)
            if epoch == epochs - 1:
                hits += (np.sign(z) == t).sum(0)
    trust = np.maximum(2 * hits / len(rows) - 1, 0.05)
    return Model(languages, codes, w.astype(np.float32), b, trust)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    low = LOWER[data]
    at = np.flatnonzero((low >= 97) & (low <= 122))
    out = np.diff(np.searchsorted(at, offsets)) > 0
    for k in np.flatnonzero(~out):
        if (part := data[offsets[k] : offsets[k + 1]]).size and part.max() > 127:
            out[k] = any(c.isalpha() for c in part.tobytes().decode("utf-8", "replace"))
    return out if n else np.zeros(0, bool)


def decode(model: Model, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codeword with the least weighted loss, and a score from 0 to 1: the nearest one's margin over the next."""
    loss = np.zeros((len(z), len(model.languages)))
    for k, code in enumerate(model.codes):
        loss[:, k] = np.logaddexp(0, -code[None] * z) @ model.trust
    order = np.sort(loss, axis=1)
    best = loss.argmin(1)
    if loss.shape[1] == 1:
        return best, np.ones(len(z))
    return best, 1 - np.exp(-(order[:, 1] - order[:, 0]))


def bit_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What the classifiers say of every text: texts x bits."""
    z = np.zeros((len(offsets) - 1, model.codes.shape[1]))
    for i, j in slices(offsets, SLICE):
        ids, values, rows = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        z[i:j] = summed(rows, model.weights[ids] * values.astype(np.float32)[:, None], j - i)
    return z + model.bias


def predict(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    n = len(offsets) - 1
    if not model.languages:
        return ["und"] * n, np.zeros(n), np.zeros(n, bool)
    letters = has_letter(data, offsets)
    best, score = decode(model, bit_scores(model, data, offsets))
    score = np.where(letters, score, 0.0)
    lang = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
    return lang, score, letters & (score < LEAST_SCORE)


def sample(docs: DataFrame, key: str, text: str, lang: str) -> list[tuple[str, str]]:
    """(text, language) of about SAMPLE rows, SAMPLE_LANGUAGE of one language, chosen by a hash of the key.

    Twice that is the most that is ever taken; it is reached only where very many rows share a key.
    """
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    place = F.pmod(F.xxhash64(F.lit("place"), k), F.greatest(F.lit(1), F.length(t) - EXCERPT)).cast("int") + 1
    rows = docs.where(F.col(f"`{lang}`").isNotNull() & t.isNotNull()).select(k.alias("k"), F.col(f"`{lang}`").alias("l"), F.when(F.length(t) > EXCERPT, F.substring(t, place, F.lit(EXCERPT))).otherwise(t).alias("t"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(SAMPLE).collect()}
    if not sizes:
        return []
    each = max(1, min(SAMPLE_LANGUAGE, SAMPLE // len(sizes)))
    shares = docs.sparkSession.createDataFrame([(name, min(1.0, each / n)) for name, n in sizes.items()], "name string, share double")
    draw = F.pmod(F.xxhash64(F.lit("langid"), "k"), F.lit(1 << 30)) / float(1 << 30)
    found = rows.join(F.broadcast(shares), F.col("l") == F.col("name")).where(draw < F.col("share")).select("t", "l").limit(2 * SAMPLE).collect()
    return [(r["t"], r["l"]) for r in found]


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(modulus)) == remainder


def identify(df: DataFrame, text: str, model: Model) -> DataFrame:
    """Adds lang_pred, score and ambiguous; columns of these names are replaced, others kept whatever their names.

    Null, empty or letterless texts: `und`, 0, false. Every row is judged alone, so repeated rows get equal results; of
    languages that are equally near the first by name is given, with score 0. An empty table gives an empty one; a model
    that was fitted on no rows says `und`. A text takes some fifty times its bytes of memory while it is read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x n-gram buckets: the size doesn't depend on the input
    added = ("lang_pred", "score", "ambiguous")
    kept = [c for c in df.columns if c not in added or c == text]
    names = [f"c{i}" for i in range(len(kept))]
    flat = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, unsure = predict(shared.value, *buffers(batch.column(at)))
            arrays = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "p", "s", "u"])
            release()

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, flat.schema, strict=True)) + ", p string, s double, u boolean"
    out = flat.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], *[F.col(n).alias(c) for n, c in zip("psu", added, strict=True)])


def trained(docs: DataFrame, key: str, text: str, lang: str, learn: Column) -> Model:
    rows = sample(docs.where(learn), key, text, lang)
    return fit([t for t, _ in rows], [x for _, x in rows])


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from rows whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 3, 1)
    model = trained(docs, "doc_id", "text", "lang", ~out)
    rows = identify(docs.select("doc_id", out.alias("held_out"), "text"), "text", model)
    return rows.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
