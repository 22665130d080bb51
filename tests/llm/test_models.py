import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataflow.llm import langid, toxicity
from strataflow.llm.textnp import buffers, span_hashes, word_bounds

LETTERS = {"xx": "abcdeéß", "yy": "ghijklmö", "zz": "opqrstuñ"}


def texts(n, seed=0):
    rng = random.Random(seed)
    return [("".join(rng.choices(LETTERS[lang] + "  ", k=rng.randint(20, 200))), lang) for lang in LETTERS for _ in range(n)]


def test_words_and_hashes():
    given = ["A b\u00a0c", None, "", "  x ", "éé\tx", "\n"]
    data, offsets = buffers(pa.array(given))
    starts, ends, at = word_bounds(data, offsets)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert words == ["A", "b\u00a0c", "x", "éé", "x"] and at.tolist() == [0, 2, 2, 2, 3, 5, 5]
    h = span_hashes(data, starts, ends)
    assert h[2] == h[4] and len(set(h.tolist())) == 4
    assert buffers(pa.array([], pa.string()))[1].tolist() == [0]
    assert buffers(pa.array(["ab", "c", "d"]).slice(1))[0].tobytes() == b"cd"


def test_languages_held_out():
    model = langid.fit(*map(list, zip(*texts(60), strict=True)))
    fresh = texts(40, seed=9)
    lang, score, unsure = langid.predict(model, *buffers(pa.array([t for t, _ in fresh])))
    assert sum(a == b for a, (_, b) in zip(lang, fresh, strict=True)) / len(fresh) > 0.97
    assert ((score >= 0) & (score <= 1)).all() and not unsure.all()
    again = langid.fit(*map(list, zip(*reversed(texts(60)), strict=True)))
    assert np.array_equal(model.weights, again.weights), "the sample's order has no say"


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 20):
        m = langid.codewords(n)
        distance = [(m[i] != m[j]).sum() for i in range(n) for j in range(i)]
        assert min(distance) >= max(1, m.shape[1] // 4)


@pytest.mark.parametrize("text", [None, "", " \n", "123 !?", "١٢٣"])
def test_without_letters(text):
    model = langid.fit(*map(list, zip(*texts(20), strict=True)))
    lang, score, unsure = langid.predict(model, *buffers(pa.array([text, "abc"])))
    assert lang[0] == "und" and score[0] == 0 and not unsure[0] and lang[1] == "xx"


def test_language_operator_keeps_columns(spark):
    rows = [(i, t, lang if i % 5 else None, "old") for i, (t, lang) in enumerate(texts(40))] + [(None, None, None, None), (3, "", "xx", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.trained(df, "doc_id", "text", "lang", F.lit(True))
    out = langid.identify(df, "text", model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"]
    got = out.collect()
    assert len(got) == len(rows) and sum(r.lang is None or r.lang_pred == r.lang for r in got) >= len(rows) - 3
    assert langid.identify(df.limit(0), "text", model).count() == 0
    empty = langid.trained(df.limit(0), "doc_id", "text", "lang", F.lit(True))
    assert {r.lang_pred for r in langid.identify(df, "text", empty).collect()} == {"und"}


def plain_scores(model, text):
    """The bits' scores of a text, an n-gram at a time."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    z = model.bias.copy()
    for base, n in enumerate(langid.GRAMS):
        counts = {}
        for i in range(len(low) - n + 1):
            key = 0
            for b in low[i : i + n]:
                key = (key * 257 + b) % 2**32
            bucket = (key * 2654435761 % 2**32) >> (32 - 14)
            counts[bucket] = counts.get(bucket, 0) + 1
        for bucket, c in counts.items():
            z = z + model.weights[bucket + base * langid.BUCKETS] * (c / len(low)) ** 0.5
    return z


def test_scores_and_decoding_by_brute_force(monkeypatch):
    model = langid.fit(*map(list, zip(*texts(20), strict=True)))
    given = ["a", "", "Öé", "abc ABC", *(t for t, _ in texts(5, seed=4)), "x" * 700]
    monkeypatch.setattr(langid, "SLICE", 300)
    z = langid.bit_scores(model, *buffers(pa.array(given)))
    assert np.allclose(z, [plain_scores(model, t) for t in given], atol=1e-4)
    best, score = langid.decode(model, z)
    for row, b, s in zip(z, best, score, strict=True):
        loss = [sum(w * np.log1p(np.exp(-c * x)) for w, c, x in zip(model.trust, code, row, strict=True)) for code in model.codes]
        near, second = sorted(loss)[:2]
        assert abs(loss[b] - near) < 1e-9 and abs(s - (1 - np.exp(near - second))) < 1e-9
    tie = langid.decode(model, np.zeros((1, model.codes.shape[1])))
    assert tie[0][0] == 0 and tie[1][0] == 0


def test_every_language_is_learned(spark):
    """More languages than were ever listed: each has a row or more in the sample."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i * 3 + j, f"{letters[i % 26] * 3}{letters[i // 26] * 2}{letters[(i * 7) % 26]} " * 20, f"l{i:03d}") for i in range(300) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.sample(df, "doc_id", "text", "lang")
    assert len({lang for _, lang in found}) == 300
    long = spark.createDataFrame([(1, "".join(chr(97 + i % 26) for i in range(50_000)), "xx")], "doc_id long, text string, lang string")
    ((text, _),) = langid.sample(long, "doc_id", "text", "lang")
    assert len(text) == langid.EXCERPT


def labelled(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(5, 150))
        if i % 5 == 0:
            for _ in range(rng.randint(1, 2)):
                words.insert(rng.randrange(len(words)), rng.choice(["Idiot,", "scum", "moron."]))
        out.append((" ".join(words), int(i % 5 == 0)))
    return out


def test_toxic_words_are_learned():
    model = toxicity.fit(*map(list, zip(*labelled(900, 1), strict=True)))
    fresh = labelled(400, 2)
    data, offsets = buffers(pa.array([t for t, _ in fresh]))
    said = toxicity.scores(model, data, offsets) >= 0.5
    truth = np.array([y for _, y in fresh], bool)
    assert (said & truth).sum() / truth.sum() > 0.9 and (said & truth).sum() / max(1, said.sum()) > 0.9


def test_sparse_scores_equal_dense_ones():
    rng = np.random.default_rng(2)
    model = toxicity.fit(*map(list, zip(*labelled(200, 3), strict=True)))
    model.words = np.vstack([np.zeros((1, toxicity.SIZE)), rng.standard_normal((30, toxicity.SIZE))]).astype(np.float32)
    sizes = [0, 1, 2, 9, 40, 0]
    rows = np.concatenate([rng.choice([0, 0, 0, *range(1, 31)], n) for n in sizes]).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    want = []
    for i in range(len(sizes)):
        x = model.words[np.concatenate([rows[at[i] : at[i + 1]], [0] * 3])]
        top = np.concatenate([np.maximum(toxicity.responses(x, w)[: at[i + 1] - at[i]].max(0, initial=0), 0) for w in model.filters])
        want.append(np.maximum(top + model.bias, 0) @ model.out + model.base)
    assert np.allclose(toxicity.logits(model, rows, at), want, atol=1e-4)


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(7)
    model = toxicity.fit(*map(list, zip(*labelled(60, 5), strict=True)))
    model.words = np.vstack([np.zeros((1, toxicity.SIZE)), rng.standard_normal((12, toxicity.SIZE))])
    model.filters = [w.astype(float) for w in model.filters]
    docs, y, weight = [rng.integers(0, 13, n) for n in (0, 1, 5, 9)], np.array([1.0, 0, 1, 0]), np.array([2.0, 1, 2, 1])

    def loss():
        tops, _, _ = toxicity.forward(model, docs)
        z = np.maximum(tops + model.bias, 0) @ model.out + model.base
        return (weight * (np.logaddexp(0, z) - y * z)).mean() + 0.5e-4 * (model.out**2).sum()

    dout, dbias, dbase, of_filters, rows, of_words = toxicity.gradients(model, *toxicity.forward(model, docs), y, weight)
    of_table = np.zeros_like(model.words)
    np.add.at(of_table, rows, of_words)
    of_table[0] = 0  # the row of unknown words stays zero
    for values, grad in [(model.out, dout), (model.bias, dbias), (model.words, of_table), *zip(model.filters, of_filters, strict=True)]:
        for place in [tuple(rng.integers(0, n) for n in values.shape) for _ in range(25)]:
            if values is model.words and place[0] == 0:
                continue
            old, step = values[place], 1e-6
            values[place] = old + step
            up = loss()
            values[place] = old - step
            down = loss()
            values[place] = old
            assert abs((up - down) / (2 * step) - grad[place]) < 1e-5
    model.base += 1e-6
    up = loss()
    model.base -= 2e-6
    assert abs((up - loss()) / 2e-6 - dbase) < 1e-5


def test_thresholds_by_brute_force():
    """The best F1 on the held rows, over every threshold, for each language with positives enough."""
    rng = np.random.default_rng(1)
    model = toxicity.fit(*map(list, zip(*labelled(80, 6), strict=True)))
    model.thresholds = np.zeros(3)
    n = 900
    y, guess, held, z = rng.integers(0, 2, n).astype(float), rng.choice([0, 0, 0, 1, 2, 2], n), rng.random(n) < 0.5, np.round(rng.standard_normal(n) + 0.0, 1)
    guess[200:] = np.where(guess[200:] == 1, 0, guess[200:])
    z += y
    original = toxicity.logits
    toxicity.logits = lambda *_: z
    try:
        toxicity.calibrate(model, np.zeros(n, int), np.arange(n + 1), y, guess, held)
    finally:
        toxicity.logits = original

    def f1(sel, threshold):
        said = z[sel] >= threshold
        return 2 * (said & (y[sel] == 1)).sum() / max(1, said.sum() + y[sel].sum())

    for k in range(3):
        sel = held & (guess == k)
        sel = sel if y[sel].sum() >= toxicity.LEAST_POSITIVES else held
        assert abs(f1(sel, model.thresholds[k]) - max(f1(sel, t) for t in np.unique(z[sel]))) < 1e-12


def test_words_that_tell_a_language():
    rows = [(" ".join(random.Random(i).choices(["und", "nicht", "der", "x", "y"] if i % 2 else ["the", "of", "and", "x", "y"], k=30)), 0, "de" if i % 2 else "en") for i in range(100)]
    model = toxicity.fit(*map(list, zip(*rows, strict=True)))
    assert len(model.telling) == 6 and len(model.thresholds) == 3
    data, offsets = buffers(pa.array(["the x of x", "x y", "und NICHT the", None]))
    _, hashes, at = toxicity.word_slots(data, offsets)
    assert toxicity.guesses(model, hashes, at).tolist() == [1, 2, 0, 2]


def test_toxicity_operator(spark):
    rows = labelled(300, 4)
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)] + [(900, None, "x"), (901, "", None), (None, "idiot", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(900, 1), (901, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.sample(docs, labels, "doc_id", "text", "toxic"))
    out = toxicity.classify(docs, "doc_id", "text", model).collect()
    assert len(out) == 303 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert toxicity.classify(docs.limit(0), "doc_id", "text", model).count() == 0
    assert toxicity.classify(docs.withColumnRenamed("score", "predicted"), "doc_id", "text", model, ["predicted"]).columns == ["doc_id", "predicted", "score", "predicted"]
    assert len(toxicity.sample(docs.withColumn("text", F.repeat("text", 9000)), labels, "doc_id", "text", "toxic")[0]) == 1, "only the null text is short enough"
    none = toxicity.fit(*toxicity.sample(docs.limit(0), labels, "doc_id", "text", "toxic"))
    assert toxicity.classify(docs, "doc_id", "text", none).where("predicted = 1").count() == 0


def toxic_tables(spark, rows):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, _, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, y) for i, (_, y, _) in enumerate(rows)], "doc_id long, toxic int")


def test_toxicity_query_learns_from_every_row(spark, tmp_path, monkeypatch):
    """More labelled rows than were ever sampled; one toxic word is in texts longer than any that was."""
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 4, 0: 8})
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        long, bad = i % 3 == 0, i % 4 == 0
        text = rng.choices(words, k=40) + ["pad"] * (6000 if long and i % 2 == 0 else 0)
        if bad:
            text.insert(rng.randrange(len(text)), "scum" if len(text) > 1000 else "moron")
        rows.append((" ".join(text), int(bad), "en"))
    docs, labels = toxic_tables(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.predicted for r in toxicity.op3_toxicity(spark, str(tmp_path)).collect()}
    assert max(len(t) for t, _, _ in rows) > toxicity.LONGEST
    assert sum(got[i] == y for i, (_, y, _) in enumerate(rows)) >= 595


def test_counts_of_words_by_brute_force(spark):
    rows = [(" ".join(random.Random(i).choices("a b c D d e, f g h".split(), k=i % 9)) + (" bad" if i % 3 == 0 else ""), int(i % 3 == 0), [None, "en", "de"][i % 7 % 3]) for i in range(90)]
    docs, labels = toxic_tables(spark, [*rows, (None, 1, "en")])
    twice = labels.union(spark.createDataFrame([(0, 0), (1, None), (2, 7), (None, 1)], labels.schema))
    found = toxicity.labelled_words(docs, twice, "doc_id", "text", "toxic", "lang")
    assert found.count() == 92
    counts = {(r.l, r.s): (r.n0, r.n1) for r in toxicity.word_counts(found).collect()}
    want = {}
    for text, y, lang in [*rows, (rows[0][0], 0, rows[0][2])]:
        slots, _, _ = toxicity.word_slots(*buffers(pa.array([text])))
        for s in set(slots.tolist()):
            n = want.setdefault((lang, s), [0, 0])
            n[y] += 1
    assert counts == {k: tuple(n) for k, n in want.items()}
    bad = toxicity.word_slots(*buffers(pa.array(["bad"])))[0]
    assert bad[0] in toxicity.associated(toxicity.word_counts(found), (61, 31))


def test_telling_counts_are_telling_words(spark):
    rows = [(" ".join(random.Random(i).choices(["und", "nicht", "der", "x", "y"] if i % 2 else ["the", "of", "and", "x", "y"], k=30)), 0, "de" if i % 2 else "en") for i in range(100)] + [("rare", 0, "fr")]
    found = toxicity.word_counts(toxicity.labelled_words(*toxic_tables(spark, rows), "doc_id", "text", "toxic", "lang"))
    slots, _, at = toxicity.word_slots(*buffers(pa.array([t for t, _, _ in rows])))
    got, want = toxicity.telling_counts(found, {"de": 50, "en": 50, "fr": 1}), toxicity.telling_words(slots, at, [lang for _, _, lang in rows])
    assert len(got[0]) == 6 and got[2] == want[2] == 2
    assert all(np.array_equal(a, b) for a, b in zip(got[:2], want[:2], strict=True))


def test_shortened_texts_answer_alike():
    rng = np.random.default_rng(4)
    model = toxicity.fit(*map(list, zip(*labelled(60, 5), strict=True)))
    model.words = np.vstack([np.zeros((1, toxicity.SIZE)), rng.standard_normal((9, toxicity.SIZE))]).astype(np.float32)
    sizes = [0, 1, 30, 200, 0, 7]
    rows = np.concatenate([rng.choice([0] * 20 + list(range(1, 10)), n) for n in sizes]).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    few, cuts = toxicity.short(rows, at)
    assert len(few) < len(rows) and few[few > 0].tolist() == rows[rows > 0].tolist()
    assert np.allclose(toxicity.logits(model, few, cuts), toxicity.logits(model, rows, at), atol=1e-5)
    full, cut = ([r[i:j] for i, j in zip(a[:-1], a[1:], strict=True)] for r, a in ((rows, at), (few, cuts)))
    assert np.allclose(np.maximum(toxicity.forward(model, full)[0], 0), np.maximum(toxicity.forward(model, cut)[0], 0))


@pytest.mark.parametrize("places", [1, 9])
def test_thresholds_of_tables_by_brute_force(spark, places):
    """The best F1 over all rows, over every threshold, for outputs with many ties and for outputs hardly apart."""
    rng = np.random.default_rng(places)
    n = 1500
    y, g = rng.integers(0, 2, n), rng.choice([0, 0, 0, 2, 2, 3], n)
    y[g == 3] = 0
    z = np.round(rng.standard_normal(n) * 10.0 ** -(places // 2) + y * 10.0 ** -(places // 2), places) + 0.0
    rows = spark.createDataFrame([(int(a), float(b), int(c), 1) for a, b, c in zip(g, z, y, strict=True)], "g int, z double, y long, n long")
    got = toxicity.best_thresholds(rows.groupBy("g", "z").agg(F.sum("y").alias("y"), F.sum("n").alias("n")), 3)

    def f1(sel, threshold):
        said = z[sel] >= threshold
        return 2 * (said & (y[sel] == 1)).sum() / max(1, said.sum() + y[sel].sum())

    for k in range(4):
        sel = g == k if k in (0, 2) else np.ones(n, bool)
        assert abs(f1(sel, got[k]) - max(f1(sel, t) for t in np.unique(z[sel]))) < 1e-12
    assert toxicity.best_thresholds(rows.where("y = 0"), 1).tolist() == [0, 0]


def test_shares_are_averaged(spark, monkeypatch):
    """An epoch over several shares by brute force: each alone, then the mean; of a word over the shares that hold it."""
    monkeypatch.setattr(toxicity, "SHARE", 40)
    rng = np.random.default_rng(6)
    fresh = toxicity.started(np.arange(1, 12) * 5, np.zeros(0, np.int64), np.zeros(0, np.int64), 0, rng)
    docs = [rng.integers(0, 12, rng.integers(0, 9)).astype(np.int32) for _ in range(100)]
    rows = spark.createDataFrame([(i, int(11 in d), bytearray(d.tobytes())) for i, d in enumerate(docs)], "k long, y int, w binary")
    shares = toxicity.shared_out(rows, 100)
    parts = shares.collect()
    assert len(parts) == 3 and sum(len(p.y) for p in parts) == 100
    moved, n, rest = np.zeros((12, toxicity.SIZE)), np.zeros(12), 0
    for p in parts:
        own = toxicity.replace(fresh, words=fresh.words.copy(), filters=[w.copy() for w in fresh.filters], out=fresh.out.copy(), bias=fresh.bias.copy())
        y, at, w = np.frombuffer(p.y, np.int8).astype(float), np.frombuffer(p["at"], np.int64), np.frombuffer(p.w, np.int32)
        toxicity.descend(own, toxicity.first_squares(own), [w[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], y, np.where(y == 1, 3.0, 1.0), np.random.default_rng([5, 0, p.b]).permutation(len(y)), 0.0)
        moved += own.words - fresh.words
        n[np.unique(w[w > 0])] += 1
        rest = rest + toxicity.flat_values(own, toxicity.first_squares(fresh)) - toxicity.flat_values(fresh, toxicity.first_squares(fresh))
    squares = toxicity.first_squares(fresh)
    want_words = fresh.words + moved / np.maximum(n, 1)[:, None]
    want = toxicity.flat_values(fresh, squares) + rest / 3
    toxicity.averaged(shares, fresh, squares, 3.0, 0, 5)
    learned = len(want) // 2
    assert np.allclose(fresh.words, want_words, atol=1e-6) and not fresh.words[0].any()
    assert np.allclose(toxicity.flat_values(fresh, squares)[:learned], want[:learned], atol=1e-6)


def test_partitions_and_order_have_no_say(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARE", 100)
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    docs, labels = toxic_tables(spark, [(t, y, "xx" if i % 2 else "yy") for i, (t, y) in enumerate(labelled(400, 8))])
    one, two = (toxicity.trained(docs.repartition(p).sortWithinPartitions("text" if p == 3 else "doc_id"), labels.repartition(p), "doc_id", "text", "toxic", "lang") for p in (1, 3))
    assert len(one.words) > 3 and np.array_equal(one.words, two.words) and np.array_equal(one.out, two.out) and np.array_equal(one.thresholds, two.thresholds)


def test_nothing_or_one_label_to_learn_from(spark):
    docs, labels = toxic_tables(spark, [("a b", 1, "en"), (None, 1, None), ("", 1, "en")])
    for given, says in ((labels, 1), (labels.limit(0), 0), (labels.withColumn("toxic", F.lit(0)), 0)):
        model = toxicity.trained(docs, given, "doc_id", "text", "toxic", "lang")
        assert {r.predicted for r in toxicity.classify(docs, "doc_id", "text", model).collect()} == {says}
    both = toxicity.trained(docs, labels.withColumn("toxic", F.when(F.col("doc_id") == 0, 1).otherwise(0)), "doc_id", "text", "toxic")
    assert toxicity.classify(docs, "doc_id", "text", both).count() == 3
