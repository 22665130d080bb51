import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from strataflow.llm import pieces, topk, warc
from strataflow.llm.common import fresh_path
from strataflow.llm.textnp import buffers

TEXTS = [
    "", "a", " ", "  ", "   x", "Hello  world\n\n\ttabs é ▁x", "naïve 日本語 梦 \U0001f600 zz\u0000q", "a" * 200, "aaaaaaa bbbbb " * 3, "    indented\n        code(x) { return  1; }", "\n", "ÿþ ʘ", "https://example.com/path?x=1&y=2",
    "1234567890 3.14159 --- === ****", " lead and trail ", "The quick brown fox, jumped! over the lazy dog's back; und die Straße — façade.",
]


@pytest.fixture(scope="module")
def model():
    return pieces.model_at()


def test_encoding_is_the_library_s(model):
    rng = random.Random(6)
    syllables = ["the", "an", "ion", "er", "é", "ß", "ou", "x", ".", ",", "\n", " ", "  ", "1", "ung", "ción", "-", "日"]
    texts = TEXTS + ["".join(rng.choices(syllables, k=rng.randint(1, 80))) for _ in range(300)]
    encoder = pieces.Encoder(model)
    data, offsets = buffers(pa.array(texts))
    ids, at = encoder.encode(data, offsets)
    want = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want
    back, ends = encoder.decode(ids, at)
    for i, t in enumerate(texts):
        assert back[ends[i] : ends[i + 1]].tobytes().decode() == t.replace("▁", " ")


def test_unigram_by_brute_force(model):
    """The same file read as a unigram model with scores of its own: every division of a word is tried."""
    rng = np.random.default_rng(3)
    m = pieces.model_at()
    m.kind, m.scores = pieces.UNIGRAM, rng.uniform(-12, -1, len(m.scores))
    known = {p.replace("▁", " "): s for p, s, t in zip(m.pieces, m.scores, m.types, strict=True) if t == pieces.NORMAL}
    low = m.scores[m.types == pieces.NORMAL].min() - pieces.UNKNOWN_PENALTY

    def best(word):
        top = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - 16), end):
                s = known.get(word[start:end], low if end - start == 1 else -np.inf)
                top[end] = max(top[end], top[start] + s)
        return top[-1]

    encoder = pieces.Encoder(m)
    for word in (" hello", " internationalisation", "x", " Straße", " naïve", "日本"):
        row = np.frombuffer(word.encode(), np.uint8)[None]
        ids, _ = encoder.viterbi(row)
        got = sum(low if i == m.unknown else m.scores[i] for i in ids[0] if i >= 0)
        assert abs(got - best(word)) < 1e-6, word


def test_piece_operator(spark, model):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids string")
    out = pieces.encoded(df, "text", model)
    assert out.columns == ["doc_id", "text", "ids", "n_pieces", "round_trip"]
    for r in out.collect():
        assert r.n_pieces == len(r.ids) and r.round_trip == ("▁" not in (r.text or ""))
    assert pieces.encoded(df.limit(0), "text", model).count() == 0
    with pytest.raises(ValueError):
        with open(pieces.MODEL, "rb") as f:
            pieces.load(f.read() + b"\x1a\x02\x20\x01")


def brute(vectors: dict, k: int) -> dict:
    out = {}
    for q, v in vectors.items():
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in vectors.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("scale", [8, 9 * 10**6, 10**9, 10**20])
def test_top_k_by_brute_force(spark, monkeypatch, scale):
    """Scores of all sizes: small ones, ones around 2^53, ones that round in floating point, ones beyond a long."""
    for name, value in (("BLOCK", 60), ("LEAST_BLOCK", 20), ("QUERIES", 4), ("LEAF", 8), ("SMALL", 2), ("TURN", 5)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(scale)
    vectors = {i: [int(float(rng.randint(-scale, scale))) for _ in range(6)] for i in range(180)}
    vectors |= {200 + i: vectors[0] for i in range(60)} | {300 + i: [0] * 6 for i in range(5)} | {400: [1, 2], 420: []}
    df = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in vectors.items()], "id long, v array<double>, score string")
    df = df.union(df.where("id in (0, 7)"))
    got: dict = {}
    for r in topk.top_k(df, df.where("id % 20 = 0"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    near = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    assert got == {q: [(i, near(s)) for i, s in found] for q, found in brute(vectors, 7).items()}


def test_vectors_of_any_size(spark):
    """Components of 2^53 and more are whole; scaling may make one infinite; huge and small vectors may meet."""
    parts = {0: [1e18, 1.0], 1: [1e20, -0.5], 2: [2.0**53 / 64, 0.99], 3: [1e300, 1.0], 4: [1.7e308, 0.0], 5: [-3e-5, 2.0], 20: [-1e-3, 3.0]}
    df = spark.createDataFrame([(i, v) for i, v in parts.items()], "vec_id long, e array<double>")
    rows = topk.whole(df, "vec_id", "e", 64)
    held = {r.id: [int(x) for x in r.v] for r in rows.collect()}
    assert set(held) == {0, 1, 2, 3, 5, 20} and held[0] == [int(1e18 * 64), 64] and held[1] == [int(1e20 * 64), -32] and held[2] == [2**53, 63] and held[20] == [-1, 192]
    got: dict = {}
    for r in topk.top_k(rows, rows.where("id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in found] for q, found in brute(held, 20).items()}


@pytest.mark.parametrize("spread,pruned", [(0.02, True), (10.0, False)])
def test_nodes_are_pruned_where_vectors_cluster(spark, monkeypatch, spread, pruned):
    """The share of all pairs that is multiplied, first pass left out: little in clusters, all of it without any."""
    monkeypatch.setattr(topk, "LEAST_BLOCK", 100)
    monkeypatch.setattr(topk, "BLOCK", 200)
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((20, 32))
    points = np.floor(64 * (centers[np.arange(2000) % 20] + spread * rng.standard_normal((2000, 32))))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(points.tolist())], "id long, v array<double>")
    asked = df.where("id % 20 = 0")
    found = topk.found_by(df, asked, 5)
    made = sum(r.products for r in found.collect()) / (2000 * 100)
    assert made < 0.2 if pruned else made > 0.9
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, asked, 5).collect()}
    want = brute({i: [int(x) for x in v] for i, v in enumerate(points.tolist())}, 5)
    assert got == {(q, n + 1): pair for q, pairs in want.items() for n, pair in enumerate(pairs)}


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, [1.0]), (1, None), (2, [nan]), (3, [inf]), (4, [None]), (None, [1.0]), (5, [0.99]), (6, [-0.001])], "vec_id long, e array<float>")
    assert {(r.id, r.v[0]) for r in topk.whole(df, "vec_id", "e", 64).collect()} == {(0, 64.0), (5, 63.0), (6, -1.0)}
    rows = topk.whole(df, "vec_id", "e", 64)
    assert [tuple(r) for r in topk.top_k(rows, rows.where("id = 0"), 20).collect()] == [(0, 1, 5, 4032), (0, 2, 6, -64)]
    assert topk.top_k(rows, rows.limit(0), 20).count() == 0 and topk.top_k(rows.limit(0), rows, 20).count() == 0


def test_cover_tree_covers():
    rng = np.random.default_rng(1)
    points = np.floor(rng.standard_normal((900, 5)) * 20)
    t = topk.Tree(points)
    assert sorted(t.order.tolist()) == list(range(900))
    for k, c in enumerate(t.center):
        own = points[t.order[slice(*t.span[k])]]
        assert np.sqrt(((own - points[c]) ** 2).sum(1)).max() <= t.radius[k] + 1e-9
    pivots = topk.net(points, 50)
    cell, far = topk.nearest(points, pivots)
    assert len(np.unique(pivots, axis=0)) == 50 and set(cell) == set(range(50))
    assert np.allclose(far, np.sqrt(((points[:, None] - pivots[None]) ** 2).sum(2)).min(1))


FAKE = "x" * 1500 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"


@pytest.mark.parametrize("size", ["128m", "1500", "350"])
def test_archives_round_trip(spark, size):
    """One archive, read by one task or by very many; what looks like records lies on the borders of their ranges."""
    pages = {1: FAKE, 2: FAKE, 3: None, 4: "", 5: "é" * 500, 6: "é" * 500, 7: FAKE + "WARC/1.1\r\nContent-Length: 50000\r\n\r\nabc", 8: "é" * 499, 9: "é" * 499}
    pages |= {10 + i: f"page {i} " * (i * 9) for i in range(12)}
    pages |= {60: "x\r\n\r\nWARC/1.1", 61: "WARC/1.1\r\n", 62: "\r\n\r\n", 63: "WARC/1.1\r\n" * 30, 64: "a" * 3000 + "WARC/1.1\r\n" + "b" * 3000}
    df = spark.createDataFrame([(i, "http://x/a b\r\n" if i % 9 else "http://x/WARC/1.1", h, "extra") for i, h in pages.items()], "page_id long, url string, html string, record_type string")
    path = fresh_path(spark, "warc")
    warc.write(warc.decided(df.coalesce(1), "page_id", "html"), path)
    old = [spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {int(r.record_id[10:-1]): r for r in warc.read(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert set(got) == set(pages)
    for i, h in pages.items():
        body = (h or "").encode()
        first = max(j for j, x in pages.items() if (x or "").encode() == body)
        if len(body) >= 1000 and first != i:
            assert got[i].record_type == "revisit" and got[i].refers_to == f"<urn:page:{first}>" and got[i].digest == "sha1:" + hashlib.sha1(body).hexdigest() and got[i].full_bytes == len(body)
        else:
            assert got[i].record_type == "response" and got[i].body_digest == hashlib.sha1(body).hexdigest() and got[i].body_bytes == len(body)


def test_what_is_decided(spark):
    long = "y" * 1200
    rows = [(1, long, "old"), (7, long, "old"), (7, long, "old"), (None, long, "old"), (None, None, "old"), (3, "short", "old"), (4, "short", "old")]
    df = spark.createDataFrame(rows, "page_id long, html string, refers_to string")
    out = warc.decided(df, "page_id", "html")
    assert out.columns == ["page_id", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in out.collect())
    assert got == [("1", 1200, "revisit", 7), ("3", 5, "response", None), ("4", 5, "response", None), ("7", 1200, "response", None), ("7", 1200, "response", None), ("None", 0, "response", None), ("None", 1200, "revisit", 7)]
    path = fresh_path(spark, "warc")
    none = df.limit(0).withColumn("url", df.html)
    warc.write(warc.decided(none, "page_id", "html"), path)
    assert warc.read(spark, path).count() == 0


def test_a_bad_archive_keeps_what_comes_before(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    wide = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 14\r\n\r\nabWARC/1.1\r\ncd%s"
    (tmp_path / "one.warc").write_bytes(record % 1 + record % 2 + b"garbage" + record % 3)
    (tmp_path / "two.warc").write_bytes(b"")
    (tmp_path / "three.warc").write_bytes(b"junk first " + record % 4)
    (tmp_path / "four.warc").write_bytes(record % 5 + wide % (6, b"\r\n\r\n") + wide % (7, b"....") + record % 8)
    (tmp_path / "five.warc").write_bytes(record % 9 + (record % 10)[:-1])
    (tmp_path / "six.warc").write_bytes(b"\xff\xfe" + record % 11)
    (tmp_path / "seven.warc").write_bytes(record % 12 + wide % (13, b""))
    assert sorted(int(r.record_id[10:-1]) for r in warc.read(spark, str(tmp_path)).collect()) == [1, 2, 5, 6, 9, 12]
