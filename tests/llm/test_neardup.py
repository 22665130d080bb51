import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataflow.llm import components, neardup


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def roots(texts: dict, k: int) -> dict:
    sets = {d: shingles(t, k) for d, t in texts.items()}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed: int) -> dict:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts: dict = {1: None, 2: "", 3: " \n", 4: "One", 5: "one ", 6: "a b", 7: "A  B", 8: "a b c", 9: "x y z x y z x y z"}
    n = 10
    for _ in range(12):
        seed_words = rng.choices(vocabulary, k=rng.randint(5, 120))
        for _ in range(rng.randint(1, 9)):
            words = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06, 0.1]) else w for w in seed_words]
            texts[n] = (" " if rng.random() < 0.5 else "\n").join(words)
            n += rng.randint(1, 3)
    return texts


@pytest.mark.parametrize("k,block", [(2, 128), (5, 128), (2, 4)])
def test_links_by_brute_force(spark, monkeypatch, k, block):
    """Small blocks make the tiles of several blocks run."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = corpus(k)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component) for r in neardup.near_duplicates(df, "doc_id", "text", k).collect()}
    assert got == roots(texts, k)


def test_a_large_family_with_many_variants(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(8)
    words = [f"v{i}" for i in range(150)]
    texts = {i: " ".join(f"x{rng.random()}" if rng.random() < 0.001 * (i % 60) else w for w in words) for i in range(150)}
    texts |= {1000 + i: texts[0] for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: r.component for r in neardup.near_duplicates(df, "doc_id", "text", 2).collect()}
    assert got == {d: c for d, (_, c) in roots(texts, 2).items()}
    kept = neardup.deduplicate(df, "doc_id", "text", 2)
    assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == set(got.values())


def test_text_that_a_family_shares_makes_no_pairs(spark, monkeypatch):
    """A family of 400 classes with most words in common, none of them linked but for a few late pairs."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    counted = []
    confirmed = neardup.confirmed
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, *more: (counted.append(pairs.count()), confirmed(pairs, *more))[1])
    shared = [f"s{i}" for i in range(160)]
    texts = {i: " ".join([*shared, *(f"own{i}x{j}" for j in range(60))]) for i in range(400)}
    texts |= {1000 + i: texts[i * 7] + f" tail{i}" for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: r.component for r in neardup.near_duplicates(df, "doc_id", "text", 2).collect()}
    assert got == {**{i: i for i in range(400)}, **{1000 + i: i * 7 for i in range(20)}}
    assert len(counted) == 3 and sum(counted[1:]) < 200, "of 88,000 pairs of the family"


def test_null_keys_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (None, "a b c", 2), (3, "a b c", 3), (3, "a b c", 4), (4, "A B  C", 5)], "doc_id long, text string, root long")
    got = sorted(r.root for r in neardup.deduplicate(df, "doc_id", "text").collect())
    assert got == [1, 2, 3, 4], "rows without a key stay, rows of one key and text stay together"
    assert neardup.deduplicate(df.limit(0), "doc_id", "text").count() == 0
    found = sorted(map(tuple, neardup.near_duplicates(df, "doc_id", "text").collect()), key=str)
    assert found == [(3, 1, 3), (3, 1, 3), (4, 1, 3), (None, 1, None), (None, 1, None)]
    with pytest.raises(ValueError):
        neardup.near_duplicates(df, "doc_id", "text", percent=70)


def test_no_text_is_lost_where_keys_repeat(spark):
    df = spark.createDataFrame([(5, "x y"), (7, "x y"), (7, "only here"), (7, "only here"), (8, "Only HERE")], "id long, component string").withColumn("n", F.lit(1))
    kept = neardup.deduplicate(df, "id", "component").collect()
    assert kept[0].asDict().keys() == {"id", "component", "n"}
    assert sorted({r.component.lower() for r in kept}) == ["only here", "x y"] and len(kept) in (2, 3)
    of = {(r.id, r.n_shingles, r.component) for r in neardup.near_duplicates(df, "id", "component", 2).collect()}
    assert of == {(5, 1, 5), (7, 1, 5), (7, 1, 7), (8, 1, 7)}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    consts = neardup.constants()
    for share, low, high in ((0.95, 0, 40), (0.8, 25, neardup.MOST_BITS), (0.4, neardup.MOST_BITS, 600)):
        both = int(2000 * share)
        pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        extra = (2000 - both) // 2
        a, b = np.sort(pool[: both + extra]), np.sort(np.concatenate([pool[:both], pool[both + extra : both + 2 * extra]]))
        _, s = neardup.sketched(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), consts)
        assert low <= int(np.bitwise_count(s[0] ^ s[1]).sum()) <= high


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
def test_components(spark, edges):
    up = {x: x for e in edges for x in e}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
