import hashlib
import random
import re
from collections import Counter

import pytest
import sentencepiece
from test_neardup import roots
from test_sharding_mixing import filled

import corpus_pipeline
from strataflow.llm import pieces
from strataflow.llm.common import cut


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    words = {"en": ["the", "of", "and", "thing", "work", "ring", "when", "hope"], "de": ["der", "und", "nicht", "straße", "ühl", "schön", "gehen", "zeit"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "en", "t"]) for _ in range(rng.randint(30, 90))), lang if i % 7 else None, f"s{i % 3}" if i % 5 else None))
    rows += [(100, rows[1][1], "en", "s0"), (101, rows[1][1].upper(), "en", "s1"), (102, rows[3][1] + " extra", "en", "s1"), (103, None, "en", "s0"), (104, "123 456", "en", "s0"), (105, "", None, None)]
    rows += [(106, rows[5][1] + " password=hunter22x " + rows[7][1], "en", "s2")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near-duplicates", "secrets", "mixing", "pieces"]
    step, before = docs, {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        step = cut(stage(spark, step, ""), name)
        kept[name] = step.collect()
        if name != "pieces":
            assert step.columns == docs.columns
    assert {r.doc_id for r in kept["language"]} == set(before) - {103, 104, 105} and all(r.lang for r in kept["language"])
    assert {r.doc_id for r in kept["near-duplicates"]} == {r.doc_id for r in kept["language"]} - {100, 101, 102}
    masked = {r.doc_id: r for r in kept["secrets"]}
    assert "hunter22x" not in masked[106].text and masked[106].n_chars == len(masked[106].text) and masked[1].text == before[1].text
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for d, r in masked.items()}
    copies = [r.doc_id for r in kept["mixing"]]
    assert set(copies) <= set(masked) and max(copies.count(d) for d in set(copies)) <= 2
    assert abs(sum(size[d] for d in copies) - 1.5 * sum(size.values())) < 4 * max(size.values())
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert sorted(r.doc_id for r in kept["pieces"]) == sorted(copies)
    assert all(r.ids == lib.encode(masked[r.doc_id].text) and r.round_trip for r in kept["pieces"])


def test_deduplication_and_mixing_by_brute_force(spark, docs):
    """What the second and the fourth stage keep, from plain sets of shingles and plain sums."""
    named = cut(corpus_pipeline.identify_language(spark, docs, ""), "language")
    kept = corpus_pipeline.drop_near_duplicates(spark, named, "")
    texts = {r.doc_id: r.text for r in named.collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, root) in roots(texts, 5).items() if root == d)
    masked = cut(corpus_pipeline.mask_secrets(spark, kept, ""), "secrets")
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in masked.collect()}
    source = {r.doc_id: r.source for r in masked.collect()}
    whole = {s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())}
    order = sorted((s for s in whole if s is not None), key=lambda s: s.encode()) + [s for s in whole if s is None]
    targets = filled(whole, {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    want: Counter = Counter()
    for s in whole:
        budget, before = int(targets[s] + 1e-9), 0
        epochs = budget // whole[s]
        for d in sorted((d for d in size if source[d] == s), key=lambda d: int(hashlib.md5(f"mix/{d}".encode()).hexdigest()[:12], 16)):
            taken = epochs * size[d] + max(0, min(size[d], budget - epochs * whole[s] - before))
            before += size[d]
            want[d] += int(taken / size[d] + 0.5)
    assert Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, masked, "").collect()) == +want


def test_empty_documents(spark, docs):
    step = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        step = cut(stage(spark, step, ""), name)
        assert step.count() == 0
