import random

import corpus_pipeline
import numpy as np
import pytest

from attesta.llm import shingles

from .conftest import AWKWARD, documents, prose


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def lowest(texts):
    """The smallest place reachable over links, by comparing all with all."""
    sets, low = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    return low


def test_near_copies_against_brute_force(spark):
    rng, texts = random.Random(6), []
    for s in range(25):
        base = prose(s + 1, 150).split()
        for _ in range(6):
            w = list(base)
            for k in rng.sample(range(len(w)), rng.choice([0, 1, 2, 3, 5])):
                w[k] = f"sub{rng.randrange(999)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    low = lowest(texts)
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r["doc_id"] for r in corpus_pipeline.near_copies_stage(spark, docs, "").collect()}
    assert got == {i for i, x in enumerate(low) if i == x} and len(got) < 80


@pytest.mark.parametrize("block", [9, 512])
def test_a_large_group_whose_links_are_few(spark, monkeypatch, block):
    """Texts that share keys with most others of their group, but are similar enough to some of them only."""
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng, texts = random.Random(7), []
    base = prose(3, 200).split()
    for _ in range(90):
        w = list(base) if not texts or rng.random() < 0.5 else rng.choice(texts).split()
        for k in rng.sample(range(len(w)), rng.choice([2, 4, 6, 8])):
            w[k] = f"sub{rng.randrange(99999)}"
        texts.append(" ".join(w))
    low = lowest(texts)
    rows = shingles.components(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(low))
    assert 5 < len(set(low)) < 85


def test_shared_shingles():
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, 60, n)) for n in sizes] for sizes in ((0, 5, 40, 90), (3, 0, 50)))
    for columns in (4096, 7):
        assert shingles.shared_shingles(a, b, columns).tolist() == [[len(set(x) & set(y)) for y in b] for x in a]


def test_keep_one_and_nothing(spark, awkward, nothing):
    assert shingles.keep_one(nothing).count() == 0
    kept = shingles.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= {1, 4, 5, 7, 10} and not ids & {2, 3, 6, 12}


def test_fingerprints_link_by_simhash(spark, tmp_path):
    """Texts whose fingerprints differ by two bits or fewer are connected, as by comparing all with all."""
    base, rng = prose(3, 4000).split(), random.Random(8)
    texts = [prose(s, 80) for s in range(8)]
    for _ in range(40):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.choice([1, 2, 3])):
            w[k] = f"sub{rng.randrange(99999)}"
        texts.append(" ".join(w))
    prints = [int(shingles.fingerprint(shingles.shingles(t))[0]) for t in texts]
    assert [int(shingles.keys_of(t)[-1]) for t in texts] == prints
    low = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= shingles.TAU:
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    nodes = spark.createDataFrame([(i, shingles.as_long(np.array([p], np.uint64))[0].item()) for i, p in enumerate(prints)], "th long, fp long")
    from attesta.operators.graph import connected_components

    edges = shingles.close_prints(nodes, f"file://{tmp_path}")
    for few in (0, 1000):
        got = {r["node"]: r["component"] for r in connected_components(edges, few=few).collect()}
        assert [got.get(i, i) for i in range(len(texts))] == low
    assert len(set(low)) < len(low) - 5
