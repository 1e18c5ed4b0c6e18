import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import embeddings, lines, simhash, substrings

from .conftest import AWKWARD, documents, prose


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(prints, tau=2):
    """Component of each distinct fingerprint by brute force."""
    nodes, root = sorted(set(prints)), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i:]:
            if bin(a ^ b).count("1") <= tau:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {a: find(a) for a in nodes}


def test_simhash_awkward(awkward):
    rows = simhash.simhash_components(awkward).collect()
    want = [(i, brute_fingerprint(x)) for i, x, *_ in AWKWARD]
    of = components([f for _, f in want])
    low = {}
    for i, f in want:
        if i is not None:
            low[of[f]] = min(low.get(of[f], i), i)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows]
    assert sorted(got, key=key) == sorted([(i, f, low.get(of[f])) for i, f in want], key=key)


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_connect_as_all_pairs_do(spark, bucket):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(40)}
    distinct = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    for choices in ((2,), (3,), (2, 3)):
        probes = simhash.plan_probes(distinct, 2, choices)
        edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(distinct, probes, 2, bucket).collect()]
        assert all(bin(a ^ b).count("1") <= 2 for a, b in edges)
        root = {x: x for x in prints}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert {x: find(x) for x in prints} == components(prints)


def test_thresholds_sum_and_cost_least():
    costs = [{-1: 0.0, 0: 5.0, 1: 50.0}, {-1: 0.0, 0: 100.0, 1: 200.0}, {-1: 0.0, 0: 7.0, 1: 20.0}]
    assert simhash.allocate(costs, 0) == (25.0, [0, -1, 1])


def test_keep_one_and_nothing(awkward, nothing):
    assert simhash.keep_one(nothing).count() == 0
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 4, 7, 10}


def distance(a, b):
    """Words to replace, add or leave out."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows, edits=1, min_words=5):
    """What stays of each (doc_id, text)."""
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows if t is not None})
    first = {}
    for d in docs:
        for k, line in enumerate(d[2].split("\n")):
            n = line.strip(" ").lower()
            if n:
                first.setdefault(n, (d, k))
    gone, seen = set(), []
    for n, at in sorted(first.items(), key=lambda x: (x[1][0][:2], x[1][0][2], x[1][1])):
        w = n.split(" ")
        if len(w) >= min_words:
            if any(distance(w, v) <= edits for v in seen):
                gone.add(at)
            seen.append(w)
    out = {}
    for d in docs:
        keep = [x for k, x in enumerate(d[2].split("\n")) if not x.strip(" ") or (first[x.strip(" ").lower()] == (d, k) and (d, k) not in gone)]
        out[d] = "\n".join(keep) if any(x.strip(" ") for x in keep) or not any(x.strip(" ") for x in d[2].split("\n")) else ""
    return out


@pytest.mark.parametrize(("edits", "run", "length"), [(1, 64, 14), (1, 4, 14), (1, 64, 5), (2, 64, 8), (0, 64, 6)])
def test_lines_against_brute_force(spark, monkeypatch, edits, run, length):
    monkeypatch.setattr(lines, "_RUN", run)
    rng = random.Random(2)
    base = [prose(s, length).split(" ") for s in range(12)]
    texts = []
    for i in range(60):
        some = []
        for _ in range(rng.randint(1, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2 + (edits > 1))):
                k = rng.randrange(len(w))
                rng.choice([lambda w=w, k=k: w.pop(k), lambda w=w, k=k: w.insert(k, f"new{rng.randrange(9)}"), lambda w=w, k=k: w.__setitem__(k, f"sub{rng.randrange(9)}")])()
            some.append(" ".join(w) if rng.random() < 0.9 else rng.choice(["", "short line", "Short Line "]))
        texts.append((i, "\n".join(some)))
    least = max(5, length - 2)
    got = {r["doc_id"]: r["kept_text"] for r in lines.dedup_lines(documents(spark, [(i, t, "en", "a") for i, t in texts]), edits, least).collect()}
    want = {d[1]: x for d, x in brute_lines(texts, edits, least).items()}
    assert got == want
    assert sum(x != t for (i, t), x in zip(texts, [want[i] for i, _ in texts], strict=True)) > 20


def test_no_link_is_lost_to_other_lines_of_the_same_pairs(spark):
    one, two = "x q q1 q2 q3 x p p1 p2 p3 x", "x p p1 p2 p3 x q q1 q2 q3 x"
    rows = [(1, one), (2, two), (3, two + " more"), (4, one[:-1] + "y"), (5, "share this page with 12 friends"), (6, "share this page with 15 friends"), (7, "page 1 of 9"), (8, "page 2 of 9")]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(documents(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0, 6: 1, 7: 0, 8: 0}


def test_edit_bounds_that_make_no_sense(awkward):
    with pytest.raises(ValueError, match="more words"):
        lines.dedup_lines(awkward, 2, 2)


def test_lines_awkward(awkward, nothing):
    rows = lines.dedup_lines(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by = [(r["doc_id"], r["text"], r["kept_text"], r["n_lines"], r["n_removed"]) for r in rows]
    assert all(k is None and n == 0 and g == 0 for _, t, k, n, g in by if t is None)
    same = [r for r in by if r[0] == 6]
    assert len(same) == 2 and same[0] == same[1] and same[0][4] == 1
    assert lines.dedup_lines(nothing).count() == 0
    kept = lines.drop_repeated_lines(awkward)
    assert kept.columns == awkward.columns and kept.schema.simpleString() == awkward.schema.simpleString()
    assert 6 not in {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_within_edits(spark, edits):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = [rng.choice("abc")] * rng.randint(0, 1)
        pairs.append((a, b))
    pairs = [(a, b) for a, b in pairs if a and b]
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", lines.within_edits("a", "b", edits).alias("ok")).collect()
    assert all(r["ok"] == (distance(r["a"], r["b"]) <= edits) for r in rows)


def brute_repeats(texts, window=35):
    count = Counter()
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for w in words:
        count.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for w in words:
        flag = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                flag[k : k + window] = [True] * window
        out.append((len(w), sum(flag), " ".join(x for x, f in zip(w, flag, strict=True) if not f)))
    return out


def test_substrings_awkward(awkward, nothing):
    got = sorted((r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(awkward).collect())
    assert got == sorted(brute_repeats([t for _, t, *_ in AWKWARD]))
    assert substrings.remove_repeats(nothing).count() == 0


def test_substrings_of_overlapping_passages(spark):
    rng = random.Random(8)
    passages = [prose(100 + s, rng.randint(20, 120)) for s in range(8)] + ["ha " * 50, "x y " * 30]
    texts = []
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.5 else prose(1000 + i * 7 + k, rng.randint(1, 40)) for k in range(rng.randint(1, 5))]
        w = " ".join(parts).split()
        a = rng.randrange(max(1, len(w) // 2))
        texts.append("\n".join(" ".join(w[j : j + 9]) for j in range(a, len(w), 9)))
    rows = substrings.remove_repeats(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows} == dict(enumerate(brute_repeats(texts)))
    words = [t.split() for t in texts]
    for r in rows:
        assert sum(f["length"] for f in r["factors"]) == r["n_removed"]
        for f in r["factors"]:
            own, there = (words[d][k : k + f["length"]] for d, k in ((r["doc_id"], f["start"]), (f["ref"], f["at"])))
            assert own == there and f["ref"] <= r["doc_id"]
    assert any(len(r["factors"]) > 1 for r in rows) and any(f["ref"] != r["doc_id"] and f["length"] > 40 for r in rows for f in r["factors"])


def test_greedy_parse():
    assert substrings.parse([]) == []
    assert substrings.parse([(3, 8, 1, 0), (4, 9, 1, 1), (5, 12, 2, 30), (20, 25, 1, 7)]) == [(3, 6, 1, 0), (9, 3, 2, 34), (20, 5, 1, 7)]
    assert substrings.parse([(0, 5, 2, 0), (0, 5, 1, 3), (5, 9, 9, 9)]) == [(0, 5, 1, 3), (5, 4, 9, 9)]


def test_anchor_is_a_function_of_the_window():
    h = np.random.default_rng(0).integers(0, 40, 400).astype(np.uint64)
    at, grams = substrings.anchors(h, 35, 8)
    for s in range(len(at)):
        part, own = substrings.anchors(h[s : s + 35], 35, 8)
        assert own[part[0]] == grams[at[s]] and s <= at[s] <= s + 27


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string, cell string, unit string")


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(900):
        v = base[rng.integers(60)] + rng.normal(size=16) * rng.choice([0.05, 0.15, 0.25])
        rows.append((i, [float(x) for x in np.float32(v)], int(rng.integers(3)), "z", "z", "z"))
    rows += [(2000 + k, rows[k][1], rows[k][2], "z", "z", "z") for k in range(10)] + [(3000 + k, rows[5][1], rows[5][2], "z", "z", "z") for k in range(30)]
    odd = [(4000, None, 1), (4001, [0.0] * 16, 1), (4002, [float("nan")] + [1.0] * 15, 1), (4003, [None] + [1.0] * 15, 1), (4004, rows[0][1], None), (4005, [], 1), (4006, [1.0, 2.0], 1), (4007, [float("inf")] * 16, 0), (4008, [2.0, 4.0], 1)]
    rows += [(*x, "z", "z", "z") for x in odd]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(vectors(spark, rows)).collect()}
    assert len(got) == len(rows)
    usable = [r for r in rows if r[0] < 4000]
    x = np.array([r[1] for r in usable], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in usable])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    n = link.sum(axis=1)
    found = np.array([got[r[0]]["n_links"] for r in usable])
    assert (found <= n).all() and found.sum() >= 0.99 * n.sum()
    for i in (4000, 4001, 4002, 4003, 4004, 4005, 4007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[4006]["n_links"] == 1 and got[4008]["component_id"] == 4006
    assert got[3000]["component_id"] == got[5]["component_id"] and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("least", [1, 10**9])
def test_embeddings_when_the_sample_is_a_small_part(spark, monkeypatch, least):
    monkeypatch.setattr(embeddings, "SAMPLE", 400)
    monkeypatch.setattr(embeddings, "PROBED", 100)
    monkeypatch.setattr(embeddings, "OCCUPANCY", 4)
    monkeypatch.setattr(embeddings, "LEAST_PAIRS", least, raising=False)
    rng, rows = np.random.default_rng(3), []
    for i in range(2000):  # pairs of cosine 0.935
        v, w = rng.normal(size=(2, 32))
        v /= np.linalg.norm(v)
        w -= w @ v * v
        w = 0.935 * v + np.sqrt(1 - 0.935**2) * w / np.linalg.norm(w)
        rows += [(2 * i + k, [float(c) for c in x], i % 2, "z", "z", "z") for k, x in enumerate((v, w))]
    got = [r["n_links"] for r in embeddings.near_duplicates(vectors(spark, rows)).collect()]
    assert len(got) == 4000 and max(got) == 1 and sum(got) >= (0.99 if least == 1 else 1) * 4000


def test_embeddings_of_nothing(spark):
    assert embeddings.near_duplicates(vectors(spark, [])).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    a, b = rng.random(7), rng.random(5)
    cells = embeddings.multi_sequence(a, b, 20)
    want = sorted(((a[i] + b[j]), i, j) for i in range(7) for j in range(5))[:20]
    assert np.allclose([a[i] + b[j] for i, j in cells], [w[0] for w in want])


def test_kept_text_hash_is_stable(awkward):
    row = substrings.remove_repeats(awkward).where("doc_id = 4").select(F.sha2("kept", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"One.").hexdigest()
