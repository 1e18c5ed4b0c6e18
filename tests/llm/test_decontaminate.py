import random
import re
import time

import pytest

from attesta.llm import decontaminate as d

from .conftest import AWKWARD, documents, prose

TRAIN = "A train leaves London at 60 km per hour and Alice boards it after 3.5 hours. How far does it travel before noon?"
LONG = TRAIN + " The train stops for as long as it takes to load all of the bags and the mail."
ITEMS = [(1, TRAIN), (2, "two words"), (3, None), (4, ""), (5, prose(77, 40)), (6, "three words here"), (None, prose(78, 40))]


def found(items, text):
    key = lambda x: (x[0] is None, x[0] or 0)
    return sorted(((i, r) for i, _, _, r in d.leaks_of(text, [(i, d.Item(x)) for i, x in items])), key=key)


@pytest.mark.parametrize(
    ("text", "leaked"),
    [
        (f"Before. {TRAIN} After.", [(1, False)]),
        (TRAIN.lower(), [(1, False)]),
        ("So: a train leaves Paris at 75 km per hour and Bob boards it after 2 hours. How far does it travel before noon?", [(1, True)]),
        ("So: a train leaves Paris at 75 km per hour and Bob quickly boards it after 2 hours. How far does it travel before noon?", [(1, True)]),
        ("A train leaves Paris at 75 km per hour and Paris boards it after 75 hours. How far does it travel before noon?", []),
        ("A train leaves London at 60 km per hour.", []),
        ("He said two words, twice.", []),
        ("Two  words.", [(2, False)]),
        ("three\nwords, here and there", [(6, False)]),
        ("three words are here", []),
        (prose(77, 40).replace(" ", "\n"), [(5, False)]),
        (prose(77, 38), [(5, False)]),
        (prose(77, 20), []),
        (prose(78, 40) + " " + prose(77, 40), [(5, False), (None, False)]),
        (None, []),
        ("", []),
    ],
)
def test_leaks_of_a_text(text, leaked):
    assert found(ITEMS, text) == leaked


@pytest.mark.parametrize(
    ("text", "leaked"),
    [
        ("So: a train leaves Paris at 75 km per hour and then Bob boards it after 2 hours. How far does it travel before noon?", [(1, True)]),
        ("So: a train leaves New  York at 75 km per hour and Bob Lee boards it after 2 hours. How far does it travel before noon?", [(1, True)]),
        ("So: a train leaves Paris at 75 km per hour and then Paris boards it after 75 hours. How far does it travel before noon?", []),
    ],
)
def test_words_added_to_other_values(text, leaked):
    assert found([(1, LONG)], text + LONG[len(TRAIN) :]) == leaked


@pytest.mark.parametrize(
    ("item", "text", "leaked"),
    [
        ("42", "There are 7 days in it.", []),
        ("42", "There are 42 days in it.", []),
        ("1 2 3 4 5", "5 6 7 8 9 and 1 2 3 4", []),
        ("1 2 3 4 5", "so 1 2 3 4 5 it is", [(1, False)]),
        ("What is 12 + 30?", "Tell me what is 5 and then 9. what is 7 8 ok", []),
        ("What is 12 + 30?", "Tell me what is 5 + 9. What is 12 + 30?", [(1, False)]),
        ("60 plus 60", "3 plus 4 and then 60 plus 60", [(1, False)]),
        ("60 plus 60", "3 plus 4 and then 60 plus 61", []),
        ("Paris", "Then Anna left", []),
    ],
)
def test_items_of_few_words_leak_with_equal_values_only(item, text, leaked):
    assert found([(1, item)], text) == leaked


def test_names_that_begin_sentences():
    item = "Alice buys 12 pens at a shop. Alice gives 5 of them to Carl. Alice then loses 2 on the way. Alice counts 3 pens left. Alice sells 4 pens."
    leak = item.replace("Alice", "Bob").replace("Carl", "Dora").replace("12", "40").replace("5", "7").replace("2 ", "9 ").replace("3", "6").replace("4 ", "8 ")
    assert found([(1, item)], leak) == [(1, True)]
    assert found([(1, item)], leak.replace("Bob gives", "Dora gives").replace("Bob counts", "Eva counts").replace("Bob sells", "Max sells")) == []


def test_an_item_met_twice_at_odds_and_then_in_order():
    wrong = TRAIN.replace("London", "Paris").replace("Alice", "Paris").replace("60", "8").replace("3.5", "8")
    right = TRAIN.replace("London", "Rome").replace("Alice", "Bob")
    assert found([(1, TRAIN)], wrong + " x " * 50 + right) == [(1, True)]
    assert found([(1, TRAIN)], wrong + " x " * 50 + wrong) == []


def test_tables_of_numbers_take_linear_time():
    item = d.Item("numbers " + " ".join(str(i * 7) for i in range(4000)))
    began = time.perf_counter()
    assert d.leaks_of("values " + " ".join(str(i * 11) for i in range(100_000)), [(1, item)]) == []
    repeated = d.Item("the cat has 3 red hats and " * 300)
    assert d.leaks_of("the cat has 5 red hats and " * 5000, [(1, repeated)]) == [(1, 2100, 2100, True)]
    assert time.perf_counter() - began < 20


def naive(text):
    """Words of a text by type and value, with patterns; no joined names."""
    out = []
    for w in re.findall(r"\d+(?:[.,:/]\d+)*|[A-Za-z]+", text or ""):
        kind = "#" if w[0].isdigit() else "U" if out and out[-1][0] == "#" and w.lower() in d.UNITS else "N" if w[0].isupper() and w.lower() not in d.OPENERS else w.lower()
        out.append((kind, w.lower()))
    return out


def test_templates():
    def kinds(text, kind=d.NAMED):
        return "".join({1: "#", 2: "N", 3: "U"}.get(int(x), "w") for x in d.Template(text).form(kind)[0])

    assert kinds("The pump moved 3,500 kg for Anna. Then 7 hours later Élodie left") == "www#UwNw#UwNw"
    assert kinds("The pump moved 3,500 kg for Anna Lee", d.PLAIN) == "www#Uwww" and kinds("for Anna  Lee, Bob") == "wNN"
    assert kinds("hours are long") == "www"
    a, b = d.Template("Été wird ÄRGER"), d.Template("été wird ärger")
    assert a.words[0] == b.words[0] and a.words[2] == b.words[2]
    assert len(d.Template(None).words) == 0
    rng = random.Random(1)
    for _ in range(50):
        text = " , ".join(rng.choice(["Anna", "bob", "The", "12", "3.5", "km", "hours", "red", "For"]) for _ in range(30))
        want = naive(text)
        template, values = d.Template(text).form(d.NAMED)
        assert ["w" if x > 3 else "#NU"[int(x) - 1] for x in template] == [k if k in "#NU" else "w" for k, _ in want]
        assert len({(int(v), w) for v, (_, w) in zip(values, want, strict=True)}) == len({w for _, w in want})


def test_slabs_do_not_cut_words(monkeypatch):
    text = prose(5, 3000)
    whole = d.Template(text).words
    monkeypatch.setattr(d, "_SLAB", 512)
    assert (d.Template(text).words == whole).all()


def test_leaks_in_documents(spark, awkward, nothing):
    bench = spark.createDataFrame([*ITEMS, (5, prose(77, 40)), (9, prose(2, 90)), (10, prose(9, 30_000)[-600:])], "item_id long, text string")
    rows = d.leaks(awkward, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(7, 9), (8, 9), (10, 10)]
    kept = d.clean(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 3
    assert d.leaks(nothing, bench).count() == 0 and d.leaks(awkward, bench.where("false")).count() == 0
    assert d.clean(awkward, bench.where("false")).count() == len(AWKWARD)


def mangled(rng, text):
    """A text with other values, some words added, left out or moved, or none of these."""
    words = text.split()
    swap = {w: rng.choice([w, str(rng.randrange(2, 99)), w]) if w.isdigit() else rng.choice([w, w, "Zoe", "Max"]) if w.istitle() else w for w in words}
    words = [swap[w] if rng.random() < 0.95 else w for w in words]
    for _ in range(rng.choice([0, 0, 1, 2, 6])):
        k = rng.randrange(max(1, len(words)))
        words[k : k + 1] = rng.choice([[], [*words[k : k + 1], "also"], ["other"]])
    return " ".join(words)


def test_join_finds_what_trying_every_item_finds(spark):
    rng = random.Random(9)
    vocabulary = "the red cat runs home with some green hats but no dog sees it from far away Alice Bob Carla 3 17 60 km hours".split()
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 12, 30, 60]))) for _ in range(120)]
    items = [(i, x) for i, x in enumerate(made)] + [(500, made[3]), (501, " ".join(str(i) for i in range(30)))]
    texts = [" ".join([prose(i, 20)] * rng.choice([0, 1]) + [mangled(rng, x) for x in rng.sample(made, rng.choice([1, 2, 3]))]) for i in range(250)]
    texts += [rng.choice(made) for _ in range(20)] + [" ".join(str(i) for i in range(40)), made[0] + "\n" + made[1]]
    rows = documents(spark, [(i, x, "en", "a") for i, x in enumerate(texts)])
    ready = [(i, d.Item(x)) for i, x in items]
    want = {(k, *x) for k, text in enumerate(texts) for x in d.leaks_of(text, ready)}
    got = [tuple(r) for r in d.leaks(rows, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 200 and {x[4] for x in want} == {False, True}


def test_all_windows_of_a_bit_table_are_found(spark):
    grams = [(-1,), (0,), (1 << 62,), (-(1 << 63),), *((i * 0x9E3779B97F4A7C1 % (1 << 63),) for i in range(500))]
    table = d.bit_table(spark.createDataFrame(grams, "gram long"), len(grams))
    import numpy as np

    assert d.maybe(table, np.array([g[0] for g in grams], np.int64).view(np.uint64)).all()
    other = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert d.maybe(table, other).mean() < 0.01
