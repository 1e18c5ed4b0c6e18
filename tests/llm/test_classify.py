import math
import random
import zlib

import numpy as np
import pytest

from attesta.llm import language, quality, toxicity

from .conftest import AWKWARD, documents, prose


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, source string")


def test_features_hold_words_pairs_and_skips():
    one = set(toxicity.features("a b c").tolist())
    assert len(one) == 3 + 2 + 1
    assert set(toxicity.features("A, b! C").tolist()) == one
    assert len(toxicity.features(None)) == len(toxicity.features("")) == 0
    assert len(toxicity.features("a")) == 1 and len(toxicity.features("a b")) == 3
    assert len(toxicity.features("abcde")) == 2 and len(set(toxicity.features("abcdef").tolist()) & set(toxicity.features("abcdxy").tolist())) == 1


def test_ftrl_is_sparse_and_learns():
    rng = random.Random(1)
    model = toxicity.Ftrl(10, alpha=1.0, l1=2.0)
    for _ in range(600):
        y = rng.random() < 0.3
        model.learn(np.array(sorted({rng.randrange(100, 1000) for _ in range(20)} | ({7} if y else set()))), int(y))
    at, w = model.weights()
    assert 7 in at and w[list(at).index(7)] > 2 and len(at) < 200


def test_toxicity_on_rows_held_out(spark, nothing):
    rng = random.Random(3)
    bad = ["zorgle", "blimpf", "quaxar"]
    docs, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.3
        w = prose(i, 60).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad).upper() + rng.choice(["", ",", "!!"]))
        docs.append((i, " ".join(w), "en", "a"))
        if rng.random() < 0.8:
            labels.append((i, 1, int(toxic), "t", "s"))
    rows = toxicity.toxicity(documents(spark, docs), labelled(spark, [*labels, labels[0], (None, 1, 1, "t", "s"), (10_000, 1, None, "t", "s")])).collect()
    assert len(rows) == 900
    known = {i: t for i, _, t, *_ in labels}
    tests = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == known[r["doc_id"]] for r in tests) >= 0.95 * len(tests)
    assert toxicity.toxicity(nothing, labelled(spark, labels)).count() == 0


def test_toxicity_awkward(spark, awkward):
    rows = toxicity.toxicity(awkward, labelled(spark, [])).collect()
    assert len(rows) == len(AWKWARD) and {r["score"] for r in rows} == {0.5}
    rows = toxicity.toxicity(awkward, labelled(spark, [(i, 1, i % 2, "t", "s") for i in range(1, 13)])).collect()
    assert len(rows) == len(AWKWARD) and not any(math.isnan(r["score"]) for r in rows)


TEXTS = {"en": "the cat sat on the mat and then it went to the house with the others", "de": "der hund und die katze sind nicht in dem haus aber auch nicht auf der strasse",
         "fr": "le chat est dans la maison et les autres sont avec une personne que nous connaissons", "es": "el perro y los gatos no son de la casa pero una persona los tiene en el campo"}


def tongue(seed, lang, n=25):
    rng = random.Random(seed)
    return " ".join(rng.choice(TEXTS[lang].split()) for _ in range(n))


def test_language_by_text_and_surroundings(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        lang = rng.choice(list(TEXTS))
        said = lang if rng.random() < 0.9 else rng.choice([None, "xx", "en"])
        rows.append((i, tongue(i, lang, rng.choice([2, 25])), said, lang + "-host"))
    rows += [(1000, "", None, "de-host"), (1001, None, None, "fr-host"), (1002, "12345 !!! ###", None, "es-host"), (1003, "жяъ щфы юьэ цкж шщч эюя", None, "en-host"), (1004, tongue(1, "de"), "en", "new-host")]
    got = {r["doc_id"]: r for r in language.identified_documents(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    right = sum(got[i]["language"] == host[:2] for i, _, _, host in rows[:400])
    assert right >= 0.98 * 400 and all(got[i]["kept"] for i, t, *_ in rows[:400] if len(t.split()) > 2)
    assert [got[i]["language"] for i in (1000, 1001, 1002)] == ["de", "fr", "es"] and not any(got[i]["kept"] for i in (1000, 1001, 1002))
    assert got[1003]["language"] == language.OTHER and not got[1003]["kept"]
    assert got[1004]["language"] == "de"


def test_surroundings_help_where_texts_are_short(spark):
    rng = random.Random(6)
    rows = []
    for i in range(800):
        lang = rng.choice(list(TEXTS))
        said = rng.choice([lang, lang, lang, None, "xx"]) if i % 2 else lang
        text = tongue(i, lang, 25) if i % 2 == 0 else rng.choice(["in de", "a la", "de", "en", "el", "die", "es", "le", "is", "and"])
        rows.append((i, text, said, f"h{rng.randrange(3)}.example.{lang}"))
    got = {r["doc_id"]: r for r in language.identified_documents(documents(spark, rows)).collect()}
    short = [(got[i], host[-2:]) for i, _, _, host in rows if i % 2]
    text_alone, fused = (sum(r[c] == lang for r, lang in short) / len(short) for c in ("by_text", "language"))
    assert fused > text_alone + 0.3 and fused > 0.7


def test_posterior_is_bayes_rule(spark):
    """The fused posterior of every row against the same sums in numpy."""
    rng = random.Random(7)
    rows = [(i, tongue(i, lang, rng.randint(1, 4)), rng.choice([lang, lang, None, "xx"]), f"{lang if rng.random() < 0.8 else 'zz'}{rng.randrange(2)}.{lang}") for i in range(160) for lang in [list(TEXTS)[i % 4]]]
    rows += [(1000, None, "de", "de0.de"), (1001, "", None, None)]
    docs = language.document_rows(documents(spark, rows))
    languages = language.languages_of(docs)
    table = language.fit(docs, languages)
    got = {r["doc_id"]: r for r in language.identify(docs, ["doc_id"], languages, table).collect()}
    ll = np.array([language.TEMPER * sum((table[c].sum(axis=0, dtype=float) for c in language.trigrams(t)), np.zeros(5)) for _, t, *_ in rows])
    seen = np.array([any(len(c) for c in language.trigrams(t)) for _, t, *_ in rows])
    p = np.exp(ll - ll.max(axis=1, keepdims=True))
    p = p / p.sum(axis=1, keepdims=True) * seen[:, None]
    said = [None if x is None else x if x in languages else "und" for _, _, x, _ in rows]
    suffix = [h and h.split(".")[-1] for *_, h in rows]
    host = [h for *_, h in rows]
    add = lambda keys, k: sum((v for x, v in zip(keys, p, strict=True) if x == k), np.zeros(5))
    corpus = (p.sum(axis=0) + 1) / (p.sum(axis=0) + 1).sum()
    for i, (doc, *_) in enumerate(rows):
        of_suffix = add(suffix, suffix[i]) + language.SUFFIX_WEIGHT * corpus
        prior = np.maximum(add(host, host[i]) - p[i], 0) + language.HOST_WEIGHT * of_suffix / of_suffix.sum()
        e = 0 if said[i] is None else np.log((add(said, said[i]) + 0.5) / (p.sum(axis=0) + 0.5 * len(set(said))))
        w = ll[i] + e + np.log(prior / prior.sum())
        post = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
        assert got[doc]["posterior"] == pytest.approx(post.max(), rel=1e-6) and got[doc]["language"] == [*languages, "und"][int(post.argmax())]


def test_language_awkward(awkward, nothing):
    rows = language.identified_documents(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(0 < r["posterior"] <= 1 for r in rows)
    kept = language.keep_identified(awkward)
    assert kept.columns == awkward.columns and kept.where("text is null").count() == 0
    assert language.identified_documents(nothing).count() == 0 and language.keep_identified(nothing).count() == 0


def test_language_of_pages(spark):
    taught = language.document_rows(documents(spark, [(i, tongue(i, lang), lang, "h") for i in range(200) for lang in [list(TEXTS)[i % 4]]]))
    languages = language.languages_of(taught)
    assert languages == ("de", "en", "es", "fr")
    page = "<html lang='{}'><script>var the='the the the the';</script><!-- the the --><body><p>{}</p>&amp;</body></html>"
    rows = [(i, f"https://{lang}{i % 3}.example.{lang}/{lang}/x", page.format(lang + "-XX", tongue(900 + i, lang, 3))) for i in range(60) for lang in [list(TEXTS)[i % 4]]]
    rows += [(100, None, None), (101, "nonsense", "<p>" + tongue(5, "fr") + "</p>"), (102, "http://de1.example.de/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["language"] for r in language.identify(language.page_rows(pages), ["page_id"], languages, language.fit(taught, languages)).collect()}
    assert all(got[i] == list(TEXTS)[i % 4] for i in range(60)) and got[101] == "fr" and got[102] == "de" and len(got) == 63


def test_quality_leans_on_its_site_as_far_as_sites_differ(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(800):
        site = rng.choice(["good", "bad"])
        poor = rng.random() < (0.9 if site == "bad" else 0.1)
        text = " ".join(w.upper() + "!!" for w in prose(i, 30).split()) if poor else prose(i, 40)
        docs.append((i, text, "en", site))
        labels.append((i, int(not poor), 0, "t", "s"))
    docs += [(9000, "word", "en", "bad"), (9001, "word", "en", "good"), (9002, "word", "en", "unseen")]
    got = {r["doc_id"]: r for r in quality.graded_documents(documents(spark, docs), labelled(spark, labels)).collect()}
    fold = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["kept"] == bool(labels[i][1]) for i in fold) >= 0.97 * len(fold)
    assert got[9000]["section_mean"] < got[9002]["section_mean"] < got[9001]["section_mean"]
    assert got[9000]["score"] < got[9002]["score"] < got[9001]["score"]


def test_quality_is_what_the_sums_give(spark):
    """Scores against the same posteriors in numpy, sections centred on their site."""
    rng = random.Random(8)
    rows = [(i, prose(i, 20) if rng.random() < 0.5 else prose(i, 20).upper() + " !! !!", rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(300)]
    docs, labels = documents(spark, rows), labelled(spark, [(i, int(t[0].islower()), 0, "t", "s") for i, t, *_ in rows])
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.graded_documents(docs, labels).collect()}
    e = np.array([1 / (1 + np.exp(-(model[0][quality.features(t)].sum() + model[1]))) for _, t, *_ in rows])
    site, section = np.array([str(s) for *_, s in rows]), np.array([f"{s}/{x}" for _, _, x, s in rows])
    mean = e.mean()

    def weight(keys, centre, parents):
        groups = [(keys == k) for k in sorted(set(keys))]
        m = np.array([centre[g][0] for g in groups])
        n = np.array([g.sum() for g in groups])
        between = sum(g.sum() * (e[g].mean() - c) ** 2 for g, c in zip(groups, m, strict=True))
        spread = max(1e-9, (between - (m * (1 - m)).sum() * (1 - parents / len(groups))) / n.sum())
        return float(np.clip((n * m * (1 - m)).sum() / n.sum() / spread - 1, quality.LEAST_WEIGHT, quality.MOST_WEIGHT))

    own = np.array([e[site == s].mean() for s in site])
    ws, wc = weight(site, np.full(len(e), mean), 1), weight(section, own, len(set(site)))
    odds = lambda x: math.log(min(max(x, quality.EDGE), 1 - quality.EDGE) / (1 - min(max(x, quality.EDGE), 1 - quality.EDGE)))
    for i in range(len(rows)):
        s, c = site == site[i], section == section[i]
        of_site = (e[s].sum() - e[i] + ws * mean) / (s.sum() - 1 + ws)
        of_section = (e[c].sum() - e[i] + wc * of_site) / (c.sum() - 1 + wc)
        assert got[i]["section_mean"] == pytest.approx(of_section, rel=1e-6)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(odds(e[i]) + odds(of_section) - odds(mean)))), rel=1e-6)


def test_sections_are_pulled_to_their_site(spark):
    even = spark.createDataFrame([("a", 50.0, 1000, 0.05), ("a", 50.0, 1000, 0.05), ("b", 950.0, 1000, 0.95), ("b", 950.0, 1000, 0.95)], "site string, k double, n long, m double")
    assert quality.pull(even, 2) == quality.MOST_WEIGHT  # sections are as their sites are, however much sites differ


def test_quality_of_pages(spark):
    docs = documents(spark, [(i, prose(i, 30) if i % 2 else prose(i, 30).upper() + "!!", "en", "a") for i in range(200)])
    labels = labelled(spark, [(i, i % 2, 0, "t", "s") for i in range(200)])
    page = "<html><body><p>{}</p></body></html>"
    rows = [(i, f"https://{'good' if i % 2 else 'bad'}.example.com/{'x' if i % 3 else 'y'}/1", page.format(prose(500 + i, 25) if i % 2 else prose(500 + i, 25).upper() + "!!")) for i in range(80)]
    rows += [(900, "https://good.example.com/x/2", None), (901, "https://bad.example.com/x/2", ""), (902, None, None)]
    got = {r["page_id"]: r for r in quality.graded_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), docs, labels).collect()}
    assert len(got) == 83 and all(got[i]["kept"] == bool(i % 2) for i in range(80)) and got[900]["score"] > got[901]["score"]


def test_quality_awkward(spark, awkward, nothing):
    labels = labelled(spark, [(i, i % 2, 0, "t", "s") for i in range(1, 13)])
    rows = quality.graded_documents(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len(quality.graded_documents(awkward, labelled(spark, [])).collect()) == len(AWKWARD)
    assert quality.graded_documents(nothing, labels).count() == 0


@pytest.mark.parametrize("text", [None, "", "x", "a\n\nb", "é" * 5])
def test_measures_are_shares(text):
    m = quality.measures(text)
    assert len(m) == quality.MEASURES and (m >= 0).all() and (m <= 1).all()
    assert (quality.features(text) < quality.MEASURES * quality.BUCKETS).all()
