"""The registered queries on the small tables, against their SQL or against what their contract says in plain Python."""

import glob
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from attesta.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

from .test_dedup import brute_fingerprint, brute_repeats, components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not glob.glob(SF), reason="tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, text from documents order by doc_id").fetchall())


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(columns).collect()
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def encoded(texts, name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    return {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_output(spark, texts):
    ids, start, want = encoded(texts, "byte_bpe_50k.json"), 0, {}
    for i in sorted(ids):
        want[i] = (start, len(ids[i]), crc(ids[i]))
        start += len(ids[i])
    assert {r["doc_id"]: tuple(r)[1:4] for r in rows(spark, "op1_token_output")} == want


def test_simhash(spark, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    of, low = components(prints.values()), {}
    for i, f in sorted(prints.items()):
        low.setdefault(of[f], i)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(spark, "op2_simhash")} == {(i, f"{f:016x}", low[of[f]]) for i, f in prints.items()}


def test_toxicity(spark, texts):
    got = rows(spark, "op3_toxicity")
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_packing(spark, texts):
    ids = encoded(texts, "word_bpe_49k.json")
    pieces, full = rows(spark, "op4_packing"), {}
    by_doc: dict = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, some in by_doc.items():
        at = 0
        for r in sorted(some, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(ids[i])
    assert set(by_doc) == set(ids)
    used = padded = 0
    for some in full.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 4096
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 4096)
    assert padded - used <= 0.01 * used


def test_substrings(spark, texts):
    import hashlib

    want = dict(zip(texts, brute_repeats(list(texts.values())), strict=True))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, "op9_substrings")} == {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in want.items()}


def test_decontamination(spark, duck, texts):
    from attesta.llm.decontaminate import Item, leaks_of

    items = [(i, Item(t)) for i, t in duck.execute("select item_id, text from benchmark").fetchall()]
    want = {(d, *x) for d, t in texts.items() for x in leaks_of(t, items)}
    assert {tuple(r) for r in rows(spark, "op10_decontamination")} == want
    plain = lambda t: re.findall(r"[a-zà-ÿ0-9]+", (t or "").lower())
    bench = {i: plain(t) for i, t in duck.execute("select item_id, text from benchmark").fetchall()}
    whole = {(d, i) for d, t in texts.items() for i, w in bench.items() if len(w) > 4 and f" {' '.join(w)} " in f" {' '.join(plain(t))} "}
    assert whole <= {x[:2] for x in want}


def test_language_and_quality(spark, duck, texts):
    told = dict(duck.execute("select doc_id, lang from documents").fetchall())
    got = {r["doc_id"]: r for r in rows(spark, "op7_language")}
    assert set(got) == set(texts)
    common = {x for x, n in Counter(told.values()).items() if n >= 10}
    clear = [i for i, t in texts.items() if told[i] in common and len((t or "").split()) >= 20]
    assert sum(got[i]["by_text"] == told[i] for i in clear) >= 0.97 * len(clear) and sum(got[i]["language"] == told[i] for i in clear) >= 0.97 * len(clear)
    quality = dict(duck.execute("select doc_id, max(quality) from labels group by doc_id").fetchall())
    graded = {r["doc_id"]: r for r in rows(spark, "op8_quality")}
    known = [i for i in graded if i in quality]
    assert set(graded) == set(texts) and sum(graded[i]["kept"] == bool(quality[i]) for i in known) >= 0.9 * len(known)


@pytest.mark.parametrize("name", ["pages_language", "pages_quality"])
def test_pages(spark, duck, name):
    got = rows(spark, name)
    assert {r["page_id"] for r in got} == {i for (i,) in duck.execute("select page_id from pages").fetchall()}
