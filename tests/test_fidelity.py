import pytest

from attesta.plans import fidelity as V
from attesta.sources import markup

PAPER = """#! source v1 id=setA
**Section I**
1. The ferry to the island sails with 326 seats and two decks for cars.
(a) Who boards first? (b) How many cars fit on it?
[[table t1]]
Deck\tCars
Lower\t18
[[/table]]
2. What would you do about the queue?
(A) Sell the tickets on the shore in advance
(B) Open one more gate for cars
(C) Leave it as it is
3. Look at the map and tell where the wind comes from.
[[figure f1 view/f1.png]]"""
SOLUTION = """1. Those on foot board first and 37.5 cars fit on average.
2. (A)"""


@pytest.fixture(scope="module")
def lines(spark):
    return markup.source_lines(spark.createDataFrame([("setA", PAPER), ("solA", SOLUTION)], "doc_id string, text string")).cache()


def good():
    table = {"t": "table", "head": ["Deck", "Cars"], "rows": [["Lower", "18"]], "src_id": "t1"}
    base = {"paper": "A", "source": "setA", "head": False, "sub": False, "e": "Because a queue on the shore costs nobody a seat, while one more gate only moves it along."}
    return [
        base | {"n": 1, "head": True, "q": "<b>Section I</b>", "lo": 2, "hi": 2},
        base | {"n": 2, "name": "Question 1", "sub": True, "q": "1. The ferry to the island sails with 326 seats and two decks for cars.<br>(a) Who boards first? (b) How many cars fit on it?", "media": [table], "lo": 3, "hi": 8,
                "official": "Those on foot board first and 37.5 cars fit on average.", "e_source": "solA", "e_lo": 1, "e_hi": 1},
        base | {"n": 3, "name": "MCQ 2", "q": "2. What would you do about the queue?", "o": ["Sell the tickets on the shore in advance", "Open one more gate for cars", "Leave it as it is"], "a": 0, "lo": 9, "hi": 12},
        base | {"n": 4, "name": "Question 3", "sub": True, "q": "3. Look at the map and tell where the wind comes from.", "media": [{"t": "fig", "src_id": "f1"}], "lo": 13, "hi": 14},
    ]


def findings(spark, lines, rows):
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(V.ITEM_SCHEMA)

    def fill(value, t):
        name = t.typeName()
        if value is None:
            return None
        if name == "struct":
            return tuple(fill(value.get(f.name), f.dataType) for f in t.fields)
        return [fill(v, t.elementType) for v in value] if name == "array" else value

    items = spark.createDataFrame([fill(r, kind) for r in rows], kind)
    found, scores, reasons = V.check_papers(items, lines)
    return [(r["paper"], r["rule"], r["n"], r["detail"]) for r in found.collect()], scores, reasons, items


def test_a_true_copy_has_no_findings(spark, lines):
    found, scores, reasons, items = findings(spark, lines, good())
    assert found == []
    assert {r["precision"] for r in scores.collect()} == {1.0}
    assert {(r["n"], r["reason"]) for r in reasons.collect()} == {(2, "table"), (3, "MCQ"), (4, "figure")}
    assert [tuple(r) for r in V.paper_counts(items).collect()] == [("A", 3, 0, 1, 0, 2)]
    assert "lo" not in V.without_private(items).columns


def change(n, **fields):
    def run(rows):
        rows[n - 1].update(fields)

    return run


def replace(n, old, new, field="q"):
    def run(rows):
        assert old in rows[n - 1][field]
        rows[n - 1][field] = rows[n - 1][field].replace(old, new)

    return run


FAULTS = [
    ("paraphrased stem", replace(2, "sails with 326 seats", "carries 326 people"), "missing from the item"),
    ("paraphrase scores low", replace(4, "tell where the wind comes from", "say which way a gale blows there in winter"), "precision"),
    ("one word dropped", replace(2, " for cars", ""), "missing from the item"),
    ("sub-part dropped", replace(2, " (b) How many cars fit on it?", ""), "missing from the item"),
    ("number mistyped", replace(2, "326", "362"), "numbers differ"),
    ("table cell mistyped", change(2, media=[{"t": "table", "head": ["Deck", "Cars"], "rows": [["Lower", "19"]], "src_id": "t1"}]), "table cell"),
    ("table cell's number", change(2, media=[{"t": "table", "head": ["Deck", "Cars"], "rows": [["Lower", "19"]], "src_id": "t1"}]), "numbers differ"),
    ("table left out", change(2, media=None), "table not shown"),
    ("figure left out", change(4, media=None), "figure not shown"),
    ("option reworded", change(3, o=["Sell the tickets on the shore in advance", "Build a second pier", "Leave it as it is"]), "option"),
    ("question left out", lambda rows: rows.pop(3), "in no item"),
    ("official number changed", replace(2, "37.5", "37.4", "official"), "official numbers differ"),
    ("official sentence dropped", replace(2, " and 37.5 cars fit on average", "", "official"), "missing from the official solution"),
    ("official reworded", change(2, official="People walk on before 37.5 others"), "official precision"),
    ("solution source lost", change(2, e_source="nowhere"), "no solution source"),
    ("answer not set", change(3, a=None), "answer not set"),
    ("answer out of range", change(3, a=7), "answer out of range"),
    ("explanation missing", change(3, e=None), "explanation missing"),
    ("guess left unconfirmed", change(3, checks=["lower-case letters read as options"]), "unconfirmed"),
    ("part's answer not set", change(4, parts=[{"label": "(a)", "q": "", "o": ["wind", "map"]}]), "answer not set"),
    ("part's key not printed", change(4, parts=[{"label": "(a)", "q": "", "official": "something else entirely"}]), "printed key"),
]


def test_faults_are_found(spark, lines):
    """Each fault in a paper of its own, all checked side by side; the papers without a fault of a rule have none."""
    rows = []
    for what, mutate, _ in FAULTS:
        own = good()
        mutate(own)
        rows += [r | {"paper": what} for r in own]
    rows += [r | {"paper": "true copy"} for r in good()]
    found, *_ = findings(spark, lines, rows)
    by = {}
    for paper, rule, _, _ in found:
        by.setdefault(paper, set()).add(rule)
    missed = [(what, rule, by.get(what)) for what, _, rule in FAULTS if rule not in by.get(what, ())]
    assert not missed and "true copy" not in by


def test_risk_refs_and_examples(spark, lines):
    rows = good()
    rows[1]["q"] = rows[1]["q"].replace("326", "362")
    rows[3]["parts"] = [{"label": "(a)", "q": "first"}, {"head": True, "q": "a passage"}, {"label": "(b)", "q": "second"}]
    found, scores, reasons, items = findings(spark, lines, rows)
    table = spark.createDataFrame([(r, "error", p, n, d) for p, r, n, d in found], "rule string, severity string, paper string, n int, detail string")
    assert V.riskiest(table, reasons).first()["n"] == 2
    bank = spark.createDataFrame([(1, "A", 3), (2, "A", 99)], "id int, ref_paper string, ref_n int")
    got = {r["id"]: (r["item_q"], r["head_q"]) for r in V.expand_refs(bank, items).collect()}
    assert got == {1: ("2. What would you do about the queue?", "<b>Section I</b>"), 2: (None, None)}
    ex = spark.createDataFrame([(1, "A", 4, "(b)"), (2, "A", 4, "1"), (3, "A", 4, "zz"), (4, "A", 9, None)], "id int, paper string, n int, part string")
    got = {r["id"]: (r["place"], r["part_q"], r["passage"]) for r in V.expand_examples(ex, items).collect()}
    assert got == {1: (3, "second", "a passage"), 2: (1, "first", None), 3: (None, None, None), 4: (None, None, None)}


def test_review_counts_triples_of_near_items_alone(spark, monkeypatch):
    """The first items are those of all rules over all items; only those that a text match could bring among them are compared."""
    from attesta.operators import containment
    from attesta.plans import papers

    items, lines = papers.paper_items(spark, "/root/testdata/sf0.001")
    found, _, reasons = V.check_papers(items, lines, exact=False)
    whole = V.riskiest(found.where("rule in ('numbers differ', 'unconfirmed')"), reasons, 40).collect()
    met, real = [], containment.segment_precision
    monkeypatch.setattr(containment, "segment_precision", lambda seg, *a, **b: met.append(seg.select("paper", "n").distinct().count()) or real(seg, *a, **b))
    for k in (8, 40):
        assert [tuple(r) for r in V.review_first(items, lines, k, exact=False).collect()] == [tuple(r) for r in whole[:k]]
    assert 8 <= met[0] < items.count() // 10


def test_review_of_few_items(spark, lines):
    """Fewer items than are asked for: all of them are compared."""
    rows = good()
    rows[1]["q"] = rows[1]["q"].replace("326", "362")
    _, _, reasons, items = findings(spark, lines, rows)
    wrong = spark.createDataFrame([("numbers differ", "error", "A", 2, x) for x in ("326", "362")], "rule string, severity string, paper string, n int, detail string")
    for k in (1, 8):
        assert V.review_first(items, lines, k).collect() == V.riskiest(wrong, reasons, k).collect()
