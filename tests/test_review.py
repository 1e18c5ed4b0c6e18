import pytest
from pyspark.sql import functions as F

from attesta.operators import review as R


def test_changed_lines_and_touched_spans(spark):
    new = spark.createDataFrame([("d", "a\nB\nc\nextra\nd"), ("e", "same")], "doc_id string, text string")
    old = spark.createDataFrame([("d", "a\nb\nc\nd"), ("e", "same")], "doc_id string, text string")
    changed = R.changed_lines(new, old)
    assert {(r["doc_id"], r["no"]) for r in changed.collect()} == {("d", 2), ("d", 4)}
    spans = spark.createDataFrame([("d", 1, 1, "x"), ("d", 2, 3, "y"), ("e", 1, 9, "z")], "doc_id string, lo int, hi int, item string")
    assert [r["item"] for r in R.touched(spans, changed).collect()] == ["y"]
    boxes = spark.createDataFrame([("d", 2, 1, 0.0, 0.0, 5.0, 1.0), ("d", 3, 1, 1.0, 1.0, 9.0, 2.0), ("d", 3, 2, 0.0, 0.0, 1.0, 1.0)], "doc_id string, no int, page int, x0 double, y0 double, x1 double, y1 double")
    assert {tuple(r) for r in R.span_boxes(spans, boxes, ["item"]).collect()} == {("y", 1, 0.0, 0.0, 9.0, 2.0), ("y", 2, 0.0, 0.0, 1.0, 1.0)}


def test_tiles(spark):
    strips = spark.createDataFrame([("p", i, h) for i, h in enumerate([700, 700, 200, 2000, 100], 1)], "page string, i int, height int")
    assert [r["tile"] for r in R.tiles(strips, ["page"], "i").orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_unique_ids(spark):
    rows = spark.createDataFrame([(1, "Set A"), (2, "set-a"), (3, "Set A!"), (4, "set a 2"), (5, "b")], "pos int, name string")
    assert [r["id"] for r in R.unique_ids(rows, "name", "pos").orderBy("pos").collect()] == ["set_a", "set_a_3", "set_a_4", "set_a_2", "b"]
    taken = spark.createDataFrame([("b",), ("b_2",)], "id string")
    assert [r["id"] for r in R.unique_ids(rows, "name", "pos", taken).where("pos = 5").collect()] == ["b_3"]


def test_summary_and_pairs(spark):
    files = spark.createDataFrame([("a", "paper", None), ("s", "solution", "a"), ("t", "solution", "a"), ("b", "paper", None)], "id string, role string, pair string")
    pages = spark.createDataFrame([("a", "typed"), ("a", "scanned")], "id string, mode string")
    views = spark.createDataFrame([("a", 10), ("a", 5)], "id string, tokens int")
    got = {r["id"]: tuple(r)[2:] for r in R.summary(files, pages, views).collect()}
    assert got["a"] == (2, "scanned/typed", 2, 15) and got["b"] == (0, "text", 0, 0)
    assert {r["id"]: r["solutions"] for r in R.solutions_of(files).collect()} == {"a": ["s", "t"], "b": []}


def test_flatten_json(spark):
    rows = spark.createDataFrame([(1, '{"papers": [{"qs": [{"q": "x", "_k": "no", "src": "no"}]}], "n": 3}'), (2, "no json"), (3, None)], "id int, text string")
    out = R.flatten_json(rows, "id", "text")
    assert [tuple(r) for r in out.collect()] == [(1, "papers[0].qs[0].q", "x")]
    assert out.select(R.where_of(F.col("path")).alias("w")).first()["w"] == "paper 1.qs[0].q"
    bad = spark.createDataFrame([({"\\Div": "x", "Div": "y"},)], "m map<string,string>").select(R.bad_macros("m").alias("b")).first()["b"]
    assert bad == ["Div"]


def test_sections():
    assert R.chosen_sections("Quiz, notes quiz past") == ["questions", "concepts", "papers"]
    with pytest.raises(ValueError, match="nothing"):
        R.chosen_sections("nothing")


def test_workings(spark):
    assert R.calculate(["12,000", "450", "30", "=SQRT(2*B1*B2/B3)", "=B1/B4"]) == [12000.0, 450.0, 30.0, 600.0, 20.0]
    assert R.calculate(["=B2", "=B1", "=1/0", "=B9", "=__import__('os')", "x", "=-2^2", "=MIN(3,B8)", "=B3"]) == [None, None, None, None, None, None, -4.0, None, None]
    rows = spark.createDataFrame([("a", ["1", "=B1*3"]), ("b", None)], "id string, cells array<string>")
    assert {r["id"]: r["values"] for r in R.workings(rows).collect()} == {"a": [1.0, 3.0], "b": []}


def test_shapes_and_blocks(spark):
    tables = spark.createDataFrame([("ok", ["a", "b"], [["1", "2"]], [2]), ("ragged", ["a", "b"], [["1"]], None), ("spans", ["a", "b"], [["1", "2"]], [1])], "id string, head array<string>, rows array<array<string>>, spans array<int>")
    assert {r["id"] for r in R.table_shape(tables).collect()} == {"ragged", "spans"}
    blocks = spark.createDataFrame([("p", "p", None, None), ("x", "zz", None, None), ("d", "defs", None, [["a"]]), ("b", "box", "", None)], "id string, t string, title string, pairs array<array<string>>")
    assert {r["id"]: r["fault"] for r in R.block_faults(blocks).collect()} == {"x": "unknown type", "d": "not pairs", "b": "no title"}
