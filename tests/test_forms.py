from attesta.operators import forms

SHAPES = "page int, x0 double, y0 double, x1 double, y1 double"


def test_marks_and_options(spark):
    shapes = spark.createDataFrame([(1, 10.0, 10.0, 20.0, 20.0), (1, 10.5, 10.5, 20.5, 20.5), (1, 100.0, 10.0, 110.0, 20.0), (1, 103.0, 13.0, 107.0, 17.0), (1, 0.0, 0.0, 50.0, 9.0)], SHAPES)
    marks = forms.choice_marks(shapes, ["page"])
    assert {(r["x0"], r["selected"]) for r in marks.collect()} == {(10.0, False), (100.0, True)}
    words = spark.createDataFrame([(1, 1, 25.0, 11.0, 40.0, 19.0, "red"), (1, 1, 42.0, 11.0, 60.0, 19.0, "one"), (1, 1, 115.0, 11.0, 130.0, 19.0, "blue"), (1, 2, 25.0, 60.0, 40.0, 69.0, "else")], "page int, line int, x0 double, y0 double, x1 double, y1 double, text string")
    assert {r["text"] for r in forms.option_words(words, marks, ["page"]).collect()} == {"red one", "blue"}


def test_boxes_and_margin(spark):
    shapes = spark.createDataFrame([(1, 10.0, 10.0, 110.0, 30.0), (1, 200.0, 10.0, 300.0, 30.0), (1, 10.0, 100.0, 110.0, 120.0)], SHAPES)
    tables = spark.createDataFrame([(1, 195.0, 5.0, 400.0, 90.0)], SHAPES)
    words = spark.createDataFrame([(1, 12.0 + 5 * i, 102.0, 15.0 + 5 * i, 110.0, "w", 600.0) for i in range(5)] + [(1, 5.0, 200.0, 60.0, 210.0, "Question", 600.0), (1, 100.0, 200.0, 150.0, 210.0, "What", 600.0)], SHAPES + ", text string, page_width double")
    assert [r["y0"] for r in forms.entry_boxes(shapes, words, tables, ["page"]).collect()] == [10.0]
    assert forms.margin_column(words, ["page"]).first()["margin"] == 98.0


def test_raised_text(spark):
    words = spark.createDataFrame([(1, 1, 10.0, 10.0, 20.0, 20.0, 10.0), (1, 1, 30.0, 10.0, 60.0, 20.0, 10.0), (1, 2, 21.0, 8.0, 24.0, 12.0, 6.0), (1, 3, 10.0, 90.0, 20.0, 95.0, 6.0), (1, 4, 10.0, 50.0, 20.0, 60.0, 10.0)], "page int, line int, x0 double, y0 double, x1 double, y1 double, size double")
    assert [(r["line"], r["host"]) for r in forms.raised_text(words, ["page"]).collect()] == [(2, 1)]


def test_option_lines_with_lead_words_and_wrapped_text(spark):
    words = [(1, 1, 10.0, 10.0, 20.0, 18.0, "Pick:"), (1, 1, 50.0, 10.0, 60.0, 18.0, "red"), (1, 1, 90.0, 10.0, 99.0, 18.0, "blue"), (1, 2, 50.0, 30.0, 70.0, 38.0, "green"), (1, 3, 51.0, 40.0, 70.0, 48.0, "grass"), (1, 4, 51.0, 52.0, 70.0, 60.0, "too"), (1, 5, 90.0, 90.0, 99.0, 98.0, "end")]
    marks = [(1, 1, 35.0, 10.0, 45.0, 18.0), (1, 2, 75.0, 10.0, 85.0, 18.0), (1, 3, 35.0, 30.0, 45.0, 38.0)]
    w = spark.createDataFrame(words, "page int, line int, x0 double, y0 double, x1 double, y1 double, text string")
    m = spark.createDataFrame(marks, "page int, i int, x0 double, y0 double, x1 double, y1 double")
    got = [(r["opt"], r["text"]) for r in forms.option_lines(w, m, ["page"]).orderBy("place").collect()]
    assert got == [(False, "Pick:"), (True, "red"), (True, "blue"), (True, "green grass too"), (False, "end")]


def test_raised_words_go_back(spark):
    rows = [(1, 1, 10.0, 10.0, 40.0, 20.0, 10.0, "(X,", [10.0, 20.0, 30.0]), (1, 1, 50.0, 10.0, 60.0, 20.0, 10.0, "Y", [50.0]), (1, 2, 30.2, 16.0, 34.0, 21.0, 5.0, "1", None), (1, 3, 61.0, 8.0, 64.0, 12.0, 5.0, "2", None), (1, 4, 10.0, 90.0, 20.0, 99.0, 10.0, "Z", None)]
    w = spark.createDataFrame(rows, "page int, line int, x0 double, y0 double, x1 double, y1 double, size double, text string, chars array<double>")
    got = {(r["line"], r["x0"], r["text"]) for r in forms.merge_raised(w, ["page"]).collect()}
    assert got == {(1, 10.0, "(X1,"), (1, 50.0, "Y"), (1, 61.0, "2"), (4, 10.0, "Z")}
