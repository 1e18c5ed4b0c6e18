import corpus_pipeline
import pytest

from .conftest import AWKWARD, documents, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, prose(50, 60)), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    rows = [(i + 100, f"the {prose(i, 80)} and this is the end of it", "en", f"s{i % 3}") for i in range(30)]
    rows += [(200, rows[0][1], "en", "s0"), (201, "intro here " + prose(50, 60), "en", "s1"), (202, rows[3][1].replace(" and ", " und ", 1) + "\nA second line.", "en", "s1")]
    documents(spark, [*AWKWARD, *rows]).write.parquet(f"{root}/documents.parquet")
    return str(root)


def test_stages_drop_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.mode("overwrite").parquet(f"{folder}/out-{k}")
        out = spark.read.parquet(f"{folder}/out-{k}")
        if k < 4:
            assert out.columns == columns
        seen[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        docs = out
    assert 201 in seen["simhash_near_dedup"] and 201 not in seen["decontamination"]
    assert 200 in seen["language_id"] and 200 not in seen["line_dedup"]
    assert {100, 101, 129} <= seen["packing"]
    assert seen["packing"] == seen["decontamination"]


def test_run_equals_its_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{folder}/out-3").select("doc_id").distinct().count()


def test_stages_of_nothing(spark, folder, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0, name


def test_driver_entry_has_the_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
