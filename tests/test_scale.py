"""What odd inputs and larger tables brought to light."""

import duckdb
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variorum.functions import rows
from variorum.operators import qa
from variorum.plans import queries as catalogue
from variorum.sources import layers, tei


def like_the_sql(spark, folder, name):
    """The query's rows over the tables of a folder, which must be the SQL's."""
    c = duckdb.connect()
    for p in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    want = c.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in want.description]
    got = sorted(map(repr, (tuple(r) for r in catalogue.queries()[name](spark, str(folder)).select(*names).collect())))
    assert got == sorted(map(repr, want.fetchall()))
    return got


def test_blank_documents_have_no_footer(spark, tmp_path):
    foot = "Printed by the press of the town in 1890"
    texts = ["", " \n\t\n", None, *[f"a\n{foot}\n \n"] * 3]
    spark.createDataFrame([("s", t) for t in texts], "source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert len(like_the_sql(spark, tmp_path, "repeated_footer")) == 1
    assert [r[0] for r in spark.createDataFrame([("",), ("\n",), ("x\n",)], "t string").select(layers.tail_of(F.col("t"))).collect()] == [None, None, "x"]


def test_references_cut_off_in_pages(spark, tmp_path):
    html = ["<h1>end = &quot</h1><p>a &amp b &amp;amp; &amp;quot;c&quot; &lt; &copy; 1 &middot; x & y</p><footer> &amp;copy;  &#39; &copy</footer>", None, "<p></p>"]
    spark.createDataFrame(list(enumerate(html)), "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert len(like_the_sql(spark, tmp_path, "hocr_ingest")) == 3


def test_a_golden_build_reads_its_documents_once(spark):
    plan = catalogue.queries()["golden_build"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # pages to fragments, documents, their items


def test_rows_are_handed_on_in_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i == 2 else "x" * i) for i in range(5)], "doc_id int, text string")
    kind = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.ArrayType(T.StringType()))])
    got = rows.read(docs.coalesce(1), "text", lambda s: [(k, [s]) for k in range(len(s) * 10000)] if s == "xxx" else [(len(s), [s])], kind)
    n = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 1, 1: 1, 3: 30000, 4: 1}
    assert got.where("doc_id = 4").first() == (4, 4, ["xxxx"])


def test_only_bad_references_leave_the_reader(spark):
    xml = "<TEI><witness xml:id='wit-A'/><app from='#no' to='#wit-A'><rdg wit='#wit-A #wit-A'/><rdg wit='#wit-A'/></app></TEI>"
    plan = tei.bad_references(spark.createDataFrame([(1, xml)], "doc_id int, tei string"))
    assert sorted((r.attribute, r.ref) for r in plan.collect()) == [("from", "#no"), ("wit", "#wit-A"), ("wit", "#wit-A")]
    assert "Filter" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_a_coverage_guard_parses_its_pages_once(spark):
    d = catalogue.queries()["coverage_guard"](spark, "/root/testdata/sf0.001")
    assert d._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id int, page_index int")
    report = spark.createDataFrame([(1, 1), (1, None), (3, 4), (2, 0)], "doc_id int, page_index int")
    assert sorted(map(tuple, qa.uncovered(report, pages).collect())) == [(1, 0, "document"), (3, 4, "report")]
