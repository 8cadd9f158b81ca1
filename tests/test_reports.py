"""Operators on small invented tables."""

import json
import sys
from datetime import date

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from reportlake.operators import canonical, facets, graph, models, search, stats, tables, tagging
from reportlake.operators.workspace import Workspace
from reportlake.sources import html, reports, sinks
from reportlake.streaming.topup import top_up_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stub models below go to the workers

SCHEMA = "report_id long, url string, date string, coroner string, area string, receiver string, investigation string, circumstances string, concerns string, theme_a boolean, theme_b boolean"
ROWS = [
    (1, "u1", "2020-01-02", "Ann", "North", "Acme; acme ; Beta", "falls at home", "a fall", None, True, True),
    (2, "u2", "2020-01-02", "ann", "South", "", None, "medication", "drug errors", True, False),
    (3, "u3", None, "nan", None, None, "", "", "", None, None),
    (4, "u4", "2021-05-06", "Bob", "North", "HMP Westwood; Beta", "prison falls", "falling", "falls risk", False, True),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("date", F.to_date("date")).cache()


def ids(df):
    return sorted(r[0] for r in df.select("report_id").collect())


def test_load_reports_from_csv(spark, small, tmp_path):
    path = str(tmp_path / "r.csv")
    small.toPandas().assign(**{"Unnamed: 0": 1}).to_csv(path, index=False)
    got = reports.load_reports(spark, path, "2020-01-01", "2020-12-31")
    assert [r["url"] for r in got.collect()] == ["u1", "u2"] and "Unnamed: 0" not in got.columns
    one = reports.load_reports(spark, path, collection="b", known={"a": "theme_a", "b": "theme_b"})
    assert [r["url"] for r in one.collect()] == ["u4", "u1"] and "theme_b" not in one.columns
    both = reports.load_reports(spark, path, collection=["a", "B", "a"], known={"a": "theme_a", "b": "theme_b"}, n_reports=2)
    assert [r["url"] for r in both.collect()] == ["u4", "u1"] and {"theme_a", "theme_b"} <= set(both.columns)
    with pytest.raises(ValueError):
        reports.load_reports(spark, path, collection="x")
    with pytest.raises(ValueError):
        reports.load_reports(spark, path, "2022-01-01", "2021-01-01")


def test_period_ends_today(small):
    assert reports.between(small, end="2050-01-01", today=date(2020, 12, 31)).count() == 2


def test_facets(small):
    assert ids(facets.facet_filter(small, coroners=["ANN"], areas=["north", "south"])) == [1, 2]
    assert ids(facets.facet_filter(small, receiver=["beta"])) == [1, 4]
    assert facets.facet_filter(small.drop("area"), areas=["north"]).count() == 0
    top = [tuple(r) for r in facets.top_receivers(small).collect()]
    assert top == [("Beta", 2), ("Not specified", 2), ("Acme", 1), ("HMP Westwood", 1)]
    assert facets.totals(small).first()["receiver_links"] == 4
    assert facets.page(small, 99, size=3).count() == 1


def test_tags(spark, small):
    tagged = tagging.tag_collections(small, areas=spark.createDataFrame([("NORTH ",)], "area string"))
    rows = {r["report_id"]: r for r in tagged.collect()}
    assert rows[4]["theme_sent_to_prisons"] and not rows[1]["theme_sent_to_prisons"] and not rows[3]["theme_sent_to_prisons"]
    assert rows[1]["theme_welsh"] and not rows[2]["theme_welsh"]
    council = spark.createDataFrame([(1, "Acme Council"), (2, "General Medical Council"), (3, None)], "report_id long, receiver string")
    got = {r["report_id"]: r["theme_sent_to_local_government"] for r in tagging.tag_collections(council).collect()}
    assert got == {1: True, 2: False, 3: False}
    old = council.withColumn("theme_sent_to_nhs_bodies", F.lit(True))
    kept = tagging.tag_collections(old, row_mask=F.col("report_id") == 1).orderBy("report_id").collect()
    assert [r["theme_sent_to_nhs_bodies"] for r in kept] == [False, True, True]


def test_areas(spark):
    dim = spark.createDataFrame([("London West", "London (West)", "allowed"), ("W. London", "London (West)", "synonym"), ("Exeter", "Devon", "legacy")], "alias string, canonical string, kind string")
    raw = spark.createDataFrame([(k, v) for k, v in enumerate(["w london", "londn west", "EXETER", "Mars", None, "London West"])], "report_id long, area string")
    got = {r["report_id"]: (r["area_canonical"], r["match_method"]) for r in canonical.match_areas(raw, dim).collect()}
    assert got[0] == ("London (West)", "normalised_synonym") and got[1] == ("London (West)", "fuzzy") and got[2][0] == "Devon"
    assert got[3] == ("Other", "none") and got[4] == ("Other", "none") and got[5][1] == "raw_allowed"
    with pytest.raises(ValueError):
        canonical.match_areas(raw, dim, strategy="guess")


def test_search(small):
    found = search.search(small, "the falls")
    assert [r["report_id"] for r in found.collect()] == [4, 1]
    assert search.search(small, "!!").count() == 0
    assert search.query_terms("of the")[1] == ["of", "the"]


def test_tabulate(spark):
    df = spark.createDataFrame([(True, None, "x"), (False, None, "y"), (None, None, "x"), (True, None, None)], "a boolean, b boolean, c string")
    got = {r["Category"]: (r["Count"], float(r["Percentage"])) for r in stats.tabulate(df, ["a", "b", "c"], ["A", "B", "C"]).collect()}
    assert got == {"A": (2, 50.0), "B": (0, 0.0), "C: x": (2, 50.0), "C: y": (1, 25.0)}
    with pytest.raises(ValueError):
        stats.tabulate(df, ["a"], ["x", "y"])
    with pytest.raises(KeyError):
        stats.tabulate(df, ["z"])


def test_lengths(spark):
    df = spark.createDataFrame([(0,), (1,), (150,), (420,)], "n int")
    table = [tuple(r) for r in stats.length_table(df, 150, 100).collect()]
    assert table == [(50, 2, 50.0), (150, 3, 75.0), (250, 3, 75.0), (350, 3, 75.0), (450, 4, 100.0)]
    empty = stats.length_stats(df.where("n < 0"), threshold=3).first()
    assert empty["reports"] == 0 and empty["mean"] == 0.0 and empty["within_reports"] == 0


def test_agreement(spark):
    same = spark.createDataFrame([(True, True, True), (False, False, False)], "a boolean, b boolean, c boolean")
    assert stats.cohen_kappa(same, "a", "b").first()["kappa"] == 1.0
    assert stats.fleiss_kappa(same, ["a", "b", "c"]).first()["kappa"] == 1.0
    one = stats.confusion(same.where("a"), "a", "b").first()
    assert one["accuracy"] == 1.0 and one["specificity"] is None


def test_forced_nodes_pass_cap_and_rarity(spark):
    rows = [("receiver", "a", 5), ("receiver", "b", 4), ("receiver", "c", 3), ("receiver", "C", 1), ("area", "x", 1)]
    node = spark.createDataFrame(rows, "kind string, value string, n long")
    got = lambda forced: sorted((r["kind"], r["value"], r["rank"]) for r in graph.capped(node, 300, {"receiver": 1}, forced).collect())
    assert got([]) == [("receiver", "a", 1)]
    assert got(["receiver::c", "receiver::C", "area::x", "area::none"]) == [("area", "x", 1), ("receiver", "a", 1), ("receiver", "c", 3)]


def test_graph(spark, small):
    edge = spark.createDataFrame([("k", "t::a", "t::b", 2), ("k", "t::b", "t::c", 1)], "kind string, source string, target string, n long")
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(edge).collect()} == {"t::a": 0.0, "t::b": 1.0, "t::c": 0.0}
    assert {r["id"]: r["degree"] for r in graph.degree(edge).collect()} == {"t::a": 0.5, "t::b": 1.0, "t::c": 0.5}
    pairs = spark.createDataFrame([("a", f"b{k}", 10, 1.0 - k / 100) for k in range(12)], "source string, target string, n long, jaccard double")
    assert [r["target"] for r in graph.greedy_pairs(pairs).orderBy(F.desc("jaccard")).collect()] == [f"b{k}" for k in range(8)]
    rows = graph.node_rows(small, ["theme_a", "theme_b"])
    assert rows.where("kind = 'theme'").count() == 4 and ids(rows.select("report_id").distinct()) == [1, 2, 4]
    jac = graph.jaccard(graph.edges(small, ["theme_a", "theme_b"]), graph.nodes(rows)).first()
    assert (jac["n"], jac["jaccard"]) == (1, 0.333333)


def test_exclude_and_restore(small):
    w = Workspace(small)
    w.exclude(small.where("report_id in (1, 2)"), "no")
    assert ids(w.state.active) == [3, 4] and ids(w.state.excluded) == [1, 2]
    w.restore(small.where("report_id = 1"))
    assert ids(w.state.active) == [1, 3, 4] and ids(w.state.excluded) == [2]
    assert w.undo() and ids(w.state.active) == [3, 4] and w.redo() and ids(w.state.active) == [1, 3, 4]
    for _ in range(15):
        w.start_over()
    assert len(w.back) == 10 and not w.ahead and "run 15" in w.script()


def test_increments(spark, small, tmp_path):
    new = small.where("report_id in (1, 4)").unionByName(small.where("report_id = 4")).withColumn("url", F.when(F.col("report_id") == 4, "u9").otherwise(F.col("url")))
    assert tables.top_up(small.where("report_id < 4"), new).count() == 4
    into, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    small.where("report_id < 3").write.parquet(into)
    assert top_up_stream(spark, into, target, mark, small.schema) == 2
    small.write.mode("append").parquet(into)
    assert top_up_stream(spark, into, target, mark, small.schema) == 4
    assert top_up_stream(spark, into, target, mark, small.schema) == 4


def test_sampling(spark):
    df = spark.range(100).select(F.col("id").alias("report_id"), F.when(F.col("id") < 90, F.lit("2020-01-01")).when(F.col("id") < 98, "2021-01-01").cast("date").alias("date"))
    got = tables.stratified_sample(df, 20)
    assert got.count() == 20 and got.where("date is null").count() >= 1
    assert ids(got) == ids(tables.stratified_sample(df.repartition(7), 20))
    assert tables.index_ranges("2,5-7,6") == [2, 5, 6, 7]
    many = spark.range(30).select(F.col("id").alias("report_id"), F.expr("make_date(1990 + id, 1, 1)").alias("date"))
    assert tables.stratified_sample(many, 5).count() == 5


def test_screening(small):
    model = models.KeywordModel("falls")
    assert ids(models.screen(small, model, "falls?")) == [1, 4]
    marked = models.screen(small, model, "falls {x}", filter_df=False)
    assert marked.count() == 4 and "matches_query" in marked.columns
    with pytest.raises(ValueError):
        models.screen(small, model, " ")


class Broken:
    def generate(self, prompts, schema=None):
        return ["not json" if schema else "Error: no" for _ in prompts]


def test_extraction_and_cache(spark, small, tmp_path):
    cache = models.Cache()
    model = models.KeywordModel(fields={"age": 41, "spans_age": " ", "kind": "x"})
    out = models.extract(small, model, {"age": "int", "kind": "str"}, produce_spans=True, cache=cache, allowed={"kind": ["y"]})
    assert out.columns[-4:] == ["spans_age", "age", "spans_kind", "kind"]
    row = out.orderBy("report_id").first()
    assert row["age"] == 41 and row["spans_age"] is None and row["kind"] is None
    cache.export(str(tmp_path / "cache"))
    again = models.Cache.load(spark, str(tmp_path / "cache"))
    same = models.extract(small, Broken(), {"age": "int", "kind": "str"}, produce_spans=True, cache=again)
    assert same.where("age = 41").count() == 4
    assert models.extract(small, Broken(), {"age": "int"}).where("age is null").count() == 4
    assert models.clean_column(small, Broken(), "coroner", "tidy").where("coroner = 'Ann'").count() == 1


def test_themes():
    assert models.parse_themes('```json\n{themes: {a: {"description": "x"}, b: ["y", "z"],}}\n```') == {"a": "x", "b": "y; z"}
    with pytest.raises(ValueError):
        models.parse_themes("[1]")


def test_summaries_and_guard(small):
    full = models.summarise(small, max_words=2)
    assert full.where("report_id = 1").first()["summary"] == "Investigation: falls"
    with pytest.raises(ValueError):
        models.summarise(small, max_words=2, max_tokens=3)
    with pytest.raises(ValueError):
        models.discover_themes(models.summarise(small), models.KeywordModel(), error=3)


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise models.Transient
        return "ok"

    assert models.with_retries(flaky, base=0.001) == "ok"


PAGE = """<html><head><title> T </title></head><body><p>Ref: 2024-1234</p><p>Date of report: 3 May 2024</p>
<div><strong>Concerns</strong> first <b>second</b></div><div class="wp-block-file"><a href="/x.pdf">x</a></div>
<a class="card__link" href="/1">1</a><a class="card__link" href="/2">2</a></body></html>"""


def test_html(spark):
    configs = [html.FieldConfig("id", keywords=("Ref",)), html.FieldConfig("date", keywords=("Date of report",), remove=("Date of report:",), date=True), html.FieldConfig("concerns", section="concern"), html.FieldConfig("none", keywords=("zzz",))]
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    rows = html.fields(df, configs).withColumn("link", html.document_link_udf()("html")).orderBy("page_id").collect()
    assert (rows[0]["id"], rows[0]["date"], rows[0]["concerns"], rows[0]["none"], rows[0]["link"]) == ("2024-1234", "2024-05-03", "first second", None, "/x.pdf")
    assert rows[1]["id"] is None and rows[1]["link"] is None
    assert html.card_links(PAGE) == ["/1", "/2"]
    pages = {"p1": PAGE, "p2": "<html></html>"}
    assert html.crawl(pages.get, lambda k: f"p{k}") == ["/1", "/2"]
    with pytest.raises(ValueError):
        html.category_url("x", {"all": "http://a/{page}"}, 1)
    assert html.truthy_cells(pd.Series(["Yes", "0", None, "maybe"])).tolist()[:2] == [True, False]


def test_sinks(spark, small, tmp_path):
    sinks.write_csv(small, str(tmp_path / "csv"), single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    root = str(tmp_path / "v")
    sinks.write_version(small, root, {"rows": 4})
    sinks.write_version(small.limit(1), root, {"rows": 1})
    df, facts = sinks.read_version(spark, root)
    assert df.count() == 1 and facts["rows"] == 1
    assert sinks.bundle({"a": small})[0] == "a.csv" and sinks.bundle({"a": small}, "x = 1")[0] == "bundle.zip"
    books = sinks.Workbooks(spark, str(tmp_path / "wb"))
    made = books.create("My book", {"a": 1})
    books.save(made["public_id"], made["edit_token"], "New", {"a": 2})
    assert json.loads(books.get(made["public_id"])["snapshot"]) == {"a": 2}
    assert books.clone(made["public_id"])["share_number"] == 2
    with pytest.raises(PermissionError):
        books.save(made["public_id"], "x", "New", {})
    with pytest.raises(ValueError):
        books.create("bad/title", {})
