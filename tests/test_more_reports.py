"""Operators against brute force on small tables, and the facades over stub models and pages."""

import itertools
import json
import random
import sys
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from reportlake import api
from reportlake.functions import text as X
from reportlake.operators import canonical, facets, graph, models, stats, tables
from reportlake.operators.workspace import Workspace
from reportlake.sources import html, reports, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_length_table_of_many_limits(spark):
    values = [0, 1, 3, 3, 9_000, 150_000]
    df = spark.createDataFrame([(v,) for v in values], "n int")
    rows = {r["limit"]: (r["reports"], r["percent"]) for r in stats.length_table(df, 5, 1).collect()}
    assert len(rows) == 150_000 and all(rows[k][0] == sum(v <= k for v in values) for k in (1, 2, 3, 4095, 4096, 4097, 8999, 9000, 149_999, 150_000))
    assert rows[150_000][1] == 100.0
    assert {r["limit"]: r["reports"] for r in stats.length_table(df.where("n < 5"), 0, 2).collect()} == {0: 1, 2: 2, 4: 4}
    assert [tuple(r) for r in stats.length_table(df.where("n < 0"), 2, 2).collect()] == [(2, 0, 0.0)]


def test_histogram_and_agreement(spark):
    df = spark.createDataFrame([(k % 50,) for k in range(1000)], "n int")
    rows = stats.histogram(df, "auto").collect()
    assert sum(r["n"] for r in rows) == 1000 and 8 <= len(rows) <= 12
    assert stats.histogram(df.where("n = 3"), "auto").collect()[0]["n"] == 20 and stats.histogram(df.where("n < 0"), "auto").count() == 0
    rng = random.Random(1)
    votes = [tuple(rng.choice("abc") if rng.random() < 0.5 else "a" for _ in range(3)) for _ in range(60)]
    got = stats.fleiss_kappa(spark.createDataFrame(votes, "x string, y string, z string"), ["x", "y", "z"]).first()
    n, m = len(votes), 3
    share = {c: sum(v.count(c) for v in votes) / (n * m) for c in "abc"}
    po = sum(sum(v.count(c) * (v.count(c) - 1) for c in "abc") for v in votes) / (n * m * (m - 1))
    pe = sum(p * p for p in share.values())
    pq = sum(p * (1 - p) for p in share.values())
    var = 2 / (pq**2 * n * m * (m - 1)) * (pq**2 - sum(p * (1 - p) * (1 - 2 * p) for p in share.values()))
    kappa = (po - pe) / (1 - pe)
    assert abs(got["kappa"] - kappa) < 1e-12 and abs(got["z"] - kappa / var**0.5) < 1e-9 and abs(got["high"] - kappa - 1.96 * var**0.5) < 1e-12


def test_betweenness_against_all_paths(spark):
    rng = random.Random(2)
    pairs = [(f"n{a}", f"n{b}") for a, b in itertools.combinations(range(12), 2) if rng.random() < 0.25]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def shortest(a, b):
        paths, size = [[a]], 1
        while paths and size <= len(near):
            if done := [p for p in paths if p[-1] == b]:
                return done
            paths, size = [[*p, x] for p in paths for x in near[p[-1]] if x not in p], size + 1
        return []

    want = Counter()
    for a, b in itertools.permutations(near, 2):
        found = shortest(a, b)
        for p in found:
            for v in p[1:-1]:
                want[v] += 1 / len(found)
    edge = spark.createDataFrame([("k", a, b, 1) for a, b in [*pairs, pairs[0]]], "kind string, source string, target string, n long")
    n = len(near)
    for how in ({}, {"most_edges": 3, "sources_a_block": 5}):
        got = {r["id"]: r["betweenness"] for r in graph.betweenness(edge, **how).collect()}
        assert set(got) == set(near) and all(abs(got[v] - want[v] / ((n - 1) * (n - 2))) < 1e-9 for v in got)
    assert graph.betweenness(edge.where("n > 1")).count() == 0


def test_the_view_groups_lines_of_reports_alone(spark, monkeypatch):
    columns = ("receiver", *reports.THEMES)
    few = reports.report_view(spark, "/root/testdata/sf0.001", columns)
    rows = sorted(map(str, few.collect()))
    assert few._jdf.queryExecution().executedPlan().toString().count("LeftSemi") >= 2
    monkeypatch.setattr(reports, "IDS_SENT", 10)
    every = reports.report_view(spark, "/root/testdata/sf0.001", columns)
    assert "LeftSemi" not in every._jdf.queryExecution().executedPlan().toString() and sorted(map(str, every.collect())) == rows and len(rows) > 50


def test_top_k_by_kind(spark):
    rng = random.Random(3)
    rows = [(k, f"{rng.choice('abAB')}{i}", rng.randint(1, 9)) for k in ("theme", "receiver", "area") for i in range(40)]
    node = spark.createDataFrame(rows, "kind string, value string, n long")
    order = lambda r: (-r[2], r[1].lower(), r[1])
    want = {(k, v, i) for kind in ("theme", "receiver", "area") for i, (k, v, _) in enumerate(sorted((r for r in rows if r[0] == kind and r[2] > 1), key=order), 1) if i <= {"receiver": 7, "area": 3}.get(kind, 99)}
    assert {(r["kind"], r["value"], r["rank"]) for r in graph.capped(node, 300, {"receiver": 7, "area": 3}).collect()} == want
    assert graph.accented(graph.capped(node, 300)).where("accent <> (rank - 1) % 6").count() == 0
    assert graph.theme_capped(node, 5).groupBy("kind").count().where("kind = 'theme'").first()["count"] == 5
    assert graph.fallback_nodes(node, node.where("false")).count() == 64 and graph.fallback_nodes(node, node).count() == 120


def test_row_ids_are_unique(spark):
    rows = [(k, f"u{k % 40}", ["", None, " ", "same", f"id{k}"][k % 5]) for k in range(200)]
    out = facets.dedupe_ids(spark.createDataFrame(rows, "report_id long, url string, row_id string")).collect()
    assert len(out) == 200 and len({r["row_id"] for r in out}) == 200
    assert sum(r["row_id"] == "same" for r in out) == 1 and all(r["row_id"] == f"id{r['report_id']}" for r in out if r["report_id"] % 5 == 4)


def test_fuzzy_match_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 14)))
    alias = sorted({word() for _ in range(80)})
    values = sorted({(a[:k] + rng.choice("abz") + a[k + 1 :]) for a in alias for k in [rng.randrange(len(a))]})
    areas = spark.createDataFrame([(a, a.upper(), "allowed") for a in alias], "alias string, canonical string, kind string")
    got = {r["value"]: (r["canonical"], round(r["score"], 9)) for r in canonical.fuzzy(spark.createDataFrame([(v,) for v in values], "value string"), areas).collect()}
    want = {}
    for v in values:
        best = sorted(((SequenceMatcher(None, v, a).ratio(), a) for a in alias), key=lambda x: (-x[0], x[1]))[:2]
        if best[0][0] >= 0.88 and best[0][0] - best[1][0] >= 0.03:
            want[v] = (best[0][1].upper(), round(best[0][0], 9))
    assert got == want and len(want) > 20


def test_truth_and_dates(spark):
    df = spark.createDataFrame([(" TRUE ",), ("2",), ("1.0",), ("y",), ("no",), (None,), ("0",)], "v string")
    rows = df.select(X.truthy(F.col("v")), X.flag_true(F.col("v")), X.summary_true(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [(True, True, True), (False, True, False), (False, True, True), (True, True, False), (False, False, False), (False, False, False), (False, False, False)]
    days = spark.createDataFrame([("2020-01-31",), ("31/01/2020",), ("31-01-2020",), (None,)], "v string").select(X.strict_date(F.col("v")).cast("string"), X.date_or(F.col("v"), F.lit("2000-01-01").cast("date")).cast("string")).collect()
    assert [tuple(r) for r in days] == [("2020-01-31", "2020-01-31"), ("2020-01-31", "2020-01-31"), (None, "2000-01-01"), (None, "2000-01-01")]


def test_names_and_sample(spark):
    df = spark.createDataFrame([("Falls!",), ("falls",), ("FALLS",), ("Drugs",)], "v string")
    assert sorted(r["name"] for r in tables.unique_names(df, "v").collect()) == ["theme_drugs", "theme_falls", "theme_falls_2", "theme_falls_3"]
    many = spark.range(5000).select(F.col("id").alias("report_id"), F.expr("make_date(2000 + cast(id % 3 as int), 1, 1)").alias("date"), F.lit("x").alias("take"))
    got = tables.stratified_sample(many, 300)
    best = {y: sorted(r["report_id"] for r in many.where(F.year("date") == y).orderBy(F.xxhash64("report_id", F.lit(67)), "report_id").limit(100).collect()) for y in (2000, 2001, 2002)}
    assert got.columns == many.columns and sorted(r["report_id"] for r in got.collect()) == sorted(itertools.chain(*best.values()))


def test_chat_model_and_progress(spark):
    calls = []

    def post(url, headers, body):
        calls.append((url, headers, body))
        if len(calls) == 1:
            raise models.Transient("busy")
        return {"choices": [{"message": {"content": body["messages"][0]["content"][::-1]}}]}

    m = api.LLM("http://host/v1/", "small", "key", workers=3, seed=5, post=post)
    assert m.generate(["abc", "de", "f"]) == ["cba", "ed", "f"]
    assert calls[0][0] == "http://host/v1/chat/completions" and calls[0][1]["Authorization"] == "Bearer key" and calls[0][2]["seed"] == 5
    told = []
    prompts = spark.createDataFrame([(f"p{k}",) for k in range(30)], "prompt string")
    assert models.ask(prompts, models.KeywordModel(), progress=told.append).count() == 30 and told[-1] == 30
    with pytest.raises(ValueError):
        models.Cache().export("nowhere")


def test_tokens_and_themes(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["unbelievable things happen", None, "", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "summary string")
    known = Tokenizer.from_file(path)
    ids = [known.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [r["tokens"] for r in models.tokens(df, tokenizer=path).collect()] == [len(x) for x in ids]
    assert [r[0] for r in df.select(models.first_tokens(F.col("summary"), 2, path)).collect()] == [known.decode(ids[0][:2]) if len(ids[0]) > 2 else texts[0], None, "", "a b"]
    model = models.KeywordModel(fields={"themes": {"a": {"details": "b"}}})
    with pytest.warns(UserWarning):
        assert models.discover_themes(df, model, warn=1) == {"a": "b"}
    small = spark.createDataFrame([(1, "one two three", "x")], "report_id long, investigation string, concerns string")
    e = api.Extractor(llm=model, reports=small)
    e.summarise(max_words=1)
    first = e.summaries
    e.discover_themes(max_words=1)
    assert e.summaries is first
    e.discover_themes(max_words=2)
    assert e.summaries is not first and e.count(measure="tokens").first()["total"] == 4
    with pytest.raises(ValueError):
        e.discover_themes(trim_approach="summarise", max_words=3)


PAGES = {
    "index1": '<a class="card__link" href="/1"></a><a class="card__link" href="/2"></a><a class="card__link" href="/3"></a>',
    "index2": "<p>none</p>",
    "/1": '<p>Ref: 2024-0001</p><p>Date of report: 3 May 2024</p><p>Coroner name: Ann Doe</p><a class="govuk-button" href="/1.pdf">x</a>',
    "/2": '<p>Ref: 2024-0002</p><a class="govuk-button" href="/2.pdf">x</a>',
    "/3": "<p>no document</p>",
    "/4": '<p>Ref: 2024-0004</p><a class="govuk-button" href="/4.pdf">x</a>',
}


def fetch(url):
    return PAGES[url]


class Filler:
    def generate(self, prompts, schema=None):
        return [json.dumps(dict.fromkeys(schema, "filled by model")) for _ in prompts]


def test_scraper(spark):
    docs = spark.createDataFrame([("/2", "CONCERNS: the floor was wet and nobody saw it at all. ACTION"), ("/1", None)], "url string, text string")
    sections = [html.SectionConfig("concerns", ("CONCERNS:",), ("ACTION",), shortest=10)]
    s = api.Scraper(spark, fetch, templates={"all": "index{page}"}, sections=sections, documents=docs, order=("html", "text"))
    rows = {r["url"]: r for r in s.scrape_reports().collect()}
    assert set(rows) == {"/1", "/2"} and (rows["/1"]["id"], rows["/1"]["date"], rows["/1"]["coroner"]) == ("2024-0001", "2024-05-03", "Ann Doe")
    assert rows["/2"]["concerns"] == "the floor was wet and nobody saw it at all." and rows["/1"]["concerns"] is None
    assert s.top_up() is s.reports and s.top_up(s.reports.where("url = '/1'")).count() == 2
    changed = s.reports.withColumn("coroner", F.lit("Bob")).withColumn("area", F.lit("kept"))
    again = {r["url"]: (r["coroner"], r["area"]) for r in s.rescrape_fields(["coroner"], changed).collect()}
    assert again == {"/1": ("Ann Doe", "kept"), "/2": (None, "kept")}
    s.llm = Filler()
    assert {r["url"]: r["coroner"] for r in s.run_llm_fallback().collect()} == {"/1": "Ann Doe", "/2": "filled by model"}
    for bad in ({"order": ("nowhere",)}, {"order": ("llm", "html")}, {"workers": 0}):
        with pytest.raises(ValueError):
            api.Scraper(spark, fetch, **bad)
    with pytest.raises(ValueError):
        s.rescrape_fields(["weather"])


def test_documents(spark, tmp_path):
    for name, data in (("a.pdf", b"good  text"), ("b.pdf", b"bad"), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(data)

    def parse(data):
        if data == b"bad":
            raise OSError
        return data.decode()

    got = {r["path"].rpartition("/")[2]: r["text"] for r in html.document_texts(spark.read.format("binaryFile").load(str(tmp_path)), parse).collect()}
    assert got == {"a.pdf": "good text", "b.pdf": html.NOT_PDF, "c.txt": None}


def test_batches_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{k:03d}", k) for k in range(23)], "url string, n long")
    path, seen = str(tmp_path / "out"), []

    def step(df):
        seen.append(df.count())
        if len(seen) == 2:
            raise OSError
        return df.withColumn("n", F.col("n") + 1)

    with pytest.raises(OSError):
        sinks.write_in_batches(rows, path, step, size=10)
    assert spark.read.parquet(path).count() == 10
    assert sinks.write_in_batches(rows, path, step, size=10).agg(F.sum("n")).first()[0] == sum(range(1, 24)) and seen == [10, 10, 10, 3]
    with pytest.raises(ValueError):
        sinks.write_in_batches(rows.where("url <> 'u005'"), path, step)
    w = Workspace(rows)
    w.exclude(rows.where("n = 3"), "no", key="url")
    w.snapshot(str(tmp_path / "snap"), {"area": ["North"]})
    back = Workspace.open(spark, str(tmp_path / "snap"))
    assert back.state.active.count() == 22 and back.state.excluded.first()["reason"] == "no" and back.state.filters == {"area": ["North"]} and not back.back
    assert sinks.bundle({"a": rows}, kind="tsv")[1].startswith(b"url\tn\n")
    assert sinks.read_split_json(spark, '{"columns": ["a", "b"], "index": [0], "data": [[1, null]]}').first().asDict() == {"a": "1", "b": None} and sinks.read_split_json(spark, " ") is None
    sinks.write_themes(spark, str(tmp_path / "themes"), "{}")
    assert spark.read.json(str(tmp_path / "themes")).first()["reply"] == "{}"
    (tmp_path / "schema.json").write_text('{"theme_falls": "**Falls**", "drugs": {"text": "`Drugs`"}}')
    assert {r["theme"]: r["description"] for r in reports.read_theme_schema(spark, str(tmp_path / "schema.json")).collect()} == {"falls": "Falls", "drugs": "Drugs"}
    with pytest.raises(FileNotFoundError):
        reports.load_reports(spark, str(tmp_path / "nothing.csv"))
