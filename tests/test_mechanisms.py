"""Stored index, data source, polite fetch, sheets, events, joins without broadcast, rounds, resumed batches, payloads."""

import io
import itertools
import json
import os
import random
import time
import zipfile
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from reportlake.operators import canonical, graph, models, search, search_index, stats, tables, tagging
from reportlake.sources import cache, fetch, sheets, sinks, site
from reportlake.streaming import progress

# ---------------------------------------------------------------------------- search


def plain_scores(rows, query):
    """Scores by the definition, in plain Python."""
    import re

    plain, tokens, stems = search.query_terms(query)
    norm = lambda t: re.sub("[^a-z0-9]+", " ", re.sub("[’']", "", (t or "").lower())).strip()
    weights = {"investigation": 4, "circumstances": 3, "concerns": 2}
    weights = {f: w for f, w in search.V.SEARCH_FIELDS.items() if f in rows[0]} or weights
    out = Counter()
    for r in rows:
        points, met, phrase = 0.0, set(), False
        for f, w in weights.items():
            text = norm(r[f])
            own = text.split()
            phrase |= plain in text
            points += w * (6 * (plain in text) + 2.5 * sum(t in own for t in tokens) + sum(s in {search.stem_word(x) for x in own} for s in stems))
            met |= {s for s in stems if s in {search.stem_word(x) for x in own}}
        score = points + (10 if len(met) == len(stems) else 0) if len(met) >= (1 if len(stems) <= 2 else 2) or phrase else 0.0
        if stems and score >= search.least_score(stems):
            out[str(r["report_id"]), score] += 1
    return out


def some_reports(n=60):
    rng = random.Random(3)
    vocab = ["fall", "falls", "falling", "bath", "bathe", "ladies", "lady", "city", "cities", "the", "of", "delay's", "Delayed", "x", "ambulance", "fallsome"]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 14)))])
    return [{"report_id": k, "investigation": text(), "circumstances": text(), "concerns": text(), "word": "own", "score": 1.5, "key": "k"} for k in range(n)]


QUERIES = ["the falls", "falls", "ladies delayed", "of the", "e fall", "city of the falling delays", "!!", "lady lady", "fallsom", "ambulance"]


def test_search_and_stored_index_agree_with_the_definition(spark, tmp_path):
    rows = some_reports()
    schema = "report_id long, investigation string, circumstances string, concerns string, word string, score double, key string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).withColumn("date", F.lit("2020-01-01").cast("date"))
    index = search_index.SearchIndex(spark, str(tmp_path / "index"), buckets=5)
    assert index.search("falls").count() == 0
    assert index.append(df.where("report_id < 25")) == 25 and index.append(df.where("report_id < 25")) == 0
    # A broken append: postings without their row in batches do not count.
    (index._postings("none")).write.mode("append").partitionBy("batch", "bucket").parquet(f"{index.root}/postings")
    assert {r["key"] for r in index.search("fall").collect()} == {k for k, _ in plain_scores(rows[:25], "fall")}
    assert index.append(df.where("report_id >= 20").unionByName(df.where("report_id = 59"))) == 35
    again = search_index.SearchIndex(spark, str(tmp_path / "index"))
    assert again.buckets == 5
    for q in QUERIES:
        want = plain_scores(rows, q)
        found = search.search(df, q)
        assert Counter((str(r["report_id"]), r["score"]) for r in found.collect()) == want, q
        assert found.columns.count("score") == 1 and found.where("word <> 'own' or key <> 'k'").count() == 0
        assert Counter((r["key"], r["score"]) for r in again.search(q).collect()) == want, q
        assert [r["score"] for r in again.search_reports(df, q).collect()] == sorted((s for (_, s), n in want.items() for _ in range(n)), reverse=True)


def test_a_stored_search_reads_its_own_buckets(spark, tmp_path):
    index = search_index.SearchIndex(spark, str(tmp_path / "index"), buckets=50)
    index.append(spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, k + 20))) for k in range(200)], "report_id long, concerns string"))
    read = index._of_stems(["w7"])
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [" in plan and "In(stem" in plan.replace("EqualTo(stem", "In(stem")
    assert len({f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()}) <= len({f.split("bucket=")[1].split("/")[0] for f in index._postings(*index._batches()).inputFiles()})
    assert read.select("stem").distinct().count() == 1


def test_an_append_holds_few_texts_at_a_time(spark, tmp_path, monkeypatch):
    """Batches to the index's Python: rows and bytes, not Spark's 10,000 rows of any length; postings leave it a few at a time."""
    taken, given = tmp_path / "taken", tmp_path / "given"
    taken.mkdir()
    given.mkdir()
    real = type(spark.range(1)).mapInArrow

    def seen(df, run, schema):
        def outer(batches):
            def told():
                for b in batches:
                    (taken / f"{os.getpid()}-{time.time_ns()}").write_text(f"{b.num_rows} {b.nbytes}")
                    yield b

            for out in run(told()):
                (given / f"{os.getpid()}-{time.time_ns()}").write_text(str(out.num_rows))
                yield out

        return real(df, outer, schema)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", seen)
    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("report_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.concat(F.lit("word"), k.cast("string"), F.lit("x"), F.col("id").cast("string"))), " ").alias("concerns"))
    settings = [spark.conf.get(f"spark.sql.execution.arrow.max{k}PerBatch") for k in ("Records", "Bytes")]
    index = search_index.SearchIndex(spark, str(tmp_path / "index"), buckets=4)
    assert index.append(df) == 3000
    assert {r["key"] for r in index.search("word7x2999").collect()} == {"2999"}
    sizes = [tuple(map(int, f.read_text().split())) for f in taken.iterdir()]
    assert sizes and max(n for n, _ in sizes) <= 1000 and max(b for _, b in sizes) < 6 << 20
    assert max(int(f.read_text()) for f in given.iterdir()) <= search_index.POSTINGS_HELD + 401
    assert settings == [spark.conf.get(f"spark.sql.execution.arrow.max{k}PerBatch") for k in ("Records", "Bytes")]


# ---------------------------------------------------------------------------- data source and fetch


def write_site(folder, n, per_page=3):
    """Index pages, newest first, and report pages of n reports; those divisible by 4 have no document, 5 is not there."""
    folder.mkdir(exist_ok=True)
    for k in range(n):
        if k != 5:
            link = f"<div class='wp-block-file'><a href='doc{k}.pdf'>x</a></div>" if k % 4 else ""
            (folder / f"report{k}.html").write_text(f"<p>Ref: {k}</p>{link}")
    newest = list(range(n))[::-1]
    for p in range(0, n, per_page):
        (folder / f"index-{p // per_page + 1}.html").write_text("".join(f"<a class='card__link' href='report{k}.html'>r</a>" for k in newest[p : p + per_page]))


def want_row(k):
    return (k + 1, 404, None) if k == 5 else (k + 1, 200, f"doc{k}.pdf" if k % 4 else None)


def test_report_site(spark, tmp_path):
    spark.dataSource.register(site.ReportSite)
    folder = tmp_path / "site"
    options = {"index": f"{folder}/index-{{page}}.html", "delay": "0"}
    for n in (1, 3, 8, 13):
        write_site(folder, n)
        rows = spark.read.format("report_site").options(**options).load().collect()
        assert sorted((r["place"], r["status"], r["document"] and os.path.basename(r["document"])) for r in rows) == [want_row(k) for k in range(n)]
        assert all((r["html"] is None) == (r["status"] == 404) for r in rows)
    df = spark.read.format("report_site").options(**options, pagesPerPartition="2").load()
    assert df.count() == 13 and df.rdd.getNumPartitions() == 3
    empty = spark.read.format("report_site").options(index=f"{tmp_path}/none-{{page}}.html", delay="0").load()
    assert empty.count() == 0
    with pytest.raises(Exception, match="template"):
        spark.read.format("report_site").option("index", "x").load().count()


def test_report_site_as_a_stream(spark, tmp_path):
    spark.dataSource.register(site.ReportSite)
    folder = tmp_path / "site"
    write_site(folder, 4)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    for n in (4, 4, 11):
        write_site(folder, n)
        stream = spark.readStream.format("report_site").option("index", f"{folder}/index-{{page}}.html").option("delay", "0").load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out).collect()
        assert sorted((r["place"], r["status"], r["document"] and os.path.basename(r["document"])) for r in rows) == [want_row(k) for k in range(n)]


def noted(folder):
    """A way to fetch that notes who asked when; x-hosts answer 503 twice, down-hosts not at all."""

    def get(url, timeout):
        import threading
        import uuid

        from pyspark import TaskContext

        host = url.split("/")[2]
        began = time.time()
        tries = len([f for f in os.listdir(folder) if f.startswith(url.replace("/", "_") + "@")])
        time.sleep(0.01)
        with open(f"{folder}/{url.replace('/', '_')}@{uuid.uuid4().hex}", "w") as f:
            f.write(json.dumps([host, TaskContext.get().partitionId(), began, time.time(), threading.get_ident()]))
        if host.startswith("down"):
            raise ConnectionError("no answer")
        return (503, b"", {"Retry-After": "0"}) if host.startswith("x") and tries < 2 else (404 if url.endswith("gone") else 200, url.encode(), {})

    return get


def test_polite_fetch(spark, tmp_path):
    links = [f"http://h{k % 7}.org/{k}" for k in range(60)] + ["http://x.org/1", "http://x.org/gone", "http://down.org/1", "http://h1.org/1", None, " "]
    df = spark.createDataFrame([(x, "extra") for x in links], "url string, host string")
    manners = fetch.Manners(delay=(0.0, 0.02), retries=3, connect_retries=1, backoff=0.01, hosts=3, requests=2)
    rows = fetch.fetch(df, manners, noted(str(tmp_path))).collect()
    assert sorted(r["url"] for r in rows) == sorted({x for x in links if x and x.strip()})
    by = {r["url"]: r for r in rows}
    assert by["http://x.org/1"]["attempts"] == 3 and by["http://x.org/1"]["status"] == 200 and by["http://x.org/gone"]["status"] == 404
    assert by["http://down.org/1"]["attempts"] == 2 and "ConnectionError" in by["http://down.org/1"]["error"]
    notes = [json.loads((tmp_path / f).read_text()) for f in os.listdir(tmp_path)]
    tasks = defaultdict(set)
    for host, task, *_ in notes:
        tasks[host].add(task)
    assert all(len(t) == 1 for t in tasks.values()) and len({t for x in tasks.values() for t in x}) <= 3
    for host in tasks:
        mine = [(a, b) for h, _, a, b, _ in notes if h == host]
        assert max(sum(a <= t < b for a, b in mine) for t, _ in mine) <= 2


def test_delay_and_pauses():
    slept = []
    answers = iter([(429, b"", {}), (503, b"", {"Retry-After": "7"}), (502, b"", {}), (200, b"ok", {})])
    s = fetch.Session(fetch.Manners(delay=(0.5, 0.5), backoff=1.0), lambda url, t: next(answers), slept.append)
    assert s.fetch("u")["attempts"] == 4 and slept == [0.5, 0.5, 7.0, 0.5, 4.0, 0.5]
    quiet = fetch.Session(fetch.Manners(delay=(0, 0)), lambda url, t: (200, b"", {}), lambda x: pytest.fail("slept"))
    assert quiet.fetch("u")["status"] == 200


def test_fetch_goes_on_where_it_stopped(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    df = spark.createDataFrame([(f"http://h{k}.org/{k}",) for k in range(12)] + [("http://down.org/1",)], "url string")
    manners = fetch.Manners(delay=(0, 0), connect_retries=0, retries=1, hosts=2)
    path = str(tmp_path / "answers")
    first = fetch.fetch_into(df.where("url < 'http://h3'"), path, manners, noted(str(notes)), rounds=3)
    assert first.where("error is null").count() == 5 and first.count() == 6
    every = fetch.fetch_into(df, path, manners, noted(str(notes)), rounds=3)
    assert every.count() == 13 and every.where("error is null").count() == 12
    asked = Counter(f.split("@")[0] for f in os.listdir(notes))
    assert asked.pop("http:__down.org_1") == 2 and set(asked.values()) == {1}


def test_refresh_job_and_dataset_copy(spark, tmp_path):
    from reportlake.sources.reports import cached_dataset, load_reports
    from reportlake.streaming import refresh

    place = lambda name: str(tmp_path / name)
    rows = lambda ids: spark.createDataFrame([(f"u{k}", f"2020-01-{k:02d}") for k in ids], "url string, date string").withColumn("date", F.to_date("date"))
    rows([1, 2]).write.parquet(place("incoming"))
    run = lambda: refresh.main([place("incoming"), place("target"), place("state")], spark)
    assert run() == (0, 2) and run() == (2, 2)
    rows([2, 3, 4]).write.mode("append").parquet(place("incoming"))
    assert run() == (2, 4)
    told = [r["event"] for r in progress.read_events(spark, f"{place('state')}/events").collect()]
    assert told.count("complete") == 3 and told.count("error") == 0
    with pytest.raises(FileNotFoundError):
        cached_dataset(spark, place("none"), place("cache"))
    assert load_reports(spark, cached_dataset(spark, place("target"), place("cache"))).count() == 4
    rows([9]).write.mode("append").parquet(place("target"))
    assert load_reports(spark, cached_dataset(spark, place("target"), place("cache"))).count() == 4
    assert load_reports(spark, cached_dataset(spark, place("target"), place("cache"), refresh=True)).count() == 5


# ---------------------------------------------------------------------------- sheets


def workbook(sheets_, shared=()):
    """The bytes of a workbook; cells as XML."""
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets_, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets_) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si>{x}</si>' for x in shared)}</sst>")
        for k, rows in enumerate(sheets_.values(), 1):
            body = "".join(f'<row r="{i}">{x}</row>' for i, x in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_sheets(spark, tmp_path):
    shared = ["<t>Case id</t>", "<t>Consensus</t>", "<r><t>Ye</t></r><r><t>s</t></r>", "<t>no</t>"]
    s = lambda place, k: f'<c r="{place}" t="s"><v>{k}</v></c>'
    rows = [
        s("A1", 0) + s("C1", 1) + '<c r="AB1" t="inlineStr"><is><t>Note</t></is></c><c r="AC1" t="inlineStr"><is><t>Note</t></is></c>',
        '<c r="A2"><v>12.5</v></c>' + s("C2", 2) + '<c r="AC2" t="str"><f>A2</f><v>sum</v></c>', "",
        '<c r="A4"><v>7</v></c><c r="C4" t="b"><v>0</v></c><c r="D4"><v>9</v></c><c r="AB4" t="e"><v>#N/A</v></c>', s("C5", 3), '<c r="C6" t="inlineStr"><is><t>maybe</t></is></c>',
    ]
    (tmp_path / "a.xlsx").write_bytes(workbook({"Other": [], "Answers": rows}, shared))
    (tmp_path / "b.xlsx").write_bytes(workbook({"Answers": ['<c t="inlineStr"><is><t>Case id</t></is></c>', "<c><v>1</v></c>"]}))
    got = sheets.read_sheets(spark, str(tmp_path / "*.xlsx"), "Answers", {"Case id": "id"}, ["Consensus"])
    assert got.columns == ["id", "Consensus", "Note", "Note_2"] and dict(got.dtypes)["Consensus"] == "boolean"
    assert Counter(tuple(r) for r in got.collect()) == Counter([("12.5", True, None, "sum"), ("7", False, None, None), (None, False, None, None), (None, None, None, None), ("1", None, None, None)])
    assert sheets.read_sheets(spark, str(tmp_path / "*.xlsx"), "Nowhere").count() == 0
    assert [sheets.column_number(x) for x in ("A1", "Z9", "AA1", "AB7")] == [0, 25, 26, 27]


# ---------------------------------------------------------------------------- events


def test_events_of_good_and_failing_runs(spark, tmp_path):
    root = str(tmp_path / "events")
    assert progress.read_events(spark, root).count() == 0
    with progress.Events(spark, root, "good", alive=0.2) as e:
        e.stage("load", "reading")
        e.progress(1, 3, "a")
        time.sleep(0.5)
        e.progress(3, 3)
    e.stage("late")
    with pytest.raises(KeyError), progress.Events(spark, root, "bad") as f:
        f.progress(0, 0)
        raise KeyError("x")
    rows = progress.read_events(spark, root, "good").orderBy("number").collect()
    names = [r["event"] for r in rows]
    assert [n for n in names if n != "keepalive"] == ["stage", "progress", "progress", "complete"] and "keepalive" in names[2:-2] + names[2:3]
    assert [r["number"] for r in rows] == list(range(len(rows))) and json.loads(rows[1]["data"])["percent"] == 33
    assert rows[0]["frame"] == f"event: stage\ndata: {rows[0]['data']}\n\n" and next(r["frame"] for r in rows if r["event"] == "keepalive") == ": keepalive\n\n"
    bad = progress.read_events(spark, root, "bad").orderBy("number").collect()
    assert [r["event"] for r in bad] == ["progress", "error"] and "KeyError" in bad[1]["data"] and json.loads(bad[0]["data"])["percent"] == 0
    assert progress.read_events(spark, root, "good", after=rows[-2]["number"]).count() == 1


def test_listener_tells_what_streams_do(spark, tmp_path):
    root = str(tmp_path / "events")
    spark.range(10).write.parquet(str(tmp_path / "in"))

    def run(name, step):
        events = progress.Events(spark, root, name)
        listener = progress.ProgressListener(events, (name,))
        spark.streams.addListener(listener)
        try:
            q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.queryName(name).foreachBatch(step).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            try:
                q.awaitTermination()
            except Exception:  # noqa: BLE001 - told by the listener
                pass
            assert events.over.wait(20)
        finally:
            spark.streams.removeListener(listener)
        return [(r["event"], json.loads(r["data"])) for r in progress.read_events(spark, root, name).orderBy("number").collect()]

    good = run("fine", lambda df, k: df.count())
    assert [e for e, _ in good] == ["stage", "progress", "complete"] and good[1][1]["completed"] == 10

    def fails(df, k):
        raise RuntimeError("broken step")

    bad = run("broken", fails)
    assert [e for e, _ in bad] == ["stage", "error"]


# ---------------------------------------------------------------------------- areas, pairs, betweenness


def test_fuzzy_equals_all_pairs(spark):
    rng = random.Random(11)
    letters = "abcde fgh"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip()
    aliases = sorted({w for w in (word(rng.choice([1, 2, 3, 4, 6, 9, 14, 20])) for _ in range(350)) if w})
    aliases += [a + rng.choice(letters[:5]) for a in aliases[:60]]

    def typo(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w, w[:k] + rng.choice("xyz") + w[k:], w[:k] + w[k + 1 :], w[:k] + w[k + 1 :][:1] + w[k : k + 1] + w[k + 2 :]])

    values = sorted({typo(typo(rng.choice(aliases))) for _ in range(350)} | {"", "!!", "a", "ab"})
    areas = spark.createDataFrame([(a, a.upper(), "allowed") for a in aliases], "alias string, canonical string, kind string")
    got = {r["value"]: (r["canonical"], r["score"], r["matched"]) for r in canonical.fuzzy(spark.createDataFrame([(v,) for v in values], "value string"), areas).collect()}
    key = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = {}
    for v in values:
        if key(v):
            scored = sorted(((SequenceMatcher(None, key(v), key(a)).ratio(), key(a), a.upper()) for a in aliases if key(a)), key=lambda x: (-x[0], x[1], x[2]))[:2]
            if scored[0][0] >= canonical.LEAST and scored[0][0] - scored[1][0] >= canonical.MARGIN:
                want[v] = (scored[0][2], scored[0][0], scored[0][1])
    assert got == want and len(want) > 50
    plan = canonical.fuzzy(spark.createDataFrame([("ab",)], "value string"), areas.where("false"))
    assert plan.count() == 0


def test_rounds_take_what_one_after_the_other_takes(spark):
    rng = random.Random(12)
    for each, total, n in ((1, 50, 12), (2, 9, 15), (3, 1000, 40), (8, 420, 25)):
        pairs = [(f"t{a:02d}", f"t{b:02d}", rng.randint(1, 4), rng.choice([0.1, 0.2, 0.5, 0.9])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        held, want = Counter(), []
        for p in sorted(pairs, key=lambda p: (-p[3], -p[2], p[0], p[1])):
            if len(want) < total and held[p[0]] < each and held[p[1]] < each:
                held[p[0]] += 1
                held[p[1]] += 1
                want.append(p)
        df = spark.createDataFrame(pairs, "source string, target string, n long, jaccard double")
        assert [tuple(r) for r in graph.greedy_pairs(df, each, total).collect()] == want
    assert graph.greedy_pairs(df.where("false")).count() == 0


def test_betweenness_by_joins_equals_in_tasks(spark):
    rng = random.Random(13)
    pairs = [("k", f"n{a}", f"n{b}", 1) for a, b in itertools.combinations(range(60), 2) if rng.random() < 0.06] + [("k", "n1", "n1", 1), ("k", "far", "away", 1)]
    edge = spark.createDataFrame(pairs, "kind string, source string, target string, n long")
    one, two = ({r["id"]: r["betweenness"] for r in graph.betweenness(edge, **how).collect()} for how in ({}, {"most_edges": 1, "sources_a_block": 25}))
    assert set(one) == set(two) and max(one.values()) > 0.1 and all(abs(one[k] - two[k]) < 1e-12 for k in one)


def test_betweenness_follows_classes_of_the_same_neighbours(spark, monkeypatch):
    rng = random.Random(14)
    hubs = [f"h{k}" for k in range(4)]
    pairs = {(a, b) for a, b in itertools.combinations(hubs, 2) if (a, b) != ("h0", "h3")} | {(h, f"n{k}") for k in range(300) for h in rng.sample(hubs, rng.choice([1, 1, 2, 3]))} | {("n0", "far"), ("w1", "w2")}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:  # node by node
        order, far, paths = [s], {s: 0}, Counter({s: 1})
        for v in order:
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    order.append(w)
                paths[w] += paths[v] * (far[w] == far[v] + 1)
        share = Counter()
        for w in reversed(order[1:]):
            want[w] += share[w]
            for v in near[w]:
                if far[v] == far[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
    edge = spark.createDataFrame([("k", a, b, 1) for a, b in sorted(pairs)], "kind string, source string, target string, n long")
    followed, in_tasks = [], graph._shares_in_tasks
    monkeypatch.setattr(graph, "_shares_in_tasks", lambda spark, rows, n: followed.append(n) or in_tasks(spark, rows, n))
    n = len(near)
    for how in ({}, {"most_edges": 1, "sources_a_block": 9}):
        got = {r["id"]: r["betweenness"] for r in graph.betweenness(edge, **how).collect()}
        assert set(got) == set(near) and all(abs(got[v] - want[v] / ((n - 1) * (n - 2))) < 1e-12 for v in got)
    assert followed == [len({frozenset(x) for x in near.values()})] and followed[0] < 25
    # Fingerprints that say nothing: nodes of as many neighbours that differ in one are told apart.
    both = spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "a string, b string")
    for r in graph.twins(both, lambda b, k: F.lit(0).cast("long")).collect():
        assert near[r["id"]] == near[r["twin"]]


# ---------------------------------------------------------------------------- batches, payloads, model calls


def test_a_model_meets_few_prompts_at_a_time(spark, tmp_path):
    class Weighed:
        """Notes how many prompts stood in the batch that a call's prompts came from."""

        def __init__(self, folder):
            self.folder = str(folder)

        def generate(self, prompts, schema=None):
            import inspect

            f = next(x.frame.f_locals["f"] for x in inspect.stack() if x.function == "run")
            with open(f"{self.folder}/{os.getpid()}-{time.time_ns()}", "w") as out:
                out.write(f"{len(f)} {int(f['prompt'].str.len().sum())}")
            return ["{}" for _ in prompts]

    for name, n, length, calls in (("rows", 5000, 10, None), ("bytes", 900, 30_000, 2)):
        folder = tmp_path / name
        folder.mkdir()
        prompts = spark.range(n).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), length)).alias("prompt")).coalesce(1)
        assert models.ask(prompts, Weighed(folder), partitions=1, calls=calls).where("reply = '{}'").count() == n
        sizes = [tuple(map(int, f.read_text().split())) for f in folder.iterdir()]
        assert max(rows for rows, _ in sizes) <= 1000 and max(size for _, size in sizes) < 5 << 20


def test_batches_lose_nothing(spark, tmp_path):
    rows = [(k, v) for v, k in enumerate([None, None, "a", "a", "a", "b", "b", "c", "c", "c", "c", "d"])]
    df = spark.createDataFrame(rows, "url string, job long")
    out = sinks.write_in_batches(df, str(tmp_path / "one"), lambda x: x, size=3)
    assert Counter(tuple(r) for r in out.collect()) == Counter(rows)
    calls = []

    def breaks(x):
        calls.append(x.count())
        if len(calls) == 2:
            raise InterruptedError
        return x

    path = str(tmp_path / "two")
    with pytest.raises(InterruptedError):
        sinks.write_in_batches(df, path, breaks, size=3)
    df.limit(1).write.parquet(f"{path}/job=left")
    more = df.unionByName(spark.createDataFrame([("e", 77)], df.schema))
    assert Counter(tuple(r) for r in sinks.write_in_batches(more, path, breaks, size=3).collect()) == Counter([*rows, ("e", 77)])
    assert sum(calls) - calls[1] == 13 and Counter(tuple(r) for r in sinks.write_in_batches(more, path, breaks, size=3).collect()) == Counter([*rows, ("e", 77)])
    with pytest.raises(ValueError, match="beginning"):
        sinks.write_in_batches(more.where("job <> 4"), path, breaks, size=3)
    many = spark.range(5000).select(F.col("id").cast("string").alias("url"))
    jobs = []
    assert sinks.write_in_batches(many, str(tmp_path / "many"), lambda x: (jobs.append(1), x)[1], size=10, waves=7).count() == 5000 and len(jobs) <= 7
    assert sinks.write_in_batches(df.where("false"), str(tmp_path / "none"), lambda x: x).count() == 0


def test_payloads(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "in"))
    read = lambda k: spark.read.parquet(str(tmp_path / "in")).where(F.col("id") % 3 == k).groupBy((F.col("id") % 2).alias("odd")).count()
    held = cache.Payloads(spark, str(tmp_path / "held"), held=2)
    first = sorted(map(tuple, held.get(read(0)).collect()))
    assert first == sorted(map(tuple, read(0).collect())) and len(held.keys()) == 1
    made = os.listdir(tmp_path / "held" / "data")
    other = cache.Payloads(spark.newSession(), str(tmp_path / "held"), held=2)
    assert sorted(map(tuple, other.get(read(0)).collect())) == first and os.listdir(tmp_path / "held" / "data") == made
    a, b, c = (held.key(read(k)) for k in range(3))
    assert len({a, b, c}) == 3
    held.get(read(1))
    held.get(read(0))
    held.get(read(2))
    assert held.keys() == [a, c] and len(os.listdir(tmp_path / "held" / "data")) == 2
    spark.range(100, 103).write.mode("append").parquet(str(tmp_path / "in"))
    assert held.key(read(0)) != a and held.get(read(0)).agg(F.sum("count")).first()[0] == 35
    with pytest.raises(ValueError, match="tag"):
        held.get(spark.createDataFrame([(1,)], "a int"))
    assert held.get(spark.createDataFrame([(1,)], "a int"), tag="one").count() == 1


def counting(folder, workers):
    """A model that notes how many calls are in flight, over all tasks; defined here, so that it goes to tasks by value."""

    class Counting:
        def __init__(self):
            self.workers = workers

        def generate(self, prompts, schema=None):
            import time
            import uuid
            from concurrent.futures import ThreadPoolExecutor

            def one(p):
                began = time.time()
                time.sleep(0.03)
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(f"{began} {time.time()}")
                return p

            with ThreadPoolExecutor(self.workers) as pool:
                return list(pool.map(one, prompts))

    return Counting()


def test_calls_are_bounded_over_all_tasks(spark, tmp_path):
    prompts = spark.createDataFrame([(f"p{k}",) for k in range(80)], "prompt string").repartition(8)
    for calls in (1, 3, 4):
        folder = tmp_path / str(calls)
        folder.mkdir()
        assert models.ask(prompts, counting(str(folder), 8), calls=calls, batch=10).count() == 80
        spans = [tuple(map(float, (folder / f).read_text().split())) for f in os.listdir(folder)]
        assert len(spans) == 80 and max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= calls


def test_theme_rows_in_sql(spark):
    models.register(spark)
    replies = spark.createDataFrame([(1, "```json\n{falls: {details: 'x'},}\n```".replace("'", '"')), (2, None), (3, "no object"), (4, '{"themes": {"a": ["b", "c"], "d": null}}'), (5, "{}")], "id long, reply string")
    got = spark.sql("SELECT id, theme, description FROM {r}, LATERAL theme_rows(reply)", r=replies).collect()
    assert sorted(map(tuple, got)) == [(1, "falls", "x"), (4, "a", "b; c"), (4, "d", "None")]


# ---------------------------------------------------------------------------- clashing names

NAMES = ["prompt", "prompt_sha", "reply", "error", "_r", "row", "gap", "found", "value", "score", "method", "canonical", "matched", "hit", "_k", "_hit", "_area_key", "key", "fresh", "_new_area", "id", "nth", "h", "y", "a.b"]


def test_own_columns_survive_whatever_their_names(spark):
    base = spark.createDataFrame([(1, "u1", "North", "NHS England", "the falls", None), (2, "u2", "Nroth", None, None, "2021-02-03"), (None, None, None, "", "", None)], "report_id long, url string, area string, receiver string, concerns string, date string")
    df = base.withColumns({n: F.lit(f"own {n}") for n in NAMES})
    model = models.KeywordModel("falls", {"age": 4})
    areas = spark.createDataFrame([("North", "North", "allowed")], "alias string, canonical string, kind string")
    results = {
        "screen": models.screen(df, model, "falls", ["concerns"], filter_df=False), "screened": models.screen(df, model, "falls", ["concerns"]),
        "spans": models.screen(df, models.KeywordModel("", {"matches": "yes", "spans": "x"}), "falls", ["concerns"], filter_df=False, produce_spans=True),
        "extract": models.extract(df, model, {"age": "int"}, ["concerns"]), "summarise": models.summarise(df, ["concerns"], trim_approach="summarise", model=model),
        "clean": models.clean_column(df, model, "area", "Clean"), "fill": models.fill_missing(df, model, ["date"], "concerns"),
        "areas": canonical.match_areas(df, areas), "tags": tagging.tag_collections(df, areas=spark.createDataFrame([("north",)], "area string")),
        "search": search.search(df, "falls"), "refresh": tables.refresh_columns(df, base.withColumn("area", F.upper("area")), ["area"]),
        "sample": tables.stratified_sample(df.withColumn("date", F.col("date").cast("date")), 3), "lengths": stats.lengths(df, ["concerns"]),
    }
    for name, got in results.items():
        kept = [n for n in NAMES if not (name == "search" and n == "score")]
        rows = got.collect()
        assert len(rows) == (1 if name in ("screened", "search") else 3), name
        assert all(got.columns.count(n) == 1 and all(r[n] == f"own {n}" for r in rows) for n in kept), name
    assert {r["report_id"]: r["area_canonical"] for r in results["areas"].collect()} == {1: "North", 2: "Other", None: "Other"}
    assert {r["report_id"]: r["age"] for r in results["extract"].collect()} == {1: 4, 2: 4, None: 4}
