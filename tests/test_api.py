"""The class facade and the frame cache."""

import pytest
from pyspark.sql import functions as F

from reportlake import api
from reportlake.operators.models import KeywordModel
from reportlake.sources.cache import FrameCache, signature

ROWS = [(1, "Ann", "Nort", "Acme NHS Trust; Chief Coroner", "falls at home", "x y", None), (2, "Bob", None, None, "drugs", None, "z")]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, "report_id long, coroner string, area string, receiver string, investigation string, circumstances string, concerns string")


def test_screener(small):
    s = api.Screener(KeywordModel("falls"), small)
    assert [r["report_id"] for r in s.screen_reports(search_query="falls").collect()] == [1]
    with pytest.raises(ValueError):
        api.Screener(KeywordModel("x"), small, include_weather=True)


def test_extractor(small):
    e = api.Extractor(llm=KeywordModel(fields={"old": True, "themes": {"a": "b"}}), reports=small)
    with pytest.raises(RuntimeError):
        e.tabulate()
    with pytest.raises(ValueError):
        e.estimate_tokens()
    e.extract_features(feature_model={"old": "bool"})
    assert tuple(e.tabulate().first())[:2] == ("old", 2)
    assert e.count(as_="stats").first()["total"] == 7
    assert e.count(as_="table", threshold=2, step=2).count() > 1
    e.summarise(max_words=3)
    assert e.estimate_tokens() == 6
    assert e.discover_themes() == {"a": "b"}
    assert api.seed_list("a\n\n b") == ["a", "b"] and api.seed_list('["x"]') == ["x"]


def test_cleaner(spark, small):
    areas = spark.createDataFrame([("North", "North", "allowed"), ("Southern Isles", "South", "allowed")], "alias string, canonical string, kind string")
    c = api.Cleaner(small, areas=areas)
    rows = c.clean_reports().orderBy("report_id").collect()
    assert (rows[0]["area"], rows[0]["receiver"]) == ("North", "Acme NHS Foundation Trust") and rows[1]["area"] is None and rows[1]["receiver"] is None
    assert c.match_area("north")[0] == "North" and c.match_area("moon")[0] == "Other"
    with pytest.raises(ValueError):
        api.Cleaner(small.drop("area"))
    shout = api.Cleaner(small, KeywordModel(), include_area=False, include_receiver=False).clean_reports()
    assert shout.orderBy("report_id").first()["coroner"] == "ANN"


def test_frame_cache(spark, small, tmp_path):
    path = str(tmp_path / "t")
    small.write.parquet(path)
    cache, loads = FrameCache(held=1), []

    def load():
        loads.append(1)
        return spark.read.parquet(path)

    key = signature(spark, path)
    assert cache.get(key, load) is cache.get(key, load) and len(loads) == 1
    small.limit(1).write.mode("append").parquet(path)
    assert signature(spark, path) != key
    assert cache.get(signature(spark, path), load).count() == 3 and len(cache.frames) == 1

    def broken():
        raise OSError

    assert cache.get(signature(spark, path), broken, refresh=True).count() == 3
    assert small.where(F.col("report_id") > 5).count() == 0
