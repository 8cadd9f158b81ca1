"""Polite fetching of many links: links go to tasks by host, so a host meets one task and its session.

The number of tasks bounds the hosts that are visited at a time, a task's threads the requests to one host, and each
request waits a random delay first. Answers that ask for patience (429 and gateway errors) and failed connections are tried again with
growing pauses. Results are written round by round to a folder, so a run that broke off goes on with the links that
have no answer there; what failed in the end is tried again by the next run.

Cases: a null or blank link is left out; a repeated link is fetched once; a link without a host (a file path) counts as
one of host ''; other columns are not carried: join the answers by ``url``; an empty table gives no rows. A status that is
neither good nor worth another try is an answer like any other, with its body.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .reports import exists

#: A function from (url, seconds) to (status, body, headers); OSError where there is no answer.
Get = Callable[[str, float], tuple[int, bytes, dict]]


@dataclass(frozen=True)
class Manners:
    """How often and how patiently a host is asked. The defaults."""

    delay: tuple[float, float] = (1.0, 2.0)
    timeout: float = 60.0
    requests: int = 5  # to one host at a time
    hosts: int = 10  # at a time
    retries: int = 30
    connect_retries: int = 10
    backoff: float = 1.0
    longest_pause: float = 120.0
    again: tuple[int, ...] = (429, 502, 503, 504)


def get_url(url: str, timeout: float) -> tuple[int, bytes, dict]:
    """http and https by the standard library; file URIs and plain paths as they are, 404 where there is no file."""
    scheme = urllib.parse.urlsplit(url).scheme
    if scheme not in ("http", "https"):
        path = urllib.parse.unquote(url.removeprefix("file://"))
        try:
            with open(path, "rb") as f:
                return 200, f.read(), {}
        except FileNotFoundError:
            return 404, b"", {}
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310 - http and https only
            return r.status, r.read(), dict(r.headers)
    except urllib.error.HTTPError as e:
        return e.code, e.read(), dict(e.headers)


class Session:
    """Requests under one set of manners; safe to share among threads."""

    def __init__(self, manners: Manners = Manners(), get: Get = get_url, sleep: Callable[[float], None] = time.sleep):
        self.manners, self.get, self.sleep = manners, get, sleep

    def pause(self) -> None:
        """The delay before a request; (0, 0) is none."""
        low, high = self.manners.delay
        if high > 0:
            self.sleep(random.uniform(low, high))  # noqa: S311

    def fetch(self, url: str) -> dict:
        """url, status, attempts, body, error of a link."""
        m, failed = self.manners, 0
        for attempt in range(1, m.retries + 2):
            self.pause()
            try:
                status, body, headers = self.get(url, m.timeout)
                error = None
                if status not in m.again:
                    return {"url": url, "status": status, "attempts": attempt, "body": body, "error": None}
                error = f"status {status}"
            except OSError as e:
                status, headers, failed, error = None, {}, failed + 1, f"{type(e).__name__}: {e}"
                if failed > m.connect_retries:
                    break
            if attempt <= m.retries:
                asked = str(headers.get("Retry-After", ""))
                wait = float(asked) if asked.isdigit() else m.backoff * 2 ** (attempt - 1)
                if attempt > 1 or asked.isdigit():  # the first try again comes at once
                    self.sleep(min(m.longest_pause, wait))
        return {"url": url, "status": status, "attempts": attempt, "body": None, "error": error}


ANSWERS = "url string, host string, status int, attempts int, body binary, error string, task int"


def fetch(links: DataFrame, manners: Manners = Manners(), get: Get = get_url, column: str = "url") -> DataFrame:
    """An answer for each distinct link: url, host, status, attempts, body, error, task (the partition that asked). Lazy."""
    asked = links.select(F.trim(F.col(column)).alias("url")).where("url is not null and url <> ''").distinct()
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    by_host = asked.select("url", host.alias("host")).repartition(manners.hosts, "host").sortWithinPartitions("host", "url")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, task = Session(manners, get), TaskContext.get().partitionId()
        with ThreadPoolExecutor(manners.requests) as pool:
            for f in frames:
                for name, some in f.groupby("host", sort=False):
                    for lo in range(0, len(some), 100):
                        got = pd.DataFrame(list(pool.map(session.fetch, some["url"].iloc[lo : lo + 100])), columns=["url", "status", "attempts", "body", "error"])
                        got["status"] = got["status"].astype("Int32")
                        yield got.assign(host=name, task=task)[["url", "host", "status", "attempts", "body", "error", "task"]]

    return by_host.mapInPandas(run, ANSWERS)


def fetch_into(links: DataFrame, path: str, manners: Manners = Manners(), get: Get = get_url, column: str = "url", rounds: int = 10) -> DataFrame:
    """Answers to all links, kept in a folder: those with one there are not asked again, and each round's are safe once written.

    Returns the last answer of each link. rounds: into how many parts of about equal size, drawn by hash, the links fall.
    """
    spark = links.sparkSession
    asked = links.select(F.trim(F.col(column)).alias("url"))

    def answered() -> DataFrame:
        if not exists(spark, path):
            return spark.createDataFrame([], f"{ANSWERS}, at timestamp")
        return spark.read.schema(f"{ANSWERS}, at timestamp").parquet(path)

    for k in range(rounds):
        good = answered().where("error is null").select("url")
        part = asked.where(F.pmod(F.xxhash64("url"), F.lit(rounds)) == k).join(good, "url", "left_anti")
        fetch(part, manners, get).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
    last = answered().groupBy("url").agg(F.max(F.struct(F.col("error").isNull().alias("good"), "at", "host", "status", "attempts", "body", "error", "task")).alias("x"))
    return last.select("url", "x.host", "x.status", "x.attempts", "x.body", "x.error", "x.at")
