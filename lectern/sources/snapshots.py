"""Snapshot tables of remote sources: a Spark data source over saved responses.

Spark has no rate-limited HTTP client and executors shouldn't hammer one, so
remote sources are harvested into files once.  ``format("harvest")`` reads
such files: one row a saved response, with its source, key and age, so the
readers in ``works`` and the cache operators work on them.
"""

from __future__ import annotations

import os
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Harvest(DataSource):
    """Options: path (a folder of <source>/<key>.json or .xml files that all executors see), source, files (a partition's, 200 by default)."""

    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return "source string, key string, value string"

    def reader(self, schema) -> HarvestReader:
        return HarvestReader(self.options)


class HarvestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.only, self.files = options["path"], options.get("source"), max(1, int(options.get("files", 200)))

    def partitions(self) -> list[InputPartition]:
        names = [self.only] if self.only else sorted(os.listdir(self.root))
        out = []
        for n in names:
            files = sorted(os.listdir(os.path.join(self.root, n)))
            out += [InputPartition((n, files[i : i + self.files])) for i in range(0, len(files), self.files)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        source, names = partition.value
        for name in names:
            with open(os.path.join(self.root, source, name), encoding="utf-8") as f:
                yield source, os.path.splitext(name)[0], f.read()


# Requests a second that each source asks its users to keep to; answers that are worth another try.
RATES = {"openalex": 10.0, "crossref": 50.0, "arxiv": 1 / 3, "semantic_scholar": 1.0, "scielo": 5.0, "tavily": 5.0, "unpaywall": 10.0}
RETRY_STATUS = {429, 500, 502, 503, 504}


class Pace:
    """Waits so that calls of a source keep to its rate: up to a second's worth at once, then one at a time."""

    def __init__(self, source: str, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep = RATES[source], clock, sleep
        self.most = max(1.0, self.rate)
        self.left, self.at = self.most, clock()

    def wait(self) -> None:
        now = self.clock()
        self.left, self.at = min(self.most, self.left + (now - self.at) * self.rate), now
        if self.left < 1:
            pause = (1 - self.left) / self.rate
            self.sleep(pause)
            self.left, self.at = 1.0, now + pause
        self.left -= 1


def harvest(source: str, calls: dict[str, Callable[[], tuple[int, dict, str]]], folder: str, suffix: str = ".json", pace: Pace | None = None, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Save the body of each call (key -> call) under ``folder``/``source``, at the source's pace; returns the keys that failed.

    The driver does this, once: a failure is not saved, so another harvest
    asks again.  ``format("harvest")`` reads what was saved.
    """
    pace, failed = pace or Pace(source), []
    os.makedirs(os.path.join(folder, source), exist_ok=True)
    for key, call in calls.items():
        pace.wait()
        try:
            body = with_retries(call, sleep)
        except (RuntimeError, TimeoutError):
            failed.append(key)
            continue
        with open(os.path.join(folder, source, key + suffix), "w", encoding="utf-8") as f:
            f.write(body)
    return failed


def download_pdf(url: str, path: str, get: Callable[[str], tuple[int, dict, bytes]]) -> dict:
    """Save what a url gives under ``path``, with the folders that it needs: saved_to, size_mb and url, or error and url.

    ``get`` returns (status, headers, body).  What doesn't call itself a PDF
    is refused, unless the path ends in .pdf.
    """
    try:
        status, headers, body = get(url)
    except (OSError, TimeoutError) as e:
        return {"error": str(e), "url": url}
    kind = {k.lower(): v for k, v in headers.items()}.get("content-type", "")
    if status >= 400:
        return {"error": f"HTTP {status}", "url": url}
    if "pdf" not in kind and not path.endswith(".pdf"):
        return {"error": f"not a PDF but {kind or 'of no stated type'}", "url": url}
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "wb") as f:
        f.write(body)
    return {"saved_to": path, "size_mb": round(len(body) / (1 << 20), 2), "url": url}


def guides(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the Markdown files under a folder, each as a whole; the name is the file's."""
    texts = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1)
    return texts.select(name.alias("name"), F.col("value").alias("text"))


def with_retries(call: Callable[[], tuple[int, dict, str]], sleep: Callable[[float], None], tries: int = 3, first: float = 1.0, most: float = 30.0, jitter: float = 2.0) -> str:
    """Body of a response; 429, server errors and timeouts are tried again with growing waits.

    ``call`` returns (status, headers, body).  A Retry-After header is obeyed
    up to a minute.  Any other error status is raised at once.
    """
    wait = first
    for attempt in range(1, tries + 1):
        try:
            status, headers, body = call()
        except TimeoutError:
            if attempt == tries:
                raise
            status, headers, body = 503, {}, ""
        if status < 400:
            return body
        if status not in RETRY_STATUS or attempt == tries:
            raise RuntimeError(f"HTTP {status}")
        asked = headers.get("Retry-After", "")
        sleep(min(60.0, float(asked)) if asked.isdigit() else min(most, wait) + random.uniform(0, jitter))
        wait *= 2
    raise RuntimeError("no try was made")
