"""Services that answer in pages, as a Python data source.

``spark.read.format("paged_hits")`` reads hits of a service whose pages are numbered from 1. Conditions on
year and source go into the request, so the service leaves out what they exclude. The first page tells how
many hits there are; ranges of pages become partitions, and each ends at its first short page. A request is
tried again after failures, with pauses that grow in proportion to the tries; some statuses stop the job.

What carries requests is a transport: ``RecordedTransport`` answers from recorded exchanges, a transport of
a user's own may reach a service. The rows hold payloads as JSON; ``records`` maps them.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

HIT = "source string, year int, page int, pos long, payload string"
RETRIES, PAUSE = 2, 1.2  # seconds, times the number of tries so far
PAGE, MOST = 100, 10_000_000

#: Gives (status, body) for a URL and the number of the try, from 0.
Transport = Callable[[str, int], tuple[int, str]]


class StoppedByStatus(RuntimeError):
    """A status that ends the whole read."""


def fetched(transport: Transport, url: str, retries: int = RETRIES, pause: float = PAUSE, stop_on: frozenset[int] = frozenset()) -> str | None:
    """The body of a successful answer; None when every try failed."""
    for attempt in range(retries + 1):
        try:
            status, body = transport(url, attempt)
        except OSError:
            status, body = 0, ""
        if status in stop_on:
            raise StoppedByStatus(f"status_{status} for {url}")
        if 200 <= status < 300:
            return body
        if attempt < retries:
            time.sleep(pause * (attempt + 1))
    return None


def exchange_name(url: str) -> str:
    return hashlib.sha1(url.encode()).hexdigest() + ".json"


@dataclass
class RecordedTransport:
    """Answers of a folder of recorded exchanges: a file a URL, its answers in the order of the tries.

    The last answer counts for all further tries; a URL that was not recorded is status 404.
    """

    folder: str

    def __call__(self, url: str, attempt: int) -> tuple[int, str]:
        from pyarrow import fs

        if "://" in self.folder or self.folder.startswith("file:"):
            files, base = fs.FileSystem.from_uri(self.folder)
        else:
            files, base = fs.LocalFileSystem(), self.folder
        try:
            with files.open_input_stream(f"{base}/{exchange_name(url)}") as f:
                answers = json.loads(f.read())
        except FileNotFoundError:
            return 404, ""
        status, body = answers[min(attempt, len(answers) - 1)]
        return status, body


def request_url(service: str, page: int, size: int, year_from: int | None = None, year_to: int | None = None, source: str | None = None) -> str:
    """The URL of a page; conditions that are not set are left out."""
    asked = {"year_from": year_from, "year_to": year_to, "source": source, "page": page, "per_page": size}
    return f"{service}?{urlencode({k: v for k, v in asked.items() if v is not None})}"


@dataclass
class PageRange(InputPartition):
    first: int
    last: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, transport: Transport):
        self.transport = transport
        self.service = options["service"]
        self.size, self.most = int(options.get("page_size", PAGE)), int(options.get("most", MOST))
        self.per_partition = int(options.get("pages_per_partition", 8))
        self.retries, self.pause = int(options.get("retries", RETRIES)), float(options.get("pause", PAUSE))
        self.stop_on = frozenset(int(s) for s in options.get("stop_on", "").split(",") if s.strip())
        self.skip_failed = options.get("failed_pages", "error") == "skip"
        self.year_from = self.year_to = self.source = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the year and one source go into the request; ``read`` tests them, as a service may ignore them. Others stay with Spark."""
        for f in filters:
            name, value = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, getattr(f, "value", None)
            if name == "year" and isinstance(value, int):
                low = {EqualTo: value, GreaterThanOrEqual: value, GreaterThan: value + 1}.get(type(f))
                high = {EqualTo: value, LessThanOrEqual: value, LessThan: value - 1}.get(type(f))
                if low is not None:
                    self.year_from = low if self.year_from is None else max(low, self.year_from)
                if high is not None:
                    self.year_to = high if self.year_to is None else min(high, self.year_to)
                if low is not None or high is not None:
                    continue
            elif name == "source" and isinstance(f, EqualTo) and isinstance(value, str) and self.source in (None, value):
                self.source = value
                continue
            yield f

    def accepts(self, hit: dict) -> bool:
        year = hit.get("publication_year")
        if (self.year_from is not None and (year is None or year < self.year_from)) or (self.year_to is not None and (year is None or year > self.year_to)):
            return False
        return self.source is None or hit.get("source") == self.source

    def answer(self, page: int) -> dict | None:
        url = request_url(self.service, page, self.size, self.year_from, self.year_to, self.source)
        body = fetched(self.transport, url, self.retries, self.pause, self.stop_on)
        try:
            found = None if body is None else json.loads(body)
        except ValueError:
            found = None
        if not isinstance(found, dict):
            if self.skip_failed:
                return None
            raise OSError(f"no answer for {url}")
        return found

    def partitions(self) -> list[InputPartition]:
        """Ranges of pages, by the number of hits that the first answer names; one range up to ``most`` where it names none."""
        first = self.answer(1) or {}
        count = (first.get("meta") or {}).get("count")
        hits = min(self.most, count if isinstance(count, int) else self.most if first.get("results") else 0)
        pages = -(-hits // self.size)
        step = self.per_partition if isinstance(count, int) else max(1, pages)
        return [PageRange(i, min(pages, i + step - 1)) for i in range(1, pages + 1, step)] or [PageRange(1, 0)]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        for page in range(partition.first, partition.last + 1):
            found = self.answer(page)
            if found is None:
                continue
            given = (found.get("results") or [])[: max(0, self.most - (page - 1) * self.size)]
            hits = [(i, h) for i, h in enumerate(given) if self.accepts(h)]
            if hits:
                yield pa.RecordBatch.from_pydict(
                    {
                        "source": pa.array([h.get("source") for _, h in hits], pa.string()),
                        "year": pa.array([h.get("publication_year") for _, h in hits], pa.int32()),
                        "page": pa.array([page] * len(hits), pa.int32()),
                        "pos": pa.array([(page - 1) * self.size + i for i, _ in hits], pa.int64()),
                        "payload": pa.array([json.dumps(h, ensure_ascii=False) for _, h in hits], pa.string()),
                    }
                )
            if len(found.get("results") or []) < self.size:
                return


class PagedHits(DataSource):
    """``format("paged_hits")`` over recorded exchanges; options: service, recorded, page_size, most,
    pages_per_partition, retries, pause, stop_on (statuses, by commas), failed_pages (error or skip)."""

    @classmethod
    def name(cls) -> str:
        return "paged_hits"

    def schema(self) -> str:
        return HIT

    def transport(self) -> Transport:
        return RecordedTransport(self.options["recorded"])

    def reader(self, schema) -> DataSourceReader:
        return PagedReader({k: v for k, v in self.options.items()}, self.transport())


def register(spark: SparkSession, source: type[DataSource] = PagedHits) -> None:
    """Make the source known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def recorded_pages(hits: DataFrame, service: str, size: int = PAGE, order: str = "pos", asked: dict | None = None, failing_every: int = 0) -> DataFrame:
    """(path, text) files of recorded exchanges of a service that gives ``hits`` (source, publication_year and more) in order.

    ``asked`` are the conditions of the request; the hits are those that meet them. ``failing_every``: pages
    whose number it divides answer with status 503 first.
    """
    from ..operators.incremental import numbered

    placed = numbered(hits, order).withColumn("page", (F.floor((F.col("number") - 1) / size) + 1).cast("int"))
    total = hits.agg(F.count("*").alias("count"))
    fields = F.struct(*[c for c in hits.columns if c != order])
    pages = placed.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", fields.alias("hit")))), lambda x: x["hit"]).alias("results"))
    numbers = F.broadcast(total)  # one row
    every = total.select(F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("count") / size).cast("int")))).alias("page"))
    body = F.to_json(F.struct(F.struct("count").alias("meta"), F.coalesce("results", F.array().cast(pages.schema["results"].dataType)).alias("results")))
    asked = asked or {}
    fixed = {k: asked.get(k) for k in ("year_from", "year_to", "source")}
    before, after = request_url(service, 0, size, **fixed).split("page=0&")
    made = every.join(pages, "page", "left").join(numbers).select("page", F.concat(F.lit(before + "page="), "page", F.lit("&" + after)).alias("url"), body.alias("body"))
    ok = F.struct(F.lit(200).alias("status"), F.col("body"))
    busy = F.struct(F.lit(503).alias("status"), F.lit("").alias("body"))
    answers = F.when(F.lit(bool(failing_every)) & (F.col("page") % max(1, failing_every) == 0), F.array(busy, ok)).otherwise(F.array(ok))
    listed = F.concat(F.lit("["), F.array_join(F.transform(answers, lambda a: F.concat(F.lit("["), a["status"], F.lit(","), F.to_json(F.array(a["body"])).substr(F.lit(2), F.length(F.to_json(F.array(a["body"]))) - 2), F.lit("]"))), ","), F.lit("]"))
    return made.select(F.concat(F.sha1("url"), F.lit(".json")).alias("path"), listed.alias("text"))
