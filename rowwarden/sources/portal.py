"""The portal's catalogue and the addresses it links, as Spark data sources.

Network access is an injected function, open(method, url, headers) -> (status, headers, body), so that everything runs
without a network. Requests are spread by host, failures are rows, and nothing is retried that will not change.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import host

Open = Callable[[str, str, dict], tuple[int, dict, bytes]]
PAGE, TRIES, BACKOFF = 1000, 4, 10.0
#: Answers that another try does not change.
FINAL = (401, 403, 404, 410)
ANSWER = "id string, url string, status int, etag string, last_modified string, content_length bigint, content_type string, served_by string, server string, error string"


def open_url(method: str, url: str, headers: dict) -> tuple[int, dict, bytes]:
    request = urllib.request.Request(url, method=method, headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), b""


def get(url: str, open_: Open = open_url, method: str = "GET", headers: dict | None = None, tries: int = TRIES, backoff: float = BACKOFF) -> tuple[int, dict, bytes]:
    """An answer, tried again with growing pauses after failures of the moment. The last failure is raised."""
    for n in range(tries):
        try:
            status, head, body = open_(method, url, headers or {})
            if status < 400 or status in FINAL:
                return status, head, body
            failure: Exception = OSError(f"HTTPError: {status} {'Client' if status < 500 else 'Server'} Error")
        except OSError as e:
            failure = e
        if n + 1 < tries:
            time.sleep(backoff * 2**n)
    raise failure


def action(portal: str, name: str, open_: Open = open_url, **params) -> dict:
    query = "&".join(f"{k}={v}" for k, v in params.items())
    return json.loads(get(f"{portal}/api/3/action/{name}?{query}", open_)[2])["result"]


class CatalogueSource(DataSource):
    """Packages of a portal, a partition for each page: name and package (JSON). Options: portal; open: set by catalogue()."""

    open_: Open = staticmethod(open_url)

    @classmethod
    def name(cls) -> str:
        return "portal_catalogue"

    def schema(self) -> str:
        return "name string, package string"

    def reader(self, schema):
        return _CatalogueReader(self.options["portal"], type(self).open_, int(self.options.get("page", PAGE)))


class _CatalogueReader(DataSourceReader):
    def __init__(self, portal: str, open_: Open, page: int):
        self.portal, self.open_, self.page = portal, open_, page

    def partitions(self) -> list[InputPartition]:
        n = action(self.portal, "package_search", self.open_, rows=0)["count"]
        return [InputPartition(i) for i in range(0, n, self.page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for p in action(self.portal, "package_search", self.open_, rows=self.page, start=partition.value, sort="name+asc")["results"]:
            yield p["name"], json.dumps(p)


def catalogue(spark: SparkSession, portal: str, open_: Open = open_url, page: int = PAGE) -> DataFrame:
    """The portal's packages by name."""
    source = type("PortalCatalogue", (CatalogueSource,), {"open_": staticmethod(open_)})
    spark.dataSource.register(source)
    return spark.read.format("portal_catalogue").option("portal", portal).option("page", str(page)).load().orderBy("name")


RESOURCE = "array<struct<id:string,name:string,format:string,url:string,last_modified:string,metadata_modified:string,size:string,description:string,schema:string,datastore_active:boolean>>"


def resources(packages: DataFrame) -> DataFrame:
    """A row for each resource of each package: dataset, title, pos and its fields."""
    parsed = packages.select("name", F.from_json("package", f"title string, resources {RESOURCE}").alias("p"))
    return parsed.select(F.col("name").alias("dataset"), F.col("p.title").alias("title"), F.posexplode("p.resources").alias("pos", "r")).select("dataset", "title", "pos", "r.*")


def store_fields(ids: DataFrame, portal: str, open_: Open = open_url) -> DataFrame:
    """resource_id, pos, name and store_type of the columns that the portal's store exposes, without its own row number."""

    def run(batches):
        for b in batches:
            out = []
            for rid in b["resource_id"]:
                try:
                    found = action(portal, "datastore_search", open_, resource_id=rid, limit=0).get("fields", [])
                except (OSError, ValueError, KeyError):
                    continue
                out += [(rid, i, f["id"], f.get("type")) for i, f in enumerate(f for f in found if f["id"] != "_id")]
            yield pd.DataFrame(out, columns=["resource_id", "pos", "name", "store_type"])

    return ids.select("resource_id").mapInPandas(run, "resource_id string, pos int, name string, store_type string")


def answers(links: DataFrame, open_: Open = open_url, ranged: bool = False, tries: int = 1, backoff: float = BACKOFF) -> DataFrame:
    """What servers say about links (id, url): a HEAD request, or with `ranged` a request for the first bytes.

    Links are dealt by host, so that one host is asked by one task at a time; after eight failures in a row a task
    stops asking that host, and says so.
    """

    def run(batches):
        misses: dict[str, int] = {}
        for b in batches:
            out = []
            for i, url, h in zip(b["id"], b["url"], b["host"], strict=True):
                if misses.get(h, 0) >= 8:
                    out.append((i, url, *[None] * 7, "not asked: the server stopped answering"))
                    continue
                try:
                    status, head, _ = get(url, open_, "GET" if ranged else "HEAD", {"Range": "bytes=0-99"} if ranged else {}, tries, backoff)
                    head = {k.lower(): v for k, v in head.items()}
                    size = head.get("content-length")
                    kind = (head.get("content-type") or "").split(";")[0].strip().lower() or None
                    out.append((i, url, status, head.get("etag"), head.get("last-modified"), int(size) if size and size.isdigit() else None, kind, head.get("x-served-by"), head.get("server"), None))
                    misses[h] = 0
                except OSError as e:
                    out.append((i, url, *[None] * 7, f"{type(e).__name__}: {e}"[:200]))
                    misses[h] = misses.get(h, 0) + 1
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in ANSWER.split(", ")]).astype({"status": "Int32", "content_length": "Int64"})

    dealt = links.select("id", "url", F.coalesce(host(F.col("url")), F.lit("")).alias("host")).repartition("host")
    return dealt.mapInPandas(run, ANSWER)


def fetched(links: DataFrame, limit: int, open_: Open = open_url, tries: int = TRIES, backoff: float = BACKOFF) -> DataFrame:
    """path (the url) and content of links, or error where there is none: too-large, or what failed."""

    def run(batches):
        for b in batches:
            for url in b["url"]:
                try:
                    status, _, body = get(url, open_, tries=tries, backoff=backoff)
                    error = "too-large" if len(body) > limit else f"HTTPError: {status} Client Error" if status >= 400 else None
                    row = (url, None if error else body, error)
                except OSError as e:
                    row = (url, None, f"{type(e).__name__}: {e}"[:200])
                yield pd.DataFrame([row], columns=["path", "content", "error"])

    return links.select("url", F.coalesce(host(F.col("url")), F.lit("")).alias("host")).repartition("host").mapInPandas(run, "path string, content binary, error string")
