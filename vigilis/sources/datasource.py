"""Spark data sources for dumped files: ``feed``, ``sitemap``, ``records`` and ``points``, to be read at once or as streams.

After ``register(spark)`` they are formats like any other: ``spark.read.format("feed").load(folder)`` and
``spark.readStream.format("feed").load(folder)``. Where a query is planned the files are listed and dealt to partitions of about
``partitionBytes``; tasks parse them, an entry at a time where the format allows it. A file is never split.

A stream's offset is the time and path of the newest file that it has taken, so files must come in with later times than those
before (a file that is written does, one that is moved may not); ``settleSeconds`` leaves the youngest ones to the next batch.
A batch that is done again reads the same files.

Names that begin with ``_`` or ``.`` are no data. A file that can't be parsed gives what stands before the fault, or fails the query with
``mode=FAILFAST``. An empty folder gives no rows.
"""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
import re
import sys
import time
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PARTITION_BYTES = 64 << 20
File = tuple[int, str, int]  # time in nanoseconds, path, bytes


def store_of(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def listed(path: str) -> list[File]:
    """Data files under ``path``, oldest first."""
    from pyarrow import fs

    store, root = store_of(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda f: any(p[:1] in ("_", ".") for p in f.path[len(root) :].split("/"))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and not hidden(f))


def dealt(files: list[File], most: int) -> list[InputPartition]:
    """Partitions of about ``most`` bytes; a larger file is one of its own."""
    out: list[list[str]] = []
    room = -1
    for _, path, size in files:
        if not out or room < size:
            out.append([])
            room = most
        out[-1].append(path)
        room -= size + 4096
    return [InputPartition(tuple(own)) for own in out]


def opened(store, path: str):
    """A file's bytes, unpacked where it is in gzip."""
    stream = store.open_input_file(path)
    head = stream.read(2)
    stream.seek(0)
    return gzip.GzipFile(fileobj=stream) if head == b"\x1f\x8b" else stream


def tag_of(element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def elements(stream, names: tuple[str, ...]) -> Iterator:
    """Elements called one of ``names`` at any depth, each given back after its use; namespaces are left out."""
    path = []
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            path.append(element)
            continue
        path.pop()
        if tag_of(element) in names:
            yield element
            if path:
                path[-1].remove(element)


def child(element, *names: str) -> str | None:
    """The text of the first child of the first name that has one."""
    for name in names:
        for c in element:
            if tag_of(c) == name and (t := "".join(c.itertext()).strip()):
                return t
    return None


def feed_rows(stream, path: str, options: dict) -> Iterator[tuple]:
    for e in elements(stream, ("item", "entry")):
        if tag_of(e) == "item":
            link, kind = child(e, "link", "guid"), "rss"
            summary, published = child(e, "description"), child(e, "pubDate", "date")
        else:
            links = [(c.get("rel", "alternate"), c.get("href")) for c in e if tag_of(c) == "link" and c.get("href")]
            link, kind = next((h for r, h in links if r == "alternate"), links[0][1] if links else None), "atom"
            summary, published = child(e, "summary", "content"), child(e, "published", "updated")
        if link:
            yield path, kind, child(e, "title"), link, summary, published


def sitemap_rows(stream, path: str, options: dict) -> Iterator[tuple]:
    for e in elements(stream, ("url", "sitemap")):
        if loc := child(e, "loc"):
            yield path, tag_of(e), loc, child(e, "lastmod")


def values_of(stream) -> Iterator:
    """JSON values: one in each line, or one in the whole file."""
    text = io.TextIOWrapper(stream, "utf-8-sig")
    first = next((line for line in text if line.strip()), "")
    try:
        value = json.loads(first) if first else None
    except json.JSONDecodeError:
        yield json.loads(first + text.read())
        return
    if first:
        yield value
    yield from (json.loads(line) for line in text if line.strip())


def unwrapped(value, keys: list[str]) -> list:
    """The records in an envelope: the array itself, an array under one of ``keys``, or under one of them in another; else the value."""
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        inner = [value.get(k) for k in keys]
        nested = [x.get(k) for x in inner if isinstance(x, dict) for k in keys]
        for x in inner + nested:
            if isinstance(x, list):
                return x
    return [value]


def record_rows(stream, path: str, options: dict) -> Iterator[tuple]:
    place = 0
    for value in values_of(stream):
        for record in unwrapped(value, options["keys"].split(",")):
            yield path, place, json.dumps(record, ensure_ascii=False)
            place += 1


def number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def points_of(stream, kind: str) -> Iterator[tuple]:
    """(id, lat, lon, value) by kind of layer."""
    if kind == "hotspots":
        for row in csv.DictReader(io.TextIOWrapper(stream, "utf-8-sig")):
            own = {(k or "").strip().lower(): v for k, v in row.items()}
            yield hashlib.sha256("|".join(v for v in row.values() if v is not None).encode()).hexdigest(), own.get("latitude"), own.get("longitude"), own.get("brightness")
        return
    for value in values_of(stream):
        if kind == "geojson":
            for f in value.get("features") or []:
                at, own = (f.get("geometry") or {}).get("coordinates") or [], f.get("properties") or {}
                yield f.get("id"), *((at[1], at[0]) if len(at) > 1 else (None, None)), own.get("mag") if own.get("mag") is not None else own.get("value")
        elif kind == "states":
            for s in value.get("states") or []:
                yield (s[0], s[6], s[5], s[7]) if len(s) > 7 else (None, None, None, None)
        elif kind == "records":
            yield value.get("id"), value.get("lat"), value.get("lon"), value.get("value")
        else:
            raise ValueError(f"no such kind of layer: {kind}")


def point_rows(stream, path: str, options: dict) -> Iterator[tuple]:
    south, west, north, east = map(float, options.get("box", "-90,-180,90,180").split(","))
    for ident, lat, lon, value in points_of(stream, options["kind"]):
        y, x = number(lat), number(lon)
        if y is not None and x is not None and south <= y <= north and west <= x <= east:
            yield None if ident is None else str(ident), y, x, number(value)


class Dump(DataSource):
    """What the formats share: options, listing and partitions. A format names its schema and the rows of a file."""

    columns = ""
    defaults: dict = {}
    rows = None

    def schema(self) -> str:
        return self.columns

    def own_options(self) -> dict:
        return {**self.defaults, **{k.lower(): v for k, v in self.options.items()}}

    def reader(self, schema) -> DumpReader:
        return DumpReader(type(self).rows, self.own_options())

    def streamReader(self, schema) -> DumpStream:
        return DumpStream(type(self).rows, self.own_options())


class Rows:
    def __init__(self, rows, options: dict):
        self.rows, self.options = rows, options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = store_of(self.options["path"])
        for path in partition.value if partition else ():  # Spark asks for one even where there is none
            with opened(store, path) as stream:
                try:
                    yield from self.rows(stream, path, self.options)
                except (ElementTree.ParseError, ValueError, EOFError, gzip.BadGzipFile) as fault:
                    if self.options.get("mode", "").upper() == "FAILFAST" or "no such kind" in str(fault):
                        raise ValueError(f"{path}: {fault}") from fault

    def deal(self, files: list[File]) -> list[InputPartition]:
        return dealt(files, int(self.options.get("partitionbytes", PARTITION_BYTES)))


class DumpReader(Rows, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.deal(listed(self.options["path"]))


class DumpStream(Rows, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(float(self.options.get("settleseconds", 0)) * 1e9)
        files = [f for f in listed(self.options["path"]) if f[0] <= until]
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return self.deal([f for f in listed(self.options["path"]) if low < f[:2] <= high])


class Feed(Dump):
    """Items of RSS and entries of Atom files; those without a link are left out."""

    columns = "path string, kind string, title string, link string, summary string, published string"
    rows = staticmethod(feed_rows)

    @classmethod
    def name(cls) -> str:
        return "feed"


class Sitemap(Dump):
    """Entries of sitemaps (kind url) and of their indexes (kind sitemap), packed or not."""

    columns = "path string, kind string, loc string, lastmod string"
    rows = staticmethod(sitemap_rows)

    @classmethod
    def name(cls) -> str:
        return "sitemap"


class Records(Dump):
    """Records (JSON) out of their envelopes; option ``keys``: what an envelope calls them, the first that is there counts."""

    columns = "path string, place long, record string"
    defaults = {"keys": "data,items,results,rows,records,list,result"}
    rows = staticmethod(record_rows)

    @classmethod
    def name(cls) -> str:
        return "records"


class Points(Dump):
    """Points of a layer of ``kind`` (hotspots, geojson, states, records) within ``box`` (south,west,north,east)."""

    columns = "id string, lat double, lon double, value double"
    defaults = {"kind": "records"}
    rows = staticmethod(point_rows)

    @classmethod
    def name(cls) -> str:
        return "points"


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session; the classes travel with the plan, so executors need not have this package."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    for source in (Feed, Sitemap, Records, Points):
        spark.dataSource.register(source)
