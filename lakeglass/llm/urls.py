"""Operator 9: a URL filter by a sorted array of 64-bit xxhash digests, memory-mapped and probed by binary search.

Building: the list's entries are hashed, dealt to shards by the top bits of the digest and sorted; each shard is a file of
uint64 digests, one of offsets and one of the strings, in the shared folder, renamed into place when whole. Shards
grow in number with the list (ENTRIES each), so no task holds all of it.

Probing: every URL gives its keys (itself in canonical form, and its host and the host's parents); their digests are looked up in
the mapped shards, a batch at a time; every hit is confirmed against the stored strings, so collisions block nothing.
The mapped files are read where they are if the shared folder is a file: folder; from another file system an executor first copies a
shard to the working folder of the application, which Spark deletes (the only local data).

Defined results: null URLs, empty ones and those without a scheme or host match nothing, and list entries that are null or empty
are ignored. Repeated rows are each reported. An entry that repeats counts once. Of a URL's keys the first that is listed is reported, in
the order canonical URL, host, parents.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path

#: Entries of a shard, about.
ENTRIES = 4_000_000
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical(url: str | Column) -> Column:
    """Lower-case host without www., m. or default port, path without index page, .html or closing slash, parameters sorted without tracking ones; no scheme or fragment. Null without scheme or host."""
    u = F.col(url) if isinstance(url, str) else url
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"(/|/index\.html?|\.html?)$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.array_join(kept, "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def keys_of(url: str | None) -> list[str]:
    """A canonical URL, its host and the host's parents of two labels or more."""
    if not url:
        return []
    host = re.split(r"[/?]", url, maxsplit=1)[0]
    labels = host.split(".")
    hosts = [".".join(labels[k:]) for k in range(max(1, len(labels) - 1))]
    return [url, *(h for h in hosts if h != url)]


def digests(strings: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings), np.uint64, len(strings))


def build(entries: DataFrame, folder: str, column: str = "entry", per_shard: int = ENTRIES, digest=digests) -> int:
    """Writes the shards under folder, from the executors; returns the number of bits that name a shard."""
    entries = entries.select(F.col(column).cast("string").alias("entry")).filter("entry <> ''").distinct()
    bits = max(0, (max(1, -(-entries.count() // per_shard)) - 1).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = digest(b["entry"].to_pylist())
            shard = (d >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(d), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(d.view(np.int64)), b["entry"]], ["shard", "digest", "entry"])

    def store(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        d = t["digest"].to_numpy().view(np.uint64)
        raw = [x.encode("utf-8", "surrogatepass") for x in t["entry"].to_pylist()]
        order = sorted(range(len(d)), key=lambda k: (d[k], raw[k]))
        raw = [raw[k] for k in order]
        place, path = fs.FileSystem.from_uri(folder)
        place.create_dir(path, recursive=True)
        own = uuid.uuid4().hex
        for kind, data in (("strings", b"".join(raw)), ("offsets", np.append(0, np.cumsum([len(x) for x in raw])).astype("<u8").tobytes()), ("digests", d[order].astype("<u8").tobytes())):
            with place.open_output_stream(f"{path}/_{own}") as sink:
                sink.write(data)
            place.move(f"{path}/_{own}", f"{path}/{shard}.{kind}")
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(raw)], pa.int64())})

    dealt = entries.mapInArrow(deal, "shard long, digest long, entry string").groupBy("shard").applyInArrow(store, "shard long, n long")
    dealt.agg(F.sum("n")).collect()
    return bits


class Filter:
    """The mapped shards, opened as they are asked for."""

    def __init__(self, folder: str, bits: int, digest=digests):
        self.folder, self.bits, self.digest, self.shards = folder, bits, digest, {}

    def _local(self, name: str) -> str | None:
        place, path = fs.FileSystem.from_uri(self.folder)
        path = f"{path}/{name}"
        if place.get_file_info(path).type == fs.FileType.NotFound:
            return None
        if isinstance(place, fs.LocalFileSystem):
            return path
        copy = os.path.join(SparkFiles.getRootDirectory(), f"{uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex}-{name}")
        if not os.path.exists(copy):
            own = f"{copy}-{uuid.uuid4().hex}"
            fs.copy_files(path, own, source_filesystem=place, destination_filesystem=fs.LocalFileSystem())
            os.replace(own, copy)
        return copy

    def _shard(self, k: int) -> tuple[np.ndarray, ...]:
        if k not in self.shards:
            paths = [self._local(f"{k}.{kind}") for kind in ("digests", "offsets", "strings")]
            if None in paths:
                self.shards[k] = (np.empty(0, np.uint64),) * 3
            else:
                self.shards[k] = tuple(np.memmap(p, t, "r") for p, t in zip(paths, ("<u8", "<u8", np.uint8)))
        return self.shards[k]

    def listed(self, keys: list[str]) -> np.ndarray:
        """Which keys are entries."""
        d = self.digest(keys)
        out = np.zeros(len(keys), bool)
        shard = (d >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(d), np.int64)
        for k in np.unique(shard):
            sorted_, offsets, strings = self._shard(int(k))
            at = np.flatnonzero(shard == k)
            lo, hi = np.searchsorted(sorted_, d[at]), np.searchsorted(sorted_, d[at], "right")
            for i, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo]):
                raw = keys[i].encode("utf-8", "surrogatepass")
                out[i] = any(strings[int(offsets[j]) : int(offsets[j + 1])].tobytes() == raw for j in range(a, b))
        return out


def blocked(pages: DataFrame, folder: str, bits: int, digest=digests) -> DataFrame:
    """(page_id, url, entry): the pages whose URL is listed, with the entry that lists it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Filter(folder, bits, digest)
        for b in batches:
            keys = [keys_of(u) for u in b["canonical"].to_pylist()]
            flat = [k for ks in keys for k in ks]
            hit, at, rows, found = filter_.listed(flat) if flat else np.empty(0, bool), 0, [], []
            for row, ks in enumerate(keys):
                first = next((k for k, h in zip(ks, hit[at : at + len(ks)]) if h), None)
                at += len(ks)
                if first is not None:
                    rows.append(row)
                    found.append(first)
            got = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([got["page_id"], got["url"], pa.array(found, pa.string())], ["page_id", "url", "entry"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", canonical("url").alias("canonical")).mapInArrow(run, "page_id long, url string, entry string")


#: Hosts that are blocked with all that is under them.
HOSTS = ("spam-farm.example.org", "cheap-pills.example.com")
#: Of the pages, each of so many stands for one that an earlier crawl has listed.
EARLIER = 10


def listed_pages(pages: DataFrame) -> DataFrame:
    """Pages whose URL is blocked by host, or was listed by an earlier crawl: the canonical URLs of every tenth page."""
    spark = pages.sparkSession
    hosts = spark.createDataFrame([(h,) for h in HOSTS], "entry string")
    earlier = pages.filter(F.col("page_id") % EARLIER == 0).select(canonical("url").alias("entry"))
    folder = fresh_path(spark, "urls")
    return blocked(pages, folder, build(hosts.unionByName(earlier), folder))


SQL = rf"""
    WITH c AS (SELECT page_id, url, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
        regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(/|/index\.html?|\.html?)$', '') AS path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&') AS query FROM pages),
    u AS (SELECT page_id, url, host, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM c),
    e AS (SELECT canonical AS entry FROM u WHERE page_id % {EARLIER} = 0 UNION {" UNION ".join(f"SELECT '{h}'" for h in HOSTS)}),
    l AS (SELECT *, string_split(host, '.') AS p FROM u WHERE canonical IS NOT NULL),
    k AS (SELECT page_id, url, canonical AS entry, 0 AS pos FROM l UNION ALL SELECT page_id, url, array_to_string(p[i:], '.'), i FROM (SELECT *, unnest(range(1, greatest(2, len(p)))) AS i FROM l)),
    r AS (SELECT page_id, url, entry, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM k WHERE entry IN (SELECT entry FROM e WHERE entry <> ''))
    SELECT page_id, url, entry FROM r WHERE rank = 1"""
