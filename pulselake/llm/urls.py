"""URL filters over a sorted array of 64-bit digests, memory-mapped by each task.

A list of entries (host, or host and beginning of the path) is a file: the sorted xxhash digests of the entries, then the
entries, and a second one of the entries' hosts with the lengths of path that entries of the host have. A url asks for the
suffixes of its host, then for each that is listed with the beginnings of its path of those lengths; all digests asked for
by a batch are searched for together, and a hit counts only if the stored entry is the string asked for.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Larger lists are joined instead of sent to every executor.
MOST_BYTES = 256 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The contract's rules: entry and verdict.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Hosts of link farms, blocked with their subdomains where no rule fits.
LISTED = tuple(f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills", "casino-win") for top in ("com", "net", "org"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without `://` (or for null)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def suffixes(host: str) -> Iterator[str]:
    while host:
        yield host
        _, _, host = host.partition(".")


def asked(host: str, path: str, lengths: dict[str, list[int]]) -> list[str]:
    """The entries that would fit, the longest first (of the same length, the longer host first); lengths: of paths, by host."""
    found = [(s, n) for s in suffixes(host) for n in lengths.get(s, ()) if n <= len(path)]
    return [s + path[:n] for s, n in sorted(found, key=lambda x: (-len(x[0]) - x[1], -len(x[0])))]


class DigestArray:
    """A memory-mapped list: n, sorted digests, string offsets, strings."""

    def __init__(self, file: str):
        self.n = int(np.memmap(file, "<u8", "r", shape=(1,))[0])
        self.digests = np.memmap(file, "<u8", "r", 8, (self.n,)) if self.n else np.zeros(0, "<u8")
        self.offsets = np.memmap(file, "<u8", "r", 8 + 8 * self.n, (self.n + 1,))
        at = 8 + 8 * (2 * self.n + 1)
        self.strings = np.memmap(file, np.uint8, "r", at) if Path(file).stat().st_size > at else np.zeros(0, np.uint8)

    @staticmethod
    def save(entries: list[str], file: str) -> None:
        rows = sorted((xxhash.xxh64_intdigest(e.partition(" ")[0].encode()), e.encode()) for e in set(entries))  # entries have no spaces; numbers may follow one
        with open(file, "wb") as out:
            out.write(np.array([len(rows), *(d for d, _ in rows)], "<u8").tobytes())
            out.write(np.cumsum([0, *(len(e) for _, e in rows)]).astype("<u8").tobytes())
            out.write(b"".join(e for _, e in rows))

    def entry(self, i: int) -> bytes:
        return self.strings[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def numbers(self, keys: list[str]) -> dict[str, list[int]]:
        """The numbers stored behind those keys that are entries."""
        out: dict[str, list[int]] = {}
        raw = [k.encode() for k in keys]
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in raw), np.uint64, len(raw))
        first, end = np.searchsorted(self.digests, digests), np.searchsorted(self.digests, digests, side="right")
        for i in np.flatnonzero(first < end):
            for j in range(first[i], end[i]):
                name, *numbers = self.entry(j).split(b" ")
                if name == raw[i]:
                    out[keys[i]] = [int(n) for n in numbers]
        return out

    def has(self, keys: list[str]) -> np.ndarray:
        """Which keys are entries: one binary search for all, then the strings of equal digests are compared."""
        raw = [k.encode() for k in keys]
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in raw), np.uint64, len(raw))
        at = np.searchsorted(self.digests, digests)
        found = np.zeros(len(raw), bool)
        for i in np.flatnonzero((at < self.n) & (self.digests[np.minimum(at, max(self.n - 1, 0))] == digests)) if self.n else ():
            j = int(at[i])
            while j < self.n and self.digests[j] == digests[i] and not found[i]:
                found[i] = self.entry(j) == raw[i]
                j += 1
        return found


def _host(entry: str) -> str:
    return entry.partition("/")[0]


def _shipped(spark: SparkSession, entries: list[str]) -> tuple[str, str]:
    """Writes the list and sends its files to every executor; their names there: entries, and `host length length ...` by host."""
    lengths: dict[str, set[int]] = {}
    for e in entries:
        lengths.setdefault(_host(e), set()).add(len(e) - len(_host(e)))
    folder = tempfile.mkdtemp(prefix="pulselake-")  # executors that start later ask the driver for it, so it stays until the driver ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    names = []
    for rows in (entries, [" ".join([h, *map(str, sorted(n))]) for h, n in lengths.items()]):
        names.append(f"digests-{uuid.uuid4().hex}.bin")
        DigestArray.save(rows, f"{folder}/{names[-1]}")
        spark.sparkContext.addFile(f"{folder}/{names[-1]}")
    return names[0], names[1]


def matched(urls: DataFrame, entries: DataFrame, out: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """urls (host, path, ...) with a column `out`: the longest row of entries (entry string) that fits, else null.

    An entry fits its host and all subdomains whose url's path begins with the entry's. Lists over most_bytes aren't sent
    out: then each url's suffixes are joined with the list's hosts and what they ask for with the list. Null entries are left
    out, repeated ones count once.
    """
    spark = urls.sparkSession
    entries = entries.select("entry").where(F.col("entry").isNotNull()).distinct()
    size = entries.agg(F.sum(F.octet_length("entry") + 16)).first()[0] or 0
    if size <= most_bytes:
        names = _shipped(spark, [r[0] for r in entries.collect()])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, hosts = (DigestArray(SparkFiles.get(n)) for n in names)
            for b in batches:
                sides = list(zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True))
                lengths = hosts.numbers(sorted({s for h, _ in sides for s in suffixes(h or "")}))
                keys = [asked(h or "", p or "", lengths) for h, p in sides]
                hit = iter(found.has([k for ks in keys for k in ks]))
                best = [next((k for k, x in [(k, next(hit)) for k in ks] if x), None) for ks in keys]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string())], [*b.schema.names, out])

        return urls.mapInArrow(probe, T.StructType([*urls.schema.fields, T.StructField(out, T.StringType())]))

    hosts = entries.select(F.substring_index("entry", "/", 1).alias("suffix"), F.length("entry").alias("n")).withColumn("n", F.col("n") - F.length("suffix")).distinct()
    sides = urls.select("host", "path").distinct()
    dots = F.split("host", r"\.")
    asks = sides.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(dots)), lambda i: F.array_join(F.slice(dots, i, F.size(dots)), "."))))
    asks = asks.join(hosts, "suffix").where(F.col("n") <= F.length("path")).withColumn("entry", F.concat("suffix", F.expr("substring(path, 1, n)")))
    best = asks.join(entries, "entry").groupBy("host", "path").agg(F.max_by("entry", F.struct(F.length("entry"), F.length("suffix"))).alias(out))
    return urls.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, listed: DataFrame | tuple[str, ...] = LISTED) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of each row of pages (page_id, url, ...): a rule's verdict goes before the list's.

    A null url or one without `://` has an empty host and path and is allowed. Repeated rows give repeated results.
    """
    spark = pages.sparkSession

    host, path = parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    one = lambda values: spark.createDataFrame([(v,) for v in values], "entry string")
    rows = matched(matched(rows, one([r for r, _ in rules]), "rule"), listed if isinstance(listed, DataFrame) else one(listed), "listed")
    by_rule = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules)) if rules else F.lit(None)
    return rows.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("listed").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "listed")
