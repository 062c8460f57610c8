"""URL filters: a sorted array of 64-bit xxhash keys, memory-mapped by every
Python worker, probed with a vectorised binary search; a hit counts only when
the stored full string equals the probe, so that a hash collision never
decides a verdict.

An entry is `host + path prefix` with an action.  A URL is probed with every
pair (host or one of its parent domains, path prefix of a length that occurs
in the list); the longest entry that fits wins (host length, then path length).
Rules come before the block list.

Defined results: a null URL, or one without `://`, has an empty host and path
and gets the default verdict; repeated rows give repeated rows; extra columns
are ignored unless `keep` names them; an empty list gives the default verdict.
An entry that is listed twice keeps its first action.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable
from itertools import chain, islice

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import append

#: (host, path prefix, action)
Rule = tuple[str, str, str]
#: entries of one array; longer lists are several arrays, all probed in one pass
BLOCK = 4_000_000


class DigestArray:
    """Keys sorted by digest: `<name>.keys` uint64, `.ends` int64 ends of the strings, `.text` the strings."""

    def __init__(self, base: str):
        self.keys = np.memmap(f"{base}.keys", np.uint64, "r") if os.path.getsize(f"{base}.keys") else np.empty(0, np.uint64)
        self.ends = np.memmap(f"{base}.ends", np.int64, "r") if len(self.keys) else np.empty(0, np.int64)
        self.text = np.memmap(f"{base}.text", np.uint8, "r") if len(self.keys) else np.empty(0, np.uint8)

    @staticmethod
    def write(base: str, strings: Iterable[str], digest=xxhash.xxh64_intdigest) -> list[int]:
        """Write the three files; returns the entries' places in the order given."""
        raw = [s.encode("utf-8", "replace") for s in strings]
        keys = np.array([digest(s) for s in raw], np.uint64)
        order = np.argsort(keys, kind="stable")
        keys[order].tofile(f"{base}.keys")
        np.cumsum([len(raw[i]) for i in order], dtype=np.int64).tofile(f"{base}.ends")
        with open(f"{base}.text", "wb") as f:
            f.writelines(raw[i] for i in order)
        return order.tolist()

    def stored(self, place: int) -> bytes:
        return self.text[(self.ends[place - 1] if place else 0) : self.ends[place]].tobytes()

    def find(self, strings: list[str], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """The place of each string, or -1; confirmed by the stored string."""
        if not strings or not len(self.keys):
            return np.full(len(strings), -1)
        raw = [s.encode("utf-8", "replace") for s in strings]
        probes = np.array([digest(s) for s in raw], np.uint64)
        at = np.searchsorted(self.keys, probes)
        out = np.full(len(raw), -1)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probes):
            place = int(at[i])
            while place < len(self.keys) and self.keys[place] == probes[i]:
                if self.stored(place) == raw[i]:
                    out[i] = place
                    break
                place += 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return host, path[:end]


def probes_of(host: str, path: str, lengths: list[int]) -> list[tuple[str, str]]:
    """(host suffix, path prefix) pairs, longest first."""
    suffixes, at = [host], host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return [(s, path[:n]) for s in suffixes for n in lengths if n <= len(path)]


_OPEN: dict[str, tuple[DigestArray, list[str]]] = {}


def _opened(name: str) -> tuple[DigestArray, list[str]]:
    if name not in _OPEN:
        with open(SparkFiles.get(f"{name}.acts")) as f:
            acts = f.read().split("\n")
        _OPEN[name] = DigestArray(SparkFiles.get(f"{name}.keys").removesuffix(".keys")), acts
    return _OPEN[name]


def filter_urls(pages: DataFrame, rules: list[Rule], blocklist: Iterable[tuple[str, str]] | DataFrame = (), url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """`keep` columns plus host, path, rule, listed and verdict.

    A rule that fits decides (rule: `host + path`); else an entry of the block
    list (listed: that entry) blocks; else the verdict is `default`.  A list of
    any length is a table with the host and the path prefix as first columns (null
    hosts are left out, a null path is an empty one); the driver holds BLOCK entries at a time.
    """
    spark = pages.sparkSession
    if isinstance(blocklist, DataFrame):
        host, path = blocklist.columns[:2]
        blocklist = ((r[0], r[1]) for r in blocklist.select(F.col(host), F.coalesce(F.col(path), F.lit(""))).where(F.col(host).isNotNull()).toLocalIterator())
    entries = chain(((0, *r) for r in rules), ((1, h, p, "block") for h, p in blocklist))
    names = []
    while block := list(islice(entries, BLOCK)):
        names.append(_publish(spark, block))

    def judge(urls):
        where = [split_url(u) for u in urls]
        best: list = [None] * len(urls)
        for name, lengths in names:
            array, acts = _opened(name)
            pairs = [(i, p) for i, (h, q) in enumerate(where) if h for p in probes_of(h, q, lengths)]
            places = array.find([f"{h}\t{p}" for _, (h, p) in pairs])
            for k in np.flatnonzero(places >= 0):
                i, (h, p) = pairs[k]
                rank, action = acts[places[k]].split(" ", 1)
                found = (-int(rank), len(h), len(p), h + p, action)
                if best[i] is None or found > best[i]:
                    best[i] = found
        rule = [b[3] if b and b[0] == 0 else None for b in best]
        listed = [b[3] if b and b[0] else None for b in best]
        return [h for h, _ in where], [p for _, p in where], rule, listed, [b[4] if b else default for b in best]

    return append(pages.select(*keep, url), [url], judge, "host string, path string, rule string, listed string, verdict string").drop(url)


def _publish(spark, block: list[tuple]) -> tuple[str, list[int]]:
    """Write a block's files and hand them to every executor; (name, prefix lengths, longest first)."""
    first: dict[tuple[str, str], str] = {}
    for rank, host, path, action in block:
        first.setdefault((host, path), f"{rank} {action}")
    entries = list(first.items())
    name = "urls-" + hashlib.md5(repr(block).encode()).hexdigest()
    added = _ADDED.setdefault(spark.sparkContext.applicationId, set())
    if name not in added:
        folder = tempfile.mkdtemp(prefix="larkspur-url-")
        order = DigestArray.write(f"{folder}/{name}", (f"{h}\t{p}" for (h, p), _ in entries))
        with open(f"{folder}/{name}.acts", "w") as f:
            f.write("\n".join(entries[i][1] for i in order))
        for kind in ("keys", "ends", "text", "acts"):
            spark.sparkContext.addFile(f"{folder}/{name}.{kind}")
        added.add(name)
    return name, sorted({len(p) for (_, p), _ in entries}, reverse=True)


_ADDED: dict[str, set[str]] = {}
