"""URL filter on a sorted digest array.

List entries (a host, or a host and the start of a path) are hashed with 64-bit xxHash; the sorted
digests lie in one file that executors map into memory, next to the offsets of the full strings.
A URL's candidate keys (each suffix of its host of at most as many labels as a listed host has, alone and with each listed path
length) are hashed, probed by vectorised binary search, and a hit counts only if the stored string is the same.

Defined cases: a null URL or one without `://` has an empty host and path and fits no entry; of
entries that fit, the longest wins, and of equal lengths the one with the longer host; equal rows
give equal rows; an empty table or list is allowed; other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import put_file

#: (host, path, verdict) of production rules, and hosts on the block list.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_ZONES = ("example.com", "example.net", "example.org")
BLOCKED_HOSTS = tuple(f"{n}.{z}" for n in BLOCKED_NAMES for z in BLOCKED_ZONES)
#: The list is kept on every executor; larger ones belong in several filters.
MAX_LIST_BYTES = 2 << 30


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:end].translate(LOWER)
    path = rest[end:]
    return host, path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def entry_key(host: str, path: str) -> bytes:
    return host.encode("utf-8", "surrogatepass") + b"\x00" + path.encode("utf-8", "surrogatepass")


class DigestArray:
    """Sorted digests, string offsets, values and strings in one mapped file."""

    def __init__(self, path: str):
        head = np.fromfile(path, dtype="<i8", count=3)
        n, self.size, self.labels = (int(x) for x in head)
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        at = 24
        self.digests = whole[at : at + 8 * n].view("<u8")
        self.offsets = whole[at + 8 * n : at + 8 * (2 * n + 1)].view("<i8")
        at += 8 * (2 * n + 1)
        self.values = whole[at : at + n]
        self.lengths = [int(x) for x in whole[at + n : at + n + 4 * self.size].view("<i4").tolist()] if self.size else []
        self.strings = whole[at + n + 4 * self.size :]

    @staticmethod
    def pack(entries) -> bytes:
        """The file of (host, path, value 0..255) entries."""
        rows = sorted({(xxhash.xxh64_intdigest(k := entry_key(h, p)), k, v) for h, p, v in entries})
        lengths = sorted({len(p) for _, p, _ in entries})
        if 17 * len(rows) + sum(len(k) for _, k, _ in rows) > MAX_LIST_BYTES:
            raise ValueError("the list is larger than one filter may hold")
        parts = [
            np.array([len(rows), len(lengths), max((h.count(".") + 1 for h, _, _ in entries), default=0)], "<i8"),
            np.array([r[0] for r in rows], "<u8"),
            np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<i8"),
            np.array([r[2] for r in rows], np.uint8),
            np.array(lengths, "<i4"),
        ]
        return b"".join([*(p.tobytes() for p in parts), *(r[1] for r in rows), b"\x00"])  # never an empty map

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Index of each key's entry, or -1."""
        found = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.digests) or not keys:
            return found
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype=np.uint64, count=len(keys))
        at = np.searchsorted(self.digests, wanted)
        at[at == len(self.digests)] = 0
        for i in np.flatnonzero(self.digests[at] == wanted).tolist():
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == wanted[i]:  # equal digests stand together
                if self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == keys[i]:
                    found[i] = j
                    break
                j += 1
        return found

    def entry(self, i: int) -> tuple[str, str, int]:
        host, path = self.strings[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "surrogatepass").split("\x00", 1)
        return host, path, int(self.values[i])


def candidates(host: str, path: str, lengths: list[int], most: int) -> list[bytes]:
    """Keys of the host's suffixes of 1 to `most` labels, in time that grows with the host's length."""
    if not host or not most:
        return []
    ends = [len(host)]
    while len(ends) <= most and ends[-1] >= 0:
        ends.append(host.rfind(".", 0, ends[-1]))
    hosts = [host[at + 1 :] for at in ends[1:]]
    return [entry_key(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]


def best(array: DigestArray, pairs: list[tuple[str, str]]) -> list[tuple[str, str, int] | None]:
    """The longest entry that fits each (host, path)."""
    keys, owner = [], []
    for i, (host, path) in enumerate(pairs):
        mine = candidates(host, path, array.lengths, array.labels)
        keys += mine
        owner += [i] * len(mine)
    out: list = [None] * len(pairs)
    hits = array.probe(keys)
    for k in np.flatnonzero(hits >= 0).tolist():
        host, path, value = array.entry(int(hits[k]))
        rank = (len(host) + len(path), len(host))
        if out[owner[k]] is None or rank > out[owner[k]][0]:
            out[owner[k]] = (rank, (host, path, value))
    return [x and x[1] for x in out]


def ship(spark, entries) -> str:
    """Store the array in the shared folder and have every executor, also a later one, fetch it; its name."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(put_file(spark, name, DigestArray.pack(list(entries))))
    return name


def judge(pages: DataFrame, rules=RULES, blocked=BLOCKED_HOSTS, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict): the verdict of the longest rule, else block for hosts on the
    block list and their subdomains, else allow."""
    rule_file = ship(pages.sparkSession, [(h, p, int(v == "allow")) for h, p, v in rules])
    list_file = ship(pages.sparkSession, [(h, "", 0) for h in blocked])
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        rule_array, list_array = DigestArray(SparkFiles.get(rule_file)), DigestArray(SparkFiles.get(list_file))
        for batch in batches:
            pairs = [split_url(u) for u in batch.column(1).to_pylist()]
            ruled, listed = best(rule_array, pairs), best(list_array, [(h, "") for h, _ in pairs])
            rule = [r and r[0] + r[1] for r in ruled]
            verdict = [("block", "allow")[r[2]] if r else "block" if b else "allow" for r, b in zip(ruled, listed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["id", "host", "path", "rule", "verdict"],
            )

    picked = pages.select(F.col(key).alias("id"), F.col(url).alias("url"))
    return picked.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", key)
