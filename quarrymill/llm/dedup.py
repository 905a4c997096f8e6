"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct k-word shingles, as 64-bit hashes. Its sketch has REGISTERS buckets;
each stores the leading-zero count of the bucket's least hash and MANTISSA bits after it. Empty
buckets borrow another's register for banding, so that short texts do not meet by emptiness.
Bands of ROWS registers are the candidate keys. Inside a bucket of equal keys, pairs are compared by
the collision-corrected Jaccard estimate of their sketches, then on their full sets; only links
that join parts not yet joined are returned, so a group of n copies gives n - 1 rows, not n * n.

Work by step:
1. sets are fingerprinted and equal sets collapse to the least id (partial aggregation),
2. band keys of the representatives are counted; only keys of two or more sets go on, and of keys
   with the same members the one of the lowest band,
3. members' sets are sent to their buckets. A bucket of more than BLOCK members or BLOCK_SHINGLES
   shingles is dealt into blocks that also hold the bucket's least member; blocks find their own links,
4. links give components by alternating large-star and small-star steps,
5. a dealt bucket that still holds several components has the pairs of its blocks compared, without
   pairs inside one component: first by sketches alone, 512 bytes a member and pair of blocks, then on the full
   sets of the members that have a near sketch in another component. So no link is lost, and groups whose members
   link to their least member, or to others in their block, cost time in proportion to their size.

Defined cases: null or blank texts have empty sets and link with nothing; rows with a null id are
never linked and have a null component; repeated rows of one id are one document, each row is
returned; an empty table gives an empty table; other columns are not read by `components`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .staging import Staging, small_batches

REGISTERS, MANTISSA, ROWS = 256, 10, 5
BANDS = REGISTERS // ROWS
#: Estimates this far below the threshold are still confirmed on full sets.
MARGIN = 0.2
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Band memberships up to this count are broadcast, about 40 bytes each with their block's name; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_order = np.random.Generator(np.random.PCG64(77))
_PROBES = np.stack([np.concatenate([p[p != j], [j]])[: REGISTERS - 1] for j in range(REGISTERS) for p in [_order.permutation(REGISTERS)]])


def doc_sets(column: pa.Array, k: int):
    """Sorted distinct shingle hashes of each row, one at a time."""
    for _, _, data, offs in textops.rounds(column):
        starts, ends, woffs = textops.word_spans(data, offs)
        hashes, soffs = textops.shingle_hashes(textops.word_hashes(data, starts, ends), woffs, k)
        for a, b in zip(soffs[:-1].tolist(), soffs[1:].tolist()):
            yield np.unique(hashes[a:b])


def sketch(members: np.ndarray) -> np.ndarray:
    """Registers of a sorted set; 0 is an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(members):
        return out
    bucket = (members >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = (members[first] << np.uint64(8)) >> np.uint64(12)  # 52 bits, exact as a double
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    shift = bits - 1 - MANTISSA
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64))
    out[bucket[first]] = 1 + ((52 - bits) << MANTISSA | (mantissa.astype(np.int64) & (1 << MANTISSA) - 1))
    return out


def densify(registers: np.ndarray) -> np.ndarray:
    """Each empty register takes that of the first filled bucket in its own fixed random order."""
    out = registers.copy()
    row, col = np.nonzero(registers == 0)
    live = registers.any(axis=1)[row]
    row, col = row[live], col[live]
    for step in range(REGISTERS - 1):
        if not len(row):
            break
        found = registers[row, _PROBES[col, step]]
        hit = found > 0
        out[row[hit], col[hit]] = found[hit]
        row, col = row[~hit], col[~hit]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys; the band's number is the top byte."""
    full = densify(registers)[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.full(full.shape[:2], 0x5851F42D4C957F2D, np.uint64)
    for j in range(ROWS):
        key = textops.mix(key * np.uint64(0x9E3779B97F4A7C15) + full[:, :, j])
    return ((key >> np.uint64(8)) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(56))).astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch rows a against the sketch b, less the registers expected to agree by chance."""
    filled = (a != 0) | (b != 0)
    equal = (a == b) & filled
    na, nb = na.astype(np.float64), float(nb)
    chance = 0.169919487159739093975315012348 * 2.0**-MANTISSA * 4 * na * nb / (na + nb) ** 2 * REGISTERS
    chance = np.where(np.maximum(na, nb) > 32 * REGISTERS, chance, 0.0)
    return np.maximum(equal.sum(axis=1) - chance, 0) / np.maximum(filled.sum(axis=1), 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


class Forest:
    """Union-find over the members of one block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.parent))])


def block_links(key: int, ids, sizes, keys, sketches, sets, percent: int, groups=None) -> list[tuple[int, int]]:
    """Links between the members of a block that join parts not joined before.

    groups: components known from earlier blocks; pairs of one component are not compared. A pair that
    meets in a lower band too is left to that band's bucket. Without sets: (id, id) of every member that has
    a near sketch in another component.
    """
    n = len(ids)
    order = np.argsort(sizes, kind="stable")
    ids, sizes, keys, sketches = ids[order], sizes[order], keys[order], sketches[order]
    sets = None if sets is None else [sets[i] for i in order]
    forest, out, marked = Forest(n), [], set()
    if groups is not None:
        seen: dict = {}
        for i, g in enumerate(groups[order].tolist()):
            forest.parent[i] = seen.setdefault(g, i)
    band = key >> 56
    for i in range(1, n):
        low = int(np.searchsorted(sizes[:i], -(-percent * int(sizes[i]) // 100)))
        if low == i:
            continue
        roots = None
        guess = estimate(sketches[low:i], sketches[i], sizes[low:i], sizes[i])
        near = np.flatnonzero(guess >= percent / 100 - MARGIN)
        for j in (near[np.argsort(-guess[near], kind="stable")] + low).tolist():
            if roots is None:
                roots = forest.root(i)
            if forest.root(j) == forest.root(i) or ids[i] == ids[j]:
                continue
            if band and (keys[i, :band] == keys[j, :band]).any():
                continue
            if sets is None:
                marked |= {i, j}
                continue
            if linked(sets[i], sets[j], percent):
                forest.parent[forest.root(j)] = forest.root(i)
                out.append((int(ids[j]), int(ids[i])))
    return out if sets is not None else [(int(ids[i]), int(ids[i])) for i in sorted(marked)]


def components_of(edges: DataFrame, staging: Staging) -> DataFrame:
    """(id, root) for every id in (a, b): root is the least id that can be reached.

    Large-star and small-star steps; neighbours are never gathered, only their minimum.
    """

    def least(frame: DataFrame) -> DataFrame:
        return frame.groupBy("u").agg(F.min("v").alias("m"))

    def measure(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = staging.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = measure(current)
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).withColumn("m", F.least("u", "m"))
        large = staging.write(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = least(large)
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        following = staging.write(small.where("u <> v").distinct())
        now = measure(following)
        staging.drop(current, large)
        current = following
        if now == last:
            return current.select(F.col("u").alias("id"), F.col("v").alias("root")).union(current.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        last = now


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, fp) and the band keys of every row."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            row, sizes, prints, regs = 0, [], [], []

            def flush(end):
                keys = band_keys(np.stack(regs))
                flat = pa.array(keys.reshape(-1))
                offsets = pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32))
                return pa.RecordBatch.from_arrays(
                    [ids.slice(end - len(sizes), len(sizes)), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                    ["id", "n", "fp", "bands"],
                )

            for members in doc_sets(batch.column(1), k):
                row += 1
                sizes.append(len(members))
                prints.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None)
                regs.append(sketch(members))
                if len(sizes) == 4096:
                    yield flush(row)
                    sizes, prints, regs = [], [], []
            if sizes:
                yield flush(row)

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, n bigint, fp binary, bands array<bigint>")


MEMBER = "key bigint, block string, id bigint, grp bigint, n bigint, bands array<bigint>, sk binary, members binary"


def _with_sets(docs: DataFrame, places: DataFrame, id_col: str, text_col: str, k: int, full: bool = True) -> DataFrame:
    """One row for each place (key, block, id, grp) with the sketch of id's document, its band keys and its full set, or the sketch alone."""

    def run(batches):
        for batch in batches:
            places_of = batch.column(2).to_pylist()
            ids = batch.column(0).to_pylist()
            rows: list = []
            size = 0
            for i, members in enumerate(doc_sets(batch.column(1), k)):
                registers = sketch(members)
                keys = band_keys(registers[None])[0].tolist()
                for p in places_of[i]:
                    rows.append((p["key"], p["block"], ids[i], p["grp"], len(members), keys if full else None, registers.tobytes(), members.tobytes() if full else None))
                    size += 8 * len(members) + 1024 if full else 600
                    if size > 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
            if rows:
                yield _rows(rows)

    def _rows(rows):
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in MEMBER.split(", ")])

    # A document is in at most BANDS buckets, so this list is short; blocks of step 5 add to it.
    by_id = places.groupBy("id").agg(F.collect_list(F.struct("key", "block", "grp")).alias("places"))
    count = places.count()
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    joined = picked.join(F.broadcast(by_id) if count <= BROADCAST_ROWS else by_id, "id")
    return joined.select("id", "text", "places").mapInArrow(run, MEMBER)


def _links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found inside the (key, block) groups; of members without sets, (id, id) of those with a near sketch."""

    def solve(group: list[pa.RecordBatch]):
        table = pa.Table.from_batches(group)
        ids = table["id"].to_numpy()
        _, keep = np.unique(ids, return_index=True)  # a repeated row or the block's copy of the least member
        table = table.take(keep)
        if len(table) < 2:
            return []
        grp = table["grp"].to_pylist()
        sketches = np.stack([np.frombuffer(x, np.uint16) for x in table["sk"].to_pylist()])
        whole = table["members"].null_count == 0
        return block_links(
            table["key"][0].as_py(), table["id"].to_numpy(), table["n"].to_numpy(), np.array(table["bands"].to_pylist(), np.int64) if whole else band_keys(sketches),
            sketches, [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()] if whole else None, percent, None if grp[0] is None else np.array(grp),
        )

    def run(batches):
        last, held = None, []
        out: list[tuple[int, int]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, blocks = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            cut = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or blocks[i] != blocks[i - 1]]
            for a, b in zip([0, *cut], [*cut, len(keys)]):
                if last != (keys[a], blocks[a]):
                    if held:
                        out += solve(held)
                    last, held = (keys[a], blocks[a]), []
                held.append(batch.slice(a, b - a))
            if out:
                yield _edges(out)
                out = []
        if held:
            out += solve(held)
        if out:
            yield _edges(out)

    def _edges(out):
        a, b = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = members.repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(docs: DataFrame, staging: Staging, k: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row; ids are integers."""
    small_batches(docs.sparkSession)
    prints = staging.write(_fingerprints(docs, id_col, text_col, k))
    filled = prints.where("n > 0 AND id IS NOT NULL")
    sets = staging.write(filled.groupBy("fp").agg(F.min("id").cast("long").alias("rep"), F.max("n").alias("n")))
    banded = filled.join(sets.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", F.explode("bands").alias("key")).distinct()
    banded = staging.write(banded)
    keyed = banded.groupBy("key").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"),
    ).where("c > 1")
    buckets = staging.write(keyed.groupBy("least", "c", "w", "who").agg(F.min("key").alias("key")))
    blocks = F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("w") / block_shingles)).cast("long")
    sized = buckets.select("key", "least", blocks.alias("blocks"))
    in_block = F.pmod(F.xxhash64("id", "key"), F.col("blocks"))
    placed = staging.write(banded.join(sized, "key").select("key", "least", "blocks", "id", F.when(F.col("blocks") > 1, in_block).otherwise(0).alias("b")))
    none = F.lit(None).cast("long")
    own = placed.select("key", F.col("b").cast("string").alias("block"), "id", none.alias("grp"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b")
    hubs = sized.where("blocks > 1").select("key", "least", each).select("key", F.col("b").cast("string").alias("block"), F.col("least").alias("id"), none.alias("grp"))
    links = staging.write(_links(_with_sets(docs, own.union(hubs), id_col, text_col, k), percent))
    roots = staging.write(components_of(links, staging))
    # What stays open: dealt buckets that hold several components.
    dealt = placed.where("blocks > 1")
    if not dealt.isEmpty():
        grouped = dealt.join(roots, "id", "left").withColumn("grp", F.coalesce("root", "id"))
        several = grouped.groupBy("key").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x <> y").select("key")
        open_rows = staging.write(grouped.join(several, "key", "left_semi"))
        pairs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o")
        second = open_rows.select("key", "id", "grp", "b", pairs).select(
            "key", F.concat_ws("-", F.least("b", "o").cast("string"), F.greatest("b", "o").cast("string")).alias("block"), "id", "grp"
        )
        near = staging.write(_links(_with_sets(docs, second, id_col, text_col, k, full=False), percent).select(F.col("a").alias("id")).distinct())
        more = staging.write(_links(_with_sets(docs, second.join(near, "id", "left_semi"), id_col, text_col, k), percent))
        roots = staging.write(components_of(links.union(more), staging))
    named = staging.write(sets.join(roots, sets["rep"] == roots["id"], "left").select("fp", F.coalesce("root", "rep").alias("root")))
    staging.drop(banded, buckets, placed, links)
    # Copies of one text may be a third of all rows: both sides are scans, so skewed parts can be split.
    out = prints.select("id", "n", "fp").join(named, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id")).cast("long")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, staging: Staging, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but the least id of each component; a repeated id stays as it is."""
    gone = components(docs, staging, k, percent).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS g
      FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.doc_id)
SELECT c.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, c.doc_id = min(root) AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id"""
