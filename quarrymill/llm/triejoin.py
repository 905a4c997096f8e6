"""Similarity join of documents on n-gram sets by prefix trees.

A document's set is its distinct k-word shingles as 64-bit hashes; two link when their Jaccard similarity reaches PERCENT / 100. Sets
are ordered globally, rarest n-gram first. Two linked sets miss so few of each other's n-grams that their first common one lies in a
short prefix of both, so documents that share a prefix n-gram are gathered, and every gathering is a prefix tree:

* members' whole sets, ordered rarest first, are stored in a trie (paths without a branch are one edge),
* a walk from the root carries, for all members at once, how many n-grams each has in common with the path so far, so documents
  that begin alike share that work,
* a member leaves the walk where even the rest of its own n-grams, or of the longest path below, cannot bring enough overlap, where its
  size fits none below, or where all below are in its component already; a subtree without members on the walk is not entered.

Of sets with LEAST n-grams or more, prefixes are taken inside a slice of the hash space, a half, quarter and so on, that holds LEAST to
2 * LEAST of them, the same slice for all sizes of one binary magnitude; a set whose partners may be of the next magnitude is entered
there too. How many missed n-grams fall into a slice is binomial; prefixes cover its tail to MISS, so a link of long documents is not found with a
probability below MISS. Sets below LEAST are entered whole, without any such chance. Links are always confirmed on whole sets.

Work by step:
1. texts are read once for sizes, fingerprints and slices; equal sets collapse to the least id (partial aggregation),
2. n-grams of the slices are counted over all sets; those in two sets or more go back to their documents, which take their prefix (n-grams
   that nobody else has come first, so a document with enough of them leaves here),
3. prefix n-grams with the same members are one gathering. One of more than BLOCK members or BLOCK_GRAMS n-grams is dealt into blocks that
   also hold its least member; only links that join parts not joined before are returned,
4. links give components by star contractions (`dedup.components_of`),
5. a dealt gathering that still holds several components has its blocks' pairs walked, without pairs inside one component.

Defined cases: null or blank texts have empty sets and link with nothing; fewer than k words are one n-gram; rows with a null id are never
linked and have a null component; repeated rows of one id are one document, each row is returned; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .dedup import components_of, doc_sets, linked
from .staging import Staging, small_batches

K, PERCENT = 3, 90
LEAST, MISS = 64, 1e-10
BLOCK, BLOCK_GRAMS = 2048, 1_000_000
#: Memberships up to this count are broadcast, about 40 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: N-grams of one edge that are walked between two looks at the bounds.
STRIDE = 48
KEY_BITS = 58
_SEED = np.uint64(0xA0761D6478BD642F)


def magnitude(n: int) -> int:
    """The slice of sets of size n: a part 2 ** -magnitude of the hash space."""
    return max(n // LEAST, 1).bit_length() - 1


@lru_cache(maxsize=100_000)
def prefix_length(n: int, shift: int, percent: int) -> int:
    """N-grams of a slice among which a linked set has one: one more than it can miss, to a tail of MISS."""
    missed = n * (100 - percent) // 100
    if not shift:
        return missed + 1
    p = 2.0**-shift
    chance = total = (1 - p) ** missed
    k = 0
    while 1 - total > MISS and k < missed:
        chance *= (missed - k) / (k + 1) * p / (1 - p)
        total += chance
        k += 1
    return k + 1


def slices(members: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(shift, prefix length, keys) of a set in its own slice and, if larger partners may have another, in that."""
    n = len(members)
    if not n:
        return []
    spread = textops.mix(members ^ _SEED)
    out = []
    for shift in sorted({magnitude(n), magnitude(n * 100 // percent)}):
        inside = spread[spread >> np.uint64(64 - shift) == 0] if shift else spread
        keys = (inside & np.uint64((1 << KEY_BITS) - 1)) | np.uint64(shift << KEY_BITS)
        out.append((shift, prefix_length(n, shift, percent), keys.astype(np.int64)))
    return out


class Trie:
    """Sets of one gathering, ordered rarest first, sorted, with the lengths of their common beginnings.

    A node is a run of sorted sets that begin alike; the walk keeps runs, no node objects.
    """

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        grams, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(grams), np.int64)
        rank[np.lexsort((grams, counts))] = np.arange(len(grams))
        ends = np.cumsum(sizes)
        paths = [np.sort(rank[inverse[e - s : e]]) for s, e in zip(sizes, ends)]
        order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.order = np.array(order)
        self.paths = [paths[i] for i in order]
        self.sizes = sizes[self.order]
        self.shared = np.zeros(len(order), np.int64)
        for i in range(1, len(order)):
            a, b = self.paths[i - 1], self.paths[i]
            n = min(len(a), len(b))
            differs = np.flatnonzero(a[:n] != b[:n])
            self.shared[i] = differs[0] if len(differs) else n
        self.grams = len(grams)
        # Holders of each gram, and every set's grams as one sorted column to look positions up in.
        member = np.repeat(np.arange(len(order)), self.sizes)
        flat = np.concatenate(self.paths)
        self.holders = member[np.argsort(flat, kind="stable")]
        self.from_ = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=self.grams))])
        self.flat = member * self.grams + flat
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def overlap(self, grams: np.ndarray) -> np.ndarray:
        """How many of the grams each member holds."""
        a, b = self.from_[grams], self.from_[grams + 1]
        lengths = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        return np.bincount(self.holders[at], minlength=len(self.order))


def needed(a, b, percent: int):
    """The least overlap of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def trie_links(ids: np.ndarray, sets: list[np.ndarray], percent: int, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between members that join parts not joined before. groups: components that are known already."""
    trie = Trie(sets)
    sizes, ids = trie.sizes, ids[trie.order]
    label = np.arange(len(ids)) if groups is None else np.unique(groups[trie.order], return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    every = np.arange(len(ids))
    todo = [(0, len(ids), 0, every, np.zeros(len(ids), np.int64))]
    while todo:
        low, high, depth, active, common = todo.pop()
        below = sizes[low:high]
        small, large = int(below.min()), int(below.max())
        if (label[low:high] == label[low]).all():
            open_ = label[active] != label[low]
            active, common = active[open_], common[open_]
        path = trie.paths[low]
        split = int(trie.shared[low + 1 : high].min()) if high - low > 1 else len(path)
        fits = sizes[active] >= needed(sizes[active], small, percent)
        active, common = active[fits], common[fits]
        while depth < split and len(active):
            step = path[depth : min(depth + STRIDE, split)]
            depth += len(step)
            common = common + trie.overlap(step)[active]
            passed = np.searchsorted(trie.flat, active * trie.grams + step[-1], "right") - trie.starts[active]
            own, size = sizes[active] - passed, sizes[active]
            lives = (common + own >= needed(size, small, percent)) & (common + large - depth >= needed(size, large, percent))
            active, common = active[lives], common[lives]
        if not len(active):
            continue
        if len(path) == split:
            near = active[(100 * common >= percent * (sizes[active] + len(path) - common)) & (label[active] != label[low])]
            for q in near.tolist():
                if label[q] != label[low]:
                    out.append((int(ids[q]), int(ids[low])))
                    label[label == label[q]] = label[low]
            low += 1
        if low < high:
            cuts = [low, *(low + 1 + np.flatnonzero(trie.shared[low + 1 : high] == split)).tolist(), high]
            todo += [(a, b, split, active, common) for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, n, fp) and the slices of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    packed = pa.struct([("shift", pa.int32()), ("cap", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            at, rows = 0, []

            def flush():
                found = [s for _, _, cut in rows for s in cut]
                keys = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(x) for _, _, x in found])]).astype(np.int32)), pa.array(np.concatenate([x for _, _, x in found] or [np.zeros(0, np.int64)]))
                )
                inner = pa.StructArray.from_arrays([pa.array([s for s, _, _ in found], pa.int32()), pa.array([c for _, c, _ in found], pa.int32()), keys], fields=list(packed))
                outer = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(cut) for _, _, cut in rows])]).astype(np.int32)), inner)
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at - len(rows), len(rows)), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([p for _, p, _ in rows], pa.binary()), outer], ["id", "n", "fp", "slices"]
                )

            for members in doc_sets(batch.column(1), k):
                at += 1
                print_ = hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None
                rows.append((len(members), print_, slices(members, percent)))
                if len(rows) == 2048:
                    yield flush()
                    rows = []
            if rows:
                yield flush()

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, n bigint, fp binary, slices array<struct<shift:int,cap:int,keys:array<bigint>>>")


def prefixes(sets: DataFrame) -> DataFrame:
    """(key, id, n): prefix n-grams, rarest first, of `sets` (id, n, slices), without those that only one set has."""
    cut = sets.select("id", "n", F.explode("slices").alias("s")).select("id", "n", "s.shift", "s.cap", F.size("s.keys").alias("held"), "s.keys")
    grams = cut.select("id", F.explode("keys").alias("key"))
    counts = grams.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    back = grams.join(counts, "key").groupBy("id", F.shiftrightunsigned("key", KEY_BITS).cast("int").alias("shift")).agg(F.collect_list(F.struct("df", "key")).alias("shared"))
    # A slice holds some hundred n-grams of one document, so this list is short.
    left = F.col("cap") - (F.col("held") - F.size("shared"))
    taken = back.join(cut.drop("keys"), ["id", "shift"]).where(left > 0).select("id", "n", F.explode(F.slice(F.sort_array("shared"), F.lit(1), left)).alias("p"))
    return taken.select("p.key", "id", "n")


MEMBER = "key bigint, block string, id bigint, grp bigint, members binary"


def _with_sets(docs: DataFrame, places: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """One row for each place (key, block, id, grp) with the set of id's document."""
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in MEMBER.split(", ")]

    def run(batches):
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            wanted, ids = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            rows, size = [], 0
            for i, members in enumerate(doc_sets(batch.column(1), k)):
                data = members.tobytes()
                for p in wanted[i]:
                    rows.append((p["key"], p["block"], ids[i], p["grp"], data))
                    size += len(data) + 100
                    if size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)

    by_id = places.groupBy("id").agg(F.collect_list(F.struct("key", "block", "grp")).alias("places"))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    small = places.count() <= BROADCAST_ROWS
    return picked.join(F.broadcast(by_id) if small else by_id, "id").select("id", "text", "places").mapInArrow(run, MEMBER)


def _links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found inside the (key, block) gatherings."""

    def solve(group: list[pa.RecordBatch]):
        table = pa.Table.from_batches(group)
        _, first = np.unique(table["id"].to_numpy(), return_index=True)  # a repeated row or the block's copy of the least member
        table = table.take(first)
        ids, grp = table["id"].to_numpy(), table["grp"].to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()]
        if len(ids) < 2:
            return []
        if len(ids) == 2:
            apart = grp[0] is None or grp[0] != grp[1]
            return [(int(ids[0]), int(ids[1]))] if apart and linked(*sets, percent) else []
        return trie_links(ids, sets, percent, None if grp[0] is None else np.array(grp))

    def run(batches):
        last, held, out = None, [], []
        for batch in batches:
            keys, blocks = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or blocks[i] != blocks[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                if last != (keys[a], blocks[a]):
                    if held:
                        out += solve(held)
                    last, held = (keys[a], blocks[a]), []
                held.append(batch.slice(a, b - a))
            if out:
                yield made(out)
                out = []
        if held:
            out += solve(held)
        if out:
            yield made(out)

    def made(out):
        a, b = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return members.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(run, "a bigint, b bigint")


def join(docs: DataFrame, staging: Staging, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(id, n_shingles, component_id) for every row; ids are integers."""
    small_batches(docs.sparkSession)
    prints = staging.write(_fingerprints(docs, id_col, text_col, k, percent))
    filled = prints.where("n > 0 AND id IS NOT NULL")
    sets = staging.write(filled.groupBy("fp").agg(F.min("id").cast("long").alias("rep")))
    single = filled.withColumn("id", F.col("id").cast("long")).join(sets.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    keyed = staging.write(prefixes(single))
    gathered = keyed.groupBy("key").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")
    ).where("c > 1")
    gathered = gathered.groupBy("least", "c", "w", "who").agg(F.min("key").alias("key"))
    blocks = F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("w") / block_grams)).cast("long")
    sized = staging.write(gathered.select("key", "least", blocks.alias("blocks")))
    dealt = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id", "key"), F.col("blocks"))).otherwise(0)
    placed = staging.write(keyed.join(sized, "key").select("key", "blocks", "id", dealt.alias("b")))
    none = F.lit(None).cast("long")
    own = placed.select("key", F.col("b").cast("string").alias("block"), "id", none.alias("grp"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    hubs = sized.where("blocks > 1").select("key", "least", each.alias("b")).select("key", F.col("b").cast("string").alias("block"), F.col("least").alias("id"), none.alias("grp"))
    links = staging.write(_links(_with_sets(docs, own.union(hubs), id_col, text_col, k), percent))
    roots = staging.write(components_of(links, staging))
    several = placed.where("blocks > 1")
    if not several.isEmpty():
        several = several.join(roots, "id", "left").withColumn("grp", F.coalesce("root", "id"))
        open_ = several.groupBy("key").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x <> y").select("key")
        rows = staging.write(several.join(open_, "key", "left_semi"))
        pair = F.concat_ws("-", F.least("b", "o").cast("string"), F.greatest("b", "o").cast("string"))
        second = rows.select("key", "id", "grp", "b", each.alias("o")).select("key", pair.alias("block"), "id", "grp")
        more = staging.write(_links(_with_sets(docs, second, id_col, text_col, k), percent))
        if not more.isEmpty():
            roots = staging.write(components_of(links.union(more), staging))
    named = staging.write(sets.join(roots, sets["rep"] == roots["id"], "left").select("fp", F.coalesce("root", "rep").alias("root")))
    staging.drop(keyed, sized, placed, links)
    # Copies of one text may be a third of all rows: both sides are scans, so skewed parts can be split.
    out = prints.select("id", "n", "fp").join(named, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id")).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+2], ' ') END AS g
      FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.doc_id)
SELECT c.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id"""
