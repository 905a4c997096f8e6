"""A stored inverted index: postings by term, kept as segments in a folder and looked up without a scan of the texts.

Folder: `postings/seg=S/part=P` (term, block, key, col, tf, positions, total, lead, block_n, block_tf, block_total), sorted by term and block
and cut into ranges of about PART_POSTINGS postings, so a frequent term lies in several parts and a rare one shares a part; `lead` marks a
key's first posting of a term, and the first posting of a term's block says how many there are, the greatest tf and the least length;
`ranges/seg=S` the first and last term of each part; `documents/seg=S` (key, hash, total); `gone/seg=S` keys whose rows in segments before S no longer count; `head/<generation>.json`,
written last, names the live segments and holds the number of live documents and tokens. A query reads the parts whose range
holds its terms, and of them the row groups that do; a posting carries its document's length, so ranking joins nothing.

A block is a set of about BLOCK_DOCS documents of like length, the same for all terms: of one round of text of one task, after a merge by a hash of
the key. So the sum of its terms' bounds is a bound of any score in it: `top` scores the blocks of the greatest bounds first and reads others only where their bound reaches the k-th score.

Terms are runs of Unicode letters and digits, lower-cased and without accents; `porter` also cuts endings.
A null text has no terms; adding a key again replaces it, or skips it when its texts are unchanged; removing
an unknown key changes nothing. Readers see the last head, so a failed write leaves the index as it was.
Segments of like size are merged, MERGED at a time, so a row is written anew a logarithmic number of times.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions.porter import stem
from quarrymill.operators.lexical import B, K1, idf
from quarrymill.session import at_most, list_files, read_small, remove, scratch, small_batches, stage, stamps, write_parts, write_small

RUN = re.compile(r"[^\W_]+")
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]{1,16}")
#: Postings of one part, and the least of a part where there are fewer parts than cores.
PART_POSTINGS, LEAST_POSTINGS = 2_000_000, 50_000
#: Bounds of blocks do not pay where every term of a query has fewer than FREQUENT postings.
BLOCK_DOCS, FREQUENT = 256, 1024
#: Segments of one size (within a factor of MERGED) that become one.
MERGED = 4
#: Characters and numbers that are handled at a time.
PIECE = 1 << 18
#: Bytes of text whose terms a task holds at a time; the rows of such a round are cut into blocks.
ROUND_BYTES = 8 << 20
#: Postings of a term that are dealt as one row, at most, and such rows of one part.
ROW_POSTINGS, PART_ROWS = 32, 250_000
#: Postings of a query's terms up to this number are scored without a look at bounds.
PLAIN_POSTINGS = 200_000
#: Tombstones, and keys of new rows, up to this number are broadcast.
GONE_ROWS = 1_000_000
#: Of a term in a block: postings, greatest tf, least length.
BOUNDS = ("block_n", "block_tf", "block_total")
#: A term's postings of a round: their keys, and the rest as bytes.
GATHERED = ("keys", "packed")
#: Gathered rows that a worker packs or opens at a time, and bytes of them that a task of the shuffle reads: what it sorts by range stays in memory.
GATHERED_ROWS, DEALT_BYTES = 1 << 12, 32 << 20
#: What a posting carries beside its own values, made anew whenever it is written.
MADE = ("part", "block", "lead", *BOUNDS)


@lru_cache(maxsize=1 << 12)
def _unmarked(run: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", run) if unicodedata.category(c) != "Mn")


def fold(text: str) -> str:
    """Lower case, without combining marks."""
    lowered = text.lower()
    return lowered if lowered.isascii() else BEYOND_ASCII.sub(lambda m: _unmarked(m[0]), lowered)


def terms_of(text: str | None, porter: bool = False) -> list[str]:
    found = RUN.findall(fold(text or ""))
    return [cut(t) for t in found] if porter else found


cut = lru_cache(maxsize=1 << 18)(stem)


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """Of each code point, whether RUN takes it."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def words_of(texts: list[str | None], porter: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """What `terms_of` finds in some texts, as numbers of distinct terms, these terms, and how many each text has."""
    pieces, sizes, start, held = [], [], 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= PIECE or i == len(texts) - 1:
            found, size = _runs([fold(t or "") for t in texts[start : i + 1]])
            pieces.append(found)
            sizes.append(size)
            start, held = i + 1, 0
    found = pa.concat_arrays(pieces).dictionary_encode()
    codes, terms = found.indices.to_numpy(), found.dictionary
    if porter:
        stems = pa.array([cut(t) for t in terms.to_pylist()], pa.string()).dictionary_encode()
        codes, terms = stems.indices.to_numpy()[codes], stems.dictionary
    return codes, terms, np.concatenate(sizes)


def _runs(folded: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The runs of some texts in their order, and how many each text has."""
    parts, joined = [f.encode() for f in folded], "\n".join(folded)
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    if len(data) == len(joined):
        inside = _in_words()[data]
    else:
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        inside = np.repeat(_in_words()[points], 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000))
    begins, ends = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0)).reshape(-1, 2).T
    upto = np.append(0, np.cumsum(ends - begins)).astype(np.int32)
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(upto), pa.py_buffer(data[inside])]), np.diff(np.searchsorted(begins, starts))


def column_bytes(texts: pa.Array) -> list[int]:
    """Length of each text in bytes, 0 for a null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def row_postings() -> int:
    """Postings of one dealt row: few enough that ranges of rows are ranges of about as many postings."""
    return max(1, min(ROW_POSTINGS, PART_POSTINGS // 8192))


def parts_of(spark: SparkSession, postings: int) -> int:
    return max(1, -(-postings // PART_POSTINGS), min(spark.sparkContext.defaultParallelism, -(-postings // LEAST_POSTINGS)))


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 to 2^35 - 1 in groups of seven bits, the lowest first, and where each begins and the last ends."""
    size = np.ones(len(values), np.int8)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    at = np.append(0, np.cumsum(size, dtype=np.int64))
    out = np.empty(at[-1], np.uint8)
    for start in range(0, len(values), PIECE):
        left, where, bytes_of = (x[start : start + PIECE] for x in (values, at[:-1], size))
        i = 0
        while len(left):
            more = bytes_of > i + 1
            out[where + i] = left & 127 | more.astype(np.int64) << 7
            left, where, bytes_of, i = left[more] >> 7, where[more], bytes_of[more], i + 1
    return out, at


def numbers_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of `varints`, and the place behind each one."""
    ends = np.flatnonzero(data < 128) + 1
    begins = np.append(0, ends)[:-1]
    size = ends - begins
    out = (data[begins] & 127).astype(np.int64)
    for i in range(1, int(size.max(initial=0))):
        more = np.flatnonzero(size > i)
        out[more] |= (data[begins[more] + i] & 127).astype(np.int64) << 7 * i
    return out, ends


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of some runs that follow one another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def packed(rows: np.ndarray, marks: np.ndarray, total: np.ndarray, tf: np.ndarray, given: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> pa.Array:
    """Postings as bytes, so many for each of `rows`: of a row first all marks, then all lengths, all tf, the bounds that are given, the steps between positions."""
    begins = np.cumsum(rows) - rows
    of_row = np.repeat(np.arange(len(rows)), rows)
    bounded, held = (np.add.reduceat(x, begins) for x in (given.astype(np.int64), tf))
    base = np.append(0, np.cumsum(3 * rows + 3 * bounded + held))
    values = np.empty(base[-1], np.int64)
    place = base[of_row] + within(rows)
    for i, plane in enumerate((marks, total, tf)):
        values[place + i * rows[of_row]] = plane
    values[(np.repeat(base[:-1] + 3 * rows, bounded) + 3 * within(bounded))[:, None] + np.arange(3)] = bounds
    steps = np.diff(at, prepend=0)
    first = np.cumsum(tf) - tf
    steps[first] = at[first]
    values[np.repeat(base[:-1] + 3 * (rows + bounded), held) + within(held)] = steps
    data, ends = varints(values)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends[base].astype(np.int32)), pa.py_buffer(data)])


def opened(columns: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of gathered rows (term, block, keys, packed)."""
    keys, blobs = batch.column(2), batch.column(3).cast(pa.binary())
    rows = pc.list_value_length(keys).to_numpy()
    ends = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, 4 * blobs.offset)
    values, behind = numbers_of(np.frombuffer(blobs.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0]))
    base = np.searchsorted(behind, ends[:-1] - ends[0], "right")
    of_row = np.repeat(np.arange(len(rows)), rows)
    place = base[of_row] + within(rows)
    marks, total, tf = (values[place + i * rows[of_row]] for i in range(3))
    given, opens, lead = (marks & bit > 0 for bit in (4, 2, 1))
    begins = np.cumsum(rows) - rows
    bounded, held = (np.add.reduceat(x, begins) for x in (given.astype(np.int64), tf))
    bounds = np.stack([np.ones(len(tf), np.int64), tf, total])
    bounds[:, given] = values[(np.repeat(base + 3 * rows, bounded) + 3 * within(bounded))[:, None] + np.arange(3)].T
    steps = np.cumsum(values[np.repeat(base + 3 * (rows + bounded), held) + within(held)])
    upto = np.append(0, np.cumsum(tf))
    at = steps - np.repeat(np.append(0, steps)[upto[:-1]], tf)
    after, col = np.divmod(marks >> 3, columns)
    positions = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(at.astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(of_row)), keys.flatten(), pa.array(col.astype(np.int32)), positions, pa.array(total.astype(np.int32)),
         pa.array(batch.column(1).to_numpy()[of_row] + after), pa.array(lead), *[pa.array(b.astype(np.int32), mask=~opens) for b in bounds]],
        ["term", "key", "col", "positions", "total", "block", "lead", *BOUNDS],
    )


class StoredIndex:
    """columns: text columns in the order of their weights."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: tuple[str, ...], porter: bool = False):
        self.spark, self.path, self.key, self.columns, self.porter = spark, path.rstrip("/"), key, columns, porter
        self._ranges: dict[int, tuple[list, list]] = {}

    # -- head ----------------------------------------------------------------------------------

    def head(self) -> dict:
        names = sorted(n for n in list_files(self.spark, f"{self.path}/head") if n.endswith(".json"))
        if not names:
            return {"generation": 0, "segments": [], "next": 1, "documents": 0, "tokens": 0, "gone": [], "sizes": {}}
        return json.loads(read_small(self.spark, f"{self.path}/head/{names[-1]}"))

    def _commit(self, head: dict) -> None:
        head["generation"] += 1
        write_small(self.spark, f"{self.path}/head/{head['generation']:012d}.json", json.dumps(head).encode())

    # -- writing -------------------------------------------------------------------------------

    def _postings(self, docs: DataFrame) -> DataFrame:
        """(term, block, n, keys, packed) and, without a term, (key, total, hash) of each row. The rows of a round of text are cut into blocks
        by length, so what they hold of a term is gathered here, with its bounds, without a shuffle: n postings a row, at most `row_postings`, the first in `block`.
        A posting's mark has the block after the first one and the column, and whether its bounds are given, it opens its block, and it leads its key."""
        porter, n, most, block_docs, most_rows = self.porter, len(self.columns), row_postings(), BLOCK_DOCS, GATHERED_ROWS
        kind = docs.schema[self.key].dataType.simpleString()

        def counted(keys, hashes, texts, block):
            rows = len(keys)
            codes, terms, lengths = words_of([texts[c][row] for row in range(rows) for c in range(n)], porter)
            total = lengths.reshape(rows, n).sum(axis=1)
            blocks = max(1, round(rows / block_docs))
            of_row = np.empty(rows, np.int64)
            of_row[np.argsort(total, kind="stable")] = np.arange(rows) * blocks // rows
            # In the order of the terms rows pack and sort better.
            sorted_terms = pc.sort_indices(terms).to_numpy()
            rank = np.empty(len(terms), np.int64)
            rank[sorted_terms] = np.arange(len(terms))
            place = np.repeat(np.arange(rows * n), lengths)
            at = (np.arange(len(place)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            name = (rank[codes] * blocks + of_row[place // n]) * (rows * n) + place
            order = np.argsort(name, kind="stable")
            name = name[order]
            first = np.flatnonzero(np.diff(name, prepend=-1))  # of each posting
            if len(first):
                group, where = np.divmod(name[first], rows * n)
                term, mine = np.divmod(group, blocks)
                row, tf = where // n, np.diff(first, append=len(order))
                opens = np.diff(group, prepend=-1) != 0
                begins = np.flatnonzero(opens)
                size = np.diff(begins, append=len(first))
                lead = opens | (np.diff(row, prepend=-1) != 0)
                of_term = np.flatnonzero(np.diff(term, prepend=-1))
                starts = np.flatnonzero((np.arange(len(first)) - np.repeat(of_term, np.diff(of_term, append=len(first)))) % most == 0)
                counts = np.diff(starts, append=len(first))
                # Bounds are given where they are not those of a block's only posting.
                given = np.zeros(len(first), bool)
                given[begins] = size > 1
                bounds = np.stack([size, np.maximum.reduceat(tf, begins), np.minimum.reduceat(total[row], begins)], axis=1)[size > 1]
                marks = ((mine - np.repeat(mine[starts], counts)) * n + where % n) << 3 | given << 2 | opens << 1 | lead
                upto, ends, before = np.append(starts, len(first)), np.append(first, len(order)), np.append(0, np.cumsum(given))
                for start in range(0, len(starts), most_rows):
                    some = slice(start, start + most_rows)
                    p, q = upto[start], upto[min(start + most_rows, len(starts))]
                    blobs = packed(counts[some], marks[p:q], total[row[p:q]], tf[p:q], given[p:q], bounds[before[p] : before[q]], at[order[ends[p] : ends[q]]])
                    held = pa.ListArray.from_arrays(pa.array((upto[start : start + len(blobs) + 1] - p).astype(np.int32)), keys.take(pa.array(row[p:q])))
                    yield pa.RecordBatch.from_arrays(
                        [terms.take(pa.array(sorted_terms[term[starts[some]]])), pa.array(block + mine[starts[some]]), pa.array(counts[some].astype(np.int32)), held, blobs,
                         *[pa.nulls(len(blobs), t) for t in (keys.type, pa.int32(), pa.string())]],
                        names,
                    )
            none = [pa.nulls(rows, t) for t in (pa.string(), pa.int64(), pa.int32(), pa.list_(keys.type), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, keys, pa.array(total.astype(np.int32)), hashes], names)

        def run(batches):
            # A block's number is one for all tasks.
            block = TaskContext.get().partitionId() << 32
            for batch in batches:
                start = size = 0
                for row, held in enumerate(zip(*(column_bytes(batch.column(i + 2)) for i in range(n)))):
                    size += sum(held)
                    if size >= ROUND_BYTES or row == batch.num_rows - 1:
                        part = batch.slice(start, row + 1 - start)
                        yield from counted(part.column(0), part.column(1), [part.column(i + 2).to_pylist() for i in range(n)], block)
                        start, size, block = row + 1, 0, block + part.num_rows

        names = ["term", "block", "n", *GATHERED, "key", "total", "hash"]
        picked = docs.select(F.col(self.key).alias("key"), self._hash().alias("hash"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(self.columns)])
        small_batches(self.spark)
        return picked.mapInArrow(run, f"term string, block long, n int, keys array<{kind}>, packed binary, key {kind}, total int, hash string")

    def _hash(self) -> Column:
        return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x1e")) for c in self.columns]), 256)

    def _write_segment(self, docs: DataFrame, number: int) -> None:
        """Gathered rows are dealt and sorted as they are, packed, and opened as postings when they are written."""
        held = stage(self._postings(docs), "postings", "zstd")
        held.where("term IS NULL").select("key", "hash", F.col("total").cast("long").alias("total")).write.parquet(f"{self.path}/documents/seg={number}")
        rows = held.where("term IS NOT NULL")
        sizes = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.count(F.lit(1)).alias("rows")).first()
        parts = max(parts_of(self.spark, sizes.postings), -(-sizes.rows // PART_ROWS))
        made = self._opened(self._dealt(rows, parts))
        split = "spark.sql.files.maxPartitionBytes"
        before = at_most(self.spark, split, DEALT_BYTES)
        try:
            self._write_made(made, number, not sizes.postings)
        finally:
            self.spark.conf.set(split, before)

    def _dealt(self, gathered: DataFrame, parts: int) -> DataFrame:
        return gathered.select("term", "block", *GATHERED).repartitionByRange(parts, "term", "block").sortWithinPartitions("term", "block")

    def _opened(self, dealt: DataFrame) -> DataFrame:
        """One row a posting, in the order of the gathered rows."""
        columns, most = len(self.columns), GATHERED_ROWS
        kind = dealt.schema["keys"].dataType.elementType.simpleString()

        def run(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, most):
                    yield opened(columns, batch.slice(start, most))

        bounds = ", ".join(f"{b} int" for b in BOUNDS)
        rows = dealt.mapInArrow(run, f"term string, key {kind}, col int, positions array<int>, total int, block long, lead boolean, {bounds}")
        return rows.select("term", "key", "col", F.size("positions").alias("tf"), "positions", "total", "block", F.spark_partition_id().alias("part"), "lead", *BOUNDS)

    def _write_postings(self, postings: DataFrame, slots: int, number: int) -> None:
        """A segment's postings in ranges of terms and blocks with the bounds of their blocks, and the ranges. `postings` is read from files: it is
        counted and sampled first. A block's postings of a term lie in one range, so its bounds need no shuffle of their own."""
        n = postings.count()
        like = F.floor(F.log2(F.col("total") + 1) * 2).cast("long")
        block = like * slots + F.pmod(F.xxhash64("key"), F.lit(slots))
        # What a posting's other values give is made behind the shuffle.
        dealt = postings.select("term", "key", "col", "positions", "total").repartitionByRange(parts_of(self.spark, n), "term", block)
        dealt = dealt.select("term", "key", "col", F.size("positions").alias("tf"), "positions", "total", block.alias("block"), F.spark_partition_id().alias("part"))
        # The order begins with the term, whose first bytes settle most comparisons of the sort; the part is one for all rows of a task.
        inside = W.partitionBy("term", "block").orderBy("key", "col")
        whole, first = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), F.row_number().over(inside) == 1
        bounds = (F.count(F.lit(1)).over(whole).cast("int"), F.max("tf").over(whole), F.min("total").over(whole))
        lead = F.lit(True) if len(self.columns) == 1 else ~F.col("key").eqNullSafe(F.lag("key").over(inside)) | first
        made = dealt.withColumns({"lead": lead} | {c: F.when(first, b) for c, b in zip(BOUNDS, bounds)})
        self._write_made(made.sortWithinPartitions("term", "block", "key", "col"), number, not n)

    def _write_made(self, made: DataFrame, number: int, empty: bool) -> None:
        where = f"{self.path}/postings/seg={number}"
        write_parts(made, where, "part")
        if empty:
            self.spark.createDataFrame([], made.drop("part").schema).withColumn("part", F.lit(0)).write.mode("append").parquet(where)
        # Every term has a posting with bounds; terms are made distinct by their hash before the least and greatest are looked for.
        terms = self.spark.read.parquet(where).where(F.col(BOUNDS[0]).isNotNull()).select("part", "term").distinct()
        terms.groupBy("part").agg(F.min("term").alias("low"), F.max("term").alias("high")).coalesce(1).write.parquet(f"{self.path}/ranges/seg={number}")

    def decisions(self, docs: DataFrame) -> DataFrame:
        """(key, decision): add, update or skip, by the hash of the texts."""
        known = self.documents().select("key", F.col("hash").alias("old"))
        new = docs.select(F.col(self.key).alias("key"), self._hash().alias("new"))
        decision = F.when(F.col("old").isNull(), "add").when(F.col("old") == F.col("new"), "skip").otherwise("update")
        return new.join(known, "key", "left").select("key", decision.alias("decision"))

    def add(self, docs: DataFrame) -> DataFrame:
        """Index new and changed rows, one row a key; the decisions taken, as a stored table."""
        head = self.head()
        number = head["next"]
        if head["segments"]:
            self.decisions(docs).write.parquet(f"{self.path}/decisions/seg={number}")
            decided = self.spark.read.parquet(f"{self.path}/decisions/seg={number}")
            # Of the two sides the keys are kept in memory: texts are not sorted, and where the keys are few, not shuffled.
            keys = decided.where("decision <> 'skip'").select(F.col("key").alias(self.key))
            self._write_segment(docs.join(F.broadcast(keys) if keys.count() <= GONE_ROWS else keys.hint("shuffle_hash"), self.key, "left_semi"), number)
        else:
            self._write_segment(docs, number)
            decided = self.spark.read.parquet(f"{self.path}/documents/seg={number}").select("key", F.lit("add").alias("decision"))
            decided.write.parquet(f"{self.path}/decisions/seg={number}")
            decided = self.spark.read.parquet(f"{self.path}/decisions/seg={number}")
        self._retire(head, decided.where("decision = 'update'").select("key"), number)
        head["segments"].append(number)
        head["next"] += 1
        added = self.spark.read.parquet(f"{self.path}/documents/seg={number}").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("t")).first()
        head["documents"] += added.n
        head["tokens"] += added.t or 0
        head["sizes"][str(number)] = added.n
        self._commit(head)
        self.merge()
        return decided

    def remove(self, keys: DataFrame) -> None:
        """keys: one column of keys to take out."""
        head = self.head()
        number = head["next"]
        self._retire(head, keys.select(F.col(keys.columns[0]).alias("key")).distinct(), number)
        head["next"] += 1
        self._commit(head)

    def _retire(self, head: dict, keys: DataFrame, number: int) -> None:
        """Tombstones for rows of earlier segments; the head's counts lose what they held."""
        live = self._live_documents(head)
        if live is None:
            return
        live.join(keys, "key", "left_semi").write.parquet(f"{self.path}/gone/seg={number}")
        lost = self.spark.read.parquet(f"{self.path}/gone/seg={number}").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("t")).first()
        if lost.n:
            head["gone"].append(number)
            head.setdefault("lost", {})[str(number)] = lost.n
            head["documents"] -= lost.n
            head["tokens"] -= lost.t or 0

    def merge(self) -> None:
        """Segments of one size become one, until no size has MERGED of them."""
        while True:
            head, tiers = self.head(), defaultdict(list)
            for seg in head["segments"]:
                size, tier = head["sizes"].get(str(seg), 0), 0
                while size >= MERGED ** (tier + 1):
                    tier += 1
                tiers[tier].append(seg)
            full = [held for held in tiers.values() if len(held) >= MERGED]
            if not full:
                return
            self._merge(head, full[0])

    def optimize(self) -> None:
        """All live postings in one segment, without tombstones; readers of the old head keep their files until `vacuum`."""
        head = self.head()
        if len(head["segments"]) > 1 or head["gone"]:
            self._merge(head, head["segments"])

    def _merge(self, head: dict, old: list[int]) -> None:
        number, part = head["next"], head | {"segments": old}
        self._live_documents(part).write.parquet(f"{self.path}/documents/seg={number}")
        size = self.spark.read.parquet(f"{self.path}/documents/seg={number}").count()
        live = self._live(head, self._read(part, "postings")).drop(*MADE)
        # Postings are read thrice, and each time held against the tombstones; what that would shuffle is stored first.
        self._write_postings(live if self._few_gone(head) else stage(live, "merged", "zstd"), max(1, -(-size // BLOCK_DOCS)), number)
        head["segments"] = [s for s in head["segments"] if s not in old] + [number]
        head["gone"] = [g for g in head["gone"] if any(s < g for s in head["segments"])]
        head["sizes"] = {str(s): head["sizes"].get(str(s), 0) for s in head["segments"]} | {str(number): size}
        head["next"] = number + 1
        self._commit(head)

    def vacuum(self) -> list[int]:
        """Remove the files of segments that the last head does not name; their numbers."""
        head = self.head()
        old = [s for s in range(1, head["next"]) if s not in head["segments"] and s not in head["gone"]]
        for s in old:
            for kind in ("postings", "ranges", "documents", "gone", "decisions"):
                remove(self.spark, f"{self.path}/{kind}/seg={s}")
        return old

    # -- reading -------------------------------------------------------------------------------

    def _read(self, head: dict, kind: str) -> DataFrame | None:
        if not head["segments"]:
            return None
        parts = [self.spark.read.parquet(f"{self.path}/{kind}/seg={s}").withColumn("seg", F.lit(s)) for s in head["segments"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _live(self, head: dict, rows: DataFrame) -> DataFrame:
        if not head["gone"]:
            return rows.drop("seg")
        gone = None
        for s in head["gone"]:
            one = self.spark.read.parquet(f"{self.path}/gone/seg={s}").select(F.col("key").alias("gone_key"), F.lit(s).alias("until"))
            gone = one if gone is None else gone.unionByName(one)
        gone = gone.groupBy("gone_key").agg(F.max("until").alias("until"))
        gone = F.broadcast(gone) if self._few_gone(head) else gone.hint("shuffle_hash")  # postings are never sorted for this
        return rows.join(gone, (F.col("key") == F.col("gone_key")) & (F.col("seg") < F.col("until")), "left_anti").drop("seg")

    def _few_gone(self, head: dict) -> bool:
        return sum(head.get("lost", {}).get(str(s), GONE_ROWS + 1) for s in head["gone"]) <= GONE_ROWS

    def _live_documents(self, head: dict) -> DataFrame | None:
        rows = self._read(head, "documents")
        return None if rows is None else self._live(head, rows)

    def documents(self) -> DataFrame:
        """(key, hash, total) of every live row."""
        found = self._live_documents(self.head())
        return self.spark.createDataFrame([], "key string, hash string, total long") if found is None else found

    def _parts(self, seg: int, terms: list[str], prefix: str | None = None) -> list[int]:
        """The parts of a segment whose range holds one of the terms, or terms with a prefix; the ranges are read once, a row a part."""
        if seg not in self._ranges:
            rows = sorted((r.low, r.high, r.part) for r in self.spark.read.parquet(f"{self.path}/ranges/seg={seg}").collect() if r.low is not None)
            self._ranges[seg] = ([r[0] for r in rows], rows)
        lows, rows = self._ranges[seg]
        found = set() if prefix is None else {part for low, high, part in rows if low[: len(prefix)] <= prefix <= high}
        for term in terms:
            at = bisect_right(lows, term) - 1
            while at >= 0 and rows[at][1] >= term:
                found.add(rows[at][2])
                at -= 1
        return sorted(found)

    def postings(self, terms: list[str] | None = None, prefix: str | None = None, head: dict | None = None) -> DataFrame:
        """Live postings of some terms, of terms with a prefix, or of all."""
        head = head or self.head()
        if not head["segments"]:
            return self.spark.createDataFrame([], "term string, key string, col int, tf int, positions array<int>, total int, block long, lead boolean, block_n int, block_tf int, block_total int, part int")
        return self._live(head, self._found(head, terms, prefix))

    def _found(self, head: dict, terms: list[str] | None, prefix: str | None = None) -> DataFrame:
        out = None
        for s in head["segments"]:
            rows = self.spark.read.parquet(f"{self.path}/postings/seg={s}").withColumn("seg", F.lit(s))
            if terms is not None:
                rows = rows.where(F.col("part").isin(self._parts(s, terms)) & F.col("term").isin(terms))
            if prefix is not None:
                rows = rows.where(F.col("part").isin(self._parts(s, [], prefix)) & F.startswith("term", F.lit(prefix)))
            out = rows if out is None else out.unionByName(rows)
        return out

    def vocabulary(self) -> DataFrame:
        """(term, docs, hits): rows that hold a term in any column, and its occurrences."""
        return self.postings().groupBy("term").agg(F.count_if("lead").alias("docs"), F.sum("tf").alias("hits"))

    # -- querying ------------------------------------------------------------------------------

    def scores(self, query: str | list[str], weights: tuple[float, ...] = (), every: bool = False) -> DataFrame:
        """(key, score, matched) of rows with any term, or with every one; lower scores are better."""
        terms = list(dict.fromkeys(terms_of(query, self.porter) if isinstance(query, str) else query))
        head = self.head()
        weight = F.lit(1.0)
        if weights:
            weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("col") + 1)
        by_row = self.postings(terms, head=head).groupBy("term", "key").agg(F.sum(F.col("tf") * weight).alias("tf"), F.first("total").alias("total"))
        df = by_row.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a term of the query
        average = head["tokens"] / head["documents"] if head["documents"] else 1.0
        part = idf(F.lit(float(head["documents"])), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("total") / F.lit(average)))
        out = by_row.join(F.broadcast(df), "term").groupBy("key").agg((-F.sum(part)).alias("score"), F.count(F.lit(1)).alias("matched"))
        return out.where(F.col("matched") == len(terms)) if every else out

    def top(self, query: str | list[str], k: int, weights: tuple[float, ...] = (), every: bool = False, skip: bool | None = None) -> DataFrame:
        """The k best rows; skip: whether blocks are looked at by their bounds first (by default where the terms have many postings)."""
        if skip is not False and len(self.columns) == 1 and not every:
            found = self._top_by_bounds(query, k, weights[0] if weights else 1.0, bool(skip))
            if found is not None:
                return found[0]
        found = self.scores(query, weights, every).withColumn("score", F.round("score", 6))
        return found.select("key", "score").orderBy("score", "key").limit(k)

    def _top_by_bounds(self, query: str | list[str], k: int, weight: float, always: bool = True) -> tuple[DataFrame, int, int] | None:
        """(the k best rows, blocks scored, blocks there are); None where bounds do not hold (rows were replaced since the last merge) or do not pay."""
        terms = list(dict.fromkeys(terms_of(query, self.porter) if isinstance(query, str) else query))
        head = self.head()
        if head["gone"] or not head["segments"] or not terms:
            return None
        postings = self._found(head, terms)
        stored = postings.where("block_n IS NOT NULL").select("term", "seg", "block", F.col("block_n").cast("long").alias("n"), F.col("block_tf").alias("tf"), F.col("block_total").alias("total"))
        counts = [r.n for r in stored.groupBy("term").agg(F.sum("n").alias("n")).collect()]  # a row a term
        if not always and (sum(counts) <= PLAIN_POSTINGS or max(counts) < FREQUENT):
            return None
        bounds = stage(stored, "bounds")
        df = {r.term: r.n for r in bounds.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if not df:
            return None
        average = head["tokens"] / head["documents"]
        worth = F.create_map(*[x for t, n in df.items() for x in (F.lit(t), idf(F.lit(float(head["documents"])), F.lit(n)))])

        def part():
            tf = F.col("tf") * F.lit(float(weight))
            return F.element_at(worth, F.col("term")) * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * F.col("total") / F.lit(average)))

        def scored(rows):
            return rows.groupBy("key").agg((-F.sum(part())).alias("score")).select("key", F.round("score", 6).alias("score"))

        most = stage(bounds.groupBy("seg", "block").agg(F.sum(part()).alias("bound"), F.max("n").alias("n")), "most")
        first = most.orderBy(F.desc("bound"), "seg", "block").limit(max(k, 8)).collect()
        best = scored(postings.where(_inside(first))).orderBy("score", "key").limit(k).collect()
        # Scores are negative; one that rounds to the k-th still counts.
        edge = -best[-1].score - 2e-6 if len(best) == k else 0.0
        chosen = most.where(F.col("bound") >= edge).select("seg", "block")
        several = chosen.count()
        if several <= 1000:
            rows = postings.where(_inside(chosen.collect()))
        else:
            rows = postings.join(chosen, ["seg", "block"], "left_semi")
        return scored(rows).orderBy("score", "key").limit(k), several, most.count()

    def match(self, query: str) -> DataFrame:
        """Keys of rows that fit a query: words, "phrases", prefix*, column:word, NEAR(a b, n), AND, OR, NOT, brackets; words side by side are all wanted."""
        tree = Parser(query, self.columns, self.porter).parse()
        leaves: list[tuple] = []

        def number(node):
            if node[0] in ("and", "or", "not"):
                return (node[0], number(node[1]), number(node[2]))
            leaves.append(node)
            return ("leaf", len(leaves) - 1)

        tree = number(tree)
        wanted = sorted({t for leaf in leaves if leaf[0] != "prefix" for t in leaf[2]})
        prefixes = sorted({leaf[2][0] for leaf in leaves if leaf[0] == "prefix"})
        head = self.head()
        rows = self.postings(wanted, head=head)
        for p in prefixes:
            rows = rows.unionByName(self.postings(prefix=p, head=head))
        # One pass over the postings of all leaves; each leaf is a test on a row's (term, col, positions).
        held = rows.select("key", F.struct("term", "col", "positions").alias("p")).groupBy("key").agg(F.collect_set("p").alias("ps"))
        tests = [self._test(leaf) for leaf in leaves]

        def build(node) -> Column:
            if node[0] == "leaf":
                return tests[node[1]]
            a, b = build(node[1]), build(node[2])
            return a & b if node[0] == "and" else a | b if node[0] == "or" else a & ~b

        return held.where(build(tree)).select("key")

    def _test(self, leaf: tuple) -> Column:
        kind, column, words, distance = leaf
        inside = (lambda p: p["col"] == self.columns.index(column)) if column else (lambda p: F.lit(True))
        if kind == "prefix":
            return F.exists("ps", lambda p: F.startswith(p["term"], F.lit(words[0])) & inside(p))
        if len(words) == 1:
            return F.exists("ps", lambda p: (p["term"] == words[0]) & inside(p))

        def positions(word, c):
            return F.flatten(F.transform(F.filter("ps", lambda p: (p["term"] == word) & (p["col"] == c)), lambda p: p["positions"]))

        def in_column(c) -> Column:
            if kind == "phrase":
                return F.exists(positions(words[0], c), lambda at: F.lit(True) & _all([F.array_contains(positions(w, c), at + i) for i, w in enumerate(words) if i]))
            # NEAR: from the first to the last word at most `distance` tokens that are not theirs.
            width = distance + len(words) - 1
            starts = F.flatten(F.array(*[positions(w, c) for w in words]))
            return F.exists(starts, lambda at: _all([F.exists(positions(w, c), lambda x: (x >= at) & (x <= at + width)) for w in words]))

        out = F.lit(False)
        for c in [self.columns.index(column)] if column else range(len(self.columns)):
            out = out | in_column(c)
        return out


def _inside(blocks: list) -> Column:
    """Whether a posting lies in one of some (seg, block) rows."""
    by_seg: dict[int, list[int]] = defaultdict(list)
    for r in blocks:
        by_seg[r.seg].append(r.block)
    out = F.lit(False)
    for seg, held in by_seg.items():
        out = out | ((F.col("seg") == seg) & F.col("block").isin(held))
    return out


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


class Parser:
    """A query as nested ("and" | "or" | "not", left, right) over (kind, column, words, distance) leaves."""

    TOKEN = re.compile(r'\s*(?:(NEAR)\s*\(|([()])|"([^"]*)"|(\w+)\s*:\s*|([^\s()":]+))', re.S)

    def __init__(self, query: str, columns: tuple[str, ...], porter: bool):
        self.columns, self.porter, self.tokens = columns, porter, []
        at = 0
        while at < len(query.rstrip()):
            m = self.TOKEN.match(query, at)
            if not m:
                raise ValueError(f"cannot read the query at {query[at:]!r}")
            near, bracket, phrase, column, word = m.groups()
            at = m.end()
            if near:
                end = query.index(")", at)
                words, _, n = query[at:end].partition(",")
                self.tokens.append(("near", terms_of(words, porter), int(n or 10)))
                at = end + 1
            elif bracket:
                self.tokens.append((bracket, None, 0))
            elif phrase is not None:
                self.tokens.append(("phrase", terms_of(phrase, porter), 0))
            elif column:
                if column not in columns:
                    raise ValueError(f"no column {column}")
                self.tokens.append(("column", column, 0))
            elif word in ("AND", "OR", "NOT"):
                self.tokens.append((word, None, 0))
            elif word.endswith("*"):
                self.tokens.append(("prefix", terms_of(word[:-1]), 0))
            else:
                self.tokens += [("word", [t], 0) for t in terms_of(word, porter)]

    def parse(self):
        out = self._or()
        if self.tokens:
            raise ValueError(f"unexpected {self.tokens[0][0]}")
        return out

    def _peek(self) -> str:
        return self.tokens[0][0] if self.tokens else ""

    def _or(self):
        left = self._and()
        while self._peek() == "OR":
            self.tokens.pop(0)
            left = ("or", left, self._and())
        return left

    def _and(self):
        left = self._not()
        while self._peek() not in ("", "OR", ")", "NOT"):
            if self._peek() == "AND":
                self.tokens.pop(0)
            left = ("and", left, self._not())
        return left

    def _not(self):
        left = self._one()
        while self._peek() == "NOT":
            self.tokens.pop(0)
            left = ("not", left, self._one())
        return left

    def _one(self):
        column = None
        if self._peek() == "column":
            column = self.tokens.pop(0)[1]
        if not self.tokens:
            raise ValueError("the query ends early")
        kind, words, distance = self.tokens.pop(0)
        if kind == "(":
            out = self._or()
            if self._peek() != ")":
                raise ValueError("a bracket is open")
            self.tokens.pop(0)
            return out
        if kind not in ("word", "phrase", "prefix", "near") or not words:
            raise ValueError(f"unexpected {kind}")
        return ("phrase" if kind == "word" else kind, column, words, distance)


# -- indexes of an application -----------------------------------------------------------------

_BUILT: dict[tuple, StoredIndex] = {}


def stored(docs: DataFrame, key: str, columns: tuple[str, ...], porter: bool = False) -> StoredIndex:
    """The index of these rows; rows of the same plan over the same files, by name, length and time, share one for the life of the application."""
    plan = docs._jdf.queryExecution().analyzed()
    name = (docs.sparkSession.sparkContext.applicationId, plan.semanticHash(), stamps(docs.sparkSession, docs.inputFiles()), key, columns, porter)
    if name not in _BUILT:
        index = StoredIndex(docs.sparkSession, scratch(docs.sparkSession, "index"), key, columns, porter)
        index.add(docs)
        _BUILT[name] = index
    return _BUILT[name]


def fresh(docs: DataFrame, key: str, columns: tuple[str, ...], porter: bool = False) -> StoredIndex:
    """An empty index of its own, for queries that change it."""
    return StoredIndex(docs.sparkSession, scratch(docs.sparkSession, "index"), key, columns, porter)
