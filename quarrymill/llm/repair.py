"""Repair of conversation structure by a scan of min-plus matrices.

A conversation should read `(s?(ua)+)?` by its role initials. That pattern has four states (START, after a system turn, after a
user turn, after an answer); START and ANSWERED may end it. A turn is a 4x4 matrix over (cost, audit): entry (i, j) is the cheapest
way to go from state i to state j over this turn, any inserted turns before it included (the closure of the insert matrix times the
turn's own edits), and among equal costs the ASCII-least string of edit initials. Addition takes the lesser element, multiplication
adds costs and joins audits. The product is associative, so a conversation is the product of its turns in any grouping: turns of a
piece are multiplied as a balanced tree, pieces make segments, and segments of one conversation that lie in several partitions are
multiplied by a tree of groups of FAN neighbours, level by level.

(Taking the lesser audit early is right: two audits of one matrix entry cover the same turns; were one a prefix of the other, the
rest would be insertions, and the costs would differ.)

Work by step:
1. equal rows of a conversation (turn, role and text) become one row with a count, by partial aggregation; the first turn of every
   (conversation, role, text) is found likewise, and marks duplicates by a join on all four, a key that no group of copies makes hot,
2. rows are dealt by ranges of (conversation, turn, role, text), so a conversation with a third of all rows spreads over many tasks,
3. tasks stream their rows in order. Conversations that lie inside a task and fit into a piece are finished at once; of others, the
   segment's matrix and counts are returned, and its rows, packed into pieces of PIECE_BYTES,
4. segments are multiplied level by level; the cheapest audit is cut into the pieces' shares,
5. pieces write their repaired turns; SHA-256 has no parallel form, so the pieces of one conversation are hashed in order in one task,
   a packed piece at a time.

A conversation's audit is one value of the result, so it must fit a row.

Defined cases: null conversations are one conversation, returned as null; null turns come first; null roles and texts are one space
(for the damage, null ids and turns are too); rows of one turn are ordered by role, then text; a role that starts with none of s, u, a
cannot be kept as it is; conversations that lost all rows have zeros, an empty audit and the hash of the empty string; gaps wrap as
64-bit numbers; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Staging, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, ASKED, ANSWERED = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
PIECE_BYTES = 1 << 20
#: Segments multiplied by one task of a level.
FAN = 16
BLANKS = " \t\n\x0b\f\r"

Element = tuple[int, str]
Matrix = tuple[Element | None, ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; None is an entry that cannot be reached."""
    out: list[Element | None] = [None] * 16
    for i in range(4):
        for k in range(4):
            left = a[4 * i + k]
            if left is None:
                continue
            for j in range(4):
                right = b[4 * k + j]
                if right is None:
                    continue
                held, cost = out[4 * i + j], left[0] + right[0]
                if held is None or cost < held[0] or (cost == held[0] and left[1] + right[1] < held[1]):
                    out[4 * i + j] = (cost, left[1] + right[1])
    return tuple(out)


def _matrix(edges) -> Matrix:
    out: list[Element | None] = [None] * 16
    for i, j, cost, letter in edges:
        held = out[4 * i + j]
        out[4 * i + j] = (cost, letter) if held is None else min(held, (cost, letter))
    return tuple(out)


IDENTITY = _matrix((i, i, 0, "") for i in range(4))
#: At most three insertions lead from any state to any other that they reach.
_inserted = _matrix([(i, i, 0, "") for i in range(4)] + [(i, j, INSERT, "I") for (i, x), j in NEXT.items() if x in NAMES])
CLOSURE = product(product(_inserted, _inserted), _inserted)
#: Kinds of turn: 0 must go; 1 + 2 * (index of its initial in 'sua', 3 for others) + truncated.
INITIALS = "sua"


def _turn(kind: int) -> Matrix:
    edges = [(i, i, DELETE, "D") for i in range(4)]
    if kind:
        which, extra = divmod(kind - 1, 2)
        for (i, x), j in NEXT.items():
            if INITIALS[which : which + 1] == x:
                edges.append((i, j, KEEP + extra * TRUNCATED, "K"))
            if x in NAMES:
                edges.append((i, j, REROLE + extra * TRUNCATED, "R"))
    return product(CLOSURE, _matrix(edges))


TURNS = [_turn(kind) for kind in range(9)]


@lru_cache(maxsize=10_000)
def _few(kinds: bytes) -> Matrix:
    if len(kinds) == 1:
        return TURNS[kinds[0]]
    return product(_few(kinds[: len(kinds) // 2]), _few(kinds[len(kinds) // 2 :]))


def scan(kinds: bytes) -> Matrix:
    """Product of the turns' matrices as a balanced tree."""
    level = [_few(bytes(kinds[i : i + 4])) for i in range(0, len(kinds), 4)]
    while len(level) > 1:
        level = [product(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else IDENTITY


def cheapest(whole: Matrix) -> Element:
    """The best way through a conversation, insertions at its end included."""
    ended = product(whole, CLOSURE)
    return min(ended[j] for j in (START, ANSWERED) if ended[j] is not None)


class Segment:
    """Counts of a run of consecutive turns; `+` joins neighbours."""

    FIELDS = ("rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "distinct")

    def __init__(self, rows=0, blank=0, duplicate=0, truncated=0, illegal=0, first=None, last=None, low=None, high=None, distinct=0):
        self.rows, self.blank, self.duplicate, self.truncated, self.illegal = rows, blank, duplicate, truncated, illegal
        self.first, self.last, self.low, self.high, self.distinct = first, last, low, high, distinct

    def values(self) -> list:
        return [getattr(self, f) for f in self.FIELDS]

    def __add__(self, other: Segment) -> Segment:
        if not self.rows or not other.rows:
            return self if self.rows else other
        met = int(self.last + other.first not in LEGAL)
        shared = int(self.high is not None and self.high == other.low)
        return Segment(
            self.rows + other.rows, self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
            self.illegal + other.illegal + met, self.first, other.last, self.low if self.low is not None else other.low,
            other.high if other.high is not None else self.high, self.distinct + other.distinct - shared,
        )

    @property
    def gaps(self) -> int:
        wide = self.high - self.low + 1 - self.distinct if self.low is not None else 0
        return (wide + (1 << 63)) % (1 << 64) - (1 << 63)


def turn_run(turn, role: str, copies: int, first: bool, blank: bool, truncated: bool) -> tuple[Segment, bytes]:
    """Counts and kinds of `copies` equal turns that follow each other; `first`: none of them came in an earlier turn."""
    initial = role[:1]
    later = copies - 1 if first else copies
    cut = int(truncated and first and not blank)
    fault = (copies, 0) if blank else (0, later)
    one = Segment(copies, *fault, cut, copies - 1, initial, initial, turn, turn, int(turn is not None))
    place = INITIALS.find(initial) if initial else -1
    kind = 0 if blank or not first else 1 + 2 * (place if place >= 0 else 3) + cut
    return one, bytes([kind]) + bytes(copies - 1)


def repaired(audit: str, runs, system: bool, written: int) -> tuple[bytes, int]:
    """The `role:text` lines that an audit makes of its turns, each after a newline but for the first of the conversation.

    runs: (role, text, copies); system: the repaired conversation starts with a system turn; written: turns before these.
    """
    out, turns = [], ((role, text) for role, text, copies in runs for _ in range(copies))
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = NAMES["ua"[(written - system) % 2]]
        out.append(f"{role}:{text}" if not written else f"\n{role}:{text}")
        written += 1
    return "".join(out).encode(), written


def starts_with_system(audit: str) -> bool:
    """Pairs make an even number of turns, so an odd number has a system turn before them."""
    return (len(audit) - audit.count("D")) % 2 == 1


def shares(audit: str, counts) -> list[str]:
    """The audit cut into consecutive parts that hold so many turns each; insertions belong to the turn after them, the last to the end."""
    out, at = [], 0
    for n in counts:
        begin = at
        while n:
            n -= audit[at] != "I"
            at += 1
        out.append(audit[begin:at])
    if out:
        out[-1] += audit[at:]
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """(ck, has_turn, turn, role, text, copies): the contract's damage by crc32 of `conv_id:turn`. Dropped rows have no copies and no turn."""
    fate = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate")).select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
    return keyed(out)


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with keys that are never null; a row without copies only says that its conversation exists."""
    there = F.col("copies") > 0
    return rows.select(
        F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("")).alias("ck"), F.when(~there, -1).otherwise(F.col("turn").isNotNull().cast("int")).alias("has_turn"),
        F.when(there, F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long"))).otherwise(0).alias("turn"), F.when(there, F.col("role")).otherwise("").alias("role"),
        F.when(there, F.col("text")).otherwise("").alias("text"), "copies",
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Steps 1 and 2: distinct rows with their counts and faults, dealt and sorted by conversation and turn."""
    rows = rows.withColumn("print", F.sha2(F.col("text").cast("binary"), 256))
    keys = ["ck", "has_turn", "turn", "role", "print"]
    single = rows.groupBy(*keys).agg(F.max("text").alias("text"), F.sum("copies").alias("copies"))
    firsts = rows.where("copies > 0").groupBy("ck", "role", "print").agg(F.min(F.struct("has_turn", "turn")).alias("at"))
    firsts = firsts.select("ck", "at.has_turn", "at.turn", "role", "print", F.lit(True).alias("first"))
    rest = F.rtrim("text", F.lit(BLANKS))
    out = single.join(firsts, keys, "left").select(
        "ck", "has_turn", "turn", "role", "text", "copies", F.coalesce("first", F.lit(False)).alias("first"), (rest == "").alias("blank"),
        (~F.right(rest, F.lit(1)).isin(".", "!", "?")).alias("truncated"), F.left("text", F.lit(64)).alias("head"),
    )
    order = ["ck", "has_turn", "turn", "role"]
    # The range's samples carry the head of a text only; the order inside is by the whole text.
    return out.repartitionByRange(*order, "head").sortWithinPartitions(*order, "text").withColumn("seg", F.spark_partition_id()).drop("head")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SEGMENT = "rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, distinct long, costs array<long>, audits array<string>, pieces array<struct<seg:int,piece:int,rows:long>>"
PIECE = "runs array<struct<role:string,text:string,copies:long>>"


def _struct(fields: str) -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in fields.split(", "))


STREAMED = f"ck string, seg int, piece int, result struct<{_struct(RESULT)}>, segment struct<{_struct(SEGMENT)}>, body struct<{_struct(PIECE)}>"


def _answer(stats: Segment, cost: int, audit: str, digest: str | None) -> dict:
    return {"gaps": stats.gaps, "blank": stats.blank, "duplicate": stats.duplicate, "truncated": stats.truncated, "illegal": stats.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _summary(stats: Segment, matrix: Matrix, pieces: list[dict]) -> dict:
    out = dict(zip(Segment.FIELDS, stats.values()))
    return out | {"costs": [e and e[0] for e in matrix], "audits": [e and e[1] for e in matrix], "pieces": pieces}


class Run:
    """One conversation's rows in one task: small enough, it is solved when it ends, else its pieces leave as they fill."""

    def __init__(self, ck: str, seg: int, is_open: bool, limit: int):
        self.ck, self.seg, self.open, self.limit = ck, seg, is_open, limit
        self.stats, self.matrix, self.kinds, self.runs, self.size, self.pieces = Segment(), IDENTITY, bytearray(), [], 0, []

    def add(self, row: dict) -> list[dict]:
        if not row["copies"]:
            return []
        turn = row["turn"] if row["has_turn"] == 1 else None
        one, kinds = turn_run(turn, row["role"], row["copies"], row["first"], row["blank"], row["truncated"])
        self.stats += one
        self.kinds += kinds
        self.runs.append({"role": row["role"], "text": row["text"], "copies": row["copies"]})
        self.size += len(row["text"]) + len(row["role"]) + len(kinds) + 32
        if self.size < self.limit:
            return []
        self.open = True
        return [self._piece()]

    def _piece(self) -> dict:
        out = {"ck": self.ck, "seg": self.seg, "piece": len(self.pieces), "body": {"runs": self.runs}}
        self.pieces.append({"seg": self.seg, "piece": len(self.pieces), "rows": len(self.kinds)})
        self.matrix = product(self.matrix, scan(self.kinds)) if len(self.pieces) > 1 else scan(self.kinds)
        self.kinds, self.runs, self.size = bytearray(), [], 0
        return out

    def end(self) -> list[dict]:
        if self.open:
            out = [self._piece()] if self.runs else []
            return [*out, {"ck": self.ck, "seg": self.seg, "piece": -1, "segment": _summary(self.stats, self.matrix, self.pieces)}]
        cost, audit = cheapest(scan(self.kinds))
        data, _ = repaired(audit, ((r["role"], r["text"], r["copies"]) for r in self.runs), starts_with_system(audit), 0)
        return [{"ck": self.ck, "seg": self.seg, "piece": -1, "result": _answer(self.stats, cost, audit, hashlib.sha256(data).hexdigest())}]


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _stream(ordered: DataFrame, limit: int) -> DataFrame:
    schema = _arrow(STREAMED)

    def run(batches):
        held, out, size = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or held.ck != row["ck"]:
                    begins = held is None  # may have begun in the task before
                    if held is not None:
                        out += held.end()
                    held = Run(row["ck"], row["seg"], begins, limit)
                out += held.add(row)
                size += len(row["text"]) + 200
                if size > limit and out:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if held is not None:
            held.open = True  # may go on in the next task
            out += held.end()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return ordered.mapInArrow(run, STREAMED)


def _joined(segments: DataFrame, last: int) -> DataFrame:
    """One row (ck, segment) for each conversation: neighbours are multiplied in groups of FAN until one is left."""
    schema = f"ck string, at int, segment struct<{_struct(SEGMENT)}>"
    fields = _arrow(schema)

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        stats, matrix, pieces = Segment(), IDENTITY, []
        for r in rows:
            s = r["segment"]
            stats += Segment(*(s[f] for f in Segment.FIELDS))
            matrix = product(matrix, tuple(None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"])))
            pieces += s["pieces"]
        return pa.Table.from_pylist([{"ck": rows[0]["ck"], "at": rows[0]["at"], "segment": _summary(stats, matrix, pieces)}], fields)

    current = segments.select("ck", F.col("seg").alias("at"), "segment")
    while True:
        last //= FAN
        grouped = current.select("ck", F.floor(F.col("at") / FAN).cast("int").alias("at"), F.col("at").alias("pos"), "segment")
        current = grouped.groupBy("ck", "at").applyInArrow(merge, schema)
        if not last:
            return current.select("ck", "segment")


SHARE = "seg int, piece int, share string, system boolean, written long"


def _solved(joined: DataFrame) -> DataFrame:
    """(ck, result without hash, shares of the audit by piece)."""
    schema = f"ck string, result struct<{_struct(RESULT)}>, shares array<struct<{_struct(SHARE)}>>"
    fields = _arrow(schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = row["segment"]
                cost, audit = cheapest(tuple(None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"])))
                system, written, cut = starts_with_system(audit), 0, []
                for p, share in zip(s["pieces"], shares(audit, [p["rows"] for p in s["pieces"]])):
                    cut.append({"seg": p["seg"], "piece": p["piece"], "share": share, "system": system, "written": written})
                    written += len(share) - share.count("D")
                answer = _answer(Segment(*(s[f] for f in Segment.FIELDS)), cost, audit, None)
                yield pa.RecordBatch.from_pylist([{"ck": row["ck"], "result": answer, "shares": cut}], fields)

    return joined.mapInArrow(run, schema)


def _hashed(pieces: DataFrame, solved: DataFrame) -> DataFrame:
    """(ck, sha) of the repaired conversations: pieces are written where they lie, then hashed in order."""

    def write(batches):
        for batch in batches:
            rows = batch.to_pylist()
            lines = [repaired(r["share"], ((x["role"], x["text"], x["copies"]) for x in r["runs"]), r["system"], r["written"])[0] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lines, pa.binary())], ["ck", "seg", "piece", "data"])

    def digest(batches):
        held, state = None, None
        for batch in batches:
            done = []
            for ck, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if ck != held:
                    if held is not None:
                        done.append({"ck": held, "sha": state.hexdigest()})
                    held, state = ck, hashlib.sha256()
                state.update(data)
            if done:
                yield pa.RecordBatch.from_pylist(done)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"ck": held, "sha": state.hexdigest()}])

    share = solved.select("ck", F.explode("shares").alias("s")).select("ck", "s.*")
    bodies = pieces.select("ck", "seg", "piece", "body.runs").join(share, ["ck", "seg", "piece"]).select("ck", "seg", "piece", "runs", "share", "system", "written")
    lines = bodies.mapInArrow(write, "ck string, seg int, piece int, data binary")
    return lines.repartition("ck").sortWithinPartitions("ck", "seg", "piece").mapInArrow(digest, "ck string, sha string")


def repair(rows: DataFrame, staging: Staging, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row for each conversation of `rows` (conv_id, turn, role, text, copies as `keyed` gives them): counts of faults, cost,
    audit and hash of the repaired conversation; `ck` names it."""
    small_batches(rows.sparkSession)
    streamed = staging.write(_stream(_ordered(rows), piece_bytes))
    segments = streamed.where("segment IS NOT NULL")
    last = segments.agg(F.max("seg")).first()[0]
    done = streamed.where("result IS NOT NULL").select("ck", "result.*")
    if last is None:
        return done
    solved = staging.write(_solved(_joined(segments, last)))
    hashes = _hashed(streamed.where("body IS NOT NULL"), solved)
    found = solved.select("ck", "result.*").join(hashes, "ck", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return done.union(found.withColumn("repaired_sha256", F.coalesce("sha", F.lit(nothing))).drop("sha"))


def damage_and_repair(conversations: DataFrame, staging: Staging, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    kind = conversations.schema["conv_id"].dataType
    out = repair(damaged(conversations.select("conv_id", "turn", "role", "text")), staging, piece_bytes)
    conv = F.when(F.col("ck") != "", F.substring("ck", 2, 1 << 30).cast(kind)).alias("conv_id")
    return out.select(conv, *[f.split()[0] for f in RESULT.split(", ")])


ORACLE = """
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda c, x:
        list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT) % 20 AS f
      FROM (SELECT DISTINCT k FROM b)),
d AS (SELECT coalesce(':' || conv_id::VARCHAR, '') AS ck, conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, f FROM b JOIN h USING (k)),
n AS (SELECT ck, turn, role, text, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role, text) AS i,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
      FROM d, range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS c(c)),
o AS (SELECT *, row_number() OVER (PARTITION BY ck, role, text ORDER BY i) > 1 AS again FROM n),
p AS (SELECT *, left(role, 1) AS x, t = '' AS blank, t <> '' AND again AS dup, t <> '' AND NOT again AND right(t, 1) NOT IN ('.', '!', '?') AS cut,
        lag(left(role, 1)) OVER (PARTITION BY ck ORDER BY i) AS y FROM o),
nx(i, x, j) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
c(i, j, n) AS (SELECT i, i, 0 FROM range(4) AS r(i) UNION ALL SELECT c.i, nx.j, n + 1 FROM c JOIN nx ON nx.i = c.j AND nx.x <> 's' WHERE n < 3),
kinds AS (SELECT DISTINCT x, blank OR dup AS gone, cut FROM p),
e AS (SELECT x, gone, cut, i, i AS j, 4 AS cost, 'D' AS l FROM kinds, range(4) AS r(i)
      UNION ALL SELECT k.x, gone, cut, i, j, 3 * cut::INT, 'K' FROM kinds k JOIN nx ON nx.x = k.x WHERE NOT gone
      UNION ALL SELECT k.x, gone, cut, i, j, 3 + 3 * cut::INT, 'R' FROM kinds k, nx WHERE NOT gone AND nx.x <> 's'),
m AS (SELECT e.x, gone, cut, c.i, e.j, cost + 3 * n AS cost, repeat('I', n) || l AS l FROM e JOIN c ON c.j = e.i),
dp(ck, i, st, cost, audit) AS (SELECT DISTINCT ck, 0::BIGINT, 0, 0, '' FROM d
  UNION ALL SELECT ck, i, st, left(s, 9)::INT, substr(s, 10) FROM (
    SELECT dp.ck, p.i, m.j AS st, min(lpad((dp.cost + m.cost)::VARCHAR, 9, '0') || audit || l) AS s
    FROM dp JOIN p ON p.ck = dp.ck AND p.i = dp.i + 1 JOIN m ON m.x = p.x AND m.gone = (p.blank OR p.dup) AND m.cut = p.cut AND m.i = dp.st GROUP BY 1, 2, 3)),
z AS (SELECT d.ck, coalesce(max(p.i), 0) AS n FROM (SELECT DISTINCT ck FROM d) d LEFT JOIN p ON p.ck = d.ck GROUP BY d.ck),
best AS (SELECT z.ck, min(lpad((cost + 3 * c.n)::VARCHAR, 9, '0') || audit || repeat('I', c.n)) AS s
      FROM z JOIN dp ON dp.ck = z.ck AND dp.i = z.n JOIN c ON c.i = dp.st AND c.j IN (0, 3) GROUP BY z.ck),
a AS (SELECT ck, left(s, 9)::BIGINT AS cost, substr(s, 10) AS audit FROM best),
q AS (SELECT ck, audit[k] AS l, k, len(translate(audit[1:k], 'I', '')) AS i, len(translate(audit[1:k], 'D', '')) AS o, len(translate(audit, 'D', '')) % 2 AS sys FROM a, range(1, len(audit) + 1) AS r(k)),
r AS (SELECT q.ck, sha256(string_agg((CASE WHEN l = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha
      FROM q LEFT JOIN p ON p.ck = q.ck AND p.i = q.i WHERE l <> 'D' GROUP BY q.ck),
g AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(dup::INT) AS duplicate, sum(cut::INT) AS truncated,
        sum(CASE WHEN i > 1 AND y || x NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal FROM p GROUP BY ck)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT ck, conv_id FROM d) v JOIN a USING (ck) LEFT JOIN g USING (ck) LEFT JOIN r USING (ck)"""
