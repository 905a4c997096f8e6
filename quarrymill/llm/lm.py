"""Word language model: a hierarchical Pitman-Yor process, sampled as Chinese restaurants.

Every token of the training rows is a customer of the restaurant of the word before it, one for each
such word by its whole 64-bit hash; all these restaurants share one parent, whose own base is uniform
over the vocabulary. A Gibbs sweep takes all
customers of a dish out of a restaurant and seats them again, all at once, by the distribution of their number of
tables given the other dishes' tables: as many as EXACT customers by the summed weights of all seatings, more by
Metropolis steps on the saddle-point formula of these weights, whose cost does not depend on the count. Dishes of
one block move together, and the parent moves between rounds. Predictive probabilities are averaged over the
SAMPLES sweeps that follow the burn-in.

Work by step:
1. words are counted, by ranges of their hash; a few sums meet on the driver, and the contexts with more
   than a block's share of the tokens, at most HOT of them,
2. pairs (context, word) are counted in chunks and dealt out by context, so whole restaurants stand in one
   block; a hot context is dealt into sub-blocks by its words, which exchange their totals by the driver,
3. blocks seat their customers; their tables of each word are summed by ranges of words, where the parent's
   customers are seated, and the sums go back to the blocks, in packed arrays: one exchange a round,
4. all rows' pairs are dealt out alike and scored where the restaurant stands; a word that its block does
   not know goes on to the range that counts it. Blocks with very frequent pairs are copied for scoring
   and chunks shared out among the copies. Sums by document meet chunk by chunk.

Defined cases: a null text is an empty text, with the end token alone; a row with a null id
counts as held out; tokens not seen in training get the parent's share for unseen words; without training
rows all tokens are unseen; repeated rows count and are scored each; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .langid import held_out
from .staging import Staging, small_batches

CONTEXT_STRENGTH, ROOT_STRENGTH = 5.0, 10.0
#: Sweeps of the first round, and of the last one before and while it is averaged.
FIRST_SWEEPS, BURN_IN, SAMPLES, SEED = 2, 1, 3, 1
#: Customers of a dish up to which its tables' distribution is summed up; steps of the sampler beyond.
EXACT, STEPS = 64, 6
CHUNK_TOKENS, CHUNK_DOCS = 600_000, 65_000
#: Bytes of stored input for each block of pairs; contexts that may be split; document sums that a scoring task holds.
BLOCK_BYTES, HOT, HELD_SUMS = 4 << 20, 1 << 16, 1 << 19
#: Rounds over the rows in scoring; each moves its share of the pairs.
WAVES = 4
END_WORD, FIRST_WORD = np.uint64(0xD1B54A32D192ED03), np.uint64(0xABC98388FB8FAC03)


# -- packing -----------------------------------------------------------------------------------


def planes(values: np.ndarray) -> bytes:
    """Bytes of the values, all first bytes together, then all second ones: high planes compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def pack_pairs(vocabulary: np.ndarray, c: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Pairs of places in a sorted vocabulary, sorted: contexts, words a context, distinct words, each pair's word."""
    first = changes(c)
    distinct, places = np.unique(w, return_inverse=True)
    return pack_keys(vocabulary[c[first]]), planes(spans(first, len(c)).astype(np.uint32)), pack_keys(vocabulary[distinct]), planes(places.astype(np.uint32))


def unpack_pairs(contexts: bytes, per: bytes, words: bytes, places: bytes):
    return unpack_keys(contexts), unplanes(per, np.uint32).astype(np.int64), unpack_keys(words), unplanes(places, np.uint32).astype(np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def spans(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.concatenate([first, [n]]))


def find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted value."""
    if not len(sorted_values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return i, sorted_values[i] == wanted


def binary_rows(names: list[str], *columns) -> pa.RecordBatch:
    """Columns of ints as bigint, of bytes as binary, and arrays as they are."""
    made = [c if isinstance(c, pa.Array) else pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(made, names)


def schema_of(ints: str, binaries: str = "") -> str:
    return ", ".join([*(f"{n} bigint" for n in ints.split()), *(f"{n} binary" for n in binaries.split())])


def blocks_of(frame: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks in proportion to the stored size of the input."""
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(size // block_bytes, 8), 1 << 24))


def part_of(keys: np.ndarray, n) -> np.ndarray:
    """Of n equal ranges of hashes, the one of each key; in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.asarray(n, np.uint64) >> np.uint64(32)).astype(np.int64)


def by_part(keys: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """(range, slice) of sorted keys."""
    part = part_of(keys, n)
    first = changes(part)
    return [(int(part[a]), slice(a, b)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)])]


class Deal:
    """Where a pair stands: the range of its context, or for a hot context a sub-block by its word."""

    def __init__(self, blocks: int, hot: list[tuple[int, int]], tokens: int):
        """hot: (context, tokens after it)."""
        hot = sorted(hot)
        self.blocks = blocks
        self.hot = np.array([h for h, _ in hot], np.uint64)
        self.customers = np.array([n for _, n in hot], np.int64)
        self.parts = np.array([-(-n * blocks // max(tokens, 1)) for _, n in hot], np.int64)
        self.base = blocks + np.cumsum(self.parts) - self.parts

    def of(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        block = part_of(contexts, self.blocks)
        place, hit = find(self.hot, contexts)
        at = np.flatnonzero(hit)
        if len(at):
            block[at] = self.base[place[at]] + part_of(words[at], self.parts[place[at]])
        return block

    def owner(self, block: int) -> int:
        """The hot context of a sub-block."""
        return int(np.searchsorted(self.base, block, "right")) - 1


# -- tokens ------------------------------------------------------------------------------------


def token_keys(column: pa.Array):
    """(first row, words, token offsets per row), the end of each row included."""
    for first, _, data, offs in textops.rounds(column):
        starts, ends, woffs = textops.word_spans(data, offs)
        words = textops.word_hashes(data, starts, ends)
        n = len(offs) - 1
        toffs = woffs + np.arange(n + 1)
        tokens = np.empty(len(words) + n, np.uint64)
        tokens[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(woffs))] = words
        tokens[toffs[1:] - 1] = END_WORD
        yield first, tokens, toffs


def indexed(tokens: np.ndarray, starts: np.ndarray):
    """(sorted vocabulary, context places, word places) of tokens whose rows begin at `starts`."""
    vocabulary, places = np.unique(np.concatenate([tokens, [FIRST_WORD]]), return_inverse=True)
    before = np.empty(len(tokens), np.int64)
    before[1:] = places[: len(tokens) - 1]
    before[starts] = places[-1]
    return vocabulary, before, places[:-1].astype(np.int64, copy=False)


def chunks(batches, column: int):
    """(tokens, row starts) of about CHUNK_TOKENS tokens each."""
    held, begun, size = [], [], 0
    for batch in batches:
        for _, tokens, toffs in token_keys(batch.column(column)):
            held.append(tokens)
            begun.append(toffs[:-1] + size)
            size += len(tokens)
            if size >= CHUNK_TOKENS:
                yield np.concatenate(held), np.concatenate(begun)
                held, begun, size = [], [], 0
    if size:
        yield np.concatenate(held), np.concatenate(begun)


def grouped(batches, columns: int = 1):
    """(values, rows as a list of slices) for runs of equal values in the first, sorted columns."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in range(columns)])
        edges = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            now = tuple(values[:, a].tolist())
            if now != last:
                if held:
                    yield last, held
                last, held = now, []
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


def records(parts: list[pa.RecordBatch]):
    """Each row of the slices as a dict, one at a time."""
    for part in parts:
        for i in range(part.num_rows):
            yield {n: part.column(k)[i].as_py() for k, n in enumerate(part.schema.names)}


# -- counting ----------------------------------------------------------------------------------

WORD_ROWS = schema_of("part", "words counts")


def _word_rows(blocks: int):
    def run(batches):
        for tokens, _ in chunks(batches, 0):
            words, counts = np.unique(tokens, return_counts=True)
            found = by_part(words, blocks)
            yield binary_rows(["part", "words", "counts"], [p for p, _ in found], [pack_keys(words[s]) for _, s in found], [planes(counts[s].astype(np.int64)) for _, s in found])

    return run


def _merge_words(batches):
    for (part,), parts in grouped(batches):
        keys, counts = zip(*((unpack_keys(r["words"]), unplanes(r["counts"], np.int64)) for r in records(parts)))
        words, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        yield binary_rows(["part", "words", "counts"], [part], [pack_keys(words)], [planes(total)])


def _word_sums(batches):
    """Tokens and words of a task."""
    total = np.zeros(2, np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            counts = unplanes(raw, np.int64)
            total += [counts.sum(), len(counts)]
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["sums"])


def _frequent(least: int):
    """(word, count) of words with at least so many tokens."""

    def run(batches):
        for batch in batches:
            for raw_words, raw_counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = unplanes(raw_counts, np.int64)
                some = np.flatnonzero(counts >= least)
                yield pa.RecordBatch.from_arrays([pa.array(unpack_keys(raw_words)[some].view(np.int64)), pa.array(counts[some])], ["word", "n"])

    return run


PAIRS = ["contexts", "per", "words", "places"]
STATE = schema_of("block", "contexts per words places counts")


def _pair_rows(deal: Deal):
    def run(batches):
        for tokens, starts in chunks(batches, 0):
            yield flush(tokens, starts)

    def flush(tokens, starts):
        vocabulary, c, w = indexed(tokens, starts)
        key = np.sort(c << 32 | w)
        first = changes(key)
        counts, key = spans(first, len(key)), key[first]
        c, w = key >> 32, key & 0xFFFFFFFF
        block = deal.of(vocabulary[c], vocabulary[w])
        order = np.argsort(block, kind="stable")
        block, c, w, counts = block[order], c[order], w[order], counts[order]
        edges = changes(block).tolist()
        rows = [(int(block[a]), *pack_pairs(vocabulary, c[a:b], w[a:b]), planes(counts[a:b].astype(np.int64))) for a, b in zip(edges, [*edges[1:], len(block)])]
        return binary_rows(["block", *PAIRS, "counts"], *zip(*rows))

    return run


def joined(pairs: list[tuple]) -> tuple:
    """(contexts, words, each pair's context and word) of several packed groups of pairs."""
    contexts, c = np.unique(np.concatenate([np.repeat(p[0], p[1]) for p in pairs]), return_inverse=True)
    lengths = [len(p[2]) for p in pairs]
    words, w = np.unique(np.concatenate([p[2] for p in pairs]), return_inverse=True)
    shift = np.cumsum([0, *lengths[:-1]])
    return contexts, words, c.astype(np.int64, copy=False), w[np.concatenate([p[3] + s for p, s in zip(pairs, shift)])].astype(np.int64, copy=False)


def _merge_pairs(batches):
    for (block,), parts in grouped(batches):
        yield _merged(block, parts)  # a call, so that one block's arrays are gone before the next


def _merged(block, parts) -> pa.RecordBatch:
    rows = list(records(parts))
    contexts, words, c, w = joined([unpack_pairs(*(r[n] for n in PAIRS)) for r in rows])
    counts = np.concatenate([unplanes(r["counts"], np.int64) for r in rows])
    key = c << 32 | w
    order = np.argsort(key, kind="stable")
    first = changes(key[order])
    total = np.add.reduceat(counts[order], first)
    key = key[order][first]
    c, w = key >> 32, key & 0xFFFFFFFF
    packed = [pack_keys(contexts), planes(spans(changes(c), len(c)).astype(np.uint32)), pack_keys(words), planes(w.astype(np.uint32)), planes(total)]
    return binary_rows(["block", *PAIRS, "counts"], [block], *([x] for x in packed))


def _block_sums(batches):
    """(block, customers, pairs, pairs of one, pairs of two) of each block."""
    for batch in batches:
        rows = [(b, n.sum(), len(n), (n == 1).sum(), (n == 2).sum()) for b, n in ((b, unplanes(x, np.int64)) for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))]
        if rows:
            yield binary_rows(["block", "customers", "pairs", "ones", "twos"], *([int(x) for x in c] for c in zip(*rows)))


# -- sampling ----------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, for arguments of 1.9 and more."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 - (1 - 2 / (7 * x * x)) / (30 * x * x)) / (12 * x)


@lru_cache(maxsize=8)
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the ways to seat n customers at k tables, weighted as the restaurant weighs them; [n, k]."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(most):
            k = np.arange(1, n + 2)
            stay = np.where(k <= n, out[n, 1 : n + 2] + np.log(np.maximum(n - discount * k, 1e-300)), -np.inf)
            out[n + 1, 1 : n + 2] = np.logaddexp(out[n, : n + 1], stay)
    return out


def saddle(y: np.ndarray, target: np.ndarray, value) -> np.ndarray:
    """The y < 0 at which the first of value(y) is target, value giving a decreasing function and its slope."""
    for _ in range(12):
        v, slope = value(y)
        y = np.clip(y - (v - target) / slope, -80, -1e-7)
    return y


def log_ways(counts: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """`stirling` for many customers by the saddle point of its generating function (1 - (1 - x)^d)^t / (t! d^t)."""

    def mean(y):
        u, v = np.exp(y), np.exp(discount * y)
        return np.log1p(-u) + (discount - 1) * y - np.log1p(-v), -u / (1 - u) + discount - 1 + discount * v / (1 - v)

    ratio = np.log(counts) - np.log(tables) - np.log(discount)
    y = saddle(np.clip(-ratio / (1 - discount), -80, -1e-3), ratio, mean)
    u = np.exp(y)
    x, f = 1 - u, -np.expm1(discount * y) / discount
    m = x * np.exp((discount - 1) * y) / f
    spread = np.maximum(m * (1 + x * (1 - discount) / u - m), 1e-9)
    out = log_gamma(counts + 1.0) - log_gamma(tables + 1.0) + tables * np.log(f) - counts * np.log(x) - 0.5 * np.log(2 * np.pi * tables * spread)
    return np.where(tables == counts, 0.0, out)


def seat_many(counts: np.ndarray, others: np.ndarray, p: np.ndarray, strength: float, discount: float, rng) -> np.ndarray:
    """Tables of dishes with many customers: Metropolis steps from the mode, on the scale of the spread."""

    def tilt(weight):
        def value(y):
            u = np.exp(y)
            return np.log1p(-u) + (discount - 1) * y, -u / (1 - u) + discount - 1

        ratio = np.log(counts) - np.log(weight)
        u = np.exp(saddle(np.clip(-ratio / (1 - discount), -80, -1e-3), ratio, value))
        mode = weight * -np.expm1(discount * np.log(u)) / discount
        return mode, np.sqrt(np.maximum(mode - counts / (1 + (1 - u) * (1 - discount) / u), 0.25))

    mode, spread = tilt((strength + discount * others) * p)
    mode, spread = tilt((strength + discount * (others + np.minimum(mode, counts) / 2)) * p)
    start = strength / discount + others
    log_p = np.log(p * discount)
    weigh = lambda t: log_gamma(start + t) + t * log_p + log_ways(counts, t, discount)
    tables = np.clip(np.rint(mode), 1, counts)
    now = weigh(tables)
    for _ in range(STEPS):
        move = np.rint(rng.normal(0, 1.2, len(counts)) * spread + np.where(rng.random(len(counts)) < 0.5, -0.5, 0.5))
        asked = tables + move
        inside = (asked >= 1) & (asked <= counts)
        asked = np.where(inside, asked, tables)
        then = weigh(asked)
        take = inside & (np.log(rng.random(len(counts))) < then - now)
        tables, now = np.where(take, asked, tables), np.where(take, then, now)
    return tables.astype(np.int64)


def seat(counts: np.ndarray, others: np.ndarray, p: np.ndarray, strength: float, discount: float, rng) -> np.ndarray:
    """Tables of each dish by its distribution given all others; counts above 1, in descending order.

    others: tables of the restaurant's other dishes; p: the dish's probability in the parent. Up to EXACT customers
    the distribution is summed up; beyond, it is that of the saddle-point formula.
    """
    out = np.empty(len(counts), np.int64)
    large = int(np.searchsorted(-counts, -EXACT, "left"))
    if large:
        out[:large] = seat_many(counts[:large], others[:large], p[:large], strength, discount, rng)
    ways = stirling(discount)
    a = large
    while a < len(counts):
        c = int(counts[a])
        b = min(int(np.searchsorted(-counts, -c, "right")), a + (1 << 19) // c + 1)
        weights = np.log((strength + discount * (others[a:b, None] + np.arange(c))) * p[a:b, None])
        np.cumsum(weights, axis=1, out=weights)
        weights += ways[c, 1 : c + 1]
        weights -= weights.max(axis=1, keepdims=True)
        np.exp(weights, out=weights)
        np.cumsum(weights, axis=1, out=weights)
        out[a:b] = 1 + (weights[:, :-1] < rng.random((b - a, 1)) * weights[:, -1:]).sum(axis=1)
        a = b
    return out


class Sums:
    """What all blocks need of the whole model: a few numbers."""

    def __init__(self, tokens, words, discount, root_customers=0, root_tables=0, root_discount=0.7, draws=1):
        self.tokens, self.words, self.discount, self.draws = tokens, words, discount, draws
        self.root_customers, self.root_tables, self.root_discount = root_customers, root_tables, root_discount

    def unseen(self) -> float:
        """The parent's probability of one word that no customer has."""
        return (ROOT_STRENGTH + self.root_discount * self.root_tables) / (ROOT_STRENGTH + self.root_customers) / (self.words + 1)

    def parent(self, served: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Probability of each word in the parent; served: its customers there, root: its tables of all draws."""
        return (served - self.root_discount / self.draws * root) / (ROOT_STRENGTH + self.root_customers) + self.unseen()


class Block:
    """The restaurants of one block, sampled from a given parent."""

    def __init__(self, per: np.ndarray, places: np.ndarray, counts: np.ndarray, parent: np.ndarray, discount: float, others: tuple[int, int] = (0, 0)):
        """others: customers and tables that the block's one hot context has in other sub-blocks."""
        self.counts, self.places, self.parent, self.discount = counts, places, parent, discount
        self.context = np.repeat(np.arange(len(per)), per)
        self.customers = np.bincount(self.context, counts, len(per)) + others[0]
        self.elsewhere = others[1]
        many = np.flatnonzero(counts > 1)
        self.many = many[np.argsort(-counts[many], kind="stable")]

    def seated(self, tables: np.ndarray) -> np.ndarray:
        """Tables of each context."""
        return np.bincount(self.context, tables, len(self.customers)) + self.elsewhere

    def sweep(self, tables: np.ndarray, seated: np.ndarray, rng) -> np.ndarray:
        """Tables of each pair after one Gibbs sweep; before it: tables of each pair and of each context."""
        following = np.ones(len(self.counts), np.int64)
        others = seated[self.context[self.many]] - tables[self.many]
        following[self.many] = seat(self.counts[self.many], others, self.parent[self.places[self.many]], CONTEXT_STRENGTH, self.discount, rng)
        return following

    def own(self, tables: np.ndarray) -> np.ndarray:
        """Each pair's probability by its own restaurant alone."""
        return (self.counts - self.discount * tables) / (CONTEXT_STRENGTH + self.customers)[self.context]

    def share(self, seated: np.ndarray) -> np.ndarray:
        """Each context's probability of a new table."""
        return (CONTEXT_STRENGTH + self.discount * seated) / (CONTEXT_STRENGTH + self.customers)


#: Rows of an exchange: to a range of words (kind 1), the sums' answer to a block (kind 2), a block's tables by pair (kind 3).
EXCHANGE = schema_of("kind part block", "words served tables")
EXCHANGED = ["kind", "part", "block", "words", "served", "tables"]


def _served(block: int, words: np.ndarray, served: np.ndarray, blocks: int) -> pa.RecordBatch:
    found = by_part(words, blocks)
    n = len(found)
    return binary_rows(
        EXCHANGED, [1] * n, [p for p, _ in found], [block] * n, [pack_keys(words[s]) for _, s in found], [planes(served[s].astype(np.int64)) for _, s in found], pa.nulls(n, pa.binary())
    )


def _first_served(blocks: int):
    """At first each pair has one table."""

    def run(batches):
        for batch in batches:
            for r in records([batch]):
                words = unpack_keys(r["words"])
                yield _served(r["block"], words, np.bincount(unplanes(r["places"], np.uint32), minlength=len(words)), blocks)

    return run


WORDS = schema_of("kind part block", "words counts served root")
WORDS_NAMES = ["kind", "part", "block", "words", "counts", "served", "root"]


def _parent(shipped, number: int, draws: int):
    """Seats the parent's customers of a range of words; a row for the range (kind 0) and one for each block (kind 2)."""

    def run(batches):
        for (part,), parts in grouped(batches):
            yield from answers(part, parts)

    def answers(part, parts):
        sums = shipped.value
        asked = []
        for r in records(parts):  # the range's words come first
            if r["kind"] == 0:
                words, counts = unpack_keys(r["words"]), unplanes(r["counts"], np.int64)
                served = np.zeros(len(words), np.int64)
            else:
                at = np.searchsorted(words, unpack_keys(r["words"])).astype(np.uint32)
                served[at] += unplanes(r["served"], np.int64)
                asked.append((r["block"], at))
        rng = np.random.Generator(np.random.PCG64([SEED, number, int(part)]))
        order = np.argsort(-served, kind="stable")
        root = np.minimum(served, 1) * draws
        many = order[: int(np.searchsorted(-served[order], -1, "left"))]
        others, p = np.full(len(many), float(sums.root_tables)), np.full(len(many), 1 / (sums.words + 1))
        root[many] = sum(seat(served[many], others, p, ROOT_STRENGTH, sums.root_discount, rng) for _ in range(draws))
        yield binary_rows(WORDS_NAMES, [0], [part], [-1], [pack_keys(words)], [planes(counts)], [planes(served)], [planes(root)])
        for block, at in asked:
            yield binary_rows(WORDS_NAMES, [2], [part], [block], pa.nulls(1, pa.binary()), [planes(counts[at])], [planes(served[at])], [planes(root[at])])

    return run


def _root_sums(batches):
    """Customers, tables (of all draws) and words of one and two customers of the parent."""
    total = np.zeros(4, np.int64)
    for batch in batches:
        for raw_served, raw_root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            served = unplanes(raw_served, np.int64)
            total += [served.sum(), unplanes(raw_root, np.int64).sum(), (served == 1).sum(), (served == 2).sum()]
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["sums"])


MODEL = schema_of("block", "contexts per words places own share parent counts")
MODEL_NAMES = ["block", *PAIRS, "own", "share", "parent", "counts"]


def _round(shipped, others, number: int, blocks: int, final: bool):
    """Sweeps over every block: its tables go to the exchange, or in the final round its averages are the model."""

    def run(batches):
        for (block,), parts in grouped(batches):
            yield from swept(block, parts)

    def swept(block, parts):
        sums = shipped.value
        state, before, answers = None, None, []
        for r in records(parts):  # by kind and range
            if r["kind"] == 0:
                state = r
            elif r["kind"] == 2:
                answers.append((unplanes(r["counts"], np.int64), unplanes(r["served"], np.int64), unplanes(r["root"], np.int64)))
            else:
                before = unplanes(r["tables"], np.int64)
        word_counts, served, root = (np.concatenate(x) for x in zip(*answers))
        per, words, places = unplanes(state["per"], np.uint32).astype(np.int64), unpack_keys(state["words"]), unplanes(state["places"], np.uint32).astype(np.int64)
        parent = sums.parent(served, root)
        work = Block(per, places, unplanes(state["pair_counts"], np.int64), parent, sums.discount, others.value.get(block, (0, 0)))
        tables = np.ones(len(places)) if before is None else before
        seated = work.seated(tables)
        rng = np.random.Generator(np.random.PCG64([SEED, 1000 + number, int(block)]))
        own, share = np.zeros(len(places)), np.zeros(len(per))
        for s in range(BURN_IN + SAMPLES if final else FIRST_SWEEPS):
            tables = work.sweep(tables, seated, rng)
            seated = work.seated(tables)
            if final and s >= BURN_IN:
                own += work.own(tables) / SAMPLES
                share += work.share(seated) / SAMPLES
        if not final:
            yield _served(block, words, np.bincount(places, tables, len(words)), blocks)
            yield binary_rows(EXCHANGED, [3], [-1], [block], pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), [planes(tables)])
            return
        p = own + share[work.context] * parent[places]
        yield binary_rows(MODEL_NAMES, [block], *([x] for x in (state["contexts"], state["per"], state["words"], state["places"], planes(p.astype(np.float32)), planes(share.astype(np.float32)), planes(parent.astype(np.float32)), planes(word_counts))))

    return run


def _hot_tables(batches):
    """(block, tables) of sub-blocks, from the exchange."""
    for batch in batches:
        yield binary_rows(["block", "tables"], batch.column(0).to_pylist(), [int(unplanes(x, np.int64).sum()) for x in batch.column(1).to_pylist()])


def _vector(frame: DataFrame) -> np.ndarray:
    """Element sums of an array column, as one short vector."""
    rows = frame.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    return np.array([r.s for r in rows], np.int64)


def _discount(ones: int, twos: int) -> float:
    return float(min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95))


class Model:
    """Tables of restaurants (a row a block) and of words (a row a range), and what is broadcast."""

    def __init__(self, blocks_table: DataFrame, words_table: DataFrame, sums: Sums, deal: Deal, copies: dict[int, int]):
        self.blocks_table, self.words_table, self.sums, self.deal, self.copies = blocks_table, words_table, sums, deal, copies


def fit(train: DataFrame, blocks: int, staging: Staging) -> Model:
    """The sampled model. train: column text."""
    context = train.sparkSession.sparkContext
    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    text = train.select("text")
    dealt = lambda frame, key, *order: frame.repartition(key).sortWithinPartitions(key, *order)
    words = staging.write(dealt(text.mapInArrow(_word_rows(blocks), WORD_ROWS), "part").mapInArrow(_merge_words, WORD_ROWS))
    counted = _vector(words.select("counts").mapInArrow(_word_sums, "sums array<bigint>"))
    tokens, kinds = counted.tolist() if len(counted) else (0, 0)
    # At most HOT contexts; the context of a row's start has as many tokens as there are row ends.
    least = max(-(-tokens // min(blocks, HOT)), 1)
    frequent = words.select("words", "counts").mapInArrow(_frequent(least), "word bigint, n bigint").collect()
    ends = int(END_WORD.view(np.int64))
    hot = [(int(np.int64(r.word).view(np.uint64)), r.n) if r.word != ends else (int(FIRST_WORD), r.n) for r in frequent]
    deal = Deal(blocks, hot, tokens)
    dealer = context.broadcast(deal)  # at most HOT contexts
    state = staging.write(dealt(text.mapInArrow(lambda b: _pair_rows(dealer.value)(b), STATE), "block").mapInArrow(_merge_pairs, STATE))
    staging.sweep()
    block_sums = state.select("block", "counts").mapInArrow(_block_sums, schema_of("block customers pairs ones twos"))
    whole = block_sums.agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).first()
    large = block_sums.where((F.col("block") >= blocks) | (F.col("customers") >= 2 * least)).select("block", "customers", "pairs").collect()  # a few times HOT rows at most
    copies = {r.block: -(-r.customers // (2 * least)) for r in large if r.customers > 2 * least}
    tables = {r.block: r.pairs for r in large if r.block >= blocks}
    customers = {r.block: r.customers for r in large if r.block >= blocks}

    def others():
        total: dict[int, int] = {}
        for b, n in tables.items():
            total[deal.owner(b)] = total.get(deal.owner(b), 0) + n
        return context.broadcast({b: (int(deal.customers[deal.owner(b)]) - customers[b], total[deal.owner(b)] - n) for b, n in tables.items()})

    sums = Sums(tokens, kinds, _discount(whole.ones or 0, whole.twos or 0), 0, kinds)
    asked = state.select("block", "words", "places").mapInArrow(_first_served(blocks), EXCHANGE)
    started = state.select(F.lit(0).cast("long").alias("kind"), F.lit(-1).cast("long").alias("part"), "block", "contexts", "per", "words", "places", F.col("counts").alias("pair_counts"))
    table = words.select(F.lit(0).cast("long").alias("kind"), "part", F.lit(-1).cast("long").alias("block"), "words", "counts")
    result = old = None
    for number in range(2):
        final = number == 1
        exchange = asked.where("kind = 1").drop("tables").withColumn("counts", F.lit(None).cast("binary"))
        answered = staging.write(dealt(table.withColumns({"served": F.lit(None).cast("binary")}).unionByName(exchange).select("part", "kind", "block", "words", "counts", "served"), "part", "kind", "block").mapInArrow(_parent(context.broadcast(sums), number, SAMPLES if final else 1), WORDS))
        staging.sweep()
        root = _vector(answered.where("kind = 0").select("served", "root").mapInArrow(_root_sums, "sums array<bigint>"))
        served, seated, ones, twos = root.tolist() if len(root) else [0] * 4
        draws = SAMPLES if final else 1
        sums = Sums(tokens, kinds, sums.discount, served, seated / draws, sums.root_discount if final else _discount(ones, twos), draws)  # the first seating used a guess
        rows = started.withColumns({n: F.lit(None).cast("binary") for n in ("counts", "served", "root", "tables")})
        rows = rows.unionByName(answered.where("kind = 2").drop("words").select("*", *none("contexts", "per", "words", "places", "pair_counts", "tables")))
        if old is not None:
            rows = rows.unionByName(old.where("kind = 3").select("kind", "part", "block", "tables", *none("contexts", "per", "words", "places", "pair_counts", "counts", "served", "root")))
        rows = dealt(rows.select("block", "kind", "part", *[c for c in rows.columns if c not in ("block", "kind", "part")]), "block", "kind", "part")
        result = staging.write(rows.mapInArrow(_round(context.broadcast(sums), others(), number, blocks, final), MODEL if final else EXCHANGE))
        if final:
            vocabulary = staging.write(answered.where("kind = 0").select("part", "words", "counts", "served", "root"))
            staging.drop(state, words, old, answered)
        else:
            for r in result.where(f"kind = 3 AND block >= {blocks}").select("block", "tables").mapInArrow(_hot_tables, schema_of("block tables")).collect():
                tables[r.block] = r.tables
            staging.drop(answered)
            asked = old = result
        staging.sweep()
    return Model(result, vocabulary, sums, deal, copies)


# -- scoring -----------------------------------------------------------------------------------

ASKED = ["block", "copy", "kind", "chunk", *PAIRS, "entries", "docs", "times", "own", "share", "parent", "counts"]
ASKED_SCHEMA = schema_of("block copy kind chunk", "contexts per words places entries docs times own share parent counts") + ", ids array<bigint>, held array<boolean>"


def _document_rows(dealer, copies, wave: int):
    """For each chunk of documents: its pairs by block (kind 1), and its ids and token counts (kind 2)."""

    def run(batches):
        task = TaskContext.get().partitionId()
        chunk = wave << 56 | task << 32
        held, docs_held, begun, ids, flags, lengths, size = [], [], [], [], [], [], 0
        for batch in batches:
            for first, tokens, toffs in token_keys(batch.column(1)):
                n = np.diff(toffs)
                row = 0
                while row < len(n):  # whole documents, as many as the chunk still takes
                    end = int(np.searchsorted(toffs, toffs[row] + CHUNK_TOKENS - size, "left"))
                    end = min(max(end, row + 1), len(n), row + CHUNK_DOCS - len(ids))
                    held.append(tokens[toffs[row] : toffs[end]])
                    begun.append(toffs[row:end] - toffs[row] + size)
                    docs_held.append(np.repeat(np.arange(len(ids), len(ids) + end - row), n[row:end]))
                    ids += batch.column(0).slice(first + row, end - row).to_pylist()
                    flags += batch.column(2).slice(first + row, end - row).to_pylist()
                    lengths += n[row:end].tolist()
                    size += int(toffs[end] - toffs[row])
                    row = end
                    if size >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                        yield flush(chunk, np.concatenate(held), np.concatenate(begun), np.concatenate(docs_held), ids, flags, lengths)
                        chunk += 1
                        held, docs_held, begun, ids, flags, lengths, size = [], [], [], [], [], [], 0
        if ids:
            yield flush(chunk, np.concatenate(held), np.concatenate(begun), np.concatenate(docs_held), ids, flags, lengths)

    def flush(chunk, tokens, starts, docs, ids, flags, lengths):
        deal, copied = dealer.value, copies.value
        vocabulary, c, w = indexed(tokens, starts)
        if len(vocabulary) < 1 << 24:
            key = np.sort(c.astype(np.uint64) << np.uint64(40) | w.astype(np.uint64) << np.uint64(16) | docs.astype(np.uint64))
            new = changes(key)
            times, key = spans(new, len(key)), key[new]
            c, w, docs = ((key >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((40, 0xFFFFFF), (16, 0xFFFFFF), (0, 0xFFFF)))
        else:
            order = np.lexsort((docs, w, c))
            c, w, docs = c[order], w[order], docs[order]
            new = changes(c, w, docs)
            times = spans(new, len(c))
            c, w, docs = c[new], w[new], docs[new]
        block = deal.of(vocabulary[c], vocabulary[w])
        order = np.argsort(block, kind="stable")
        block, c, w, docs, times = block[order], c[order], w[order], docs[order], times[order]
        edges = changes(block).tolist()
        rows = []
        for a, b in zip(edges, [*edges[1:], len(block)]):
            first = changes(c[a:b], w[a:b])
            number = int(block[a])
            rows.append((number, chunk % copied.get(number, 1), *pack_pairs(vocabulary, c[a:b][first], w[a:b][first]), planes(spans(first, b - a).astype(np.uint32)), planes(docs[a:b].astype(np.uint16)), planes(times[a:b].astype(np.uint32))))
        n = len(rows) + 1
        numbers, copy, contexts, per, words, places, entries, docs_of, times_of = zip(*rows)
        last = lambda column, value=None: pa.array([*column, value], pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*numbers, int(block[0])], pa.int64()), pa.array([*copy, copy[0]], pa.int64()), pa.array([1] * (n - 1) + [2], pa.int64()), pa.array([chunk] * n, pa.int64()),
                last(contexts), last(per), last(words), last(places), last(entries), last(docs_of, planes(np.array(lengths, np.int64))), last(times_of),
                *[pa.nulls(n, pa.binary())] * 4, pa.array([None] * (n - 1) + [ids], pa.list_(pa.int64())), pa.array([None] * (n - 1) + [flags], pa.list_(pa.bool_())),
            ],
            [*ASKED, "ids", "held"],
        )

    return run


#: Of a chunk: its ids (kind 0) or sums of documents (kind 1); of many chunks: words that their blocks do not know, for a range (kind 2).
FOUND = ["kind", "chunk", "part", "docs", "score", "base", "known", "words", "entries", "times", "places", "chunks"]
FOUND_SCHEMA = schema_of("kind chunk part", "docs score base known words entries times places chunks") + ", ids array<bigint>, held array<boolean>"


def _found(kind, chunk, part=-1, ids=None, held=None, **binaries) -> pa.RecordBatch:
    given = [pa.array([x], pa.int64()) for x in (kind, chunk, part)] + [pa.array([binaries.get(n)], pa.binary()) for n in FOUND[3:]]
    return pa.RecordBatch.from_arrays([*given, pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_()))], [*FOUND, "ids", "held"])


class DocumentSums:
    """Sums of documents by chunk, given out before they outgrow the task."""

    def __init__(self):
        self.sums: dict[int, np.ndarray] = {}
        self.size = 0

    def add(self, chunk: int, docs: np.ndarray, *values: np.ndarray):
        n = int(docs.max()) + 1 if len(docs) else 0
        old = self.sums.get(chunk)
        if old is None or old.shape[1] < n:
            wide = np.zeros((3, n))
            if old is not None:
                wide[:, : old.shape[1]] = old
                self.size -= old.shape[1]
            self.sums[chunk] = old = wide
            self.size += n
        for k, v in enumerate(values):
            old[k, :n] += np.bincount(docs, v, n)
        if self.size > HELD_SUMS:
            yield from self.flush()

    def flush(self):
        for chunk, (score, base, known) in self.sums.items():
            some = np.flatnonzero((base != 0) | (score != 0))
            if len(some):
                yield _sums_row(chunk, some, score[some], base[some], known[some])
        self.sums, self.size = {}, 0


def _sums_row(chunk: int, docs, score, base, known) -> pa.RecordBatch:
    return _found(1, chunk, docs=planes(docs.astype(np.uint16)), score=score.tobytes(), base=base.tobytes(), known=planes(known.astype(np.uint32)))


class SparseSums:
    """Sums of documents over entries of many chunks at once, in compressed form, given out before they outgrow the task."""

    def __init__(self):
        self.number: dict[int, int] = {}
        self.keys, self.values, self.fresh, self.size = np.zeros(0, np.int64), np.zeros((3, 0)), [], 0

    def add(self, chunks: np.ndarray, places: np.ndarray, docs: np.ndarray, *values: np.ndarray):
        numbers = np.array([self.number.setdefault(c, len(self.number)) for c in chunks.tolist()], np.int64)
        self.fresh.append((numbers[places] << 16 | docs, np.stack(values)))
        self.size += len(docs)
        if self.size > HELD_SUMS:
            self._compress()
            if len(self.keys) > HELD_SUMS // 2:
                yield from self.flush()

    def _compress(self):
        keys = np.concatenate([self.keys, *(k for k, _ in self.fresh)])
        values = np.concatenate([self.values, *(v for _, v in self.fresh)], axis=1)
        order = np.argsort(keys, kind="stable")
        first = changes(keys[order])
        self.values = np.add.reduceat(values[:, order], first, axis=1) if len(first) else np.zeros((3, 0))
        self.keys, self.fresh, self.size = keys[order][first], [], 0

    def flush(self):
        self._compress()
        names = list(self.number)
        first = changes(self.keys >> 16)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(self.keys)]):
            yield _sums_row(names[int(self.keys[a]) >> 16], self.keys[a:b] & 0xFFFF, *(v[a:b] for v in self.values))
        self.__init__()


class Unknown:
    """Occurrences of words that their blocks do not know, of all chunks of a task, given out by range."""

    def __init__(self, blocks: int):
        self.blocks, self.held, self.size = blocks, [], 0

    def add(self, chunk: int, words: np.ndarray, docs: np.ndarray, times: np.ndarray):
        self.held.append((chunk, words, docs, times))
        self.size += len(words)
        if self.size > HELD_SUMS:
            yield from self.flush()

    def flush(self):
        if not self.held:
            return
        chunks = np.array(sorted({h[0] for h in self.held}), np.int64)
        place = np.concatenate([np.full(len(h[1]), np.searchsorted(chunks, h[0]), np.uint32) for h in self.held])
        words, docs, times = (np.concatenate([h[i] for h in self.held]) for i in (1, 2, 3))
        order = np.argsort(words, kind="stable")
        words, docs, times, place = words[order], docs[order], times[order], place[order]
        first = changes(words)
        keys, n = words[first], spans(first, len(words))
        edge = np.concatenate([[0], np.cumsum(n)])
        for part, s in by_part(keys, self.blocks):
            a, b = edge[s.start], edge[s.stop]
            mine, local = np.unique(place[a:b], return_inverse=True)
            yield _found(
                2, -1, part, words=pack_keys(keys[s]), entries=planes(n[s].astype(np.uint32)), docs=planes(docs[a:b].astype(np.uint16)), times=planes(times[a:b].astype(np.uint32)),
                places=planes(local.astype(np.uint32)), chunks=chunks[mine].tobytes(),
            )
        self.held, self.size = [], 0


def _score_rows(shipped, blocks: int):
    def run(batches):
        sums = shipped.value
        floor = np.log10(sums.tokens + 0.5 * (sums.words + 1))
        totals, unknown = DocumentSums(), Unknown(blocks)
        none = np.zeros(0)
        for _, parts in grouped(batches, 2):
            contexts, words, keys = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            own = share = parent = counts = none
            for r in records(parts):  # the block's restaurants come first
                if r["kind"] == 0:
                    contexts, per, words, places = unpack_pairs(*(r[n] for n in PAIRS))
                    keys = np.repeat(np.arange(len(per)), per) << 32 | places
                    own, share, parent = (unplanes(r[n], np.float32).astype(np.float64) for n in ("own", "share", "parent"))
                    counts = unplanes(r["counts"], np.int64)
                    continue
                if r["kind"] == 2:
                    yield _found(0, r["chunk"], docs=r["docs"], ids=r["ids"], held=r["held"])
                    continue
                asked, per, wanted, places = unpack_pairs(*(r[n] for n in PAIRS))
                entries, docs, times = unplanes(r["entries"], np.uint32), unplanes(r["docs"], np.uint16).astype(np.int64), unplanes(r["times"], np.uint32)
                i, met = find(contexts, asked)
                j, known = find(words, wanted)
                # A context without customers gives all to its new table.
                log_share = np.log10(share[i], out=np.zeros(len(i)), where=met) if len(share) else np.zeros(len(i))
                c, w_known, w_place = np.repeat(np.arange(len(asked)), per), known[places], j[places]
                k, pair = find(keys, i[c] << 32 | w_place)
                pair &= met[c] & w_known
                score = log_share[c].copy()
                base = np.zeros(len(c))
                new = w_known & ~pair
                score[new] += np.log10(parent[w_place[new]])
                score[pair] = np.log10(own[k[pair]])
                base[w_known] = np.log10(counts[w_place[w_known]] + 0.5) - floor
                yield from totals.add(r["chunk"], docs, times * np.repeat(score, entries), times * np.repeat(base, entries), times * np.repeat(w_known, entries))
                if not known.all():
                    at = np.flatnonzero(np.repeat(~w_known, entries))
                    yield from unknown.add(r["chunk"], wanted[np.repeat(places, entries)[at]], docs[at], times[at])
        yield from totals.flush()
        yield from unknown.flush()

    return run


def _range_rows(shipped):
    """Sums of documents over words that their blocks did not know."""

    def run(batches):
        sums = shipped.value
        floor = np.log10(sums.tokens + 0.5 * (sums.words + 1))
        totals = SparseSums()
        for _, parts in grouped(batches):
            words, parent, counts = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
            for r in records(parts):  # the range's words come first
                if r["kind"] == 0:
                    words, counts = unpack_keys(r["words"]), unplanes(r["counts"], np.int64)
                    parent = sums.parent(unplanes(r["served"], np.int64), unplanes(r["root"], np.int64))
                    continue
                wanted, n = unpack_keys(r["words"]), unplanes(r["entries"], np.uint32)
                i, known = find(words, wanted)
                p, seen = np.full(len(wanted), sums.unseen()), np.zeros(len(wanted))
                p[known], seen[known] = parent[i[known]], counts[i[known]]
                docs, times = unplanes(r["docs"], np.uint16).astype(np.int64), unplanes(r["times"], np.uint32)
                chunks, places = np.frombuffer(r["chunks"], np.int64), unplanes(r["places"], np.uint32)
                yield from totals.add(chunks, places, docs, times * np.repeat(np.log10(p), n), times * np.repeat(np.log10(seen + 0.5) - floor, n), times * np.repeat(known, n))
        yield from totals.flush()

    return run


RESULT = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _add_rows(batches):
    """One row for each document of a chunk."""
    for (_,), parts in grouped(batches):
        for r in records(parts):  # the chunk's ids come first
            docs = unplanes(r["docs"], np.uint16 if r["kind"] else np.int64)
            if r["kind"] == 0:
                ids, held, lengths = r["ids"], r["held"], docs
                total = np.zeros((3, len(ids)))
                continue
            total[0, docs] += np.frombuffer(r["score"], np.float64)
            total[1, docs] += np.frombuffer(r["base"], np.float64)
            total[2, docs] += unplanes(r["known"], np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(lengths, pa.int64()), pa.array(total[2].astype(np.int64)), pa.array(total[1]), pa.array(total[0])],
            [x.split()[0] for x in RESULT.split(", ")],
        )


def score(docs: DataFrame, model: Model, staging: Staging) -> DataFrame:
    """docs: id bigint, text, held. One row each with token counts and scores."""
    context = docs.sparkSession.sparkContext
    dealer, copies, sums = context.broadcast(model.deal), context.broadcast(model.copies), context.broadcast(model.sums)
    blocks = model.deal.blocks
    copied = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for b in model.copies.items() for x in b]), F.col("block")), F.lit(1)).cast("long") - 1)) if model.copies else F.lit(0).cast("long")
    table = model.blocks_table.select("*", copied.alias("copy"), F.lit(0).cast("long").alias("kind"), F.lit(-1).cast("long").alias("chunk"))
    found = []
    for wave in range(WAVES):  # of all rows by the hash of their id, so that only a part of the pairs is under way at a time
        mine = docs.where(F.pmod(F.xxhash64("id"), F.lit(WAVES)) == wave)
        rows = mine.select("id", "text", "held").mapInArrow(_document_rows(dealer, copies, wave), ASKED_SCHEMA)
        asked = rows.unionByName(table, allowMissingColumns=True).select(*ASKED, "ids", "held").repartition("block", "copy").sortWithinPartitions("block", "copy", "kind")
        found.append(staging.write(asked.mapInArrow(_score_rows(sums, blocks), FOUND_SCHEMA)))
        del rows, asked
        staging.sweep()
    staging.drop(model.blocks_table)
    every = reduce(DataFrame.unionByName, found)
    unknown = every.where("kind = 2").select("part", "kind", "chunk", "words", "entries", "docs", "times", "places", "chunks")
    table = model.words_table.withColumns({"kind": F.lit(0).cast("long"), "chunk": F.lit(-1).cast("long")})
    more = unknown.unionByName(table, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_range_rows(sums), FOUND_SCHEMA)
    parts = every.where("kind < 2").unionByName(more).select("chunk", "kind", *[n for n in FOUND if n not in ("chunk", "kind")], "ids", "held")
    return parts.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_add_rows, RESULT)


def train_and_score(docs: DataFrame, staging: Staging, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; ids are integers."""
    small_batches(docs.sparkSession)
    blocks = blocks_of(docs, block_bytes)
    held = held_out(F.col(id_col), modulus)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    model = fit(picked.where("NOT held"), blocks, staging)
    scored = score(picked, model, staging)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.sums.tokens).cast("long").alias("train_tokens"), "base_score", "score")
