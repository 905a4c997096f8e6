"""Language identification by interpolated Kneser-Ney character models.

One model per learned language over the letters of words, lower-cased, with marks for a word's start
and end. A model takes memory in proportion to its n-grams: each key's values are listed for the languages that have it. Models are fitted on a bounded sample of labelled rows: of each language the SAMPLE_DOCS
rows with the least hash of their id, up to SAMPLE_CHARS characters; a longer text counts with its
first tenth of that from its first letter on, so no language is left out for its texts' length. Every
fifth sampled row is kept out of the fit and calibrates rejection and scores: the score is a softmax over the languages of
-a * n^g * entropy for n characters, with the a and g that give the kept-out rows' labels the highest likelihood. N-grams are 64-bit hashes in one
sorted array per order, with each language's discounted probability and back-off weight beside it.
A text gets the language of least cross-entropy per character; words are scored once for a batch
and found again by their hash, which changes no score as contexts do not cross words.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; ties go to
the language that sorts first; without any labelled row everything is `und`; texts of any length are scored whole;
repeated rows get equal rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textops
from .staging import small_batches

ORDER = 5
SAMPLE_DOCS, SAMPLE_CHARS = 400, 1_500_000
CALIBRATE_EVERY, REJECT_SIGMAS = 5, 6.0
#: Factors and powers of the length among which the score's calibration chooses.
FACTORS, POWERS = (0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.5, 4.0, 6.0), (0.0, 0.25, 0.5, 0.75, 1.0)
#: Words whose scores a worker keeps between batches.
CACHE_WORDS = 400_000
#: Bytes of words that are scored at a time; each takes about 400 bytes of array work.
WORD_BYTES = 128 << 10
START, END = "\x02", "\x03"
LETTERS = regex.compile(r"\p{L}+")
_C = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column, modulus: int, remainder: int = 1) -> Column:
    """crc32 of the id as text; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == remainder, F.lit(True))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column) -> list[tuple[str, str]]:
    """(lang, text) of the sample, bounded by SAMPLE_DOCS and SAMPLE_CHARS a language."""
    most = max(SAMPLE_CHARS // 10, 1)
    part = F.when(F.length(text_col) > most, F.left(F.regexp_replace(text_col, r"^\P{L}+", ""), F.lit(most))).otherwise(F.col(text_col))
    picked = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), part.alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(5)).alias("h"), F.least(F.length(text_col), F.lit(most)).alias("chars")
    )
    # Of each language a share of about twice the sample is ranked, on narrow rows; the texts of those below the
    # language's last hash are read in a second scan. An id that is repeated counts once.
    sizes = docs.where(train & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))  # a row a language
    share = F.pmod(F.xxhash64("h"), F.lit(1_000_000)) * F.col("n") < F.lit(2_000_000 * SAMPLE_DOCS)
    order = W.partitionBy("lang").orderBy("h", "chars")
    picked = picked.join(F.broadcast(sizes), "lang").where(share)
    narrow = picked.select("lang", "h", "chars")
    ranked = narrow.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_DOCS)
    total = F.sum("chars").over(order.rowsBetween(W.unboundedPreceding, -1))
    within = ranked.withColumn("before", F.coalesce(total, F.lit(0))).where(F.col("before") + F.col("chars") <= SAMPLE_CHARS)
    bounds = within.groupBy("lang").agg(F.max("h").alias("last"))  # a row a language
    rows = picked.join(F.broadcast(bounds), "lang").where("h <= last").groupBy("lang", "h").agg(F.min("text").alias("text"))
    return [(r.lang, r.text) for r in rows.orderBy("lang", "h").select("lang", "text").collect()]


def segments(word: str) -> list[str]:
    return LETTERS.findall(word.lower())


def codes_of(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the padded parts in one array, and where each part starts."""
    text = "".join(START * (ORDER - 1) + p + END for p in parts)
    lengths = np.fromiter((len(p) + ORDER for p in parts), np.int64, len(parts))
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64), np.concatenate([[0], np.cumsum(lengths)])


def gram_keys(codes: np.ndarray) -> list[np.ndarray]:
    """Keys of the k-grams that end at each position, k = 1..ORDER (the first k - 1 positions are void)."""
    keys = [textops.mix(codes + _C)]
    for _ in range(1, ORDER):
        before = np.concatenate([[np.uint64(0)], keys[-1][:-1]])
        keys.append(textops.mix(before * _C + codes))
    return keys


class Table:
    """The n-grams of one order: sorted keys, and behind each the languages that have it with their probability and back-off weight."""

    def __init__(self, collected):
        """collected: of each language keys and probabilities, and keys (among them) and back-off weights."""
        gamma = [np.ones(len(c[0]), np.float32) for c in collected]
        for g, c in zip(gamma, collected):
            order = np.argsort(c[0], kind="stable")
            g[order[np.searchsorted(c[0], c[2], sorter=order)]] = c[3]
        keys = np.concatenate([c[0] for c in collected]) if collected else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys)).astype(np.int64)
        self.language = np.repeat(np.arange(len(collected)), [len(c[0]) for c in collected])[order].astype(np.uint16)
        self.alpha = np.concatenate([c[1] for c in collected])[order] if collected else np.zeros(0, np.float32)
        self.gamma = np.concatenate(gamma)[order] if collected else np.zeros(0, np.float32)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.first, self.language, self.alpha, self.gamma))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def spread(self, places: np.ndarray, values: np.ndarray, default: float, languages: int) -> np.ndarray:
        """(places, languages): the value of each, the default where a language does not have the key."""
        out = np.full((len(places), languages), default, np.float32)
        row = np.flatnonzero(places >= 0)
        first = self.first[places[row]]
        n = self.first[places[row] + 1] - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.repeat(row, n), self.language[at]] = values[at]
        return out


class Model:
    """Sorted hash arrays of all languages."""

    def __init__(self, languages: list[str], tables, uniform: np.ndarray, threshold: float, evidence: tuple[float, float] = (1.0, 0.5)):
        self.languages, self.tables, self.uniform, self.threshold, self.evidence = languages, tables, uniform, threshold, evidence

    @staticmethod
    def fit(rows: list[tuple[str, str]]) -> Model:
        languages = sorted({lang for lang, _ in rows})
        fit, check = [], []
        for lang in languages:
            mine = [t for at, t in rows if at == lang]
            check += [(lang, t) for i, t in enumerate(mine) if i % CALIBRATE_EVERY == CALIBRATE_EVERY - 1]
            fit.append([t for i, t in enumerate(mine) if i % CALIBRATE_EVERY != CALIBRATE_EVERY - 1])
        collected = [_count(texts) for texts in fit]
        uniform = np.array([1.0 / (len(alphabet) + 1) for _, alphabet in collected])
        tables = []
        for k in range(ORDER):
            tables.append(Table([c[k] for c, _ in collected]))
        root = np.array([c[ORDER] for c, _ in collected], np.float32)
        model = Model(languages, tables, uniform * root, math.inf)
        measured = [(languages.index(lang), *model.text_entropies(t)) for lang, t in check]
        measured = [(i, h, n) for i, h, n in measured if n]
        entropies = [float(h.min()) for _, h, _ in measured]
        if entropies:
            model.evidence = calibrated(*(np.array(x) for x in zip(*measured)))
            # Half way from a usual text to chance, or further out where usual texts vary more.
            chance = float(-np.log(uniform).mean())
            model.threshold = max(float(np.mean(entropies) + REJECT_SIGMAS * np.std(entropies)), (float(np.mean(entropies)) + chance) / 2)
        return model

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(natural log probability by language, characters scored, marks included) of each word."""
        parts, owner = [], []
        for i, word in enumerate(words):
            found = segments(word)
            parts += found
            owner += [i] * len(found)
        total = np.zeros((len(words), len(self.languages)))
        chars = np.zeros(len(words), np.int64)
        if not parts or not self.languages:
            return total, chars
        codes, starts = codes_of(parts)
        keys = gram_keys(codes)
        real = np.ones(len(codes), bool)
        real[(starts[:-1, None] + np.arange(ORDER - 1)).reshape(-1)] = False
        at = np.flatnonzero(real)
        p = np.repeat(self.uniform[None], len(at), axis=0)
        back = None
        for k in range(ORDER):
            place = self.tables[k].places(keys[k])
            if back is not None:
                p *= back
            p += self.tables[k].spread(place[at], self.tables[k].alpha, 0.0, len(self.languages))
            back = self.tables[k].spread(place[at - 1], self.tables[k].gamma, 1.0, len(self.languages))  # of the k-gram before the character
        logs = np.log(p)
        sums = np.add.reduceat(logs, np.searchsorted(at, starts[:-1]))
        np.add.at(total, owner, sums)
        np.add.at(chars, owner, np.diff(starts) - (ORDER - 1))
        return total, chars

    def text_entropies(self, text: str) -> tuple[np.ndarray, int]:
        """(entropy by language, characters) of one text."""
        words = Counter(text.split())
        scores, chars = self.word_scores(list(words))
        times = np.array(list(words.values()), np.int64)
        n = int((chars * times).sum())
        return -(scores * times[:, None]).sum(axis=0) / max(n, 1), n

    def certainty(self, entropies: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probability of the best language of each row; 0 for rows without a letter."""
        return np.where(n > 0, np.exp(shares(entropies, n, self.evidence).max(axis=1)), 0.0)


def shares(entropies: np.ndarray, n: np.ndarray, evidence: tuple[float, float]) -> np.ndarray:
    """Log probability of each language."""
    with np.errstate(invalid="ignore"):
        x = -evidence[0] * np.maximum(n, 1)[:, None] ** evidence[1] * np.where(np.isfinite(entropies), entropies, 1e9)
    x -= x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def calibrated(labels: np.ndarray, entropies: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """The (factor, power) under which the labels are most likely; a hundredth of each row's weight stands for wrong labels."""
    rows = np.arange(len(labels))

    def likelihood(evidence):
        p = np.exp(shares(entropies, n, evidence)[rows, labels])
        return np.log(0.99 * p + 0.01 / entropies.shape[1]).sum()

    return max(((a, g) for g in POWERS for a in FACTORS), key=likelihood)


def _count(texts: list[str]):
    """Per order: keys and discounted probabilities, context keys and back-off weights; last the root's weight."""
    words = Counter(p for text in texts for p in segments(text))
    grams: list[Counter] = [Counter() for _ in range(ORDER)]
    for word, times in words.items():
        padded = START * (ORDER - 1) + word + END
        for i in range(ORDER - 1, len(padded)):
            grams[-1][padded[i - ORDER + 1 : i + 1]] += times
    for k in range(ORDER - 2, -1, -1):  # lower orders count the distinct characters before
        for gram in grams[k + 1]:
            grams[k][gram[1:]] += 1
    alphabet = set(grams[0])
    out = []
    for k in range(ORDER):
        ones, twos = (sum(1 for v in grams[k].values() if v == x) for x in (1, 2))
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        totals, kinds = defaultdict(float), Counter()
        for gram, n in grams[k].items():
            totals[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        strings = list(grams[k])
        alpha = np.array([(grams[k][g] - discount) / totals[g[:-1]] for g in strings], np.float32)
        weights = {h: discount * kinds[h] / totals[h] for h in totals}
        out.append([_keys(strings), alpha, weights])
    # A context's back-off weight stands with the gram of its own string, one order below.
    for k in range(ORDER - 1):
        contexts = out[k + 1][2]
        known = [h for h in contexts if h in grams[k]]
        # Contexts of start marks alone are no grams that end in a character; they get entries without probability.
        extra = [h for h in contexts if h not in grams[k]]
        out[k][0] = np.concatenate([out[k][0], _keys(extra)])
        out[k][1] = np.concatenate([out[k][1], np.zeros(len(extra), np.float32)])
        out[k] += [_keys(known + extra), np.array([contexts[h] for h in known + extra], np.float32)]
    out[-1] += [np.zeros(0, np.uint64), np.zeros(0, np.float32)]
    tables = [(o[0], o[1], o[3], o[4]) for o in out]
    return [*tables, out[0][2].get("", 1.0)], alphabet


def _keys(strings: list[str]) -> np.ndarray:
    if not strings:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(len(strings), -1)
    key = textops.mix(codes[:, 0] + _C)
    for j in range(1, codes.shape[1]):
        key = textops.mix(key * _C + codes[:, j])
    return key


def part_words(which: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Places of words in parts of about WORD_BYTES each; a longer word is a part alone."""
    part = np.concatenate([[0], np.cumsum(lengths)[:-1]]) // WORD_BYTES
    return np.split(which, np.flatnonzero(np.diff(part)) + 1)


class Scorer:
    """Scores batches, with the word scores of earlier batches at hand."""

    def __init__(self, model: Model):
        self.model = model
        self.hashes, self.scores, self.chars = np.zeros(0, np.uint64), np.zeros((0, len(model.languages))), np.zeros(0, np.int64)

    def rows(self, column: pa.Array):
        """(entropies by language, characters) of each text."""
        for _, _, data, offs in textops.rounds(column):
            starts, ends, woffs = textops.word_spans(data, offs)
            hashes = textops.word_hashes(data, starts, ends)
            kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            place = np.searchsorted(self.hashes, kinds)
            known = np.zeros(len(kinds), bool)
            inside = place < len(self.hashes)
            known[inside] = self.hashes[place[inside]] == kinds[inside]
            scores, chars = np.zeros((len(kinds), len(self.model.languages))), np.zeros(len(kinds), np.int64)
            scores[known], chars[known] = self.scores[place[known]], self.chars[place[known]]
            new = np.flatnonzero(~known)
            if len(new):
                raw = data.tobytes()
                for some in part_words(new, ends[first[new]] - starts[first[new]]):
                    words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[some]].tolist(), ends[first[some]].tolist())]
                    scores[some], chars[some] = self.model.word_scores(words)
                if len(self.hashes) + len(new) <= CACHE_WORDS:
                    merged = np.concatenate([self.hashes, kinds[new]])
                    order = np.argsort(merged, kind="stable")
                    self.hashes = merged[order]
                    self.scores = np.concatenate([self.scores, scores[new]])[order]
                    self.chars = np.concatenate([self.chars, chars[new]])[order]
            sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores[which], axis=0)]) if len(which) else np.zeros((1, scores.shape[1]))
            count = np.concatenate([[0], np.cumsum(chars[which])]) if len(which) else np.zeros(1, np.int64)
            n = count[woffs[1:]] - count[woffs[:-1]]
            yield -(sums[woffs[1:]] - sums[woffs[:-1]]) / np.maximum(n, 1)[:, None], n


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang_pred, score, entropy, rejected) for every row; the model learns from rows with `train`."""
    model = Model.fit(sample(docs, id_col, text_col, lang_col, train))
    return predict(docs, model, id_col, text_col)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str | None = "text") -> DataFrame:
    """text_col None: the id is a struct that holds the text, and travels once."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scorer = Scorer(shipped.value)
        languages = [*scorer.model.languages, "und"]
        for batch in batches:
            pred, score, entropy, rejected = [], [], [], []
            for entropies, n in scorer.rows(batch.column(1) if text_col else pc.struct_field(batch.column(0), "text")):
                if not entropies.shape[1]:
                    entropies = np.full((len(entropies), 1), np.inf)
                    n = np.zeros_like(n)
                best = entropies.argmin(axis=1)
                least = entropies[np.arange(len(best)), best]
                sure = scorer.model.certainty(entropies, n)
                best[n == 0] = len(languages) - 1
                pred += [languages[i] for i in best.tolist()]
                score += sure.tolist()
                entropy += np.where(n > 0, least, np.inf).tolist()
                rejected += ((n == 0) | (least > scorer.model.threshold)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "entropy", "rejected"])

    picked = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias("text") for c in [text_col] if c])
    return picked.mapInArrow(run, f"id {kind}, lang_pred string, score double, entropy double, rejected boolean").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with the columns of the input."""
    model = Model.fit(sample(docs, "doc_id", "text", "lang", ~held_out(F.col("doc_id"), 3)))
    columns = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    return predict(keyed, model, "row", None).where("NOT rejected").select("row.*")
