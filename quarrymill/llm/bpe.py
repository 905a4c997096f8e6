"""Byte-level BPE: text to token ids with tiktoken and a local rank file, and back to raw bytes.

Defined cases: a null text counts as the empty text and has no ids; equal rows give equal rows;
an empty table gives an empty table; other columns of the input are not read, so their names
cannot clash. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .staging import small_batches

#: Longer texts are cut before a space that follows a letter, digit, dot or comma. No match of the
#: pre-splitting pattern runs from a non-space into a following space, so ids do not change.
PIECE_CHARS = 1 << 16
SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9.,])(?= )")
#: Bytes of text, and ids, that are Python objects at one time.
BATCH_BYTES, BATCH_IDS = 1 << 20, 1 << 18


def load_ranks(path: str) -> bytes:
    """The rank file's content, read on the driver and shipped to tasks (under 1 MB)."""
    with open(path, "rb") as file:
        return file.read()


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in parts of about `size` characters; a stretch without a safe cut stays whole."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


_ENCODINGS: dict[tuple[int, str], object] = {}


def encoding(ranks: bytes, pattern: str):
    """One tiktoken encoding per worker process."""
    key = (hash(ranks), pattern)
    if key not in _ENCODINGS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text) for i in enc.encode_ordinary(part)]


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)  # a fixed vocabulary, under 1 MB
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoding(shipped.value, pattern)
        for batch in batches:
            for part in textops.slices(batch, 1, BATCH_BYTES):
                rows = [np.array(encode_text(enc, text or ""), np.int32) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int32()))], ["id", "ids"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """The input's id and ids with `decoded`, the raw bytes of the ids."""
    shipped = encoded.sparkSession.sparkContext.broadcast(ranks)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoding(shipped.value, pattern)
        for batch in batches:
            for part in textops.slices(batch, 1, BATCH_IDS):
                raw = [enc.decode_bytes(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], ["id", "ids", "decoded"])

    picked = encoded.select(F.col(id_col).alias("id"), F.col("ids"))
    return picked.mapInArrow(run, f"id {id_type}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, ids if asked for, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded in one worker.

    Ids and bytes are hashed part by part, so a long text never stands whole in ids, digits and bytes at once.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)  # a fixed vocabulary, under 1 MB
    id_type = docs.schema[id_col].dataType.simpleString()

    def one(enc, text: str):
        ids_hash, bytes_hash, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
        for part in pieces(text):
            ids = enc.encode_ordinary(part)
            if ids:
                ids_hash.update((" " * bool(n) + " ".join(map(str, ids))).encode())
                bytes_hash.update(enc.decode_bytes(ids))
                n += len(ids)
                if with_ids:
                    kept.append(np.array(ids, np.int32))
        return np.concatenate(kept) if kept else np.zeros(0, np.int32), n, ids_hash.hexdigest(), bytes_hash.hexdigest()

    def run(batches):
        enc = encoding(shipped.value, pattern)
        for batch in batches:
            for part in textops.slices(batch, 1, BATCH_BYTES):
                ids, n, ids_sha, bytes_sha = zip(*(one(enc, text or "") for text in part.column(1).to_pylist()))
                out = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]
                out += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(out, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
