"""Best-fit packing of tokenized documents under several capacities.

A sequence has a capacity in tokens, in documents and in attention cost (sum of squared
lengths). Pieces go, longest first, to the open sequence that can hold them in every
dimension and keeps the smallest weighted norm of what is then left (vector best fit).
Pieces are dealt to groups of about GROUP_ROWS, packed one task per group; a group loses a
fraction of a sequence at its end, whatever the size of the corpus.

Defined results: a null or empty text is one piece of the closing id alone; repeated rows are
packed each on their own; an empty table gives no rows; only texts longer than a sequence are
cut, the remainder first.
"""

from __future__ import annotations

import base64
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Bounded, saved, small_batches, worker_cache

TOKENS = 2048
DOCUMENTS = 2048  # per sequence; as many as tokens, so that by default it never binds
ATTENTION = TOKENS * TOKENS  # of squared lengths; never binds by default
WEIGHTS = (1.0, 0.01, 0.01)  # tokens, documents, attention
GROUP_ROWS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# fixed values: white space of the tokenizer's splitting pattern (Unicode White_Space)
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"  # a token never reaches over the end of such a part


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """text -> its ids as little-endian 32-bit integers; parts seen before come from a cache.

    Beside the tokenizer's file lies the same vocabulary as ranks, whose library encodes a new
    part faster to equal ids; parts that hold a special token's text take the tokenizer itself.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    special = [t.content for t in model.get_added_tokens_decoder().values()]
    quick = ranked(path.replace(".json", ".tiktoken"))

    def encode(part: str) -> bytes:
        if quick and not any(t in part for t in special):
            return np.array(quick.encode_ordinary(part), "<u4").tobytes()
        return np.array(model.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    known, parts = Bounded(encode, 250_000), re.compile(CUT).findall
    return lambda text: b"".join(map(known.__getitem__, parts(text)))


def ranked(path: str):
    """The vocabulary's ranks as an encoder, or None where there is no such file."""
    import public_tokenizers
    import tiktoken

    if not os.path.exists(path):
        return None
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(docs: DataFrame, path: str | None = None, longest: int = TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, in pieces of at most ``longest`` ids."""
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_cache(f"encoder {path}", lambda: encoder(path))
        size = longest * 4
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for at, text in enumerate(batch.column("text").to_pylist()):
                raw = encode(text or "") + b"\0\0\0\0"
                first = len(raw) % size or size
                cuts = [0, *range(first, len(raw) + 1, size)]
                rows += [(at, n, a // 4, (b - a) // 4, zlib.crc32(raw[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            owner, *rest = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
            rest[0] = rest[0].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner)), *map(pa.array, rest)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES.replace("doc_id long", f"doc_id {kind}"))


def best_fit(
    lengths: np.ndarray, tokens: int | None = None, documents: int | None = None, attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length; lengths come in decreasing order, each within the capacities."""
    given = zip((tokens, documents, attention), (TOKENS, DOCUMENTS, ATTENTION), strict=True)
    full = np.array([d if c is None else c for c, d in given], float)
    if len(lengths) and ((np.array([lengths.max(), 1, float(lengths.max()) ** 2])) > full).any():
        raise ValueError("a piece is above a capacity of an empty sequence")
    weight = np.array(weights)
    left, names = np.empty((3, 1024)), np.empty(1024, np.int64)
    where, offset, made, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0, 0
    least = lengths.min() if len(lengths) else 0
    for at, length in enumerate(lengths):
        need = np.array([length, 1, float(length) ** 2])
        fits = np.flatnonzero((left[:, :used] >= need[:, None]).all(0))
        if len(fits):
            rest = (left[:, fits] - need[:, None]) / full[:, None]
            slot = fits[np.argmin(weight @ rest**2)]
        else:
            if used == len(names):
                left, names = np.hstack([left, np.empty_like(left)]), np.append(names, np.empty_like(names))
            slot, left[:, used], names[used] = used, full, made
            used, made = used + 1, made + 1
        where[at], offset[at] = names[slot], full[0] - left[0, slot]
        left[:, slot] -= need
        if left[0, slot] < least or left[1, slot] < 1:  # full: the last open one takes its place
            used -= 1
            left[:, slot], names[slot] = left[:, used], names[used]
    return where, offset


def pack(
    docs: DataFrame, path: str | None = None, tokens: int = TOKENS, documents: int | None = None,
    attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS,
) -> DataFrame:
    """pieces() with sequence_id and offset; a text is cut where one piece would break a capacity."""
    longest = min(tokens, tokens if attention is None else math.isqrt(attention))
    if longest < 1 or documents is not None and documents < 1:
        raise ValueError("a sequence holds at least one document of one token")
    documents = max(DOCUMENTS, tokens) if documents is None else documents
    attention = max(ATTENTION, tokens**2) if attention is None else attention
    made = saved(pieces(docs, path, longest), "pieces")
    groups = max(1, -(-made.count() // GROUP_ROWS))
    dealt = made.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        where, offset = best_fit(group["length"].to_numpy(), tokens, documents, attention, weights)
        group["sequence_id"] = where + (group["__group"].to_numpy() << 32)
        group["offset"] = offset
        return group.drop(columns="__group")

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"{PIECES}, sequence_id long, offset long".replace("doc_id long", f"doc_id {kind}")
    return dealt.groupBy("__group").applyInPandas(packed, schema)
