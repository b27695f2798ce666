"""Language-model scores of whole texts by a causal self-attention model in numpy.

The model reads subword ids of a public byte-level BPE, word by word in lower case, and
predicts a class of the next id: frequent ids are classes of their own, the rest share classes
of about equal mass, inside which an id has its corpus share. A class's chance is that of its kind
(word beginnings and the end, or the rest) times its own inside the kind, so that an id costs the
classes of one kind. Logits of kinds and classes are the log bigram shares of the whole training
corpus plus what one masked attention head reads from its context.
Texts are cut into windows of QUERIES ids with CONTEXT ids before them, so windows overlap and
every id is scored once.

A word's chance is its ids' chance and that of ending behind them; it is mixed with the word's
own corpus share where the word is known, so that words known as a whole need not be
spelt; the shares of rare words are joined to their places, those of frequent ones are held by
every task; the text's chance is the mean over several weights of that mixture. Both parts are chances over words and the end, so the score is a log chance of the text.

What is learnt from the corpus grows with it: word and bigram counts cover every training
text, and the attention weights are fitted by local Adam steps in every task, then averaged
over tasks, for ROUNDS rounds. A round takes every STRIDE-th window of every training text;
STRIDE equals ROUNDS, so that the rounds together take every window once.

Defined results: a null or empty text is its end alone; every input row gives one row,
repeated rows alike; without training texts the base is 0 and ids are equally likely; a null
id belongs to the fold of the empty text.
"""

from __future__ import annotations

import base64
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import Bounded, fold, lowered, saved, with_columns, worker_cache

FREQUENT = 200_000  # words whose counts every task holds at most; rarer ones are joined
FLUSH = 300_000  # distinct words that a task counts before it hands them on
SINGLES, SHARED = 240, 8  # classes of one id; shared classes of word beginnings and of the rest each
INPUTS = 2048  # ids with an embedding of their own
WIDTH, QUERIES, CONTEXT = 16, 32, 16
CHUNK = 64  # windows of a training step
SCORED = 32  # windows scored at once, few enough that their logits stay in a core's cache
STEEP = 60.0  # logits end here, far above any fitted value, so that exp stays finite
STRIDE, ROUNDS, RATE = 2, 2, 0.02
MIXED = (0.1, 0.3, 0.6, 0.9, 0.98)
PRIOR = 5.0  # pseudo-counts of a bigram row


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def subwords(path: str):
    """Word (bytes) -> its ids as little-endian 16-bit integers; a space marks the word's start."""
    def make():
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def ids(word: bytes) -> bytes:  # a word of letters is one piece of the pattern
            found = model._encode_single_piece(b" " + word) if word.isalpha() else model.encode_ordinary(" " + word.decode())
            return struct.pack(f"<{len(found)}H", *found)

        return Bounded(ids, 250_000)

    return worker_cache(f"subwords {path}", make)


def vocabulary(path: str) -> np.ndarray:
    """Whether an id starts a word, by id."""
    with open(path, "rb") as file:
        ranks = [(int(b), base64.b64decode(a)[:1] == b" ") for a, b in map(bytes.split, file)]
    out = np.zeros(max(r for r, _ in ranks) + 1, bool)
    for rank, starts in ranks:
        out[rank] = starts
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; counted in the task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(lowered(text).split())
                if len(seen) > FLUSH:
                    yield flushed()
                    seen.clear()
        yield flushed()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bigram_counts(words: DataFrame, path: str) -> DataFrame:
    """(before, id, n) inside words; before is -1 at a word's start, id is -1 at its end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = subwords(path)
        for batch in batches:
            texts, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            ids = [np.frombuffer(ids_of[w], "<u2") for w in texts]
            size = np.array([len(i) + 1 for i in ids], dtype=int)
            edge = np.full(1, -1)
            before = np.concatenate([np.zeros(0, int), *(np.concatenate([edge, i]) for i in ids)])
            after = np.concatenate([np.zeros(0, int), *(np.concatenate([i, edge]) for i in ids)])
            pair, at = np.unique(before * 65536 + after, return_inverse=True)
            total = np.bincount(at, np.repeat(n, size), len(pair)).astype(np.int64)
            before, after = (pair + 1) // 65536, (pair + 1) % 65536 - 1
            yield pa.RecordBatch.from_arrays([pa.array(before), pa.array(after), pa.array(total)], ["before", "id", "n"])

    made = words.mapInArrow(run, "before long, id long, n long")
    return made.groupBy("before", "id").agg(F.sum("n").alias("n"))


@dataclass
class Kinds:
    """The classes of the rest (kind 0) and of word beginnings and the end (kind 1), and their bigram shares."""

    kind: np.ndarray  # class -> kind
    place: np.ndarray  # class -> place among the classes of its kind
    classes: list[np.ndarray]  # of each kind
    stem: np.ndarray  # row x kind, ln share
    leaves: list[np.ndarray]  # of each kind: row x place, ln share inside the kind


def kinds_of(bigram: np.ndarray, begins: np.ndarray) -> Kinds:
    kind = (begins > 0).astype(np.uint8)
    classes, place = [np.flatnonzero(kind == k) for k in (0, 1)], np.empty(len(kind), int)
    stem, leaves = np.full((len(bigram), 2), -1e9, bigram.dtype), []
    for k, own in enumerate(classes):
        place[own] = np.arange(len(own))
        if len(own):
            stem[:, k] = np.logaddexp.reduce(bigram[:, own], 1)
        leaves.append(np.ascontiguousarray(bigram[:, own] - stem[:, k : k + 1]))
    return Kinds(kind, place, classes, stem, leaves)


@dataclass
class Model:
    """Tables by id (with the end and the start of a text as the last two ids), and the weights."""

    row: np.ndarray  # id -> embedding and bigram row
    group: np.ndarray  # id -> class
    inside: np.ndarray  # id -> ln share inside its class
    bigram: np.ndarray  # row x class, ln
    weights: dict[str, np.ndarray]
    begins: np.ndarray  # class -> 1 if its ids start a word or are the end

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What rows ask and what they are, and the place term with the causal mask.

        A query is taken to the keys' embeddings, so that these are keys and values at once. They
        carry a one that sums up the weights; a last row of zeros stands for no key.
        """
        w = self.weights
        near = np.where(AGE < 0, np.float32(-1e9), np.clip(w["near"][np.maximum(AGE, 0)], -30, 30))
        query = w["embed"] @ (np.float32(WIDTH**-0.5) * w["query"] @ w["key"].T)
        return np.vstack([query, np.zeros((1, WIDTH), query.dtype)]), with_ones(w["embed"]), near

    @cached_property
    def kinds(self) -> Kinds:
        return kinds_of(self.bigram, self.begins)

    @property
    def end(self) -> int:
        return len(self.row) - 2


def with_ones(embed: np.ndarray) -> np.ndarray:
    """Embeddings with a one behind each, and a last row of zeros."""
    out = np.zeros((len(embed) + 1, WIDTH + 1), embed.dtype)
    out[:-1, :WIDTH], out[:-1, WIDTH] = embed, 1
    return out


def grouped(unigram: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, class, ln share) of each id, the end and the start of a text last."""
    size = len(unigram)
    order = np.lexsort((np.arange(size), -unigram))
    group, inside = np.zeros(size + 2, int), np.zeros(size + 2)
    group[order[:SINGLES]] = np.arange(min(SINGLES, size))
    at = SINGLES
    for kind in (True, False):
        rest = order[SINGLES:][starts[order[SINGLES:]] == kind]
        mass = unigram[rest] + 0.1
        cut = np.minimum((np.cumsum(mass) - mass) * SHARED // max(mass.sum(), 1e-9), SHARED - 1).astype(int)
        group[rest] = at + cut
        inside[rest] = np.log(mass / np.bincount(cut, mass, SHARED)[cut])
        at += SHARED
    group[size:] = at
    row = INPUTS + group
    row[order[:INPUTS]] = np.arange(min(INPUTS, size))
    row[size + 1] = INPUTS + at + 1
    return row, group, inside


def bigram_table(cells: np.ndarray, boundary: np.ndarray, first: np.ndarray, texts: int) -> np.ndarray:
    """ln share of the next class by row: inside a word, or its end followed by any beginning.

    cells[row, class] counts inside words, boundary[row] word ends, first[class] word starts.
    """
    begin = np.append(first, texts) + 0.1
    begin /= begin.sum()
    table = np.hstack([cells, np.zeros((len(cells), 1))]) + boundary[:, None] * begin
    table[-1] = begin * max(texts, 1)
    overall = table.sum(0) + 0.01
    return np.log((table + PRIOR * overall / overall.sum()) / (table.sum(1, keepdims=True) + PRIOR)).astype(np.float32)


def fresh_weights(rows: int, classes: int) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(5)
    shapes = {"embed": (rows, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH)}
    made = {k: (draw.normal(0, 0.3, s)).astype(np.float32) for k, s in shapes.items()}
    zeros = {"near": QUERIES + CONTEXT, "out": (WIDTH, classes), "stem": (WIDTH, 2)}
    return made | {k: np.zeros(s, np.float32) for k, s in zeros.items()}


def windows(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, valid) of the windows over ``size`` positions: window w asks from w * QUERIES on."""
    at = np.arange(0, size, QUERIES)[:, None] + np.arange(-CONTEXT, QUERIES)[None, :]
    return np.clip(at, 0, size - 1), (at >= 0) & (at < size)


AGE = np.arange(QUERIES)[:, None] + CONTEXT - np.arange(QUERIES + CONTEXT)[None, :]  # of a key, for a query


def log_chances(model: Model, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln p of each id, and of any word's start or the end at its place.

    ids are the texts' ids, one after the other, each text closed by the end; ``sizes`` count them.
    """
    query, key, near = model.tables()
    none, kinds, value = len(key) - 1, model.kinds, model.weights["value"]  # the last row counts for nothing
    starts = np.cumsum(sizes) - sizes
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[starts] = model.end + 1
    count = -(-sizes // QUERIES)
    first = np.cumsum(count) - count  # window of each text
    slot = np.arange(len(ids)) + np.repeat(first * QUERIES - starts, sizes)
    keys = np.full((int(count.sum()), CONTEXT + QUERIES), none)
    asked = np.full(len(keys) * QUERIES, none)
    rows, target = model.row[before], model.group[ids]
    asked[slot] = rows
    asked = asked.reshape(-1, QUERIES)
    keys[:, CONTEXT:] = asked
    keys[1:, :CONTEXT] = asked[:-1, QUERIES - CONTEXT :]
    keys[first, :CONTEXT] = none
    kind, place = kinds.kind[target], kinds.place[target]
    stem_weights, out_weights = value @ model.weights["stem"], value @ model.weights["out"]
    steep = steepest(model.weights["embed"], stem_weights, out_weights) > STEEP
    out_weights = [np.ascontiguousarray(out_weights[:, own]) for own in kinds.classes]
    out, edge = np.empty(len(ids)), np.empty(len(ids))
    share = np.empty((SCORED, QUERIES, CONTEXT + QUERIES), np.float32)
    cuts = np.searchsorted(slot, np.arange(0, len(keys) + SCORED, SCORED) * QUERIES).tolist()
    for number, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        r = keys[number * SCORED : (number + 1) * SCORED]
        k, weight = key.take(r, 0), share[: len(r)]
        np.matmul(query.take(r[:, CONTEXT:], 0), k[:, :, :WIDTH].transpose(0, 2, 1), out=weight, casting="same_kind")
        weight += near
        np.exp(weight, out=weight)
        own = kind[low:high]
        at = low + np.argsort(own, kind="stable")
        read = flat(weight @ k).take(slot[at] - number * SCORED * QUERIES, 0)
        read = read[:, :WIDTH] / read[:, WIDTH:]
        row, wanted = rows[at], place[at]
        stem = read @ stem_weights
        stem += kinds.stem.take(row, 0)
        if steep:
            np.minimum(stem, STEEP, out=stem)
        stem = stem - np.log(np.exp(stem) @ np.ones(2, stem.dtype))[:, None].astype(float)
        edge[at] = stem[:, 1]
        for b, low, high in parts(len(own) - int(own.sum()), len(own)):
            logit = read[low:high] @ out_weights[b]
            logit += kinds.leaves[b].take(row[low:high], 0)
            if steep:
                np.minimum(logit, STEEP, out=logit)
            hit = logit[np.arange(high - low), wanted[low:high]].astype(float)
            np.exp(logit, out=logit)
            total = logit @ np.ones(logit.shape[1], logit.dtype)
            out[at[low:high]] = stem[low:high, b] + hit - np.log(np.maximum(total, 1e-30))
    out += model.inside[ids]
    return out, edge


def steepest(embed: np.ndarray, *weights: np.ndarray) -> float:
    """Bounds every logit: what is read is a mean of embeddings, and ln shares are below 0."""
    return np.abs(embed).max(initial=0) * max(np.abs(w).sum(0).max() for w in weights)


def parts(first: int, size: int) -> list[tuple[int, int, int]]:
    """(kind, from, to) of the kinds that occur, of ``size`` sorted rows with ``first`` of kind 0."""
    return [p for p in ((0, 0, first), (1, first, size)) if p[1] < p[2]]


def text_chances(
    model: Model, ids: np.ndarray, sizes: np.ndarray, first: np.ndarray, shares: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(ln p of each text for each weight in MIXED, ln p of each word as spelt).

    ``first`` are the places of word starts and ends of texts, ``shares`` the ln shares of these
    words in the corpus, -inf for words that are not frequent; see with_share() for these.
    """
    out, edge = log_chances(model, ids, sizes)
    out[first] -= edge[first]
    spelt = np.add.reduceat(out, first)
    closed = model.end != ids[first]
    spelt[closed] += edge[first[np.flatnonzero(closed) + 1]]  # a word ends where the next unit starts
    texts = np.searchsorted(first, np.cumsum(sizes) - sizes)
    each = [np.add.reduceat(np.logaddexp(np.log(1 - m) + spelt, np.log(m) + shares), texts) for m in MIXED]
    return np.array(each), spelt


def with_share(weight: float, share: Column, spelt: Column) -> Column:
    """What a word's ln share adds to ln((1 - weight) * spelt) when it is mixed in."""
    more = F.lit(float(np.log(weight / (1 - weight)))) + share - spelt
    return F.greatest(more, F.lit(0.0)) + F.log1p(F.exp(-F.abs(more)))


def mean_chance(each: list[Column]) -> Column:
    """ln of the mean of chances given as ln."""
    most = F.greatest(*each)
    return most + F.log(sum((F.exp(e - most) for e in each), F.lit(0.0)) / len(each))


def gradient(model: Model, rows: np.ndarray, valid: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss over the valid queries of a batch of windows, by weight."""
    w, scale, kinds = model.weights, np.float32(WIDTH**-0.5), model.kinds
    both = w["query"] @ w["key"].T * scale
    rows = np.where(valid, rows, len(w["embed"]))  # its last row counts for nothing
    x = with_ones(w["embed"]).take(rows, 0)
    key, asked = x[:, :, :WIDTH], np.ascontiguousarray(x[:, CONTEXT:, :WIDTH])
    query = (flat(asked) @ both).reshape(asked.shape)
    near = w["near"][np.maximum(AGE, 0)]
    share = query @ key.transpose(0, 2, 1)
    steep = max(share.max(), -share.min()) + np.abs(near).max() > STEEP
    share += np.where(AGE < 0, near.dtype.type(-1e9), near)
    if steep:
        share -= share.max(2, keepdims=True)
    np.exp(share, out=share)
    read = flat(share @ x)
    # the valid queries, by kind of what they have to find
    at = np.flatnonzero(valid[:, CONTEXT:])
    found = target.ravel()[at]
    own = kinds.kind[found]
    order = np.argsort(own, kind="stable")
    at, own, found = at[order], own[order], found[order]
    row, wanted, size = rows[:, CONTEXT:].ravel()[at], kinds.place[found], len(at)
    read = read.take(at, 0)
    whole = read[:, WIDTH:]
    read = read[:, :WIDTH] / whole
    stem_weights, out_weights = w["value"] @ w["stem"], w["value"] @ w["out"]
    clip = steepest(w["embed"], stem_weights, out_weights) > STEEP
    stem = read @ stem_weights
    stem += kinds.stem.take(row, 0)
    slope(stem, own, size, clip)
    d_read, for_stem, for_out = stem @ stem_weights.T, read.T @ stem, np.zeros_like(out_weights)
    for b, low, high in parts(size - int(own.sum()), size):
        mine = np.ascontiguousarray(out_weights[:, kinds.classes[b]])
        logit = read[low:high] @ mine
        logit += kinds.leaves[b].take(row[low:high], 0)
        slope(logit, wanted[low:high], size, clip)
        d_read[low:high] += logit @ mine.T
        for_out[:, kinds.classes[b]] = read[low:high].T @ logit
    # shares were not divided by their sum, so what comes back is; the last column takes off its mean
    back = np.zeros((target.size, WIDTH + 1), d_read.dtype)
    d_read /= whole
    back[at, :WIDTH] = d_read
    back[at, WIDTH] = -np.einsum("nd,nd->n", d_read, read)
    back = back.reshape(*target.shape, WIDTH + 1)
    d_score = back @ x.transpose(0, 2, 1)
    d_score *= share
    d_query = flat(d_score @ key)
    d_x = share.transpose(0, 2, 1) @ back[:, :, :WIDTH]
    d_x += d_score.transpose(0, 2, 1) @ query
    d_x[:, CONTEXT:] += (d_query @ both.T).reshape(query.shape)
    cell = (rows * WIDTH)[:, :, None] + np.arange(WIDTH)
    embed = np.bincount(cell.ravel(), d_x.ravel(), w["embed"].size + WIDTH)[: w["embed"].size]
    d_both = flat(asked).T @ d_query * scale
    return {
        "embed": embed.reshape(w["embed"].shape).astype(d_x.dtype), "query": d_both @ w["key"], "key": d_both.T @ w["query"],
        "value": for_stem @ w["stem"].T + for_out @ w["out"].T, "out": w["value"].T @ for_out, "stem": w["value"].T @ for_stem,
        "near": np.bincount(np.maximum(AGE, 0).ravel(), (d_score.sum(0) * (AGE >= 0)).ravel(), QUERIES + CONTEXT).astype(np.float32),
    }


def flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


def slope(logits: np.ndarray, hit: np.ndarray, size: int, clip: bool) -> None:
    """Turns logits into what the mean loss of ``size`` rows changes by; ``hit`` is the column that came."""
    if clip:
        np.minimum(logits, STEEP, out=logits)
    np.exp(logits, out=logits)
    logits *= (1 / (logits @ np.full(logits.shape[1], size, logits.dtype)))[:, None]
    logits.ravel()[np.arange(len(logits)) * logits.shape[1] + hit] -= logits.dtype.type(1 / max(size, 1))


class Trainer:
    """Adam on batches of windows, as they fill up."""

    def __init__(self, model: Model):
        self.model = replace(model, weights={k: v.copy() for k, v in model.weights.items()})
        self.model.kinds = model.kinds
        self.first = {k: np.zeros_like(v) for k, v in model.weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in model.weights.items()}
        self.step, self.seen, self.held, self.waiting = 0, 0, 0, []

    def add(self, ids: np.ndarray, phase: int) -> None:
        """Take every STRIDE-th window of a text, from ``phase`` on."""
        m, size = self.model, -(-len(ids) // QUERIES) * QUERIES
        if size > phase * QUERIES:
            # as windows() has them
            line, target = np.full(size, -1), np.full(size, m.end)
            line[0], line[1 : len(ids)], target[: len(ids)] = m.end + 1, ids[:-1], ids
            line = line.reshape(-1, QUERIES)
            keys = np.full((len(line), CONTEXT + QUERIES), -1)
            keys[:, CONTEXT:], keys[1:, :CONTEXT] = line, line[:-1, QUERIES - CONTEXT :]
            keys = keys[phase::STRIDE]
            self.waiting.append((m.row[keys], keys >= 0, m.group[target].reshape(-1, QUERIES)[phase::STRIDE]))
            self.held += len(keys)
            if self.held >= CHUNK:
                self.learn()

    def learn(self) -> None:
        if not self.waiting:
            return
        rows, valid, target = (np.concatenate(a) for a in zip(*self.waiting, strict=True))
        self.held, self.waiting = 0, []
        self.seen += int(valid[:, CONTEXT:].sum())
        self.step += 1
        for k, g in gradient(self.model, rows, valid, target).items():
            first, second = self.first[k], self.second[k]
            first *= 0.9
            first += 0.1 * g
            second *= 0.99
            np.multiply(g, g, out=g)
            g *= 0.01
            second += g
            rise = np.sqrt(second)
            rise *= (1 - 0.99**self.step) ** -0.5
            rise += 1e-8
            np.divide(first, rise, out=rise)
            rise *= RATE / (1 - 0.9**self.step)
            self.model.weights[k] -= rise


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, ids): the ids as 16-bit integers, without the end; made once for all passes."""
    def per_batch(batch: pa.RecordBatch):
        ids_of = subwords(path)
        return ([b"".join(map(ids_of.__getitem__, lowered(t).split())) for t in batch.column("text").to_pylist()],)

    return with_columns(docs.select("doc_id", "text"), {"ids": T.BinaryType()}, per_batch)


def phase_of(phase: int, number: int) -> int:
    """The first window that round ``number`` takes of a text."""
    return (phase + number * (STRIDE // ROUNDS)) % STRIDE


def closed_ids(raw: bytes, end: int) -> np.ndarray:
    return np.append(np.frombuffer(raw, "<u2").astype(np.int64), end)


def averaged_round(docs: DataFrame, model: Model, number: int) -> dict[str, np.ndarray]:
    """Local training in every task, then the mean of the weights by windows seen, summed in Spark."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(shared.value)
        for batch in batches:
            for raw, phase in zip(batch.column("ids").to_pylist(), batch.column("phase").to_pylist(), strict=True):
                trainer.add(closed_ids(raw, trainer.model.end), phase_of(phase, number))
        trainer.learn()
        if trainer.seen:
            flat = np.concatenate([v.ravel() for v in trainer.model.weights.values()]).astype(float) * trainer.seen
            place = np.arange(len(flat), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(flat), pa.array(np.full(len(flat), trainer.seen))], ["place", "part", "seen"])

    local = docs.select("ids", fold(F.col("doc_id"), STRIDE).cast("int").alias("phase"))
    local = local.mapInArrow(run, "place int, part double, seen long")
    mean = local.groupBy("place").agg((F.sum("part") / F.sum("seen")).alias("mean")).collect()  # as many rows as weights
    if not mean:
        return model.weights
    flat = np.zeros(sum(v.size for v in model.weights.values()), np.float32)
    flat[[r["place"] for r in mean]] = [r["mean"] for r in mean]
    cuts = np.cumsum([v.size for v in model.weights.values()])[:-1]
    return {k: p.reshape(v.shape) for (k, v), p in zip(model.weights.items(), np.split(flat, cuts), strict=True)}


def learn_model(docs: DataFrame, words: DataFrame, texts: int, path: str) -> Model:
    pairs = saved(bigram_counts(words, path), "bigrams")
    starts = vocabulary(path)
    unigram = np.zeros(len(starts))
    for r in pairs.where("id >= 0").groupBy("id").agg(F.sum("n").alias("n")).collect():  # bounded by the vocabulary
        unigram[r["id"]] = r["n"]
    row, group, inside = grouped(unigram, starts)
    classes = int(group.max()) + 1
    begins = np.zeros(classes, np.float32)
    begins[group[:-2][starts]] = begins[-1] = 1

    def cells(batches):
        for frame in batches:
            frame["row"] = np.where(frame["before"] < 0, -1, row[frame["before"]])
            frame["group"] = np.where(frame["id"] < 0, -1, group[frame["id"]])
            yield frame.groupby(["row", "group"], as_index=False)["n"].sum()

    table = np.zeros((int(row.max()) + 1, classes - 1))
    boundary, first = np.zeros(len(table)), np.zeros(classes - 1)
    summed = pairs.mapInPandas(cells, "row long, group long, n long").groupBy("row", "group").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # bounded by rows x classes
        if r["row"] < 0:
            first[r["group"]] += r["n"]
        elif r["group"] < 0:
            boundary[r["row"]] += r["n"]
        else:
            table[r["row"], r["group"]] += r["n"]
    model = Model(row, group, inside, bigram_table(table, boundary, first, texts), fresh_weights(len(table), classes), begins)
    for number in range(ROUNDS):
        model.weights = averaged_round(docs, model, number)
    return model


def frequent_words(words: DataFrame) -> tuple[int, dict[bytes, int]]:
    """(bound, counts of the words that reach it), at most FREQUENT words."""
    level = F.floor(F.log2("n") * 4)
    steps = words.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect()
    bound, total = 2**62, 0
    for r in sorted(steps, key=lambda r: -r["level"]):
        total += r["k"]
        if total > FREQUENT:
            break
        bound = r["least"]
    return bound, {bytes(r["word"]): r["n"] for r in words.where(F.col("n") >= bound).collect()}


def score_texts(docs: DataFrame, folds: int = 10, held: int = 0, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs."""
    path = path or tokenizer_path()
    docs = saved(tokenised(docs, path), "subword-ids")
    train = docs.where(fold(F.col("doc_id"), folds) != held)
    words = saved(word_counts(train), "word-counts")
    texts = train.select("doc_id").count()
    kinds, running = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, kinds = running + texts, kinds + (texts > 0)
    low = float(np.log10(total + 0.1 * (kinds + 1)))
    model = learn_model(train, words, texts, path)
    bound, common = frequent_words(words)
    context = docs.sparkSession.sparkContext
    known = context.broadcast({w: float(np.log10(n + 0.1)) - low for w, n in common.items()})
    shared = context.broadcast(model)
    ending = float(np.log10(texts + 0.1)) - low
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (
        ("row", T.LongType()), ("n_tokens", T.LongType()), ("n_common", T.LongType()), ("n_rare", T.LongType()),
        ("common", T.DoubleType()), ("mixed", T.ArrayType(T.DoubleType())),
        ("rare", T.ArrayType(T.BinaryType())), ("spelt", T.ArrayType(T.DoubleType())),
    ))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, model = known.value, shared.value
        begins = np.append(vocabulary(path), True)
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, len(whole), 256)):
                ids, first, shares, stats, size = [], [], [], [], 0
                for text, raw in zip(batch.column("text").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    split, own = lowered(text).split(), closed_ids(raw, model.end)
                    ids.append(own)
                    first.append(np.flatnonzero(begins[own]) + size)
                    size += len(own)
                    found = [*map(logs.get, split), ending]
                    rare = [w for w, x in zip(split, found) if x is None]
                    share = np.array([-np.inf if x is None else x for x in found]) if rare else np.array(found)
                    shares.append(share)
                    base = share[share > -np.inf].sum()
                    stats.append((row, len(found), len(split) - len(rare), len(rare), base, rare))
                    row += 1
                sizes = np.array([len(i) for i in ids], dtype=int)
                mixed, spelt = text_chances(
                    model, np.concatenate(ids), sizes, np.concatenate(first), np.concatenate(shares) * np.log(10)
                )
                cuts = np.cumsum([len(s) for s in shares])[:-1]
                spelt = [p[s == -np.inf] for p, s in zip(np.split(spelt, cuts), shares, strict=True)]
                row_, *numbers, rare = zip(*stats, strict=True)
                columns = [
                    batch.column("doc_id"), pa.array(row_), *map(pa.array, numbers), pa.array(list(mixed.T), pa.list_(pa.float64())),
                    pa.array(rare, pa.list_(pa.binary())), pa.array(spelt, pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    made = saved(docs.mapInArrow(run, schema), "lm-scores")
    rare = made.where("n_rare > 0").select("row", F.explode(F.arrays_zip("rare", "spelt")).alias("r"))
    rare = rare.select("row", F.col("r.rare").alias("word"), F.col("r.spelt").alias("spelt"))
    share = F.log10(F.col("n") + 0.1) - low
    gains = [F.sum(with_share(m, share * float(np.log(10)), F.col("spelt"))).alias(f"gain{i}") for i, m in enumerate(MIXED)]
    found = rare.join(words.where(F.col("n") < bound), "word").groupBy("row").agg(F.count("*").alias("met"), F.sum(share).alias("sum"), *gains)
    base = F.col("common") + F.coalesce("sum", F.lit(0.0)) + (F.col("n_rare") - F.coalesce("met", F.lit(0))) * (-1.0 - low)
    score = mean_chance([F.col("mixed")[i] + F.coalesce(f"gain{i}", F.lit(0.0)) for i in range(len(MIXED))])
    return made.drop("rare", "spelt").join(found, "row", "left").select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens",
        (F.col("n_common") + F.coalesce("met", F.lit(0)) + F.lit(int(texts > 0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), (score / float(np.log(10))).alias("score"),
    )
