"""Divergence audit of sources: how far the words of a source lie from those of others.

A translate table lowers letters and blanks separators in one pass over the bytes of a text,
bytes.split() gives the terms, and a Counter per document their counts; a task adds up
counts and document numbers of each (language, source, term) it meets before Spark does. Shares
are whole billionths with one added to each count, and the divergence of two shares is
floor((p - q)^2 / q), so every number is exact.

Only terms that occur are stored. The comparison of sources works on blocks of terms of one
language: a task holds the counts of BLOCK_TERMS terms or so in every source, adds up the
divergences of all pairs of sources over its block, and Spark adds up the blocks; a language of a
third of the corpus is many blocks. Terms are ranked in the language's sources with
Spark's own window, which keeps the ranks asked for before the shuffle.

Defined results: null text, language and source count as empty; a group without terms still
takes part, with every kept term at count 0; repeated rows count each; without kept terms pairs
have value 0 and there are no terms; texts are read whole; a table without rows gives none; other
columns are not read. Shares need fewer than 2^63 occurrences.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import saved, small_batches

BILLION = 1_000_000_000
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in LETTERS else 32 for c in range(256))
HELD_TERMS = 200_000  # of a task before it hands its counts on
BLOCK_TERMS = 2_000


def terms_of(text: str | None) -> Counter:
    """Counts of the terms of one text, as UTF-8."""
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(TABLE).split())


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, docs, n) of a task, handed on whenever many terms are held."""
    docs, total, size = defaultdict(Counter), defaultdict(Counter), 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            found, key = terms_of(text), (lang, source)
            before = len(docs[key])
            docs[key].update(found.keys())
            total[key].update(found)
            size += len(docs[key]) - before
            if size > HELD_TERMS:
                yield from drained(docs, total)
                size = 0
    yield from drained(docs, total)


def drained(docs: dict, total: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), seen in docs.items():
        names = ["lang", "source", "term", "docs", "n"]
        terms = pa.array([t.decode("utf-8", "surrogatepass") for t in seen], pa.string())
        times = total[lang, source]
        sides = [pa.array([v] * len(seen), pa.string()) for v in (lang, source)]
        numbers = [pa.array([c[t] for t in seen], pa.int64()) for c in (seen, times)]
        yield pa.RecordBatch.from_arrays([*sides, terms, *numbers], names=names)
    docs.clear()
    total.clear()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n) of every term that occurs."""
    small_batches(docs.sparkSession)
    found = named(docs).mapInArrow(counted, "lang string, source string, term string, docs long, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def part(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + size)), exact."""
    above = F.lit(BILLION).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.call_function("div", above, (total + size).cast("decimal(19,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    d = (p - q).cast("decimal(19,0)")
    return F.call_function("div", d * d, q.cast("decimal(19,0)"))


def pair_sums(counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """(lang, source, other, value): divergences of all pairs of sources over one block's terms."""
    names = groups["source"].tolist()
    out = {"lang": [], "source": [], "other": [], "value": []}
    if counts.empty or len(names) < 2:
        return pd.DataFrame(out, dtype=object)
    base = [1 + BILLION // (t + v) if t + v else 1 for t, v in zip(groups["total"].tolist(), groups["size"].tolist(), strict=True)]
    row, at = {s: i for i, s in enumerate(names)}, pd.factorize(counts["term"])[0]
    p = np.repeat(np.array(base, np.int64)[:, None], at.max() + 1, axis=1)
    p[counts["source"].map(row).to_numpy(), at] = counts["p"].to_numpy()
    for i, source in enumerate(names):
        value = ((p[i] - p) ** 2 // p).sum(1)  # below 2^63: shares of a source add up to about 10^9
        value = value.tolist()
        for j, other in enumerate(names):
            if i != j:
                out["source"].append(source)
                out["other"].append(other)
                out["value"].append(value[j])
    out["lang"] = [groups["lang"].iloc[0]] * len(out["value"])
    return pd.DataFrame(out)


def divergence(docs: DataFrame, documents: int = 3, ranks: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources and telling terms of every group."""
    counts = saved(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    kept = saved(kept.where(F.col("docs") >= documents).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("lang_n").alias("lang_total"))
    found = saved(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = saved(groups.na.fill(0, ["total", "size", "lang_total"]), "groups")

    p = found.join(groups, ["lang", "source"]).withColumn("p", part(F.col("n"), F.col("total"), F.col("size")))
    p = p.withColumn("q", part(F.col("lang_n"), F.col("lang_total"), F.col("size"))).where("n > 0")
    told = p.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    blocks = F.ceil(F.col("size") / BLOCK_TERMS).cast("int")
    left = p.select("lang", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "source", "term", "p")
    right = groups.where("size > 0").select("lang", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "source", "total", "size")
    sums = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInPandas(
        pair_sums, "lang string, source string, other string, value long"
    )
    sums = sums.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    without = groups.where("size = 0").select("lang", "source")  # languages without kept terms
    zero = without.join(without.select("lang", F.col("source").alias("other")), "lang").where("source != other")
    pairs = sums.unionByName(zero.withColumn("value", F.lit(0).cast("long")))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    return ranked(pairs).unionByName(ranked(told).where(F.col("rank") <= ranks))


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))
