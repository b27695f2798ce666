"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of the k-gram hashes of a text, those are kept that are smallest in some window of w
neighbours. Any shared span of w + k - 1 words lies in equal windows on both sides, so both
keep an equal fingerprint inside it. With k = 5 and w = 6 that is 10 words, the length of a
benchmark window. Fingerprints are joined and hits extended word by word on both sides, so
hash collisions never count. Items shorter than a window are one window as a whole; they are
found by the hash of their first words at every position.

A first pass keeps the places of fingerprints that the benchmark has too, a second one reads the words
around them in the documents that have any.

Defined results: a null or empty text, or one without words, has no hits; one row per
distinct (doc_id, text), so repeated rows count once; a null item_id is written as an empty
text; items with equal words all count; an empty benchmark marks nothing; texts are read whole, in time
proportional to their words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import ascii_lower, saved

GRAM = 5
WINDOW = 6
SPAN = GRAM + WINDOW - 1
REACH = SPAN - GRAM  # words that a window can extend beyond a gram inside it
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 50_000  # fingerprints of the benchmark that are broadcast at most
KEYS_BROADCAST = 500_000  # documents with a spot whose keys are broadcast at most


def words_of(text: Column) -> Column:
    """Lower-cased words in order; [] for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it; a plain column could be inlined into a lambda per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def upto(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def gram_hashes(hashes: Column, k: int) -> Column:
    """Hash of the k words from each position on; [] if there are fewer."""
    return F.transform(
        upto(F.size(hashes) - (k - 1)),
        lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]),
    )


def places(grams: Column) -> Column:
    """(pos, key) of every gram."""
    return F.transform(grams, lambda g, i: F.struct(i.alias("pos"), g.alias("key")))


def winnowed(grams: Column) -> Column:
    """(pos, key) of the grams that are smallest in some window of WINDOW = 6 grams.

    Minima over six come from minima over pairs. A gram is kept if it equals the largest
    minimum among the windows that hold it.
    """
    def kept(pairs_of: Column) -> Column:
        lowest = F.transform(
            upto(F.size(grams) - (WINDOW - 1)),
            lambda i: F.least(F.get(pairs_of, i), F.get(pairs_of, i + 2), F.get(pairs_of, i + 4)),
        )
        return let(lowest, lambda low: let(
            F.transform(upto(F.size(low) + 1), lambda i: F.greatest(F.get(low, i), F.get(low, i - 1))),
            lambda top: F.filter(places(grams), lambda x: x["key"] == F.greatest(
                F.get(top, x["pos"]), F.get(top, x["pos"] - 2), F.get(top, x["pos"] - 4)
            )),
        ))

    pairs = F.transform(grams, lambda g, i: F.least(g, F.get(grams, i + 1)))
    return F.when(F.size(grams) >= WINDOW, let(pairs, kept)).otherwise(F.array().cast("array<struct<pos:int,key:bigint>>"))


def fingerprints(words: Column, short: list[int]) -> Column:
    """Winnowed grams, and for each class of short items the grams at every position."""
    def of(hashes: Column) -> Column:
        whole = let(gram_hashes(hashes, GRAM), winnowed)
        return F.concat(whole, *[let(gram_hashes(hashes, k), places) for k in short])

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def before(words: Column, pos: Column) -> Column:
    """The REACH words before a position, nearest first."""
    return F.reverse(F.slice(words, F.greatest(pos - REACH, F.lit(0)) + 1, F.least(pos, F.lit(REACH))))


def shared_start(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays of at most REACH words."""
    differs = F.filter(
        F.sequence(F.lit(0), F.lit(REACH - 1)), lambda i: ~F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False))
    )
    return F.coalesce(F.array_min(differs), F.lit(REACH))


def benchmark_rows(items: DataFrame) -> DataFrame:
    """(key, item, before, mid, after, need): what has to surround a fingerprint for a hit."""
    items = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")
    ).where(F.size("words") > 0)
    items = items.withColumn("n", F.size("words"))
    long = (
        items.where(F.col("n") >= SPAN)
        .select("item", "words", F.explode(fingerprints(F.col("words"), [])).alias("f"))
        .select(
            F.col("f.key").alias("key"), "item",
            before(F.col("words"), F.col("f.pos")).alias("before"),
            F.slice("words", F.col("f.pos") + 1, F.lit(GRAM)).alias("mid"),
            F.slice("words", F.col("f.pos") + 1 + GRAM, F.lit(REACH)).alias("after"),
            F.lit(SPAN).alias("need"),
        )
    )
    none = F.array().cast("array<string>")
    short = items.where(F.col("n") < SPAN)
    heads = [F.xxhash64(F.lit(k), *[F.xxhash64(F.get("words", F.lit(j))) for j in range(k)]) for k in range(1, GRAM + 1)]
    first = F.get(F.array(*heads), F.least("n", F.lit(GRAM)) - 1)
    short = short.select(
        first.alias("key"), "item", none.alias("before"), F.col("words").alias("mid"), none.alias("after"),
        F.col("n").alias("need"),
    )
    return long.unionByName(short).distinct()


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated) per distinct document."""
    bench = saved(benchmark_rows(items), "benchmark-fingerprints")
    classes = bench.where(F.col("need") < SPAN).select(F.least("need", F.lit(GRAM)).alias("k")).distinct()
    short = sorted(r["k"] for r in classes.collect())  # at most GRAM numbers
    small = bench.count() <= BROADCAST_ROWS

    marked = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    size = F.size("words").alias("n_words")
    # position -1 stands for the document itself, so that one pass gives its row and its hits
    itself = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("key")))
    prints = F.concat(itself, fingerprints(F.col("words"), short)) if small else fingerprints(F.col("words"), short)
    # the size is taken before the explode, or each fingerprint would carry all words
    found = marked.select("doc_id", "text_key", size, prints.alias("prints"))
    found = found.select("doc_id", "text_key", "n_words", F.explode("prints").alias("f")).select("doc_id", "text_key", "n_words", "f.pos", "f.key")
    keys = bench.select("key").distinct()
    if small:
        known = F.broadcast(keys.withColumn("known", F.lit(True)))
        spots = found.join(known, "key", "left").where("pos = -1 or known").drop("known")
    else:
        alone = marked.select("doc_id", "text_key", size, F.lit(-1).alias("pos"))
        spots = found.join(keys, "key", "left_semi").unionByName(alone, allowMissingColumns=True)
    spots = saved(spots.select("doc_id", "text_key", "n_words", "pos", "key"), "spots")
    near = surroundings(docs, spots.where("pos >= 0"))
    met = near.join(F.broadcast(bench) if small else bench, "key")
    return by_document(met.unionByName(spots.where("pos = -1"), allowMissingColumns=True))


def surroundings(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """The spots with the words around them, cut inside the document's row.

    Only documents with a spot are read again, and no row leaves with more than the few
    words of one spot, so a text costs time in proportion to its length.
    """
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__key"))
    of = spots.groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), "n_words").agg(
        F.collect_set(F.struct("pos", "key")).alias("spots")  # at most one a word and class of short items
    )
    asked = saved(of, "spots-by-text")
    only = asked.select("__doc", "__key")
    wanted = docs.select("doc_id", "text").join(F.broadcast(only) if only.count() <= KEYS_BROADCAST else only, same, "left_semi")
    wanted = wanted.join(asked, same)
    cut = let(words_of(F.col("text")), lambda words: F.transform("spots", lambda s: F.struct(
        s["pos"].alias("pos"), s["key"].alias("key"), before(words, s["pos"]).alias("doc_before"),
        F.slice(words, s["pos"] + 1, F.lit(SPAN)).alias("doc_from"),
    )))
    each = wanted.select("doc_id", F.col("__key").alias("text_key"), "n_words", F.explode(cut).alias("s"))
    return each.select("doc_id", "text_key", "n_words", "s.*")


def by_document(met: DataFrame) -> DataFrame:
    """Extend each hit and sum up per document; its spans are at most as many as its words."""
    size = F.size("mid")
    left = shared_start(F.col("doc_before"), F.col("before"))
    right = shared_start(F.slice("doc_from", size + 1, F.lit(REACH)), F.col("after"))
    equal = F.slice("doc_from", F.lit(1), size) == F.col("mid")
    long_enough = left + size + right >= F.col("need")
    span = F.struct((F.col("pos") - left).alias("start"), (F.col("pos") + size + right).alias("end"))
    itself = F.col("pos") == -1
    every = met.where(itself | (equal & long_enough)).select(
        "doc_id", "text_key", "n_words", F.when(~itself, F.col("item")).alias("item"), F.when(~itself, span).alias("span")
    )
    covered = F.aggregate(
        F.array_sort(F.col("spans")),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["end"]).alias("end"),
            (a["n"] + F.greatest(x["end"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return (
        every.groupBy("doc_id", "text_key", "n_words")
        .agg(F.collect_set("span").alias("spans"), F.collect_set("item").alias("items"))
        .select(
            "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
            (F.size("spans") > 0).alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of docs without a benchmark window; all columns stay."""
    bad = saved(contamination(docs, items).where("contaminated").select("doc_id", "text_key"), "contaminated")
    bad = bad.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"))
    side = F.broadcast(bad) if bad.count() <= KEYS_BROADCAST else bad
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(side, same, "left_anti")
