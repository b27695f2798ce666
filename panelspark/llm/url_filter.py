"""URL verdicts: rules first, a character language-model ratio for the rest; DataFrame functions only.

URLs that a rule allows or blocks train two variable-order Markov models over characters
(contexts of 0 to 3, smoothed by Witten-Bell: the mass of unseen characters is the number of
distinct followers of the context). A URL without a rule is allowed if its log-likelihood
difference per character reaches the cut, which lies midway between the mean of the allowed
and of the blocked URLs of a calibration fold. Logarithms are summed as whole millionths, so
results do not depend on order.

Defined results: a null url, or one without "://", has empty host and path and is judged by
the empty text; every row gives one row, repeated rows alike; without URLs of both kinds the
cut is 0 and every ratio is 0, so that the rest is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import micro
from panelspark.llm.common import ascii_lower, fold, saved
from panelspark.llm.decontaminate import let

# fixed values: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4  # a character with its context
START, END = "\x01", "\x02"
CALIBRATION_FOLDS = 5
BROADCAST_ROWS = 200_000  # distinct grams that are broadcast at most


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return ascii_lower(host), path


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, decided): the longest rule that fits, by host then path."""
    host, path = host_and_path(F.coalesce(F.col("url"), F.lit("")))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        decided = F.when(fits, F.lit(verdict)).otherwise(decided)
    return out.select("*", rule.alias("rule"), decided.alias("decided"))


def grams_of(text: Column) -> Column:
    """Each character, and the end, behind its three predecessors."""
    chars = F.concat(F.array(*[F.lit(START)] * (ORDER - 1)), F.split(text, ""), F.array(F.lit(END)))
    return let(F.filter(chars, lambda c: c != ""), lambda every: F.transform(
        F.slice(every, F.lit(ORDER), F.size(every)),
        lambda _, i: F.concat(*[F.get(every, i + j) for j in range(ORDER)]),
    ))


def counted(texts: DataFrame) -> DataFrame:
    """(gram, allow, block): how often the training URLs of each kind hold the gram."""
    each = texts.select("decided", F.explode(grams_of(F.col("text"))).alias("gram"))
    return each.groupBy("gram").agg(
        *[F.sum((F.col("decided") == k).cast("long")).alias(k) for k in ("allow", "block")]
    )


def gram_ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio): millionths of ln p_allow - ln p_block of the last character in its context."""
    sizes = F.explode(F.sequence(F.lit(1), F.lit(ORDER))).alias("m")
    tail = F.expr("right(gram, m)")
    kinds = ("allow", "block")
    by_size = counts.select("gram", *kinds, sizes).select("m", tail.alias("tail"), *kinds)
    by_size = by_size.groupBy("m", "tail").agg(*[F.sum(k).alias(k) for k in kinds])
    before = F.expr("left(tail, m - 1)").alias("context")
    contexts = by_size.select("m", before, *kinds).groupBy("m", "context").agg(
        *[F.sum(k).alias(f"{k}_total") for k in kinds],
        *[F.sum((F.col(k) > 0).cast("long")).alias(f"{k}_kinds") for k in kinds],
    )
    alphabet = by_size.where("m = 1").count() + 1
    asked = wanted.select("gram", sizes).select("gram", "m", tail.alias("tail")).withColumn("context", F.expr("left(tail, m - 1)"))
    met = asked.join(by_size, ["m", "tail"], "left")
    # single characters share one context, so its one row goes to them
    one, more = (contexts.where(c) for c in ("m = 1", "m > 1"))
    met = met.where("m = 1").join(F.broadcast(one), ["m", "context"], "left").unionByName(
        met.where("m > 1").join(more, ["m", "context"], "left")
    ).na.fill(0)
    orders = met.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("m", *[c for c in met.columns if c.startswith(kinds)]))).alias("orders"))

    def chance(kind: str) -> Column:
        def longer(shorter: Column, o: Column) -> Column:
            seen = o[f"{kind}_total"] + o[f"{kind}_kinds"]
            better = (o[kind] + o[f"{kind}_kinds"] * shorter) / seen
            return F.when(seen > 0, better).otherwise(shorter)

        return F.aggregate("orders", F.lit(1.0 / alphabet), longer)

    return orders.select("gram", micro(F.log(chance("allow")) - F.log(chance("block"))).alias("ratio"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of pages."""
    known = saved(
        ruled(pages, rules).select(
            "*", F.concat("host", "path").alias("text"), (fold(F.col("page_id"), CALIBRATION_FOLDS) == 0).alias("calibrates")
        ),
        "ruled-pages",
    )
    counts = saved(counted(known.where("decided is not null and not calibrates")), "gram-counts")
    rest = known.where("decided is null").select("text", F.lit(None).cast("string").alias("kind"))
    trial = known.where("decided is not null and calibrates").select("text", F.col("decided").alias("kind"))
    # dealt out before the write, or one task would read the small table and explode it alone
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rest.unionByName(trial).groupBy("text", "kind").agg(F.count("*").alias("n"))
    texts = saved(texts.repartition(parts, "text"), "url-texts")
    lines = texts.select("text", "kind", "n", grams_of(F.col("text")).alias("grams"))
    each = saved(
        lines.select("text", "kind", "n", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
        .groupBy("text", "kind", "n", "size", "gram").agg(F.count("*").alias("times")),
        "url-grams",
    )
    ratios = saved(gram_ratios(counts, each.select("gram").distinct()), "gram-ratios")
    side = F.broadcast(ratios) if ratios.count() <= BROADCAST_ROWS else ratios
    scored = each.join(side, "gram").groupBy("text", "kind", "n", "size").agg(F.sum(F.col("ratio") * F.col("times")).alias("sum"))
    scored = saved(scored.select("text", "kind", "n", F.expr("sum div size").alias("mean")), "url-scores")
    mean = {
        r["kind"]: r["mean"]
        for r in scored.where("kind is not null").groupBy("kind")
        .agg(F.expr("sum(mean * n) div sum(n)").alias("mean")).collect()
    }  # two rows at most
    cut = (mean["allow"] + mean["block"]) // 2 if len(mean) == 2 else 0
    verdicts = scored.where("kind is null").select("text", F.when(F.col("mean") >= cut, "allow").otherwise("block").alias("judged"))
    return known.join(verdicts, "text", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("decided", "judged").alias("verdict")
    )
