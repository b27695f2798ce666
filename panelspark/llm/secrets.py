"""Secret scans through a trigram inverted index.

From each rule's regular expression follows a Boolean query of trigrams: an OR over its
alternatives of the AND of the trigrams that an alternative must contain. Every Arrow batch
is an index segment: postings of the trigrams that occur in the queries, over the batch's
texts. Postings are intersected and united, and only candidates are verified by the regular
expression. A rule with an alternative without a trigram scans every text.

Defined results: a null text counts as empty and has no spans; one output row per input row,
repeated rows alike; a match of fewer characters than its rule wants is dropped, and what it
covered is not searched again; spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import re._parser as syntax
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import with_columns

ALTERNATIVES = 64  # of a rule that are told apart; a rule with more scans every text


def either_case(words: str) -> str:
    """ASCII letters in either case; flags would also fold letters beyond ASCII."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# fixed values: the base rules, then key formats that vendors publish
RULES = (
    Rule("assign", f"({either_case('password|passwd|secret|token|api_?key')})"
         r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", "[0-9a-f]+", 0, 24, True),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("live", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
)

GAP = None  # anything may stand here


def readings(parsed) -> list[list]:
    """The alternatives of a parsed expression as lists of lower-case characters and gaps."""
    out: list[list] = [[]]
    for op, arg in parsed:
        if op is syntax.LITERAL:
            step = [[chr(arg).lower()]]
        elif op is syntax.IN and all(o is syntax.LITERAL for o, _ in arg) and len({chr(c).lower() for _, c in arg}) == 1:
            step = [[chr(arg[0][1]).lower()]]
        elif op is syntax.SUBPATTERN:
            step = readings(arg[3])
        elif op is syntax.BRANCH:
            step = [r for branch in arg[1] for r in readings(branch)]
        elif op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT):
            least, most, body = arg
            inner = readings(body)
            if (least, most) == (0, 1):
                step = [[], *inner]
            else:
                step = [r if most == 1 else [*r, GAP, *r] if least > 1 else [*r, GAP] for r in inner] if least else [[GAP]]
        else:
            step = [[GAP]]
        out = [a + b for a in out for b in step]
        if len(out) > ALTERNATIVES:
            return [[GAP]]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR over sets of trigrams that must all occur; None if some alternative demands none."""
    found = []
    for reading in readings(syntax.parse(pattern)):
        runs = "".join("\0" if c is GAP else c for c in reading).split("\0")
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return None
        found.append(grams)
    return sorted(set(found), key=sorted)


class Segment:
    """Postings over one batch of texts, made for the trigrams that are asked for."""

    def __init__(self, texts: list[str]):
        self.texts = [t.lower() for t in texts]
        self.postings: dict[str, np.ndarray] = {}

    def rows(self, gram: str) -> np.ndarray:
        if gram not in self.postings:
            self.postings[gram] = np.array([i for i, t in enumerate(self.texts) if gram in t], dtype=int)
        return self.postings[gram]

    def candidates(self, query: list[frozenset[str]] | None) -> np.ndarray:
        if query is None:
            return np.arange(len(self.texts))
        found = np.zeros(0, int)
        for grams in query:
            both = None
            for gram in sorted(grams):
                both = self.rows(gram) if both is None else np.intersect1d(both, self.rows(gram), True)
                if not len(both):
                    break
            found = np.union1d(found, both)
        return found


def scan(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """Per text its (start, rule number, end), sorted."""
    segment, spans = Segment(texts), [[] for _ in texts]
    for number, rule in enumerate(rules):
        find = re.compile(rule.pattern).finditer
        for row in segment.candidates(trigram_query(rule.pattern)):
            for m in find(texts[row]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    spans[row].append((m.start(), number, m.end()))
    return [sorted(s) for s in spans]


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[n].kind}:{a}:{b}" for a, n, b in spans)


def with_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with counts of the base kinds, base_sha256 and spans."""
    base = [n for n, r in enumerate(rules) if r.base]

    def per_batch(batch: pa.RecordBatch):
        found = scan([t or "" for t in batch.column("text").to_pylist()], rules)
        counts = [[sum(n == k for _, n, _ in s) for s in found] for k in base]
        digest = [hashlib.sha256(joined([x for x in s if rules[x[1]].base], rules).encode()).hexdigest() for s in found]
        return *counts, digest, [joined(s, rules) for s in found]

    kinds = {f"n_{rules[k].kind}": T.LongType() for k in base}
    return with_columns(docs, kinds | {"base_sha256": T.StringType(), "spans": T.StringType()}, per_batch)


MARK = "[SECRET]"


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret in ``text`` replaced by MARK, and ``n_chars`` counted again."""
    def per_batch(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        found = scan([t or "" for t in texts], rules)
        return ([redacted(t, s) for t, s in zip(texts, found, strict=True)],)

    made = with_columns(docs, {"__clean": T.StringType()}, per_batch).withColumn("text", F.col("__clean"))
    made = made.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else made
    return made.select(docs.columns)
