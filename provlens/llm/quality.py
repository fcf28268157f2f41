"""Operator 1: quality rules as a short-circuit cascade, cheapest rejections first.

All of it is column expressions; a rule is evaluated only for the documents that every rule
before it let pass. The order comes from a sample and never changes what is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens.llm.common import SPACE, WORD, landed, words_of

SAMPLE = 2000  # documents, about, on which cost and selectivity are estimated

# What counts as a symbol, and the bounds of the rules below.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 0.5  # share of words in repeated three-word windows
MOST_SYMBOLS = 0.02  # symbols per character of words
MOST_CAPITALS = 0.3  # capitals per letter
MOST_SHOUTS = 0.05  # exclamation and question marks per character of words
MOST_DUPLICATE_LINES = 0.5  # lines equal to an earlier one, per line with a word
LEAST_DISTINCT = 0.2  # different words per word


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def n_symbols(text: str) -> Column:
    return F.length(F.regexp_replace(_text(text), f"[^{SYMBOLS}]+", "")).cast("long")


def _lines(text: str) -> Column:
    return F.filter(F.split(_text(text), "\n", -1), lambda line: line.rlike(WORD))


def n_dup_lines(text: str) -> Column:
    """Lines with a word that equal an earlier one."""
    return _let(_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the document.

    Windows are compared by 64-bit hash within one document. Only documents with a repeated
    window sort theirs.
    """
    windows = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
                          lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(found: Column) -> Column:
        ranked = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(order: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1)),
                                            lambda x: x["i"]))

        def spread(at: Column) -> Column:
            # A window covers three words, less what the next one covers too.
            return F.aggregate(F.transform(at, lambda a, k: F.least(F.coalesce(F.get(at, k + 1) - a, F.lit(3)), F.lit(3))),
                               F.lit(0), lambda total, x: total + x)

        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(
            _let(_let(ranked, repeated), spread))

    return _let(windows, covered).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


@dataclass(frozen=True)
class Rule:
    """A named reason to reject a document; ``rejects`` is true, false or null (lets pass)."""

    name: str
    rejects: Column


def base_rules(text: str, words: Column) -> list[Rule]:
    n = F.size(words)
    return [Rule("few_words", n < LEAST_WORDS),
            Rule("repetition", n_repeat_words(words) > MOST_REPEATED * n)]


def further_rules(text: str, words: Column) -> list[Rule]:
    t = _text(text)
    share = lambda part, whole: part / F.greatest(whole, F.lit(1))
    solid = F.length(F.regexp_replace(t, f"[{SPACE}]+", ""))
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    shouts = F.length(F.regexp_replace(t, "[^!?]+", ""))
    return [Rule("symbols", share(n_symbols(text), solid) > MOST_SYMBOLS),
            Rule("capitals", share(capitals, letters) > MOST_CAPITALS),
            Rule("shouting", share(shouts, solid) > MOST_SHOUTS),
            Rule("duplicate_lines", _let(_lines(text), lambda lines: share(
                F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines))) > MOST_DUPLICATE_LINES),
            Rule("few_distinct_words", share(F.size(F.array_distinct(words)), F.size(words)) < LEAST_DISTINCT)]


Rules = Callable[[str, Column], list[Rule]]


def estimate(docs: DataFrame, rules: list[Rule], sample: int = SAMPLE, seed: int = 1) -> list[tuple[Rule, float, float]]:
    """Each rule with seconds per sampled document and the share it rejects, best first.

    Best is most rejections per second. The sample is drawn at random from all documents
    and written once; each rule is then timed on it alone.
    """
    n = docs.count()
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    drawn = landed(docs.sample(min(1.0, sample / n), seed), "quality-sample")
    measured = []
    for rule in [Rule("nothing", F.lit(False)), *rules]:
        begin = time.perf_counter()
        got = drawn.agg(F.count("*").alias("n"), F.avg(F.coalesce(rule.rejects, F.lit(False)).cast("int")).alias("r")).first()
        measured.append((rule, (time.perf_counter() - begin) / max(got["n"], 1), got["r"] or 0.0))
    idle = measured[0][1]
    found = [(r, max(s - idle, 1e-9), x) for r, s, x in measured[1:]]
    return sorted(found, key=lambda m: -m[2] / m[1])


def _ordered(docs: DataFrame, text: str, rules: Rules, sample: int) -> list[str]:
    """Names of rules in the order that the sample suggests."""
    held = docs.select(F.col(text), words_of(F.col(text)).alias("_words"))
    return [r.name for r, _, _ in estimate(held, rules(text, F.col("_words")), sample)]


def _first_rejection(rules: list[Rule], order: list[str]) -> Column:
    first = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: -order.index(r.name)):
        first = F.when(rule.rejects, F.lit(rule.name)).otherwise(first)
    return first


def all_rules(text: str, words: Column) -> list[Rule]:
    return base_rules(text, words) + further_rules(text, words)


def judged(docs: DataFrame, text: str = "text", sample: int = SAMPLE, rules: Rules = all_rules) -> DataFrame:
    """Add ``rejected_by``: the first rule of the cascade that rejects, null for kept documents.

    Nulls and empty texts have no words and are rejected; other columns stay as they are, one
    of the name ``rejected_by`` is replaced. Which rule is named may depend on the order,
    whether one rejects doesn't.
    """
    docs = docs.drop("rejected_by")
    order = _ordered(docs, text, rules, sample)
    # Words are bound inside the expression: a filter that moves below still splits a text once.
    return docs.withColumn("rejected_by", _let(words_of(F.col(text)),
                                               lambda w: _first_rejection(rules(text, w), order)))


def kept_documents(docs: DataFrame, text: str = "text", sample: int = SAMPLE, rules: Rules = all_rules) -> DataFrame:
    """The documents no rule rejects, columns unchanged."""
    columns = docs.columns
    return judged(docs, text, sample, rules).filter("rejected_by IS NULL").select(*[F.col(f"`{c}`") for c in columns])


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The counts that the base rules look at, and the verdict, for every document.

    The base counts are asked for, so they are computed for all; the further rules run as a
    cascade over what the base keeps.
    """
    order = _ordered(docs, text, further_rules, sample)

    def all_counts(w: Column) -> Column:
        def with_repeats(r: Column) -> Column:
            n = F.size(w).cast("long")
            failed = (n < LEAST_WORDS) | (r > MOST_REPEATED * n)
            passes = _first_rejection(further_rules(text, w), order).isNull()
            return F.struct(
                n.alias("n_words"), word_chars(w).alias("word_chars"), n_symbols(text).alias("n_symbols"),
                n_dup_lines(text).alias("n_dup_lines"), r.alias("n_repeat_words"), failed.alias("base_failed"),
                F.when(failed, F.lit(False)).otherwise(passes).alias("kept"))

        return _let(n_repeat_words(w), with_repeats)

    counted = docs.select(F.col(id_col).alias("doc_id"), _let(words_of(F.col(text)), all_counts).alias("_r"))
    return counted.select("doc_id", "_r.*")
