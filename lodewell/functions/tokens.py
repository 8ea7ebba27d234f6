"""Tokenisers as Column functions: words, Chinese bigrams and hex codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def fold(items: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str, block: int = 256) -> Column:
    """array<out>: all that step(at, item) = (new at, results) gives for the items in turn, with at = 0 before the first.

    Results are gathered in blocks, so that no long array is copied for every item.
    """
    none = F.array().cast(f"array<{out}>")

    def one(acc: Column, x: Column) -> Column:
        at, own = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], own).alias("out"))

    def whole(rows: Column) -> Column:
        def of_block(acc: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(rows, k * block + 1, block), F.struct(acc["at"].alias("at"), none.alias("out")), one)
            return let(part, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(rows) - 1) / block).cast("int"), F.lit(0)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{out}>>").alias("out"))
        return F.aggregate(blocks, start, of_block, lambda acc: F.flatten(acc["out"]))

    return let(items, whole)


def gaps(text: Column, pattern: str) -> Column:
    """For each leftmost non-overlapping match: g, the length of the text since the match before, and m, the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda all_: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(all_)), all_, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m"))))


def _pairs(text: Column) -> Column:
    """Pairs of neighbouring Chinese characters of the lower-cased text, whatever stands between them; with repeats."""
    chars = F.regexp_extract_all(F.lower(text), F.lit("[\\x{4e00}-\\x{9fff}]"), F.lit(0))
    return let(chars, lambda c: F.filter(F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c), F.lit(1))), lambda a, b: F.concat(a, b)), lambda x: x.isNotNull()))


def tfidf_tokens(text: Column) -> Column:
    """Runs of a-z, 0-9 and _ of the lower-cased text, then its Chinese bigrams."""
    return F.concat(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), _pairs(text))


def bm25_tokens(text: Column, longest: int | None = None) -> Column:
    """Hex codes whole, words split at _ (two characters and more), Chinese bigrams; dp words add their family.

    `longest` keeps the first tokens only.
    """
    none = F.array().cast("array<string>")
    family = F.array(F.lit("dp"), F.lit("DP"), F.lit("data"), F.lit("Data"))

    def of(low: Column) -> Column:
        codes = F.regexp_extract_all(low, F.lit("0x[0-9a-f]{1,8}"), F.lit(0))
        rest = F.regexp_replace(low, "0x[0-9a-f]{1,8}", " ")
        return F.concat(codes, let(rest, lambda r: F.concat(F.regexp_extract_all(r, F.lit("(?<![a-z0-9])[a-z0-9]{2,}"), F.lit(0)), _pairs(r))))

    every = let(let(F.lower(text), of), lambda t: F.concat(t, F.when(F.exists(t, lambda x: x.isin("dp", "data", "datapoint")), family).otherwise(none)))
    return every if longest is None else F.slice(every, 1, longest)


def key_terms(text: Column) -> Column:
    """Distinct terms of two characters and more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tfidf_tokens(text), lambda t: F.length(t) >= 2)))


def fts_runs(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased: the tokens of a full-text index."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fts_prefixes(query: Column) -> Column:
    """What a full-text query looks for: words as prefixes; of Chinese runs every character and every 2- to 4-gram."""
    runs = F.regexp_extract_all(F.lower(query), F.lit(r"[a-z0-9_]+|[^\sa-z0-9_]+"), F.lit(0))

    def grams(run: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.length(run), F.lit(4)))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n))))

    parts = F.transform(runs, lambda r: F.when(r.rlike("[\\x{4e00}-\\x{9fff}]"), grams(r)).otherwise(F.array(F.regexp_replace(r, r"[^\p{L}\p{N}]", ""))))
    return F.array_distinct(F.filter(F.flatten(parts), lambda p: F.length(p) > 0))
