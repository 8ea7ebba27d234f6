"""Words of text without blanks: the most likely split by a dictionary of words and their counts.

A word's weight is the logarithm of its share of all counts; a character that the dictionary does not have is a word of
count one. The best split is found by a pass from left to right over a prefix tree of the dictionary; of equally likely
ones that with the longer last word is taken. A `Segmenter` (words and counts, at most some hundred thousand) goes to
the tasks with the plan; a larger dictionary stays a table (`split_by_table`). Texts pass in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of Chinese characters.
CHINESE = re.compile("[一-鿿]+")


class Segmenter:
    """Splits runs of characters by a dictionary {word: count}."""

    def __init__(self, counts: dict[str, float], total: float | None = None):
        """total: the sum of all counts, where `counts` has those of some words only."""
        self.counts = {w: float(n) for w, n in counts.items() if w and n > 0}
        self.total = float(total if total is not None else sum(self.counts.values()) or 1.0)
        self._total = log(self.total)
        self._tree: dict = {}
        for word, n in self.counts.items():
            node = self._tree
            for c in word:
                node = node.setdefault(c, {})
            node[""] = log(n) - self._total

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "total": self.total}  # the tree is nested as deep as words are long

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["counts"], state["total"])

    def split(self, run: str) -> list[str]:
        """The words of a run, in order; all its characters are in one of them."""
        n, unknown = len(run), -self._total
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for i in range(n):
            here, node, j = best[i], self._tree.get(run[i]), i + 1
            if node is None or "" not in node:
                if here + unknown > best[j]:
                    best[j], back[j] = here + unknown, i
            while node is not None:
                own = node.get("")
                if own is not None and here + own > best[j]:
                    best[j], back[j] = here + own, i
                if j == n:
                    break
                node, j = node.get(run[j]), j + 1
        out, at = [], n
        while at:
            out.append(run[back[at] : at])
            at = back[at]
        return out[::-1]

    def words(self, text: str | None) -> list[str]:
        """The words of all Chinese runs of a text."""
        return [w for run in CHINESE.findall(text or "") for w in self.split(run)]


def with_bigrams(words: list[str]) -> list[str]:
    """The words, then every two neighbours joined."""
    return words + [a + b for a, b in zip(words, words[1:])]


def split_words(text: Column, segmenter: Segmenter) -> Column:
    """The words of a text without blanks; null for null."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else segmenter.split(t) for t in batch], dtype=object)

    return run(text)


def split_by_table(runs: DataFrame, key: str, run: str, counts: DataFrame, word: str, count: str) -> DataFrame:
    """(key, words): runs split by a table of distinct words and their counts, of any size.

    Of the table only the words that a run holds can be in its split. They are found by a join with the pieces of the run that
    are as long as some word, so no task and no driver holds the dictionary.
    """
    known = counts.where((F.col(count) > 0) & (F.col(word) != "")).select(F.col(word).alias("_w"), F.col(count).alias("_n"))
    facts = known.agg(F.coalesce(F.sum("_n"), F.lit(1)).cast("double").alias("_total"), F.array_sort(F.collect_set(F.length("_w"))).alias("_lengths"))  # one row
    runs = runs.select(F.col(key).alias("_k"), F.col(run).alias("_run"))
    long = runs.crossJoin(F.broadcast(facts)).select("_k", "_run", F.explode("_lengths").alias("_l")).where(F.length("_run") >= F.col("_l"))
    at = F.explode(F.sequence(F.lit(1), F.length("_run") - F.col("_l") + 1))
    pieces = long.select("_k", "_run", "_l", at.alias("_i")).select("_k", F.substring("_run", F.col("_i"), F.col("_l")).alias("_w")).distinct()
    own = pieces.join(known, "_w").groupBy("_k").agg(F.collect_list(F.struct("_w", "_n")).alias("_own"))
    met = runs.join(own, "_k", "left").crossJoin(F.broadcast(facts.select("_total")))

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, words: pd.Series, ns: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else Segmenter(dict(zip(() if w is None else w, () if n is None else n)), t).split(r) for r, w, n, t in zip(run, words, ns, total)], dtype=object)

    return met.select(F.col("_k").alias(key), split("_run", F.col("_own._w"), F.col("_own._n"), "_total").alias("words"))


def chinese_words(text: Column, segmenter: Segmenter, bigrams: bool = False) -> Column:
    """The words of the Chinese runs of a lower-cased text, with `bigrams` also every two neighbours joined; empty for null."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            words = (segmenter.words(t) for t in batch)
            yield pd.Series([with_bigrams(w) if bigrams else w for w in words], dtype=object)

    return run(F.lower(text))


def bm25_words(segmenter: Segmenter):
    """A tokeniser like `tokens.bm25_tokens` with dictionary words, and pairs of these, in place of character pairs."""
    from lodewell.functions import tokens as T

    return lambda text: F.concat(T.bm25_tokens(F.regexp_replace(text, "[\\x{4e00}-\\x{9fff}]+", " ")), chinese_words(text, segmenter, True))


def key_words(text: Column, segmenter: Segmenter) -> Column:
    """Distinct terms of two characters and more, sorted, Chinese ones by the dictionary."""
    from lodewell.functions import tokens as T

    plain = T.tfidf_tokens(F.regexp_replace(text, "[\\x{4e00}-\\x{9fff}]+", " "))
    return F.array_sort(F.array_distinct(F.filter(F.concat(plain, chinese_words(text, segmenter)), lambda t: F.length(t) >= 2)))


def dictionary(rows, word: str, count: str, most: int = 200_000) -> Segmenter:
    """A segmenter from a table of words and counts: its `most` most frequent words."""
    top = rows.where(F.col(word).isNotNull() & (F.col(count) > 0)).groupBy(word).agg(F.sum(count).alias("n")).orderBy(F.desc("n"), word).limit(most)
    return Segmenter({r[word]: r["n"] for r in top.collect()})
