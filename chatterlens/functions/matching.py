"""Finding the words of a list in texts, inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlens.functions.columns import col

HEAD = 4  # characters of a place that are tested before any word


def prefix_tree(words: Sequence[str]) -> str:
    """A regular expression for the longest of the words that begins at a place."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def branch(node: dict) -> str:
        ends = "" in node
        ways = [re.escape(letter) + branch(below) for letter, below in sorted(node.items()) if letter]
        if not ways:
            return ""
        whole = ways[0] if len(ways) == 1 and not ends else "(?:" + "|".join(ways) + ")"
        return whole + "?" if ends else whole

    return branch(tree)


def heads(words: Sequence[str]) -> str:
    """A class for each of the first characters of the words."""
    return "".join("[" + "".join(re.escape(c) for c in sorted({w[i] for w in words})) + "]" for i in range(min(HEAD, *map(len, words), HEAD)))


def search_tree(words: Sequence[str]) -> str:
    """Like ``prefix_tree``, with the first letters halved step by step.

    Each half is entered only where the next characters fit its classes, so most places are left after a few tests
    instead of one per first letter.
    """
    letters = sorted({w[0] for w in words})
    if len(letters) == 1:
        return prefix_tree(words)
    halves = [[w for w in words if (w[0] < letters[len(letters) // 2]) == low] for low in (True, False)]
    return "(?:" + "|".join(f"(?={heads(half)}){search_tree(half)}" for half in halves) + ")"


def words_in(text: str | Column, words: Sequence[str]) -> Column:
    """The words of a list that occur in the lower-cased text as substrings, sorted.

    One regular expression for the longer words and one for the shorter ones give at every place the longest word that
    begins there; shorter words that begin it follow from a fixed map. Everything stays in the JVM.
    """
    wanted = sorted({w for w in words if w})
    if not wanted:
        return F.when(col(text).isNotNull(), F.array().cast("array<string>"))
    lowered = F.lower(col(text))
    sizes = [[w for w in wanted if (len(w) >= HEAD) == longer] for longer in (True, False)]
    longest = [F.regexp_extract_all(lowered, F.lit(f"(?={heads(part)})(?=({search_tree(part)}))"), F.lit(1)) for part in sizes if part]
    found = F.array_distinct(F.concat(*longest))
    begun = {w: [p for p in wanted if w.startswith(p)] for w in wanted}
    several = {w: parts for w, parts in begun.items() if len(parts) > 1}
    if several:
        parts = F.create_map(*chain.from_iterable((F.lit(w), F.array(*map(F.lit, p))) for w, p in several.items()))
        found = F.array_distinct(F.flatten(F.transform(found, lambda w: F.coalesce(F.try_element_at(parts, w), F.array(w)))))
    return F.array_sort(found)


def with_words(df: DataFrame, name: str, words: Sequence[str], text: str = "content") -> DataFrame:
    """The frame with ``name``: the words of the list in its texts.

    Every distinct text is searched once, whatever the number of its copies and however the frame is partitioned. Only
    digests travel back; adaptive execution splits the rows of a text with very many copies. A stream's rows are
    searched where they are.
    """
    if df.isStreaming:
        return df.withColumn(name, words_in(text, words))
    key, made = "__text", "__words"
    searched = df.select(F.col(text).alias(key)).distinct().select(F.sha2(F.col(key).cast("binary"), 256).alias(key), words_in(key, words).alias(made))
    return (
        df.withColumn(key, F.sha2(F.col(text).cast("binary"), 256)).join(searched.filter(F.col(key).isNotNull()), key, "left")
        .drop(key).withColumnRenamed(made, name)
    )
