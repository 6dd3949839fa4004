"""Extractive summaries by centroid scores with redundancy removal, as one expression.

A context is cut into sentences. Each sentence is the vector of its word counts, the
centroid is their sum, and a sentence scores the cosine with the centroid (times the centroid's
length, the same for all). The best sentence is taken; the next one is the best of those that share
less than ``OVERLAP`` of their distinct words with every sentence taken so far.

The expression reads one context (the few chunks of a topic), so nothing is shuffled; its cost is
quadratic in the words of that one context.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions.text import clean_text, tokens, unigrams

#: Share of distinct words (Jaccard) from which a sentence repeats another.
OVERLAP = 0.5
#: Sentences of a summary.
SENTENCES = 2
SENTENCE = r"[^.!?\n]+[.!?]*"


def sentences(context: Column) -> Column:
    """Sentences in order, trimmed: runs that end at a stop, question or exclamation mark, or at a line's end."""
    return F.filter(F.transform(F.regexp_extract_all(context, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def _count(words: Column, word: Column) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


def _dot(words: Column, others: Column) -> Column:
    """Inner product of two word-count vectors: for each word, how often the other side has it."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda total, w: total + _count(others, w))


def _overlap(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def summary(context: Column, n: int = SENTENCES, overlap: float = OVERLAP) -> Column:
    """The ``n`` most central sentences that don't repeat each other, best first, joined by a space.

    Equal scores go to the earlier sentence; a sentence without words (after
    cleaning, stop words left out) scores 0. NULL for a NULL context; the context itself when it has no sentence.
    """
    cut = F.transform(sentences(context), lambda s: F.struct(s.alias("text"), unigrams(tokens(clean_text(s))).alias("words")))

    def scored(parts: Column) -> Column:
        # Arrays of one element bind a value once for the lambdas below.
        every = F.flatten(F.transform(parts, lambda p: p["words"]))
        return F.transform(F.array(every), lambda e: F.transform(parts, lambda p, i: F.struct(
            (-F.coalesce(_dot(p["words"], e) / F.nullif(F.sqrt(_dot(p["words"], p["words"]).cast("double")), F.lit(0.0)), F.lit(0.0))).alias("less"),
            i.alias("at"), p["text"].alias("text"), F.array_distinct(p["words"]).alias("words"))))[0]

    ranked = F.transform(F.array(cut), lambda parts: F.array_sort(scored(parts)))[0]  # ascending: best first
    empty = F.slice(ranked, 1, 0)
    taken = F.aggregate(ranked, empty, lambda kept, s: F.when(
        (F.size(kept) < n) & ~F.exists(kept, lambda k: _overlap(k["words"], s["words"]) >= overlap), F.concat(kept, F.array(s))).otherwise(kept))
    text = F.array_join(F.transform(taken, lambda s: s["text"]), " ")
    return F.when(context.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(F.nullif(text, F.lit("")), context))
