"""Pairs of like word sets, found exactly by their rarest words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import overlap


def word_classes(rows: DataFrame, group: str, words: str, key: str) -> DataFrame:
    """(group, set, a, members): each distinct set of a group once, with its smallest key. Null words and empty sets go."""
    sets = rows.select(group, F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isNotNull()))).alias("set"), key)
    return sets.where(F.size("set") > 0).groupBy(group, "set").agg(F.min(key).alias("a"), F.count("*").alias("members"))


def like_sets(classes: DataFrame, group: str, least: float) -> DataFrame:
    """(group, a, b, likeness) of all pairs of classes (see word_classes) that share at least `least` of their words, a with the fewer words.

    Words are ordered from the rarest to the most frequent one of their group. Two sets that are alike enough
    share one of the first words of either, and the smaller one needs to show fewer of them, so only those
    words are joined: a word that most sets have is joined for none of them but sets that are hardly more than
    it. A pair meets once, at the first word that both have, if what is left of both can still reach `least`.
    Groups are compared by value; a null group has no pairs.
    """
    if not 0 < least <= 1:
        raise ValueError("the least likeness is above 0 and at most 1")
    words = classes.select(group, "a", F.explode("set").alias("word"))
    often = words.groupBy(group, "word").agg(F.count("*").alias("n"))
    ordered = words.join(often, [group, "word"]).groupBy(group, "a").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("set"))
    k = F.size("set")
    # a hair less than the exact bound: rounding may show a word too many, never one too few
    shown = lambda share: k - F.ceil(k * F.lit(share) - 1e-9).cast("int") + 1
    first = ordered.select(group, "a", "set", F.posexplode(F.slice("set", F.lit(1), shown(2 * least / (1 + least)))).alias("at", "word"))
    second = ordered.select(group, F.col("a").alias("b"), F.col("set").alias("other"), F.posexplode(F.slice("set", F.lit(1), shown(least))).alias("spot", "word"))
    n, m = F.size("set"), F.size("other")
    smaller = (n < m) | ((n == m) & (F.col("a") < F.col("b")))
    reach = 1 + F.least(n - F.col("at"), m - F.col("spot")) - 1
    met = first.join(second, [group, "word"]).where(smaller & (n >= F.lit(least) * m - 1e-9) & (reach >= F.lit(least / (1 + least)) * (n + m) - 1e-9))
    once = met.where(F.get(F.array_intersect("set", "other"), F.lit(0)) == F.col("word"))
    return once.select(group, "a", "b", overlap(F.col("set"), F.col("other")).alias("likeness")).where(F.col("likeness") >= least)


def like_texts(rows: DataFrame, group: str, key: str, words: Column, least: float = 0.5) -> DataFrame:
    """(group, a, b, likeness, pairs): like_sets of rows' words, and how many pairs of rows each stands for.

    Classes of equal sets stand for their rows; pairs within a class are not listed.
    """
    classes = word_classes(rows.withColumn("_words", words), group, "_words", key)
    one = classes.select(group, "a", F.col("members").alias("_m"))
    two = classes.select(group, F.col("a").alias("b"), F.col("members").alias("_n"))
    found = like_sets(classes, group, least)
    return found.join(one, [group, "a"]).join(two, [group, "b"]).select(group, "a", "b", "likeness", (F.col("_m") * F.col("_n")).alias("pairs"))
