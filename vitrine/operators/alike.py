"""Joins by gestalt similarity without comparing all pairs.

The ratio is 2 M / T, with M letters in matching blocks and T letters in both texts. Three facts bound it from above, exactly:
M is at most the shorter length; M is at most the number of letters that the texts share, repeats counted; and as blocks are parted
by unmatched letters, the texts share at least 3 M - T - 1 pairs of adjacent letters. So texts that reach a ratio share so many
tokens (letters, or letter pairs where that bound says anything) that they share one among their rarest few, their
prefix. An equi-join on prefix tokens finds the pairs, the bounds thin them out in the JVM, and only what is left is compared in Python.

Texts are judged once each, whatever the number of their rows. A null text is like nothing; two empty ones are alike by 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import let, ratio
from vitrine.operators.lineage import checkpoint

#: Taken off a bound before it is rounded up, against the rounding of doubles.
EPSILON = 1e-9


def counted_tokens(parts: Column) -> Column:
    """Parts of a text, each with the number of times that it has come up, so that sets of them are bags."""
    place = lambda ordered: F.transform(ordered, lambda x, i: F.concat(x, F.lit("\x00"), (i + 2 - F.array_position(ordered, x)).cast("string")))
    return let(F.array_sort(parts), place)


def letters(text: Column) -> Column:
    return counted_tokens(F.when(text == "", F.array(F.lit(""))).otherwise(F.split(text, "")))


def letter_pairs(text: Column) -> Column:
    size = F.length(text)
    return F.when(size > 1, counted_tokens(F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def shortest_partner(size: Column, least: float) -> Column:
    return F.ceil(least * size / (2 - least) - EPSILON)


def pairs_shared(size: Column, least: float) -> Column:
    """How many letter pairs a text of this length shares at least with any partner; under 1 the bound says nothing."""
    return F.ceil((1.5 * least - 1) * (size + shortest_partner(size, least)) - 1 - EPSILON)


def letters_shared(size: Column, least: float) -> Column:
    return F.ceil(least * (size + shortest_partner(size, least)) / 2 - EPSILON)


def prefixes(texts: DataFrame, tokens: Column, shared: Column) -> DataFrame:
    """(group, text, token) of the rarest tokens of each text, one of which it has in common with all texts of its group that share ``shared`` of its tokens."""
    each = texts.select("group", "text", shared.alias("shared"), F.explode(tokens).alias("token"))
    rarity = each.groupBy("group", "token").agg(F.count("*").alias("n"))
    ordered = each.join(rarity, ["group", "token"]).groupBy("group", "text", "shared").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))  # as many as the text has letters
    few = F.slice("tokens", 1, F.greatest(F.size("tokens") - F.col("shared") + 1, F.lit(0)).cast("int"))
    return ordered.select("group", "text", F.explode(few).alias("t")).select("group", "text", "t.token")


def met(texts: DataFrame, tokens: Column, shared: Column, which: Column) -> DataFrame:
    """Pairs (group, left, right) of texts of the two sides that share a prefix token."""
    own = texts.filter(which)
    found = prefixes(own.select("group", "text").distinct(), tokens, shared).join(own, ["group", "text"])
    left = found.filter("side = 0").select("group", F.col("text").alias("left"), "token")
    right = found.filter("side = 1").select("group", F.col("text").alias("right"), "token")
    return left.join(right, ["group", "token"]).select("group", "left", "right")


def alike(a: DataFrame, b: DataFrame, left: str, right: str, least: float, within: str | None = None) -> DataFrame:
    """(left, right, score): all pairs of the texts of two columns with a ratio of at least ``least`` (over 0), each once.

    With ``within``, a column of both tables, only texts of equal values of it are compared, and it comes first in the result. Rows
    without a value of it are compared with none. The right column is named ``<right>_2`` if both have one name."""
    if not 0 < least <= 1:
        raise ValueError("a similarity join needs a least ratio over 0 and up to 1")
    group = F.col(within) if within else F.lit(0)
    sides = [df.select(group.alias("group"), F.col(c).alias("text"), F.lit(n).alias("side")).dropna() for n, (df, c) in enumerate([(a, left), (b, right)])]
    texts = sides[0].unionByName(sides[1]).distinct()
    text, size = F.col("text"), F.length("text")
    long_ = pairs_shared(size, least) >= 1
    # a text meets by its letters if it, or a partner that it may have, is too short for the bound on letter pairs
    some_short = pairs_shared(shortest_partner(size, least), least) < 1
    pairs = met(texts, letters(text), letters_shared(size, least), some_short)
    if least > 2 / 3:
        pairs = pairs.unionByName(met(texts, letter_pairs(text), pairs_shared(size, least), long_))
    la, lb = F.length("left"), F.length("right")
    near = pairs.filter(2 * F.least(la, lb) >= least * (la + lb) - EPSILON).distinct()
    both = F.size(F.array_intersect(letters(F.col("left")), letters(F.col("right")))) - F.when(la + lb == 0, 1).otherwise(0)
    likely = near.filter(2 * both >= least * (la + lb) - EPSILON)
    scored = likely.withColumn("score", ratio("left", "right")).filter(F.col("score") >= least)
    grouped = [F.col("group").alias(within)] if within else []
    return scored.select(*grouped, F.col("left").alias(left), F.col("right").alias(right if right != left else f"{right}_2"), "score")


def best_alike(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """Of each key's pairs the one with the highest score; of equally good ones the first in order."""
    best = F.min_by(F.struct(other, "score"), F.struct(-F.col("score"), other))
    return pairs.groupBy(key).agg(best.alias("__b")).select(key, f"__b.{other}", "__b.score")


def leaders(df: DataFrame, session: str, key: str, order: list[Column], least: float = 0.85) -> DataFrame:
    """Rows of each session in order, each kept unless its key is similar to that of a row kept before it: sessions of any size.

    Rows of one key are alike, so only the first can stay; the first rows of different keys are joined by similarity once. Then
    rounds keep each row without an undecided earlier neighbour and drop its later neighbours, which gives what the loop in order gives.
    Empty keys (and null ones) are like nothing: all their rows stay. ``order`` must tell rows of a session apart."""
    placed = df.withColumn("__at", F.struct(*order))
    free = placed.filter(F.coalesce(F.col(key), F.lit("")) == "")
    named = placed.filter(F.col(key) != "").withColumn("__s", F.coalesce(F.col(session).cast("string"), F.lit("")))
    firsts = named.groupBy("__s", key).agg(F.min_by(F.struct(*df.columns), "__at").alias("row"), F.min("__at").alias("at"))
    firsts = checkpoint(firsts.select("__s", F.col(key).alias("text"), "row", "at"))
    pairs = alike(firsts, firsts, "text", "text", least, "__s").filter("text <> text_2").select("__s", "text", "text_2")
    at = firsts.select("__s", "text", "at")
    other = at.select("__s", F.col("text").alias("text_2"), F.col("at").alias("at_2"))
    # the ratio depends on the order of its texts: a later key is held against an earlier one as (later, earlier)
    edges = checkpoint(pairs.join(at, ["__s", "text"]).join(other, ["__s", "text_2"]).filter("at_2 < at").select("__s", F.col("text").alias("late"), F.col("text_2").alias("early")))
    kept = firsts.select("__s", "text").join(edges.select("__s", F.col("late").alias("text")), ["__s", "text"], "left_anti")
    while not edges.isEmpty():
        open_ = edges.select("__s", F.col("late").alias("text")).distinct()
        sure = edges.select("__s", F.col("early").alias("text")).distinct().join(open_, ["__s", "text"], "left_anti")
        lost = checkpoint(edges.join(sure.withColumnRenamed("text", "early"), ["__s", "early"], "left_semi").select("__s", F.col("late").alias("text")).distinct())
        left = edges.join(lost.withColumnRenamed("text", "late"), ["__s", "late"], "left_anti").join(lost.withColumnRenamed("text", "early"), ["__s", "early"], "left_anti")
        left = checkpoint(left)
        # what was held back only by dropped rows has no earlier neighbour now
        kept = checkpoint(kept.unionByName(open_.join(lost, ["__s", "text"], "left_anti").join(left.select("__s", F.col("late").alias("text")), ["__s", "text"], "left_anti")).distinct())
        edges = left
    return firsts.join(kept, ["__s", "text"], "left_semi").select("row.*").unionByName(free.drop("__at"))
