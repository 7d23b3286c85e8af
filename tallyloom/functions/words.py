"""The word mapping: a text becomes one row for each distinct lower-cased word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what separates words, as a pattern.
PATTERN = '[ ,.?;"()!]+'


def words(text: Column) -> Column:
    """All words, in order; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), PATTERN), "")


def word_rows(docs: DataFrame, text: str) -> DataFrame:
    """docs, one row per distinct word: word, word_count, and first_count, 1 on the row of a text's least word and 0 on its others.

    No shuffle: words are sorted and counted inside each row's array, in time linear in the sorted words. A text without words gives no row.
    """
    found = docs.withColumn("_words", F.sort_array(words(F.col(text))))
    starts = F.filter(F.transform("_words", lambda w, i: i), lambda i: (i == 0) | (F.get("_words", i) != F.get("_words", i - 1)))
    found = found.withColumn("_starts", starts)
    entries = F.transform(
        "_starts",
        lambda at, i: F.struct(
            F.get("_words", at).alias("word"),
            (F.coalesce(F.get("_starts", i + 1), F.size("_words")) - at).cast("bigint").alias("word_count"),
            (i == 0).cast("bigint").alias("first_count"),
        ),
    )
    # An inner generator would be given a filter on its array's size, which computes the array a second time below it.
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline_outer(entries)).where("word IS NOT NULL")
