"""Message tables: cleaning, de-duplication, class counts."""

from pyspark.sql import DataFrame, functions as F

from ..functions import text


def clean_messages(messages: DataFrame, strict: bool = True) -> DataFrame:
    """Clean ``body`` and drop messages left without text; every other column stays on its row.

    Emoji go first, then outer white space, then (``strict``) every message that is not made
    of letters alone, then punctuation. A strict message thus is one word, without any mark
    left to remove; ``strict=False`` keeps messages with blanks, digits and marks.

    The cleaned text is filtered as a list of one and then unnested: a filter and a projection
    over the same expression would each run its patterns again.
    """
    body = text.strip_whitespace(text.strip_emoji(F.col("body")))
    if strict:
        kept = F.filter(F.array(body), text.is_alphabetic)
    else:
        kept = F.filter(F.array(text.remove_punctuation(body)), lambda b: b != "")
    return messages.withColumn("body", F.explode(kept))


def deduplicate(df: DataFrame) -> DataFrame:
    """One of each group of equal rows; copies are merged before the shuffle."""
    return df.distinct()


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("count"))


def sentences(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """One row per sentence with its position in the text."""
    return df.select(key, F.posexplode(text.sentences(F.col(column))).alias("position", "sentence"))
