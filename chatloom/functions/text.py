"""Text as native column expressions; no Python worker is started."""

from pyspark.sql import Column, functions as F

from .fixed_values import (
    EMOJI, EMOJI_CHARACTER, PUNCTUATION, STOP_WORDS, WEB_TOKEN, WHITESPACE,
)


def tokens(text: Column) -> Column:
    """Lower-cased text cut at each white-space character; a missing text has no words.

    As in ``pyspark.ml.feature.Tokenizer``, neighbouring separators leave empty tokens and
    separators at the end leave none; a text without any other character gives one empty token
    if it is empty, else none.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    body = F.rtrim(lowered, F.lit(" \t\n\x0b\f\r"))  # the characters of \s
    blank = (body == "") & (lowered != "")
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(body, r"\s"))


def without_web_tokens(words: Column) -> Column:
    """Drop empty tokens and tokens that hold a handle, a hashtag or a web address."""
    return F.filter(words, lambda w: (w != "") & ~w.rlike(WEB_TOKEN))


def letters_only(words: Column) -> Column:
    """Keep the letters a-z of each token in lower case; drop tokens left empty."""
    return F.filter(_letters(words), lambda w: w != "")


def _letters(words: Column) -> Column:
    return F.transform(words, lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z]+", "")))


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(STOP_WORDS))


def content_words(text: Column) -> Column:
    """Tokenize, drop web tokens, keep letters, drop stop words."""
    words = tokens(text)
    # Plain byte searches spare most texts the pattern match per token.
    suspect = (
        text.contains("@") | text.contains("#") | text.contains("://")
        | F.lower(text).contains("www.")
    )
    plain = F.when(suspect, without_web_tokens(words)).otherwise(words)
    return F.filter(_letters(plain), lambda w: ~w.isin(["", *STOP_WORDS]))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def strip_emoji(text: Column) -> Column:
    return F.when(_is_ascii(text), text).otherwise(F.regexp_replace(text, EMOJI, ""))


def drop_emoji_tokens(text: Column) -> Column:
    """Drop each white-space token that holds an emoji; join the rest by one blank."""
    words = F.split(text, f"[{WHITESPACE}]+")
    return F.array_join(
        F.filter(words, lambda w: (w != "") & (_is_ascii(w) | ~w.rlike(EMOJI_CHARACTER))), " "
    )


def strip_whitespace(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_alphabetic(text: Column) -> Column:
    r"""True when every character is a letter; ``\z`` leaves no room for a final newline."""
    return text.rlike(r"\A\p{L}+\z")


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def sentences(text: Column) -> Column:
    """Sentences with their end marks.

    A sentence ends at a line break, at ``. ! ?`` followed by white space, or at a
    full-width mark; 3.5 or a.b stay whole.
    """
    broken = F.regexp_replace(text, r"([.!?]+)\s+", "$1\n")
    broken = F.regexp_replace(broken, r"([\x{3002}\x{FF01}\x{FF1F}]+)", "$1\n")
    parts = F.transform(F.split(broken, r"[\r\n]+"), strip_whitespace)
    return F.array_remove(parts, "")


def label_of_source(source: Column) -> Column:
    """0 for a source named nonflagged, 1 for any other."""
    return F.when(source.contains("nonflagged"), 0).otherwise(1)
