import random
import re
import string

import pytest
import regex
from pyspark.ml.feature import StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from chatloom.functions import text
from chatloom.functions.casts import cast_columns, first_result
from chatloom.functions.fixed_values import (
    EMOJI_RANGES, PUNCTUATION, STOP_WORDS, WEB_TOKEN, WHITESPACE,
)
from chatloom.operators import messages
from chatloom.sources.readers import with_label


def apply(spark, function, values, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_fixed_values(spark):
    assert STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")
    assert PUNCTUATION == string.punctuation
    assert all(chr(c).isspace() == (chr(c) in WHITESPACE) for c in range(0x110000))


def test_emoji_ranges_are_the_unicode_property():
    ours = set()
    for span in EMOJI_RANGES:
        first, _, last = span.partition("-")
        ours |= set(range(int(first, 16), int(last or first, 16) + 1))
    theirs = {c for c in range(0x80, 0x110000) if regex.match(r"\p{Emoji}", chr(c))}
    theirs -= set(range(0x1F1E6, 0x1F200))
    # The installed Unicode tables may know fewer or more of the newest characters.
    assert {c for c in ours ^ theirs if c < 0x1F6D0} == set()


def test_tokens_equal_the_ml_tokenizer(spark):
    values = [" Lead", "two  blanks", "tab\tand\nline", "plain", "ÀÉ x", "end ", "ends  \n", "", " ", "\u00a0x\u00a0"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    ml = [r["t"] for r in Tokenizer(inputCol="v", outputCol="t").transform(df).collect()]
    assert apply(spark, text.tokens, values) == ml
    assert apply(spark, text.tokens, ["end ", None, ""]) == [["end"], [""], [""]]


def test_web_tokens(spark):
    words = ["@x", "#x", "http://x", "www.x", "a@b", "@;", "plain", "", "@", "#", "https://", "x#é"]
    pattern = re.compile(WEB_TOKEN)
    want = [w for w in words if w and not pattern.search(w)]
    assert apply(spark, text.without_web_tokens, [words], "array<string>") == [want]


def test_letters_only(spark):
    words = ["Don't", "a1b", "123", "", "é", "日本", "OK!"]
    got = apply(spark, text.letters_only, [words], "array<string>")
    assert got == [["dont", "ab", "ok"]]


def test_stop_words(spark):
    got = apply(spark, text.without_stop_words, [["The", "cat", "don't", "sat"]], "array<string>")
    assert got == [["cat", "sat"]]


def test_content_words_equal_their_steps(spark):
    values = ["The cat @me sat", "plain words only here", "see www.x.y or HTTP://a", None, "", "x #1 B#2"]
    steps = apply(
        spark, lambda v: text.without_stop_words(
            text.letters_only(text.without_web_tokens(text.tokens(v)))), values
    )
    assert apply(spark, text.content_words, values) == steps


EMOJI = {
    "flag": "\U0001F1EF\U0001F1F5", "skin tone": "\U0001F44D\U0001F3FD", "heart": "❤️",
    "family": "\U0001F468‍\U0001F469‍\U0001F467", "keycap": "1️⃣",
    "england": "\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F",
    "face": "\U0001F600", "copyright": "©",
}


@pytest.mark.parametrize("name", EMOJI)
def test_strip_emoji(spark, name):
    e = EMOJI[name]
    assert apply(spark, text.strip_emoji, [f"a{e}b", e * 3, f"1 {e} #"]) == ["ab", "", "1  #"]


def test_strip_emoji_keeps_other_symbols(spark):
    values = ["★♪ 草 123 #* →", "plain", None]
    assert apply(spark, text.strip_emoji, values) == values


def test_drop_emoji_tokens(spark):
    values = ["a \U0001F600 b", "x\U0001F600y z", "　wide　❤️ end", "  ", None]
    assert apply(spark, text.drop_emoji_tokens, values) == ["a b", "z", "wide end", "", None]


def test_strip_whitespace_like_python(spark):
    values = ["　 é\n", "\x1c\x85x y\xa0", "", " ﻿"]
    assert apply(spark, text.strip_whitespace, values) == [v.strip() for v in values]


def test_is_alphabetic_like_python(spark):
    values = ["abc", "草ー", "a b", "a1", "", "é\n", "abc\n", "ª"]
    assert apply(spark, text.is_alphabetic, values) == [v.isalpha() for v in values]


def test_remove_punctuation(spark):
    assert apply(spark, text.remove_punctuation, [f"a{string.punctuation}b", "「x」。"]) == ["ab", "「x」。"]


def test_sentences(spark):
    values = ["One. Two! Three?", "3.5 is a.b", "はい。そう！次", "line\nbreak", "...", "", None]
    assert apply(spark, text.sentences, values) == [
        ["One.", "Two!", "Three?"], ["3.5 is a.b"], ["はい。", "そう！", "次"], ["line", "break"],
        ["..."], [], None,
    ]


BODIES = ["abc", "草", "a b", "a1", "", "  é\n", "\U0001F600", "a\U0001F600", "　x　", None, "don’t"]


def test_clean_messages_keeps_the_label_of_its_row(spark):
    df = spark.createDataFrame([(b, i) for i, b in enumerate(BODIES)], "body string, label int")
    got = {r["label"]: r["body"] for r in messages.clean_messages(df).collect()}
    assert got == {0: "abc", 1: "草", 5: "é", 7: "a", 8: "x"}
    loose = {r["label"]: r["body"] for r in messages.clean_messages(df, strict=False).collect()}
    assert loose == {**got, 2: "a b", 3: "a1", 10: "don’t"}


CONTENT = {
    "The Cat sat": ["cat", "sat"],
    "see @me or #tag, at www.x.y": ["see"],
    "go http://a.b/c now https://d": ["go"],
    "mail a@b and @; stay@": ["mail", "stay"],
    "Don't can't it's": ["dont", "cant"],
    "don't": ["dont"],
    "1234 x1y2 --- Ünï": ["xy", "n"],
    "草 abc日本": ["abc"],
    "tab\tline\n end  ": ["tab", "line", "end"],
    "a\u00a0b": ["ab"],
    "THE the Over UNDER": [],
    "": [],
    "HTTP://up": [],
}


def test_content_words(spark):
    assert apply(spark, text.content_words, list(CONTENT)) == list(CONTENT.values())


def test_random_texts_like_python(spark):
    draw = random.Random(11)
    pool = list(string.printable + WHITESPACE + "éñß草ー日本١「」。ａ１@@##:/\u200d") + [
        "http://", "https://", "www.", "the ", "don't", "a", "b"
    ]
    values = ["".join(draw.choices(pool, k=draw.randint(0, 30))) for _ in range(3000)]
    assert apply(spark, text.strip_whitespace, values) == [v.strip() for v in values]
    assert apply(spark, text.is_alphabetic, values) == [v.isalpha() for v in values]
    no_marks = str.maketrans("", "", string.punctuation)
    assert apply(spark, text.remove_punctuation, values) == [v.translate(no_marks) for v in values]
    steps = apply(
        spark, lambda v: text.without_stop_words(
            text.letters_only(text.without_web_tokens(text.tokens(v)))), values
    )
    assert apply(spark, text.content_words, values) == steps
    assert apply(spark, text.strip_emoji, values) == values


def test_labels(spark):
    df = spark.createDataFrame([("chats_nonflagged_1",), ("chats_flagged_1",)], "label string")
    assert [r["label"] for r in with_label(df).collect()] == [0, 1]


def test_deduplicate_and_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 0), (None, 0), (None, 0)], "b string, label int")
    unique = messages.deduplicate(df)
    assert unique.count() == 3
    assert {r["label"]: r["count"] for r in messages.class_counts(unique).collect()} == {0: 2, 1: 1}


def test_cast_columns(spark):
    values = ["12", "12.5", "3000000000", "x", None, " 7 ", "-1.9"]
    df = spark.createDataFrame([(v, v, "k") for v in values], "i string, d string, keep string")
    got = cast_columns(df, {"i": "int", "d": "double"})
    assert got.dtypes == [("i", "int"), ("d", "double"), ("keep", "string")]
    assert [r["i"] for r in got.collect()] == [12, 12, None, None, None, 7, -1]
    assert [r["d"] for r in got.collect()] == [12, 12.5, 3e9, None, None, 7, -1.9]


def test_first_result(spark):
    df = spark.createDataFrame([([{"result": "1"}, {"result": "0"}],), ([],), (None,)], "c array<struct<result:string>>")
    assert [r[0] for r in df.select(first_result(F.col("c"))).collect()] == ["1", None, None]
