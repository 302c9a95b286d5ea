"""Token filters, tokenizers, cleaners."""

import pytest
from pyspark.sql import functions as F

from stackweave.functions import text as t


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize(
    "f,value,want",
    [
        (t.lower_case, "AbÉ", "abé"), (t.digits_to_zero, "a12", "a00"), (t.number_to_zero, "a12b3", "a0b0"), (t.drop_html_symbols, "a&lt&gtb", "ab"), (t.drop_stop_word, "the", ""), (t.drop_stop_word, "crash", "crash"),
        (t.module_function, "org.ab.run()", "#MODULE_FUNCTION"), (t.module_function, "plain", "plain"), (t.url, "http://x.y/z", "#URL"), (t.url, "www.q", "#URL"), (t.url, "site.org/a?b", "#URL"), (t.url, "a.b", "a.b"),
        (t.collapse_punctuation, "!!!!", "!"), (t.collapse_punctuation, "......", "..."), (t.collapse_punctuation, "..", "."), (t.collapse_punctuation, "-----", "--"), (t.collapse_punctuation, "\\\\", "\\"), (t.collapse_punctuation, "a!!", "a!!"),
        (t.drop_punctuation, "a]b\\c-d", "abcd"), (t.strip_punctuation, "12(abc)!", "abc"), (t.drop_unusual, "ab1", ""), (t.drop_unusual, "abcde1", "abcde1"), (t.drop_unusual, "", ""),
        (t.whitespace_tokens, " a b\n c ", ["a", "b", "c"]), (t.whitespace_tokens, "", []), (t.alphanumeric_tokens, "hello world, org.site_x é", ["hello", "world", "org", "site", "x", "é"]),
        (t.camel_tokens, "TileCacheMap<PageKey, 0>::find", ["Tile", "Cache", "Map", "<", "Page", "Key", ",", "0", ">", "::", "find"]),
        (t.camel_tokens, "IPQu 123a $$,", ["IP", "Qu", "123", "a", "$$", ","]), (t.word_tokens, "It doesn't work, v1.2!", ["It", "does", "n't", "work", ",", "v1", ".", "2", "!"]),
        (t.field_or_none, None, "NNNOOONNNEEE"), (t.stripped_or_empty, None, ""), (t.stripped_or_empty, "  a ", "a"), (t.lower_case, None, None),
        (t.soft_clean, "a!!b 12:30:45 2010-1-02", "a ! b  "), (lambda x: t.soft_clean(x, True, True), "a1!b", "a b"),
        (t.clean_description, "short\nthis line has five good tokens\nint x = new Foo();\n1 2 3 4 5 6 7 8 9\n", "this line has five good tokens\n"),
    ],
)
def test_functions(spark, f, value, want):
    assert one(spark, f, value) == want


def test_quotes(spark):
    assert one(spark, t.directed_quotes, ['"', "a", "'", "`", "b"], "array<string>") == ["``", "a", "''", "``", "b"]


def test_filters_by_name(spark):
    f = t.load_filters(["lower_case", "number_to_zero"])
    assert one(spark, f, "AB12") == "ab0"
    with pytest.raises(KeyError):
        t.load_filters(["no_such"])
