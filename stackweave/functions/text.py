"""Token filters, tokenizers and cleaners as column builders. Nulls stay null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, and the token of a missing field.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NONE_TOKEN = "NNNOOONNNEEE"
# Fixed value: Unicode's white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as a class of Java's regular expressions.
_PUNCT = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"
# Common English words without meaning of their own.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by "
    "for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def lower_case(t: Column) -> Column:
    return F.lower(t)


def digits_to_zero(t: Column) -> Column:
    return F.regexp_replace(t, "[0-9]", "0")


def number_to_zero(t: Column) -> Column:
    return F.regexp_replace(t, "[0-9]+", "0")


def whitespace_tokens(t: Column) -> Column:
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


def camel_tokens(t: Column) -> Column:
    """Numbers, words broken at capitals (the last of several begins a word), and runs of one symbol.

    ``HTTPServer2::run`` gives HTTP, Server, 2, ``::``, run.
    """
    low = r"[\p{L}&&[^\p{Lu}]]"
    return F.regexp_extract_all(t, F.lit(rf"\p{{N}}+|\p{{Lu}}?{low}+|\p{{Lu}}+(?=\p{{Lu}}{low})|\p{{Lu}}+|([^\p{{L}}\p{{N}}\s])\1*"), F.lit(0))


def alphanumeric_tokens(t: Column) -> Column:
    return F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def replace_symbols(t: Column, by: str = " ") -> Column:
    return F.regexp_replace(t, r"[^\p{L}\p{N}]+", by)


def word_tokens(t: Column) -> Column:
    """An approximation of Treebank tokens: words with their apostrophes split off, numbers with inner marks, single symbols."""
    # Contractions part before the mark: do n't, it 's.
    parted = F.regexp_replace(t, r"(?i)\b(\w+)(n't)\b", "$1 $2")
    parted = F.regexp_replace(parted, r"(?i)(\w)('(?:s|m|d|ll|re|ve))\b", "$1 $2")
    return F.regexp_extract_all(parted, F.lit(r"(?U)n't|'(?:s|m|d|ll|re|ve)\b|\d+(?:[.,:]\d+)*|\w+(?:-\w+)*|\.\.\.|--|[^\w\s]"), F.lit(0))


def drop_html_symbols(t: Column) -> Column:
    return F.regexp_replace(t, "(?:&quot|&gt|&lt|&amp|&nbsp|&copy|&reg)+", "")


def drop_stop_word(t: Column, words: list[str] | None = None) -> Column:
    return F.when(t.isin(words or ENGLISH_STOP_WORDS), "").otherwise(t)


def directed_quotes(tokens: Column) -> Column:
    """Lone quotes in an array of tokens become opening and closing ones in turn."""
    placed = F.transform(tokens, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    quote = lambda e: F.coalesce(e["x"].isin('"', "`", "'"), F.lit(False))
    turned = F.transform(F.filter(placed, quote), lambda e, k: F.struct(e["i"].alias("i"), F.when(k % 2 == 0, "``").otherwise("''").alias("x")))
    # Quotes and other tokens are numbered apart and sorted together, so that no token looks through the others.
    return F.transform(F.sort_array(F.concat(F.filter(placed, lambda e: ~quote(e)), turned)), lambda e: e["x"])


# The patterns of the next three filters and of times and dates are fixed values: other ones would give other tokens than the results to match.


def module_function(t: Column) -> Column:
    return F.regexp_replace(t, r"^[a-zA-Z][a-zA-Z0-9]+(?:\.[a-zA-Z][a-zA-Z0-9]+)+(?:\(\))?$", "#MODULE_FUNCTION")


def url(t: Column) -> Column:
    first = F.regexp_replace(t, r"^(?:https?://|www\.)\S+$", "#URL")
    return F.regexp_replace(first, r"^\S+(?:\.com|\.net|\.org)(?:[/?][-a-zA-Z0-9@;:%_+.~#?&/=]*)?$", "#URL")


def collapse_punctuation(t: Column) -> Column:
    """A token of one repeated mark becomes one; four dots or more three, two dots one, three dashes or more two."""
    out = F.regexp_replace(t, r"^([,:;><!?=_\\/])\1+$", "$1")
    out = F.regexp_replace(out, r"^[.]{4,}$", "...")
    out = F.regexp_replace(out, r"^[.]{2}$", ".")
    return F.regexp_replace(out, r"^-{3,}$", "--")


def drop_punctuation(t: Column) -> Column:
    return F.regexp_replace(t, f"[{_PUNCT}]", "")


def strip_punctuation(t: Column) -> Column:
    """Drops digits and punctuation from both ends."""
    return F.regexp_replace(t, rf"^[\d{_PUNCT}]+|[\d{_PUNCT}]+$", "")


def drop_unusual(t: Column) -> Column:
    """Tokens of more than a fifth digits and punctuation become empty."""
    odd = F.length(t) - F.length(F.regexp_replace(t, rf"[\p{{N}}{_PUNCT}]", ""))
    return F.when((F.length(t) > 0) & (odd / F.greatest(F.length(t), F.lit(1)) > 0.2), "").otherwise(t)


def _without_times(t: Column) -> Column:
    out = F.regexp_replace(t, r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}", "")
    return F.regexp_replace(out, r"[0-9]{1,4}([/-])[0-9]{1,2}\1[0-9]{2,4}", "")


def clean_description(t: Column) -> Column:
    """Drops code, times and dates, then lines of under 10 characters or 5 tokens or with over a fifth digits and punctuation; kept lines end in a line feed."""
    # The patterns of code, in this order.
    out = t
    for p in (
        r"(?:(?:public|private)\s*)?class\s+\w+(?:\s+extends\s+\w+)?(?:\s+implements\s+[\w,\s]+)?\s+\{(?:\s*\})?",
        r"if\s*\(.*\{",
        r"\w+\s*\([^)]*\)\s*\{",
        r"\w\s*=\snew[^;]+;",
    ):
        out = F.regexp_replace(out, f"(?d){p}", "")
    out = F.regexp_replace(_without_times(out), r"([,:;><!?=_\\/*\-.])\1+", "$1")
    tokens = lambda line: F.size(F.filter(F.split(line, r"\s"), lambda x: x != ""))
    odd = lambda line: F.length(line) - F.length(F.regexp_replace(line, rf"[\p{{N}}{_PUNCT}]", ""))
    kept = F.filter(F.split(out, "\n"), lambda line: (F.length(line) >= 10) & (tokens(line) >= 5) & (odd(line) / F.greatest(F.length(line), F.lit(1)) <= 0.2))
    return F.array_join(F.transform(kept, lambda line: F.concat(line, F.lit("\n"))), "")


def soft_clean(t: Column, drop_marks: bool = False, drop_numbers: bool = False) -> Column:
    """Collapses repeated punctuation, drops times and dates, and sets punctuation apart or drops it."""
    out = _without_times(F.regexp_replace(t, f"([{_PUNCT}])\\1+", "$1"))
    if drop_numbers:
        out = F.regexp_replace(out, "[0-9]", "")
    return F.regexp_replace(out, f"([{_PUNCT}])", " " if drop_marks else " $1 ")


def field_or_none(t: Column) -> Column:
    return F.coalesce(t, F.lit(NONE_TOKEN))


def stripped_or_empty(t: Column) -> Column:
    return F.coalesce(F.trim(t, F.lit(WHITE_SPACE)), F.lit(""))


#: Token filters by name.
FILTERS: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (
        lower_case, digits_to_zero, number_to_zero, drop_html_symbols, drop_stop_word, module_function, replace_symbols, url, collapse_punctuation, drop_punctuation,
        strip_punctuation, drop_unusual,
    )
}


def load_filters(names: list[str]) -> Callable[[Column], Column]:
    """The named filters applied one after the other to a token."""
    chosen = [FILTERS[n] for n in names]

    def apply(t: Column) -> Column:
        for f in chosen:
            t = f(t)
        return t

    return apply
