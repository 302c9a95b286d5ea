"""Column builders over frames: names, packages, recursion, stop words, n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 300


def canonical_name(name: Column) -> Column:
    """The name without its outermost parentheses, a leading ``GI_`` and leading underscores; null stays null."""
    # The three patterns, in this order.
    out = F.regexp_replace(name, r"(?d)\(.*\)", "")
    out = F.regexp_replace(out, r"^_*GI_+", "")
    return F.regexp_replace(out, r"^_+", "")


def unknown_token(report: Column, keep_unknown: bool = False) -> Column:
    """The token of unknown functions: one of the report's own, or one for all."""
    return F.lit("??") if keep_unknown else F.concat(F.lit("??"), report.cast("string"))


def token(name: Column, report: Column, keep_unknown: bool = False) -> Column:
    """Canonical name, unknown where null. A name ``??`` is ordinary unless unknowns are shared."""
    return F.coalesce(canonical_name(name), unknown_token(report, keep_unknown))


def package_tokens(names: Column, row_key: Column, max_depth: int = MAX_DEPTH) -> Column:
    """Packages (all but the last two dotted parts) of an array of names; a unique token if none is left.

    Null names count for the depth but give no token, nor do names of fewer than three parts.
    """
    cut = F.slice(names, 1, max_depth) if max_depth > 0 else names
    packages = F.transform(
        F.filter(cut, lambda n: n.isNotNull() & (F.size(F.split(n, r"\.")) >= 3)),
        lambda n: canonical_name(F.array_join(F.slice(F.split(n, r"\."), 1, F.size(F.split(n, r"\.")) - 2), ".")),
    )
    return F.when(F.size(packages) > 0, packages).otherwise(F.array(F.concat(F.lit("@@@"), row_key.cast("string"), F.lit("@@@"))))


def module_of(name: Column, source: str, file: Column | None = None, dylib: Column | None = None) -> Column:
    """``{function, module}`` of one frame; the module is the ``package``, ``class``, ``namespace`` or ``file``."""
    if source == "file":
        base = lambda c: F.element_at(F.split(c, "/"), -1)
        return F.struct(canonical_name(name).alias("function"), F.coalesce(base(file), base(dylib)).alias("module"))
    mark, keep = {"package": (r"\.", 2), "class": (r"\.", 1), "namespace": ("::", 1)}[source]
    glue = mark.replace("\\", "")
    parts = F.split(name, mark)
    n = F.size(parts)
    head = F.when(n > keep, F.array_join(F.slice(parts, 1, F.greatest(n - keep, F.lit(0))), glue))
    tail = F.array_join(F.slice(parts, F.greatest(n - keep + 1, F.lit(1)), keep), glue)
    return F.struct(canonical_name(tail).alias("function"), head.alias("module"))


def collapse_repeats(tokens: Column, unknown: Column) -> Column:
    """Consecutive equal tokens become one, unknown ones stay."""
    previous = lambda i: F.get(tokens, i - 1)
    return F.filter(tokens, lambda x, i: (i == 0) | (x == unknown) | (x != previous(i)))


def skip_recursion(tokens: Column, unknown: Column) -> Column:
    """Keeps a token and jumps past its last later occurrence; unknown ones never jump."""
    n = F.size(tokens)
    last = lambda x: n - F.array_position(F.reverse(tokens), x).cast("int")
    empty = F.array().cast("array<string>")
    state = F.struct(F.lit(0).alias("next"), F.lit(0).alias("at"), empty.alias("out"))

    def step(s: Column, x: Column) -> Column:
        take = s["at"] == s["next"]
        after = F.when(take & (x != unknown), last(x) + 1).when(take, s["at"] + 1).otherwise(s["next"])
        return F.struct(after.alias("next"), (s["at"] + 1).alias("at"), F.when(take, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    return F.aggregate(tokens, state, step, lambda s: s["out"])


def trim_stops(tokens: Column, stops: Column) -> Column:
    """Drops stop tokens from both ends, keeps those inside; all-stop arrays become empty.

    ``stops`` is an array of booleans aligned with ``tokens``.
    """
    first = F.array_position(stops, False).cast("int")
    last = F.size(stops) - F.array_position(F.reverse(stops), False).cast("int") + 1
    return F.when(first == 0, F.slice(tokens, 1, 0)).otherwise(F.slice(tokens, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))))


def drop_stops(tokens: Column, stops: Column) -> Column:
    """Drops stop tokens everywhere."""
    return F.filter(tokens, lambda _, i: ~F.get(stops, i))


def ngram_bag(tokens: Column, longest: int, glue: str = "\n") -> Column:
    """All n-grams of one to ``longest`` tokens, joined by ``glue``."""
    n = F.size(tokens)

    def of_length(k: int) -> Column:
        at = F.when(n >= k, F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, k), glue))

    return F.concat(tokens, *[of_length(k) for k in range(2, longest + 1)])
