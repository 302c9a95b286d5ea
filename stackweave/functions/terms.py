"""Canonical terms of functions and libraries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def function_term(name: Column) -> Column:
    """The name without arguments, marks after ``@``, suffixes after a dot, ``GI_`` and leading underscores.

    Names in angle brackets stay; null, blank and ``??`` give null.
    """
    t = F.trim(name)
    cut = F.trim(F.regexp_replace(t, r"(?s)[(@.].*$", ""))
    bare = F.regexp_replace(cut, r"^(?:_*GI_+|_+)", "")
    term = F.when(t.rlike(r"(?s)^<.*>$"), t).otherwise(bare)
    return F.when((term != "") & (term != "??"), term)


def library_term(path: Column) -> Column:
    """The library's file name up to ``.so``; null, blank and ``??`` give null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(path), r"(?s)^.*/", ""), r"(?s)\.so.*$", "")
    return F.when((bare != "") & (bare != "??"), bare)
