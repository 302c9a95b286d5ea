"""Frame functions and stacks: the rules' fixtures."""

import pytest
from pyspark.sql import functions as F

from stackweave.functions import frames as fr
from stackweave.functions.terms import function_term, library_term
from stackweave.operators import docfreq, reports


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "name,want",
    [("__GI__foo(int (*)(x)) const", "foo const"), ("__libc_start_main", "libc_start_main"), ("*__GI_raise", "*__GI_raise"), ("", ""), (None, None), ("_GI_x", "x"), ("__", "")],
)
def test_canonical_name(spark, name, want):
    assert one(spark, fr.canonical_name, name) == want


@pytest.mark.parametrize(
    "name,want",
    [
        ("__GI___hid_cell_commit_v2", "hid_cell_commit_v2"), ("_GI_rt_start_main", "rt_start_main"), ("___main", "main"), ("a::B (int) [clone .part.3]", "a::B"), ("x@@CORE_2.8", "x"),
        ("__w.cold.4@plt", "w"), ("f.constprop.5.cold", "f"), ("<signal handler called>", "<signal handler called>"), ("  s  ", "s"), ("??", None), (" ", None), ("", None), (None, None), ("_()", None),
        ("GI_GI_x", "GI_x"), ("g(\nint)", "g"),
    ],
)
def test_function_term(spark, name, want):
    assert one(spark, function_term, name) == want


@pytest.mark.parametrize(
    "path,want", [("/usr/lib/libx.so.2", "libx"), ("./liby.so", "liby"), ("libz.so.1?", "libz"), ("/a.so.d/libq.so.3 (deleted)", "libq"), ("kernel", "kernel"), (" ", None), (None, None), ("/x/", None)]
)
def test_library_term(spark, path, want):
    assert one(spark, library_term, path) == want


@pytest.mark.parametrize("tokens,want", [("44455", "45"), ("UU44", "UU4"), ("", ""), ("4", "4"), ("4U4", "4U4")])
def test_collapse(spark, tokens, want):
    got = one(spark, lambda x: fr.collapse_repeats(x, F.lit("U")), list(tokens), "array<string>")
    assert "".join(got) == want


@pytest.mark.parametrize("tokens,want", [("123121212", "12"), ("12121232323", "123"), ("4444445555", "45"), ("", ""), ("U1U1", "U1"), ("UU", "UU")])
def test_skip_recursion(spark, tokens, want):
    got = one(spark, lambda x: fr.skip_recursion(x, F.lit("U")), list(tokens), "array<string>")
    assert "".join(got) == want


@pytest.mark.parametrize("tokens,want,everywhere", [("991929", "192", "12"), ("99", "", ""), ("12", "12", "12"), ("", "", "")])
def test_stops(spark, tokens, want, everywhere):
    df = spark.createDataFrame([(list(tokens), [t == "9" for t in tokens])], "t array<string>, s array<boolean>")
    row = df.select(fr.trim_stops(F.col("t"), F.col("s")), fr.drop_stops(F.col("t"), F.col("s"))).first()
    assert "".join(row[0]) == want and "".join(row[1]) == everywhere


def test_packages_and_modules(spark):
    df = spark.createDataFrame([(1, ["org.x.C.m", "C.m", None]), (2, ["C.m"]), (3, [])], "i int, n array<string>")
    got = {r.i: r.p for r in df.select("i", fr.package_tokens(F.col("n"), F.col("i")).alias("p")).collect()}
    assert got == {1: ["org.x"], 2: ["@@@2@@@"], 3: ["@@@3@@@"]}
    names = spark.createDataFrame([("a.b.C.m", "/s/f.c", None), ("m", None, "/l/x.so")], "n string, f string, d string")
    out = [(tuple(r[0]), tuple(r[1]), tuple(r[2])) for r in names.select(fr.module_of(F.col("n"), "package"), fr.module_of(F.col("n"), "class"), fr.module_of(F.col("n"), "file", F.col("f"), F.col("d"))).collect()]
    assert out == [(("C.m", "a.b"), ("m", "a.b.C"), ("a.b.C.m", "f.c")), (("m", None), ("m", None), ("m", "x.so"))]


def test_ngrams(spark):
    assert one(spark, lambda x: fr.ngram_bag(x, 3, "-"), list("abc"), "array<string>") == ["a", "b", "c", "a-b", "b-c", "a-b-c"]
    assert one(spark, lambda x: fr.ngram_bag(x, 3, "-"), [], "array<string>") == []


@pytest.mark.parametrize("depths,want", [([0, 1, 3], [0, 0, 0]), ([0, 1, 2, 0, 1], [0, 0, 0, 1, 1]), ([0, 1, 1], [0, 0, 1]), ([2, 3], [0, 0])])
def test_segments(spark, depths, want):
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate(depths)], "b int, at int, depth int")
    assert [r.segment for r in reports.split_by_depth(df, ["b"], "at", "depth").orderBy("at").collect()] == want


FLAT = "bug_id long, stack_no int, depth int, function string"


def test_stacks_and_frequencies(spark):
    flat = spark.createDataFrame([(1, 0, 0, "f()"), (1, 0, 0, "f()"), (1, 0, 2, "_g"), (1, 1, 1, None), (2, 0, 0, "f"), (2, 0, 400, "deep"), (2, 0, None, "x"), (None, 0, 0, "x")], FLAT)
    stacks = reports.encode(reports.stack_names(flat))
    assert {(r.bug_id, r.stack_no): r.tokens for r in stacks.collect()} == {(1, 0): ["f", "??1", "g"], (1, 1): ["??1", "??1"], (2, 0): ["f"]}
    df = docfreq.document_frequency(stacks)
    assert {r.token: (r.df, r.percent) for r in df.collect()} == {"f": (2, 100.0), "??1": (1, 50.0), "g": (1, 50.0)}
    assert {r.token: r.df for r in docfreq.document_frequency(stacks, by_stack=True).collect()} == {"f": 2, "??1": 2, "g": 1}
    trimmed = reports.trim(reports.with_frequencies(stacks, df), 60.0)
    assert {(r.bug_id, r.stack_no): r.tokens for r in trimmed.collect()} == {(1, 0): ["??1", "g"], (1, 1): ["??1", "??1"]}
    assert reports.stack_names(spark.createDataFrame([], FLAT)).count() == 0
    assert {r.term: r.freq for r in reports.bag(stacks.where("bug_id = 1"), 2).collect()}["??1\n??1"] == 1
    with pytest.raises(KeyError):
        reports.remove_recursion(stacks, "none")


def test_frequencies_at_queries(spark):
    flat = spark.createDataFrame([(b, 0, 0, "f") for b in (1, 2, 3, 4)] + [(5, 0, 0, "g")], FLAT)
    stacks = reports.encode(reports.stack_names(flat))
    queries = spark.createDataFrame([(0, 4), (1, 5), (2, 4)], "query_ord long, bug_id long")
    base = spark.createDataFrame([(1,), (2,), (3,)], "bug_id long")
    got = {(r.query_ord, r.token): (r.df, r.total) for r in docfreq.frequency_at_queries(stacks, queries, base).collect()}
    assert got == {(0, "f"): (4, 4), (1, "g"): (1, 5), (2, "f"): (5, 6)}


def test_packages_of_all_calls_of_a_document(spark, tmp_path):
    from stackweave.queries import reference

    text = "".join(f"\tat org.p{k}.Cls.run(Cls.java:{k})\n" for k in range(310))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert reference.QUERIES["fn_package"](spark, str(tmp_path)).first().packages == [f"org.p{k}" for k in range(310)]
