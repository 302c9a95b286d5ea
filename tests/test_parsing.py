"""Parsers: the forms of frames, groups, threads, fields, Java traces."""

import pytest
from pyspark.sql import functions as F

from stackweave.functions import parsing as p


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize(
    "line,function,file,fileline,dylib",
    [
        ("#1 0x0a in foo (x=1) at a.c:12 from /lib/l.so", "foo", "a.c", "12", "/lib/l.so"),
        ("#2 0x0a in foo (x=1) from /lib/l.so", "foo", None, None, "/lib/l.so"),
        ("#3 0x0a foo (x=1) from /lib/l.so", "foo", None, None, "/lib/l.so"),
        ("#4 0x0a in foo (x=1) at a.c:12", "foo", "a.c", "12", None),
        ("#5 foo (x=1) at a.c:12", "foo", "a.c", "12", None),
        ("#6 0x0a in foo (x=1", "foo", None, None, None),
        ("#7 0x0a in foo", "foo", None, None, None),
        ("#8 foo (x=1", "foo", None, None, None),
        ("#9 <signal handler called>", "<signal handler called>", None, None, None),
    ],
)
def test_frame_forms(spark, line, function, file, fileline, dylib):
    f = one(spark, p.frame_of, line)
    assert (f.depth, f.function, f.file, f.fileline, f.dylib) == (int(line[1]), function, file, fileline, dylib)


@pytest.mark.parametrize("line", ["no frame", "", None, "#x"])
def test_no_frame(spark, line):
    assert one(spark, p.frame_of, line) is None


def test_groups(spark):
    text = "head\r\n#0 0x1 in f\n  at a.c:5\n  p = 3\n#1 0x2 in g"
    got = one(spark, p.grouped_lines, text)
    assert [(g.line, len(g.extras)) for g in got] == [("#0 0x1 in f", 3), ("#1 0x2 in g", 1)]
    assert one(spark, lambda x: p.file_of_extras(F.get(p.grouped_lines(x), F.lit(0))["extras"]), text) == ("a.c", "5")
    assert one(spark, p.grouped_lines, text + "\nrax 0x0") == []
    assert one(spark, p.grouped_lines, "") == [] and one(spark, p.grouped_lines, None) is None


LONG = """#0 0xb78a9b5d in tree_notify_all (node=0x9133590,
   more)
#1 0x00002b88b1a23599 in idx::util::Order::Text::operator() () from /usr/lib/libidx.so.0
#3 <signal handler called>
#4 0x0 in main () at main.c:3
#0 0x1 in second () at b.c:1"""


def filled(spark, text):
    traces = spark.createDataFrame([(1, text)], "id long, x string").select("id", p.long_frames(F.col("x")).alias("frames"))
    return sorted((tuple(r)[1:] for r in p.fill_numbers(traces, "id", "frames").collect()), key=lambda r: -1 if r[0] is None else r[0])


def test_long_frames(spark):
    got = filled(spark, LONG)
    assert [(n, f) for n, f, _ in got] == [(0, "tree_notify_all"), (1, "idx::util::Order::Text::operator"), (2, None), (3, "<signal handler called>"), (4, "main")]
    assert got[1][2] == "/usr/lib/libidx.so.0" and got[4][2] == "main.c:3"
    assert filled(spark, "nothing") == [] and filled(spark, None) == []
    # Every hole is filled, however long; of an absurd number a row without number tells.
    far = filled(spark, "#0 a (x)\n#9500 f (a)\n#3 g (x)")
    assert [n for n, _, _ in far] == list(range(9501)) and [f for _, f, _ in far if f] == ["a", "g", "f"]
    assert filled(spark, "#99999999 f (a)") == [(None, None, None), (99999999, "f", None)]
    assert filled(spark, "#99999999999999999999 f (a)") == [(None, "f", None)]
    many = spark.createDataFrame([(k, f"#{k} f (a)\n#{k} f (b)") for k in range(3)], "id long, x string").select("id", p.long_frames(F.col("x")).alias("frames"))
    assert sorted((r.id, r.number) for r in p.fill_numbers(many, "id", "frames").collect()) == [(0, 0), (1, 0), (1, 1), (1, 1), (2, 0), (2, 1), (2, 2), (2, 2)]


def test_threads_tops_fields(spark):
    assert one(spark, p.threads_of, "x\nThread 1 (a):\n#0 f ()\nthread 22:\n#0 g ()") == [" (a):\n#0 f ()\n", ":\n#0 g ()"]
    assert one(spark, p.threads_of, "none") == []
    assert [tuple(f) for f in one(spark, p.top_frames, "foo (x) from /l.so\nbar ()")] == [("foo", "/l.so"), ("bar", None)]
    text = "It broke.\nTwice.\nTitle: a b\nUname: Linux\n more\nTitle: last\n"
    assert one(spark, p.description_of, text) == "It broke.\nTwice.\n"
    assert one(spark, p.fields_of, text) == {"uname": "Linux\n more", "title": "last"}
    assert one(spark, p.fields_of, "plain") == {}
    files = spark.createDataFrame([("Stacktrace.gz",), ("Stacktrace.txt (retraced)",), ("other",)], "f string")
    assert [r[0] for r in files.select(p.file_priority(F.col("f"))).collect()] == [5, 1, None]


@pytest.mark.parametrize(
    "extras,want",
    [
        (["from /lib/x.so.1?", "at y.c:3"], ("/lib/x.so.1", None, None)), (["from here", "at y.cpp:33,"], (None, "y.cpp", 33)), (["at home"], (None, None, None)),
        (["at bits/ostream"], (None, "bits/ostream", None)), ([], (None, None, None)),
    ],
)
def test_recover(spark, extras, want):
    assert tuple(one(spark, p.recover_location, extras, "array<string>")) == want


def test_old_shape_and_unknown(spark):
    got = one(spark, p.modern_frames, [("m", "F.java:12"), ("n", "Native")], "array<struct<method:string,source:string>>")
    assert [tuple(f) for f in got] == [(0, "m", "F.java", "12"), (1, "n", "Native", None)]
    names = spark.createDataFrame([("??",), ("0x1f in",), ("f",), (None,)], "f string")
    assert [r[0] for r in names.select(p.null_unknown(F.col("f"))).collect()] == [None, None, "f", None]


JAVA = "x java.lang.NullPointerException: oops\n\tat a.b.C.m(C.java:12)\n at a.b.D.<init>(D.java(Compiled Code))\nCaused by: java.io.IOException at a.E.f(Native Method)"


def traces(text):
    return [(t["exception"], t["message"], [(f["function"], f["file"], f["fileline"]) for f in t["frames"]], [n["exception"] for n in t["nested"]]) for t in p.java_traces(text)]


def test_java(spark):
    (t,) = one(spark, p.parse_java, JAVA)
    assert (t.exception, t.message) == ("java.lang.NullPointerException", "oops")
    assert [(f.depth, f.function, f.file, f.fileline) for f in t.frames] == [(0, "a.b.C.m", "C.java", "12"), (1, "a.b.D.<init>", "D.java(CompiledCode", None)]
    assert [(n.exception, len(n.frames)) for n in t.nested] == [("java.io.IOException", 1)]
    for nothing in ("", None, "an Exception at noon", "java.lang.FooError without frames"):
        assert one(spark, p.parse_java, nothing) == []
    many = "a.BException" + "".join(f" at a.b.C.m{i}(C.java:{i})" for i in range(5000))
    assert len(one(spark, p.parse_java, many)[0].frames) == 5000


@pytest.mark.parametrize(
    "text,want",
    [
        # Without a message the calls follow at once, else what stands between is none; a later exception may have them.
        ("a.BException and c.DError: it broke at x.Y.z(Y.java:1)", [("c.DError", "it broke", [("x.Y.z", "Y.java", "1")], [])]),
        # Up to the first call all is message, other exceptions too.
        ("a.BException: c.DError at x.Y.z(Y.java:1) tail at q.R.s(R.java:2)", [("a.BException", "c.DError", [("x.Y.z", "Y.java", "1")], [])]),
        ("a.BException at x.Y.z(Y.java:1234567890123) [main] at q.R.s(Unknown Source)", [("a.BException", None, [("x.Y.z", "Y.java", "1234567890123"), ("q.R.s", "UnknownSource", None)], [])]),
        ("a.B$CException at x.Y.z(Y.java:no) d.EError at u.v(W)", [("a.B$CException", None, [("x.Y.z", "Y.java", None)], []), ("d.EError", None, [("u.v", "W", None)], [])]),
        # A name with blanks as in prose, a first call without a qualified name, a message that tells a cause.
        ("a.BException at x.the same place as (before)", []),
        ("a.BException at main(Y.java:1)", []),
        ("a.BException: caused by: c.DException at x.Y.z(Y.java:1)", []),
        # A cause that is no sound stack takes the trace with it; one without calls is no cause; only one is read.
        ("a.BException at x.Y.z(Y:1) caused by: c.DError at x.so it goes on and (on)", []),
        ("a.BException at x.Y.z(Y:1) caused by: nothing", [("a.BException", None, [("x.Y.z", "Y", "1")], [])]),
        ("a.BException at x.Y.z(Y:1) Caused  by : c.DError: m at u.V.w(V:2) caused by: e.FError at g.H.i(H:3)", [("a.BException", None, [("x.Y.z", "Y", "1")], ["c.DError"]), ("e.FError", None, [("g.H.i", "H", "3")], [])]),
        ("A.BEXCEPTION AT x.Y.z(Y:1)", [("A.BEXCEPTION", None, [("x.Y.z", "Y", "1")], [])]),
    ],
)
def test_java_cases(text, want):
    assert traces(text) == want


@pytest.mark.parametrize("text", ["a.BException: " * 30_000, "a.b" * 100_000, "a.BException at " * 20_000, " at x.y(" * 30_000, "(" * 200_000])
def test_java_takes_no_time_on_huge_texts(text):
    import time

    began = time.time()
    traces(text)
    assert time.time() - began < 10


def test_python_and_threads(spark):
    python = 'Traceback (most recent call last):\n  File "/usr/a.py", line 3, in <module>\n    f(1)\n  File "b.py", line 12345678901, in f\nValueError: x'
    assert [tuple(f) for f in one(spark, p.python_frames, python)] == [(0, "f", "b.py", "12345678901"), (1, "<module>", "/usr/a.py", "3")]
    assert one(spark, p.python_frames, "") == [] and one(spark, p.python_frames, None) is None
    gdb = "#0 0x1 in first () at a.c:1\nThread 2 (x):\r\n#0 0x2 in ?? ()\n#1 0x3 in g (a=1) from /l.so\n noise\nThread 1 (y):\nnothing here"
    got = one(spark, p.thread_stacks, gdb)
    assert [[(f.depth, f.function) for f in s] for s in got] == [[(0, "first")], [(0, None), (1, "g")]]
    assert [[f.function for f in s] for s in one(spark, p.thread_stacks, python)] == [["f", "<module>"]]
    assert one(spark, p.thread_stacks, "") == [] and one(spark, p.thread_stacks, None) is None


def test_normal_field_names(spark):
    row = spark.createDataFrame([(1, "a", "b", "c")], "`Bug.ID` long, Title string, Os string, oS string") if spark.conf.get("spark.sql.caseSensitive") == "true" else None
    row = row or spark.createDataFrame([(1, "a", "b")], "`Bug.ID` long, Title string, Os string")
    got = p.normal_field_names(row)
    assert got.columns == ["bug.id", "short_desc", "os"] and tuple(got.first())[:2] == (1, "a")
    assert p.normal_field_names(spark.createDataFrame([], "title string")).columns == ["title"]


def test_threads_are_written_and_read_back(spark):
    schema = "bug_id long, stack_no int, depth int, function string, file string, fileline string, dylib string, address string, args string"
    rows = [(1, 0, 0, "f", "a.c", "3", None, "0x1", "x=1"), (1, 0, 1, None, None, None, "/l.so", None, None), (1, 2, 0, "g", None, None, None, "0x2", "a\nb"), (1, 2, 0, "g", None, None, None, "0x2", "a\nb")]
    rows += [(2, 0, 0, "h", "b.c", None, "/l.so", "0x3", None), (2, 0, -1, "no", None, None, None, None, None), (2, 0, 300, "deep", None, None, None, None, None), (None, 0, 0, "n", None, None, None, None, None)]
    texts = {r.bug_id: r.text for r in p.threads_text(spark.createDataFrame(rows, schema)).collect()}
    assert texts == {1: "Thread 0:\n#0 0x1 in f (x=1) at a.c:3\n#1 0x0 in ?? () from /l.so\nThread 2:\n#0 0x2 in g (a b)", 2: "Thread 0:\n#0 0x3 in h () at b.c"}
    got = one(spark, p.thread_stacks, texts[1])
    assert [[(f.depth, f.function, f.file, f.dylib) for f in s] for s in got] == [[(0, "f", "a.c", None), (1, None, None, "/l.so")], [(0, "g", None, None)]]
    assert p.threads_text(spark.createDataFrame([], schema)).count() == 0
