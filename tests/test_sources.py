"""Readers and writers, round trips."""

import gzip
import json
import struct

from stackweave.sources import datasets, recommendations, reports, stackfiles


def test_reports(spark, tmp_path):
    rows = [
        {"bug_id": 1, "dup_id": [], "creation_ts": 1000000.0, "stacktrace": {"exception": "E", "message": None, "frames": [{"depth": 0, "function": "f", "fileline": 12}], "nested": [{"frames": [{"depth": 0, "function": "g"}]}]}},
        {"bug_id": 2, "dup_id": 1, "creation_ts": 1090000.0, "label": False, "stacktrace": [{"exception": None, "frames": [], "nested": []}]},
        None,
    ]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    got = {r.bug_id: r for r in reports.read_reports(spark, str(tmp_path / "r.json")).collect()}
    assert set(got) == {1, 2} and got[1].dup_id is None and got[2].dup_id == 1 and got[2].label is False
    assert got[1].stacktrace[0].frames[0].fileline == "12"
    df = reports.read_reports(spark, str(tmp_path / "r.json"))
    assert {(r.position, r.function) for r in reports.flat_frames(df).where("bug_id = 1").collect()} == {(0, "f"), (1, "g")}
    assert reports.lookup(df, 2).count() == 1 and reports.contained(df, spark.createDataFrame([(1,), (9,)], "bug_id long")).count() == 1
    twice = df.select("bug_id", "creation_ts").unionByName(spark.createDataFrame([(1, 5.0)], "bug_id long, creation_ts double"))
    assert {(r.bug_id, r.creation_ts) for r in reports.last_of_each(twice, "creation_ts").collect()} == {(1, 1000000.0), (2, 1090000.0)}
    timed = spark.sql("select 1L as bug_id, timestamp_ntz'1970-01-02 00:00:01.5' as creation_ts")
    reports.write_reports(timed, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().creation_ts == 86401.5


def test_datasets(spark, tmp_path):
    (tmp_path / "c.txt").write_text("Chunk 0; 2015/01/01-2016/01/01\n10 11 12\n12\n")
    df = datasets.read_dataset(spark, str(tmp_path / "c.txt"))
    assert [(r.query_ord, r.bug_id, r.is_duplicate) for r in df.orderBy("query_ord").collect()] == [(0, 10, False), (1, 11, False), (2, 12, True)]
    datasets.write_datasets(df, str(tmp_path / "out"))
    again = datasets.read_dataset(spark, str(tmp_path / "out/*/part-*"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "empty.txt").write_text("")
    assert datasets.read_dataset(spark, str(tmp_path / "empty.txt")).count() == 0


LISTS = [(5, 1, 2**40 + 1, 0.5), (5, 2, 7, -1.0), (6, 1, 8, 0.25)]


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rec_rank", "cand_id", "score").collect())


def test_recommendations(spark, tmp_path):
    df = spark.createDataFrame(LISTS, recommendations.RECOMMENDATION)
    path = str(tmp_path / "l.sparse")
    recommendations.write_sparse(df, path)
    assert rows(recommendations.read(spark, path)) == LISTS
    assert struct.unpack(">ii", open(path, "rb").read(8)) == (2, 50)
    with open(tmp_path / "l.bin", "wb") as f:
        f.write(struct.pack(">q", 1) + struct.pack(">qq", 5, 1) + struct.pack(">qd", 9, 0.5))
    assert rows(recommendations.read(spark, str(tmp_path / "l.bin"))) == [(5, 1, 9, 0.5)]
    (tmp_path / "a.json").write_text(json.dumps([[5, [9, 8], [0.5, 0.25]]]))
    (tmp_path / "b.json").write_text('[5, null, [[9, 0.5], [8, 0.25]]]\n[6, null, []]\n')
    want = [(5, 1, 9, 0.5), (5, 2, 8, 0.25)]
    assert rows(recommendations.read(spark, str(tmp_path / "a.json"))) == want == rows(recommendations.read(spark, str(tmp_path / "b.json")))
    first, second = (recommendations.write(df, str(tmp_path / "out")) for _ in range(2))
    assert (first, second) == (str(tmp_path / "out"), str(tmp_path / "out_1"))
    assert rows(recommendations.read(spark, second)) == LISTS


def test_folders(spark, tmp_path):
    for report, name, content in ((11, "Stacktrace.txt", b"#0 f\xe9\x01()\n"), (11, "Post.txt", b"x"), (12, "Stacktrace.gz", gzip.compress(b"#0 g ()"))):
        (tmp_path / "b 1" / str(report)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "b 1" / str(report) / name).write_bytes(content)
    files = stackfiles.read_folder(spark, str(tmp_path))
    assert files.count() == 3
    got = {r.bug_id: (r.bucket, r.file, r.text) for r in stackfiles.first_trace(files).collect()}
    assert got == {11: ("b 1", "Stacktrace.txt", "#0 fé?()\n"), 12: ("b 1", "Stacktrace.gz", "#0 g ()")}
