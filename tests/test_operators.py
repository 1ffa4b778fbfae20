"""Set, window, judge, source and streaming operators on small tables with edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import judge as J
from textloom.operators import report as R
from textloom.operators import sets as S
from textloom.operators import windows as W
from textloom.operators.drift import consistent_table, schema_changes
from textloom.operators.graph import connected_components, pairs_within
from textloom.sources import io
from textloom.streaming import incremental as I


def test_positions_splits_and_quotas(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    placed, n = S.ranked(df, "k", F.desc("k"))
    assert n == 100 and {r["k"]: r["pos"] for r in placed.collect()} == {k: 99 - k for k in range(100)}
    split = S.split_by_share(df, "k", 0.9, 1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 90, "val": 10}
    sample = S.quota_sample(df.withColumn("g", F.col("k") % 3), "g", "k", 5, 1)
    assert {r["count"] for r in sample.groupBy("g").count().collect()} == {5}
    assert S.ranked(df.limit(0), "k")[1] == 0
    assert S.tail_size(3000) == 500 and S.tail_size(300) == 200


def test_null_keys_and_ties(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "i int, k string")
    used = spark.createDataFrame([(None,), ("x",)], "k string")
    assert sorted(r["i"] for r in S.anti(a, used, "k").collect()) == [1, 3]
    dup = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 3)], "k string, v int")
    assert sorted(((r["k"] or ""), r["v"]) for r in S.first_of(dup, "k", "v").collect()) == [("", 3), ("a", 1)]


def test_components_and_pairs(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 5)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(chain.limit(0)).count() == 0
    members = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 99), (1, 3), (None, 4)], "g long, id long")
    pairs = pairs_within(members, "g", "id", "a", "b", block=7).collect()
    assert len(pairs) == len(set(pairs)) == 30 * 29 // 2


def test_windows(spark):
    df = spark.createDataFrame([("a", i, float(v) if v is not None else None) for i, v in enumerate([5, None, 7, 1, 9, 9])], "g string, o int, v double")
    got = {r["o"]: r["smooth"] for r in W.moving_average(df, "g", "o", "v", 2).collect()}
    values = [5, 7, 1, 9, 9]
    mirrored = [values[0], *values]
    want = [(mirrored[i] + mirrored[i + 1]) / 2 for i in range(5)]
    assert got[1] is None and [got[i] for i in (0, 2, 3, 4, 5)] == want
    few = spark.createDataFrame([("a", 0, None), ("a", 1, 3.0), ("b", 0, None), ("b", 1, 1.0), ("b", 2, 5.0), ("b", 3, 5.0)], "g string, o int, diff double")
    kept = sorted((r["g"], r["o"]) for r in W.keyframes(few, "g", "o", 3).collect())
    assert kept == [("a", 0), ("a", 1), ("b", 0), ("b", 2), ("b", 3)]
    log = spark.createDataFrame([("r", s, v) for s, v in zip((50, 100, 150, 200), (44.4, 39.8, 28.0, 10.0))], "g string, o int, v double")
    row = W.plateau(log, "g", "o", "v").collect()[0]
    assert (row["best"], row["streak"], row["stop"]) == (44.4, 3, 200)
    stop = W.first_below(spark.createDataFrame([("r", 1, 0.0), ("r", 2, 0.01)], "g string, o int, v double"), "g", "o", "v", 0.05)
    assert stop.collect()[0]["stop"] == 2


def test_judge_answers(spark):
    dims = ("a", "b")
    texts = ['```json\n{"a": 7.9, "b": "11"}\n```', 'well {"a": 3, "b": 0} done', '{"a": 1}', "no json", None, '{"a": "x", "b": 2}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r["a"], r["b"], r["failed"]) for r in J.scores(df, "t", dims).collect()]
    assert got == [(7, 10, False), (3, 1, False)] + [(0, 0, True)] * 4
    assert J.scores(df, "t", dims, "skip").count() == 2


def test_report(spark):
    long = spark.createDataFrame([("m", "A", 1.0), ("m", "B", 3.0), ("n", "B", 2.0)], "metric string, c string, value double")
    wide = {r["metric"]: r["delta"] for r in R.pivot_with_delta(long, "c", ["A", "B"]).collect()}
    assert wide == {"m": 2.0, "n": None}
    common = R.most_common(spark.createDataFrame([(2, ["y", "x"]), (1, ["x", "y", "z"])], "pos int, f array<string>"), "f", "pos", 2)
    assert [(r["item"], r["n"]) for r in common.collect()] == [("x", 2), ("y", 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"video_id": "1", "caption": "x"}, {"video_id": "2"}]))
    assert io.json_array(spark, str(tmp_path / "a.json"), "video_id string, caption string").count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"7546030642.0": "t", "b": "[ERROR: x]"}))
    assert {r["video_id"] for r in io.json_map(spark, str(tmp_path / "m.json"), "string").collect()} == {"7546030642.0", "b"}
    (tmp_path / "s.json").write_text(json.dumps({"train": [{"v": 1}], "val": [{"v": 2}, {"v": 3}]}))
    assert sorted((r["split"], r["v"]) for r in io.json_splits(spark, str(tmp_path / "s.json"), "v int").collect()) == [("train", 1), ("val", 2), ("val", 3)]
    (tmp_path / "d.json").write_text(json.dumps({"data": [{"q": "x"}]}))
    assert io.json_member(spark, str(tmp_path / "d.json"), "data", "q string").count() == 1
    (tmp_path / "ids.txt").write_text("b\n\na\r\n")
    assert [r["id"] for r in io.id_list(spark, str(tmp_path / "ids.txt")).orderBy("pos").collect()] == ["b", "a"]
    for name, value in (("l.json", [{"video_id": "a", "score": 1}]), ("o.json", {"a": {"score": 2}, "b": 3})):
        (tmp_path / name).write_text(json.dumps(value))
    assert [(r[0], r[1]) for r in io.score_map(spark, str(tmp_path / "l.json")).collect()] == [("a", 1.0)]
    assert sorted((r[0], r[1]) for r in io.score_map(spark, str(tmp_path / "o.json")).collect()) == [("a", 2.0), ("b", 3.0)]
    frames = tmp_path / "frames"
    frames.mkdir()
    for n in ("v1_kf00.jpg", "v1_kf01.jpg", "v2_kf00.jpg", "x.txt"):
        (frames / n).write_bytes(b"1")
    assert {r["key"]: len(r["paths"]) for r in io.files(spark, str(frames), "*.jpg").collect()} == {"v1": 2, "v2": 1}
    rows = spark.createDataFrame([(["a", "b"],), (["c"],), (None,)], "p array<string>")
    held = io.existing(rows, "p", spark.createDataFrame([("a",), ("b",)], "path string"))
    assert sorted((tuple(r["p"]), r["all_exist"]) for r in held.collect()) == [((), False), ((), True), (("a", "b"), True)]


def test_resumed_runs_and_streams(spark, tmp_path):
    todo = spark.createDataFrame([(i, str(i)) for i in range(6)], "pos int, id string")
    sink = str(tmp_path / "sink")
    assert I.resume(todo, sink, "id", lambda d: d, 3, "pos").count() == 3
    assert I.resume(todo, sink, "id", lambda d: d, 5, "pos").count() == 5
    source = str(tmp_path / "in")
    todo.unionByName(todo).write.json(source)
    stream = spark.readStream.schema("pos int, id string").json(source)
    I.resumable_stream(stream, sink, str(tmp_path / "cp"), "id", lambda d: d.select("pos", "id")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list("012345")
    io.write_routed(spark.createDataFrame([(1, ["x"]), (2, [])], "i int, flags array<string>"), str(tmp_path / "r"))
    assert [r["i"] for r in spark.read.parquet(str(tmp_path / "r")).where("cast(is_clean as boolean)").collect()] == [2]


def records(files):
    rows = []
    for no, recs in enumerate(files, 1):
        rows += [("run", no, f"f{no}", vid, None if o is None else o if isinstance(o, str) else json.dumps(o)) for vid, o in recs]
    return rows


SCHEMA = "run_name string, file_no int, file_name string, video_id string, payload string"


def test_schema_changes(spark):
    files = [
        [("a", {"x": 1, "y": 2, "t": 5}), ("b", {"x": 2, "y": 3, "t": 6}), ("c", {"error": "timeout"}), ("d", "{broken"), ("e", None)],
        [("b", {"z": 2, "y": 3, "t": 6}), ("n", {"z": 4, "y": 1, "t": 1}), ("b", {"z": 2, "y": 3, "t": 6})],
        [("q", {"z": "4", "y": 1.5, "w": True}), ("r", {"z": "5", "y": 2.5, "w": False, "odd": 1})],
    ]
    df = spark.createDataFrame(records(files), SCHEMA).withColumn("field", F.lit("clash"))
    got = {tuple(r) for r in schema_changes(df, "payload").collect()}
    assert got == {("f2", "renamed", "x", "z"), ("f3", "retyped", "z", ""), ("f3", "retyped", "y", ""), ("f3", "removed", "t", ""), ("f3", "added", "w", "")}
    assert schema_changes(df.limit(0), "payload").count() == 0
    table = consistent_table(df, "payload", schema_changes(df, "payload"))
    assert "x" in table.columns and "z" not in table.columns
    assert sorted(r["x"] for r in table.where("x is not null").collect()) == [1.0, 2.0, 2.0, 2.0, 4.0, 4.0, 5.0]


def test_renames_are_matched_to_the_end(spark):
    """Two fields of equal values are renamed at once: both renames come out, whatever pair is taken first."""
    files = [[(v, {"a": i, "b": i, "k": 1}) for i, v in enumerate("uvw")], [(v, {"x": i, "y": i, "k": 1}) for i, v in enumerate("uvw")]]
    got = {tuple(r) for r in schema_changes(spark.createDataFrame(records(files), SCHEMA), "payload").collect()}
    assert got == {("f2", "renamed", "a", "x"), ("f2", "renamed", "b", "y")}


def test_one_table_keeps_all_values(spark):
    """One run renames a to x, another b to x, and a third has both a and b in its records: no value is lost."""
    one = [[("u", {"a": 1}), ("v", {"a": 2})], [("u", {"x": 1}), ("v", {"x": 2})]]
    two = [[("u", {"b": 5}), ("v", {"b": 6})], [("u", {"x": 5}), ("v", {"x": 6})]]
    three = [[("u", {"a": 7, "b": 8, "Extra": 1}), ("v", {"a": 9, "b": 10, "extra": 2})]]
    rows = [(run, no, f"{run}{file}", vid, raw) for run, files in (("r1", one), ("r2", two), ("r3", three)) for _, no, file, vid, raw in records(files)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit("own"))
    table = consistent_table(df, "payload", schema_changes(df, "payload"))
    held = sorted(v for r in table.collect() for k, v in r.asDict().items() if isinstance(v, float))
    assert held == sorted([1, 2, 1, 2, 5, 6, 5, 6, 7, 8, 9, 10, 1, 2]) and [r["extra"] for r in table.collect()] == ["own"] * 10


def test_shared_folder_is_asked_for(spark, monkeypatch):
    from textloom import session

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda name, other=None: other)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})  # noqa: N815

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster)
    written = session.cut_lineage(spark.range(3))
    assert written.count() == 3


def test_absent_and_broken_sinks(spark, tmp_path):
    assert not I.table_exists(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert not I.table_exists(spark, str(tmp_path / "empty"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017 a sink that can't be read isn't taken for absent
        I.table_exists(spark, str(tmp_path / "bad"))
