"""Logs, versions, tables, text search, traces and streams."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import fulltext, tables, vector
from weftgraph.session import GraphSession
from weftgraph.sources import log as logs
from weftgraph.sources.snapshot import VersionedTable
from weftgraph.sources.traces import TraceStore
from weftgraph.streaming import live


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_log_store(spark, tmp_path):
    s = logs.LogStore(spark, str(tmp_path / "log"))
    assert s.vertices().count() == 0
    s.merge_record("Person", "rkey", "a", {"name": "Ann", "age": 3})
    s.merge_record("Person", "rkey", "a", {"name": "Anna", "age": 4})
    s.merge_record("Person", "rkey", "b", {"name": "Bo"})
    s.merge_record("City", "rkey", "a", {"name": "Aix"})
    s.merge_record("LIVES", "eid", "e1", {"_src": "a", "_dst": "b", "since": 5})
    s.merge_record("LIVES", "eid", "e2", {"_src": "a", "_dst": "nobody"})
    g = GraphSession(s.graph(["age", "since"]))
    assert rows(g.query("MATCH (n:Person)-[r]->(m) RETURN n.name, n.age, r.since, m.name")) == [("Anna", "4", "5", "Bo")]
    assert not s.delete_record("Person", "rkey", "zz") and s.delete_record("Person", "rkey", "b") and s.delete_record("LIVES", "eid", "zz")
    assert GraphSession(s.graph()).query("MATCH (n:Person)-[r]->(m) RETURN n").count() == 0
    stats = {r["key"]: r for r in logs.statistics(s.vertices(), s.edges()).collect()}
    assert (stats["Person"]["raw_rows"], stats["Person"]["live_rows"], stats["Person"]["dead_rows"]) == (4, 1, 3)
    s.merge_record("Person", "rkey", "b", {"name": "Bob"})
    before = sorted(rows(logs.live_vertices(s.vertices()).select("label", "pk_value", "name")))
    assert s.should_compact(0)
    s.compact()
    assert sorted(rows(s.vertices().select("label", "pk_value", "name"))) == before and len(before) == 3


def test_global_ids(spark):
    df = spark.createDataFrame([(3, 77), (65535, 1), (0, (1 << 48) - 1)], "p int, i long")
    p, i = logs.decode_global_id(logs.encode_global_id(F.col("p"), F.col("i")))
    assert rows(df.select(p, i)) == rows(df)


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert t.write(one, "create") == 1 and t.write(one.limit(1)) == 2
    with pytest.raises(ValueError):
        t.write(one, "create")
    t.tag("first", 1)
    assert (t.count_rows(), t.checkout(1).count_rows(), t.checkout("first").count_rows(), t.count_rows("k = 2")) == (3, 2, 2, 1)
    assert t.delete("k = 1") == 3 and rows(t.read()) == [(2, "b")]
    assert t.update({"v": "concat(v, '!')"}, "k = 2") == 4 and rows(t.read()) == [(2, "b!")]
    assert t.merge_insert(spark.createDataFrame([(2, "x"), (9, "y")], "k int, v string"), ["k"]) == 5 and sorted(rows(t.read())) == [(2, "x"), (9, "y")]
    assert t.restore(1) == 6 and t.count_rows() == 2 and [h[1] for h in t.history()][-1] == "restore"
    assert t.compact() == 7 and t.repair() == 7
    assert t.cleanup(1) == [2, 3, 4, 5, 6] and t.versions() == [1, 7] and t.checkout("first").count_rows() == 2
    fs, where = t._fs(t._get("_manifests/v0000000007.json")["folders"][0])
    fs.delete(where, True)
    assert t.repair() == 1 and t.count_rows() == 2


MATRIX = [
    ({}, [(1, "old"), (2, "new"), (3, "new")]),
    ({"when_matched": "do_nothing"}, [(1, "old"), (2, "old"), (3, "new")]),
    ({"when_matched": "update_if", "update_if": "source.v <> 'new'"}, [(1, "old"), (2, "old"), (3, "new")]),
    ({"when_not_matched": "do_nothing"}, [(1, "old"), (2, "new")]),
    ({"not_matched_by_source": "delete"}, [(2, "new"), (3, "new")]),
    ({"not_matched_by_source": "delete_if", "delete_if": "k = 1"}, [(2, "new"), (3, "new")]),
]


@pytest.mark.parametrize("how,want", MATRIX)
def test_merge_insert(spark, how, want):
    t = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    s = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert sorted(rows(tables.merge_insert(t, s, ["k"], **how))) == want


def test_scan_and_schema(spark):
    df = spark.createDataFrame([(i, None if i == 3 else float(i % 4), str(i)) for i in range(10)], "k int, x double, s string")
    assert rows(tables.scan(df, ["k"], "k > 1", [("x", True, True), ("k", False, True)], 3, 1)) == [(8,), (4,), (9,)]
    assert tables.scan(df, with_row_id=True).select("_rowid").distinct().count() == 10
    assert tables.add_columns(df, {"y": "x + 1"}).columns[-1] == "y" and tables.alter_columns(df, {"path": "k", "name": "key", "data_type": "long"}).dtypes[0] == ("key", "bigint")
    assert rows(tables.take(df, [9, 0], ["k"]).select("k").orderBy("k")) == [(0,), (9,)]
    assert sorted(r["_position"] for r in tables.numbered(df, ["s"]).collect()) == list(range(10))
    assert tables.reservoir(df, 4, "k").count() == 4 and sum(tables.shard(df, "k", i, 3).count() for i in range(3)) == 10
    stats = {r["column"]: r for r in tables.statistics(df).collect()}
    assert stats["x"]["nulls"] == 1 and stats["k"]["max"] == "9"


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id int, v array<double>")
    assert rows(vector.nearest(df, "v", [2.1, 1.0], 2).select("id")) == [(2,), (3,)]
    assert rows(vector.nearest(df, "v", [0.0, 1.0], 9, distance_range=(1.0, 9.0)).select("id")) == [(1,), (2,)]
    bits = spark.createDataFrame([(1, [3, 0]), (2, [1, 0])], "id int, v array<int>")
    assert rows(vector.nearest(bits, "v", [1, 0], 2, "hamming").select("id", "_distance")) == [(2, 0.0), (1, 1.0)]
    many = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[1.0, 0.0]])], "id int, v array<array<double>>")
    assert rows(vector.multi_nearest(many, "v", [[1.0, 0.0], [0.0, 1.0]], 1).select("id")) == [(1,)]
    ivf = vector.InvertedLists.build(df, "v", cells=2)
    assert rows(ivf.search([5.0, 1.0], 2, nprobes=2).select("id")) == [(5,), (4,)]
    assert rows(df.select(vector.sign_bits("v"), vector.scalar_quantised("v", 0.0, 5.0)).limit(1)) == [("01", [0, 51])]
    with pytest.raises(ValueError):
        vector.nearest(df, "v", [1.0], 0)


def test_fulltext(spark):
    df = spark.createDataFrame([(1, "the quick brown fox"), (2, "the lazy dog"), (3, "quick quick foxes"), (4, None)], "id int, t string")
    i = fulltext.TextIndex(df, "id", "t")
    assert [r[0] for r in i.match("quick", 2).collect()] == [3, 1]
    assert {r[0] for r in i.match("the quick", operator="and").collect()} == {1}
    assert {r[0] for r in i.phrase("quick brown").collect()} == {1}
    assert {r[0] for r in i.match("lazi", fuzziness=None).collect()} == {2} and i.match("").count() == 0
    assert {r[0]: r[1] < 0 for r in i.boosted(i.match("the"), i.match("dog"), 9.0).collect()} == {1: False, 2: True}


def test_traces(spark, tmp_path):
    t = TraceStore(spark, str(tmp_path / "traces"))
    t.ingest("a", spark.createDataFrame([("x", "1", [1.0, 0.0]), ("y", "2", [0.0, 1.0])], "id string, payload string, vector array<float>"))
    t.ingest("a", spark.createDataFrame([("z", "3")], "id string, payload string"))
    assert [r["id"] for r in t.read("a", 1, 5).collect()] == ["y", "z"] and t.count("a") == 3 and t.count() == 3
    assert [list(r["vector"]) for r in t.vectors("a", ["y", "no"], 2).collect()] == [[0.0, 1.0], [0.0, 0.0]]
    assert [r["id"] for r in t.route("a", [1.0, 0.1], 1).collect()] == ["x"] and rows(t.stats()) == [("a", 3, 2)]


def test_append_log(spark, tmp_path):
    a = live.AppendLog(spark, str(tmp_path / "a"), "v string, seq long")
    assert a.append(spark.createDataFrame([("x",), ("y",)], "v string"), ["v"], 0) == 2
    with pytest.raises(live.SequenceConflict):
        a.append(spark.createDataFrame([("z",)], "v string"), ["v"], 0)
    assert a.append(spark.createDataFrame([("z",)], "v string"), ["v"], 2) == 3 and rows(a.read_from(2)) == [("y", 2), ("z", 3)]


def test_live_view(spark, tmp_path):
    schema = "op tinyint, label string, pk_value string, timestamp_ms long, seq long, name string"
    path, keys = str(tmp_path / "log"), ["label", "pk_value"]
    view = VersionedTable(spark, str(tmp_path / "view"))
    put = lambda rs: spark.createDataFrame(rs, schema).write.mode("append").parquet(path)
    put([(0, "P", "a", 1, 1, "one"), (0, "P", "b", 1, 2, "b")])
    live.live_view(spark, path, schema, keys, view, str(tmp_path / "cp")).awaitTermination()
    put([(0, "P", "a", 2, 3, "two"), (1, "P", "b", 3, 4, None)])
    live.live_view(spark, path, schema, keys, view, str(tmp_path / "cp")).awaitTermination()
    assert rows(live.current(view, keys).select("pk_value", "name")) == [("a", "two")]
    batch = logs.live_vertices(spark.read.schema(schema).parquet(path))
    assert rows(batch.select("pk_value", "name")) == [("a", "two")]


def test_event_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 10:00:00", 5, "a", 1.0), (2, "2024-01-01 11:00:00", 5, "a", 2.0), (3, "2024-01-03 10:00:00", 6, "b", 4.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    assert sorted(tuple(r)[1:] for r in live.event_counts(events).collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    live.event_graph(stream, str(tmp_path / "g"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "g/did")).count() == 3
    q = live.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").count() == 2
