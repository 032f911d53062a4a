import json

import pytest
from pyspark.sql import functions as F

from tidemill.sources import readers, store
from tidemill.streaming import jobs as streams


def test_missing_table_is_empty(spark, tmp_path):
    assert readers.table(spark, str(tmp_path / "none"), "a int").count() == 0


def test_json_and_envelopes(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    good, bad = readers.json_records(spark, str(tmp_path / "x.json"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.value for r in bad.collect()] == ["not json"]
    lines = ['{"type": "ping"}', '{"type": "result", "requestId": "r", "payload": "{}"}', '{"type": "result"}', '{"type": "what"}', "?", None]
    ok, dead = readers.envelopes(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert ok.count() == 2 and sorted(r.reason for r in dead.collect()) == ["malformed", "malformed", "no request", "unknown type"]


def test_safe_paths():
    assert store.safe_path("/lib", "a/b.md") == "/lib/a/b.md"
    for bad in ("../x", "/etc/x", "a/../../x", ""):
        with pytest.raises(ValueError):
            store.safe_path("/lib", bad)


def test_write_entries(spark, tmp_path):
    df = spark.createDataFrame([("a/index.md", "body"), ("../out.md", "x"), (None, "y")], "relativePath string, body string")
    got = {r.path: r.ok for r in store.write_entries(df, str(tmp_path)).collect()}
    assert got == {"a/index.md": True, "../out.md": False, None: False}
    assert (tmp_path / "a/index.md").read_text() == "body" and not list(tmp_path.rglob("*.tmp"))


def test_versioned_table(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "t"), "k string, v int, path string", ["k"], keep=("path",))
    assert t.read().count() == 0
    one = spark.createDataFrame([("a", 1, "p1"), ("b", 1, "p2")], t.schema)
    two = spark.createDataFrame([("a", 2, "other")], t.schema)
    assert t.upsert(one, 0) and t.upsert(two, 1) and not t.upsert(one, 1)
    assert sorted(map(tuple, t.read().collect())) == [("a", 2, "p1"), ("b", 1, "p2")]


def test_upsert_rewrites_touched_buckets_and_survives_a_crash(spark, tmp_path, monkeypatch):
    t = store.VersionedTable(spark, str(tmp_path / "t"), "k string, v int", ["k"], buckets=8)
    rows = lambda n, v: spark.createDataFrame([(f"k{i}", v) for i in n], "k string, v int")
    t.upsert(rows(range(40), 0), 0)
    before = t._current()["folders"]
    commit = store.VersionedTable._commit
    for batch, n in ((1, [3]), (2, [3, 17, 99]), (3, [])):
        def die(self, *_):
            raise OSError("killed")

        monkeypatch.setattr(store.VersionedTable, "_commit", die)
        with pytest.raises(OSError):
            t.upsert(rows(n, batch), batch)
        assert len(t.read().collect()) == (41 if batch > 2 else 40)
        monkeypatch.setattr(store.VersionedTable, "_commit", commit)
        assert t.upsert(rows(n, batch), batch) and not t.upsert(rows(n, batch), batch)
        changed = {b for b, f in t._current()["folders"].items() if before.get(b) != f}
        assert len(changed) <= len(n)
        before = t._current()["folders"]
    want = {f"k{i}": 0 for i in range(40)} | {"k3": 2, "k17": 2, "k99": 2}
    assert {r.k: r.v for r in t.read().collect()} == want
    assert t.vacuum() and not t.vacuum() and {r.k: r.v for r in t.read().collect()} == want


def write(path, name, events):
    (path / name).write_text("\n".join(json.dumps(dict(zip(("job_id", "seq", "event"), e, strict=True))) for e in events))


def test_job_stream_over_two_runs(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out = []

    def drain():
        events = spark.readStream.schema("job_id string, seq long, event string").json(str(src))
        q = streams.transitions(events).writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend(map(tuple, b.collect())))
        q.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()

    write(src, "1.json", [("j", 2, "collecting"), ("j", 1, "queued"), ("k", 1, "saved")])
    drain()
    write(src, "2.json", [("j", 3, "saved"), ("j", 4, "queued")])
    drain()
    assert sorted(out, key=lambda r: r[:2]) == [
        ("j", 1, None, "queued", True, 0), ("j", 2, "queued", "collecting", True, 0), ("j", 3, "collecting", "saved", True, 0),
        ("j", 4, "saved", "saved", False, 1), ("k", 1, None, None, False, 1),
    ]


def test_once_keeps_first(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 00:01:00"), ("b", "2025-01-01 00:02:00")], "k string, t string").select("k", F.to_timestamp("t").alias("t")).write.mode("append").parquet(str(src / "p"))
    s = streams.once(spark.readStream.schema("k string, t timestamp").parquet(str(src / "p")), "k", "t")
    t = store.VersionedTable(spark, str(tmp_path / "t"), "k string, t timestamp", ["k"])
    streams.upsert_into(s, t, str(tmp_path / "log"), order=["t"]).awaitTermination()
    assert sorted(r.k for r in t.read().collect()) == ["a", "b"]
