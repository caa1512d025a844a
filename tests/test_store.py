"""The store against a dict, through transactions, crashes, flushes and compactions."""

import random

import pytest
from pyspark.sql import functions as F

from tidefold.operators import compact
from tidefold.store import Store


def test_put_get_delete(spark, folder):
    with Store(spark, folder, key="string") as s:
        s.put("a", "1")
        s.put("a", "2")
        s.put("b", b"\x00\xfe")
        assert (s.get("a"), s.get("b"), s.get("none")) == ("2", b"\x00\xfe", None)
        assert s.get_count() == 2
        assert s.delete("a") == "a" and s.get("a") is None and not s.exists("a") and s.exists("b")
        assert s.delete("never") == "never"
        assert s.getCount() == 1
        assert list(s.get_all_it()) == [("b", b"\x00\xfe")]
    s.close()
    assert s.is_closed() and not s.is_open()


def test_refused_writes(spark, folder):
    with Store(spark, folder, key="int") as s:
        with pytest.raises(ValueError, match="Key can't be null or undefined!"):
            s.put(None, "x")
        with pytest.raises(ValueError, match="Data must be a string or Buffer!"):
            s.put(1, 5)
        with pytest.raises(ValueError):
            s.batch([{"type": "put", "key": 1, "value": "good"}, {"type": "del", "key": None}])
        assert s.get_count() == 0
        with pytest.raises(RuntimeError, match="open elsewhere"):
            Store(spark, folder, key="int")
    with pytest.raises(ValueError, match="int keys"):
        Store(spark, folder, key="string")
    with pytest.raises(RuntimeError, match="closed"):
        s.get(1)


def test_transactions(spark, folder):
    with Store(spark, folder, key="string", auto_flush=False) as s:
        s.batch([{"type": "put", "key": k, "value": "1"} for k in "abc"])
        tx = s.start_tx()
        assert s.is_tx
        s.put("a", "2")
        s.delete("b")
        s.put("d", "1")
        assert s.get("a") == "1" and s.exists("b") and s.get("d") is None
        with pytest.raises(RuntimeError, match="Can't do nested transactions, finish the current one first!"):
            s.start_tx()
        assert s.end_tx() == tx and not s.is_tx
        assert dict(s.get_all_it()) == {"a": "2", "c": "1", "d": "1"} and s.get_count() == 3
        s.begin_transaction()
        s.put("a", "9")
        s.abort_tx()
        assert s.get("a") == "2" and s.abort_tx() is None
        s.start_tx()
        s.put("z", "lost")
    # Closed with the transaction open: incomplete.
    with Store(spark, folder, key="string") as s:
        assert dict(s.get_all_it()) == {"a": "2", "c": "1", "d": "1"}


def test_batch_chain_and_unknown_types(spark, folder):
    with Store(spark, folder) as s:
        chain = s.batch().put("a", "1").put("b", "2").delete("a")
        assert chain.length == len(chain) == 3
        chain.write()
        s.batch([{"type": "what", "key": "x"}, {"type": "put", "key": "c"}])
        assert list(s.get_all_it()) == [("b", "2"), ("c", "")]
        assert len(chain.clear()) == 0


def test_reads_and_streams(spark, folder):
    with Store(spark, folder, key="int") as s:
        s.put_many(spark.createDataFrame([(k, f"v{k}") for k in range(100)], "key long, value string"))
        assert [k for k, _ in s.range_it(20, 23)] == [20, 21, 22, 23]
        assert [k for k, _ in s.range_it(20, 23, True)] == [23, 22, 21, 20]
        assert [k for k, _ in s.offset_it(97, 10)] == [97, 98, 99]
        assert list(s.query_it({"gt": 97, "values": False})) == [98, 99]
        assert list(s.create_read_stream({"lt": 2})) == [{"key": 0, "value": "v0"}, {"key": 1, "value": "v1"}]
        assert list(s.create_key_stream({"lt": 2})) == [0, 1]
        assert list(s.create_value_stream({"lt": 2})) == ["v0", "v1"]
        assert list(s.create_read_stream({"lt": 2, "keys": False})) == [{"value": "v0"}, {"value": "v1"}]
        seen, done = [], []
        s.range(5, 6, lambda k, v: seen.append((k, v)), done.append)
        assert seen == [(5, "v5"), (6, "v6")] and done == [None]
        s.get_all_keys(seen.append, done.append, True)
        assert seen[2:] == list(range(99, -1, -1))
        got = s.get_many([1, 500]).select("key", "value").collect()
        assert {r.key: r.value for r in got} == {1: "v1", 500: None}
        assert {r.key: r.present for r in s.exists_many([1, 500]).collect()} == {1: True, 500: False}
        s.create_view("kv")
        assert spark.sql("SELECT count(*) AS n FROM kv WHERE key < 10").first().n == 10


def test_any_keys(spark, folder):
    with Store(spark, folder) as s:
        for k in ["b", 3, b"\x01", 2.5, "a"]:
            s.put(k, f"{k}")
        assert [k for k, _ in s.get_all_it()] == [2.5, 3, "a", "b", b"\x01"]
        assert s.get(b"\x01") == "b'\\x01'" and s.get(3) == "3"
        s.flush_log()
        assert [k for k, _ in s.range_it(3, "a")] == [3, "a"]


def test_events(spark, folder):
    heard = []
    with Store(spark, folder, key="string") as s:
        for e in ("put", "get", "delete", "get-all", "get-all-end", "clear", "close", "compact-start", "compact-end"):
            s.on(e, lambda *_, e=e: heard.append(e))
        s.put("a", "1")
        s.get("a")
        s.delete("a")
        list(s.get_all_it())
        s.flush_log()
        s.empty()
        assert s.get_count() == 0
        with pytest.raises(ValueError):
            s.on("no-such", print)
    assert heard == ["put", "get", "delete", "get-all", "get-all-end", "compact-start", "compact-end", "clear", "close"]


def test_null_keys_in_a_batch_leave_nothing(spark, folder):
    with Store(spark, folder, key="string") as s:
        with pytest.raises(Exception, match="Key can't be null or undefined!"):
            s.put_many(spark.createDataFrame([("a", "1"), (None, "2")], "key string, value string"))
        assert s.get_count() == 0


@pytest.mark.parametrize("mode", ["string", "int", "float", "buffer", "any"])
def test_random_script_matches_a_dict(spark, folder, mode, monkeypatch):
    monkeypatch.setattr(compact, "SEGMENT_BYTES", 15_000)
    monkeypatch.setattr(compact, "level_limit", lambda level, base: 20_000 if level < 1 else 10**9)
    make = {
        "string": lambda n: f"k{n:03d}",
        "int": lambda n: n,
        "float": lambda n: n / 10,
        "buffer": lambda n: bytes([n]),
        "any": lambda n: [n, f"s{n}", bytes([n])][n % 3],
    }[mode]
    rng, model = random.Random(mode), {}
    store = Store(spark, folder, key=mode, auto_flush=False)
    for wave in range(3):
        ops = []
        for _ in range(60):
            k = make(rng.randrange(80))
            if rng.random() < 0.3:
                ops.append({"type": "del", "key": k})
                model.pop(k, None)
            else:
                v = "x" * rng.randrange(40)
                ops.append({"type": "put", "key": k, "value": v})
                model[k] = v
        store.batch(ops)
        if wave != 1:
            store.flush_log()
        if wave == 1:
            store.close()
            store = Store(spark, folder, key=mode, auto_flush=False)
    rank = {bool: 0, int: 0, float: 0, str: 1, bytes: 2}
    want = sorted(model.items(), key=lambda x: (rank[type(x[0])], x[0]))
    assert list(store.get_all_it()) == want
    assert store.get_count() == len(model)
    for n in (0, 41, 79):
        assert store.get(make(n)) == model.get(make(n))
    store.compact(force=True)
    assert list(store.get_all_it()) == want
    assert sum(s.rows for s in store.manifest.segments) == len(model)  # no tombstones left
    store.close()


def test_broken_manifest_and_lost_writes(spark, folder, tmp_path):
    with Store(spark, folder, key="string") as s:
        s.put("a", "1")
        last = s.manifest.version
    root = tmp_path / "store"
    # A crash while the next version was written, and a batch that no manifest has.
    (root / f"manifest-{last + 1:012d}.json").write_text('{"mode": "str')
    (root / "log" / "0000000000000009-dead").mkdir()
    with Store(spark, folder, key="string") as s:
        assert list(s.get_all_it()) == [("a", "1")]
        s.put("b", "2")
        assert s.get_count() == 2


def test_records_with_a_wrong_checksum_are_skipped(spark, folder, tmp_path):
    with Store(spark, folder, key="string", auto_flush=False) as s:
        s.put("a", "1")
        s.put("b", "2")
        path = s._log_paths(s.manifest)[1]
        bad = spark.read.parquet(path).withColumn("value", F.lit("torn")).collect()
        spark.createDataFrame(bad, spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
        assert list(s.get_all_it()) == [("a", "1")]


def test_auto_flush_and_cache(spark, folder):
    with Store(spark, folder, key="int", cache=True, auto_flush=0.001) as s:
        s.put_many(spark.createDataFrame([(k, "x" * 50) for k in range(200)], "key long, value string"))
        assert not s.manifest.log and s.manifest.segments
        assert s.get(5) == "x" * 50
        s.put(5, "new")
        assert s.get(5) == "new" and s.get_count() == 200


def test_names_of_the_interface(spark, folder):
    names = """on off flushLog isOpen isClosed ready get delete del put batch createReadStream createKeyStream
        createValueStream getAllKeys getAllKeysIt getAllKeysStream getCount getAll getAllIt getAllStream range rangeIt
        rangeStream offset offsetIt offsetStream query queryIt queryStream exists startTx begin_transaction endTx
        end_transaction abortTx close empty version isCompacting isTx keyType memoryCache""".split()
    with Store(spark, folder, key="int") as s:
        assert all(hasattr(s, n) for n in names)
        assert (s.keyType, s.memoryCache, s.isTx, s.isCompacting, s.isOpen()) == ("int", False, False, False, True)
        getattr(s, "del")(1)
        s.put(2, "x")
        s.flushLog()
        assert list(s.level_bytes()) == [0]


def test_large_values_survive_waves_of_compaction(spark, folder, monkeypatch):
    """Newest version, deletes and counts after restarts between waves of wide values."""
    monkeypatch.setattr(compact, "SEGMENT_BYTES", 15_000)
    monkeypatch.setattr(compact, "level_limit", lambda level, base: 5_000 if level == 0 else 10**9)
    frame = lambda keys, tag: spark.createDataFrame([(k, tag + "x" * 3000) for k in keys], "key long, value string")
    with Store(spark, folder, key="int", auto_flush=False) as s:
        s.put_many(frame(range(80), "v1"))
        s.flush_log()
    with Store(spark, folder, key="int", auto_flush=False) as s:
        s.put_many(frame(range(20, 80), "v2"))
        s.batch([{"type": "del", "key": k} for k in range(15)])
        s.flush_log()
        s.put_many(frame(range(90, 120), "v3"))
        s.flush_log()
    with Store(spark, folder, key="int", auto_flush=False) as s:
        assert s.get_count() == 95
        assert [(s.get(k) or "none")[:2] for k in (5, 17, 45, 119)] == ["no", "v1", "v2", "v3"]
        assert max(x.level for x in s.manifest.segments) > 0


def test_what_a_crashed_writer_left_is_deleted_and_not_counted(spark, folder):
    import os

    with Store(spark, folder, key="int", auto_flush=2) as s:
        s.put(1, "a")
    path = folder.removeprefix("file://")
    for orphan in ("log/0000000000000009-dead", "segments/L0-dead"):
        os.makedirs(f"{path}/{orphan}")
        with open(f"{path}/{orphan}/part-0.parquet", "wb") as f:
            f.write(bytes(3_000_000))
    with Store(spark, folder, key="int", auto_flush=2) as s:
        assert os.listdir(f"{path}/segments") == [] and len(os.listdir(f"{path}/log")) == 1
        os.makedirs(f"{path}/log/0000000000000010-dead")
        with open(f"{path}/log/0000000000000010-dead/part-0.parquet", "wb") as f:
            f.write(bytes(3_000_000))
        s.put(2, "b")
        assert len(s.manifest.log) == 2 and s.manifest.segments == []  # no flush


def test_every_file_of_a_level_has_its_turn(spark, folder, monkeypatch):
    from tidefold.operators import compact
    from tidefold.sources import manifest as M

    monkeypatch.setattr(compact, "level_limit", lambda level, base: 250 if level == 1 else 10**9)
    with Store(spark, folder, key="int", auto_flush=False) as s:
        segment = lambda k, lo: M.Segment(k, 1, f"segments/x/{k}", [0, lo], [0, lo + 5], 1, 100)
        s.manifest = s.manifest.changed(segments=[segment(k, 100 * k) for k in (1, 2, 3)])
        gone = []

        def merge(inputs, level, cursors):
            gone.extend(i.lo[1] for i in inputs if i.level == 1)
            kept = [x for x in s.manifest.segments if x.id not in {i.id for i in inputs}]
            low = 1 + len(gone)
            s.manifest = s.manifest.changed(segments=[*kept, segment(10 + low, low)], cursors=cursors)

        monkeypatch.setattr(s, "_merge", merge)
        for _ in range(4):
            assert s._compact_once()
        assert {100, 200, 300} <= set(gone)


def test_level_0_holds_some_files_of_any_size(spark, folder):
    with Store(spark, folder, segment_bytes=1_000_000) as s:
        assert s.level_mb == 5


def test_int_keys_end_at_64_bits(spark, folder):
    from pyspark.sql import functions as F

    from tidefold.functions import keys as K

    odd = ["1e30", "-1e30", "Infinity", "-Infinity", "NaN", "x", "9.9", "-9.9", str(10**400)]
    frame = spark.createDataFrame([(x,) for x in odd], "k string")
    column = [r[0] for r in frame.select(K.normalize(F.col("k"), "int", frame.schema["k"].dataType)).collect()]
    assert [K.python_key(x, "int") for x in odd] == column == [2**63 - 1, -(2**63), 2**63 - 1, -(2**63), 0, 0, 9, -9, 2**63 - 1]
    assert K.python_key(10**30, "int") == 2**63 - 1 and K.python_key(10**400, "float") == float("inf")
    with Store(spark, folder, key="int") as s:
        s.put("1e30", "big")
        assert s.get("1e30") == s.get(float("inf")) == s.get(10**25) == "big" and s.get("2") is None


def test_filters_on_keys_of_any_kind_reach_the_files(spark, folder):
    with Store(spark, folder, auto_flush=False) as s:
        s.batch([{"type": "put", "key": k, "value": str(k)} for k in (1, 2.5, 7, "a", "b", b"a")])
        s.flush_log()
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(key.num,7.0)" in plan(s.range_frame(7, 7)) or "GreaterThanOrEqual(key.num,7.0)" in plan(s.range_frame(7, 7))
        assert "GreaterThanOrEqual(key.str,a)" in plan(s.range_frame("a", "b"))
        assert "LessThanOrEqual(key.kind,0)" in plan(s.query_frame(lt=3))
        assert [k for k, _ in s.range_it(2, "a")] == [2.5, 7, "a"] and [k for k, _ in s.query_it(gt="a")] == ["b", b"a"]
        assert s.get(2.5) == "2.5" and s.get(b"a") == str(b"a") and s.get("c") is None
