import pytest

from tidefold.operators import compact, fold, scan
from tidefold.operators.scan import QueryArgs


@pytest.fixture(scope="module")
def view(spark):
    return spark.createDataFrame([(k, f"v{k}") for k in range(0, 100, 2)], "key long, value string").repartition(5)


def keys_of(df):
    return [r.key for r in df.collect()]


@pytest.mark.parametrize(
    "args, want",
    [
        ({"gt": 20, "lt": 28}, [22, 24, 26]),
        ({"gte": 20, "lte": 24}, [20, 22, 24]),
        ({"gte": 20, "lt": 24, "reverse": True}, [22, 20]),
        ({"gt": 90, "limit": 2}, [92, 94]),
        ({"lte": 6, "reverse": True, "limit": 2}, [6, 4]),
        ({"lt": 4, "limit": 0}, [0, 2]),
        ({"gte": 20, "lt": 24, "bounds": "swapped"}, [20, 22, 24]),
        ({"gte": 20, "lte": 24, "bounds": "swapped"}, [20, 22]),
        ({"lte": 24, "gt": 20, "reverse": True, "bounds": "swapped"}, [24, 22, 20]),
        ({"lte": 24, "gte": 20, "reverse": True, "bounds": "swapped"}, [24, 22]),
        ({"offset": 47}, [94, 96, 98]),
        ({"offset": 2, "limit": 2, "reverse": True}, [94, 92]),
        ({"offset": 50}, []),
    ],
)
def test_query(view, args, want):
    assert keys_of(scan.query(view, args, "int")) == want


def test_range_includes_both_ends(view):
    assert keys_of(scan.key_range(view, 20, 24, "int")) == [20, 22, 24]
    assert keys_of(scan.key_range(view, 20, 24, "int", True)) == [24, 22, 20]


@pytest.mark.parametrize(
    "args",
    [{"gt": 1, "gte": 1}, {"lt": 1, "lte": 1}, {"offset": 1, "gt": 1}, {"limit": -1}, {"offset": -1}, {"offset": 1.5}, {"bounds": "x"}],
)
def test_refused_arguments(args):
    with pytest.raises(ValueError):
        QueryArgs.of(args)


def test_projections(view):
    assert scan.query(view, {"values": False}).columns == ["key"]
    assert scan.query(view, {"keys": False}).columns == ["value"]
    assert scan.query(view, {"keys": False, "values": False}).count() == 50


def test_positions_in_either_direction(view):
    up = scan.with_position(view).collect()
    assert {r.key: r.pos for r in up} == {k: k // 2 + 1 for k in range(0, 100, 2)}
    down = scan.with_position(view, True).collect()
    assert {r.key: r.pos for r in down} == {k: 50 - k // 2 for k in range(0, 100, 2)}
    assert scan.with_position(view.limit(0)).collect() == []


@pytest.fixture
def many_stretches(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("mode", ["int", "string", "any"])
def test_positions_over_many_stretches(spark, many_stretches, mode):
    from pyspark.sql import functions as F

    n = 4000
    number = F.col("id") - n // 2
    text = F.format_string("k%05d", "id")
    key = {"int": number, "string": text, "any": F.struct((F.col("id") % 2).alias("kind"), text.alias("str"))}[mode]
    rows = spark.range(n).select(key.alias("key"), "id").repartition(7)
    want = sorted(rows.collect(), key=lambda r: r.key)
    for reverse in (False, True):
        got = {r.id: r.pos for r in scan.with_position(rows, reverse).collect()}
        order = list(reversed(want)) if reverse else want
        assert got == {r.id: k + 1 for k, r in enumerate(order)}
    parts = {r._part for r in scan.stretch_of(rows, scan.key_cuts(rows), _part="key").select("_part").distinct().collect()}
    assert len(parts) > 6


def test_sums_with_null_and_repeated_keys(spark, many_stretches):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.when(F.col("id") >= 1000, F.col("id")).when(F.col("id") >= 5, F.lit(2000)).alias("key"), "id")
    got = sorted((r.rnk, -1 if r.key is None else r.key) for r in scan.rank(rows).select("rnk", "key").collect())
    want = sorted([-1] * 5 + [2000] * 995 + list(range(1000, 3000)))
    assert got == list(enumerate(want))


def test_positions_run_nothing_before_they_are_asked_for(spark, view):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("positions", "plan only")
    try:
        scan.with_position(view)
        assert not tracker.getJobIdsForGroup("positions")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_committed_uses_a_number_again(spark):
    log = spark.createDataFrame(
        [
            (0, None, "put", "a", "1"),
            (1, 5, "put", "b", "1"),
            (2, 5, "commit", None, None),
            (3, 5, "put", "a", "2"),
            (4, 5, "abort", None, None),
            (5, 5, "put", "c", "3"),
        ],
        "seq long, tx long, op string, key string, value string",
    )
    state = {r.key: r.value for r in fold.fold(fold.committed(log), carry=["value"]).collect()}
    assert state == {"a": "1", "b": "1"}


def test_fold_keeps_a_null_value_of_the_newest_record(spark):
    log = spark.createDataFrame([(1, "k", "put", "x"), (2, "k", "put", None)], "seq long, key string, op string, value string")
    assert [tuple(r) for r in fold.fold(log, carry=["value"]).collect()] == [("k", None)]


@pytest.mark.parametrize("n, most", [(25, 60), (400, 900)])
def test_overlap_matches_brute_force(spark, many_stretches, n, most):
    import random

    rng = random.Random(5)
    ranges = [(k, *sorted((rng.randint(0, most), rng.randint(0, most)))) for k in range(n)]
    df = spark.createDataFrame(ranges, "seg long, lo long, hi long")
    want = {(a[0], b[0]) for a in ranges for b in ranges if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2]}
    found = [(r.seg_a, r.seg_b) for r in compact.overlapping(df).collect()]
    assert len(found) == len(want) and set(found) == want


def test_purge_keeps_needed_tombstones(spark):
    state = spark.createDataFrame([("a", "del", None), ("b", "del", None), ("c", "put", "1")], "key string, op string, value string")
    deeper = spark.createDataFrame([("a",)], "key string")
    assert sorted((r.key, r.op) for r in compact.purge(state, deeper).collect()) == [("a", "del"), ("c", "put")]
    assert [r.key for r in compact.purge(state, None).collect()] == ["c"]
