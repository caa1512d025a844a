"""Named queries over the driver tables, each through the engine's operators, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, values
from ..operators import compact, fold, scan
from ..sources import log as logs
from ..sources.files import scratch

WANTED = (1, 42, -5, 99999999)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders_view(spark, d) -> DataFrame:
    """Integer keys."""
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))


def customers_view(spark, d) -> DataFrame:
    """String keys."""
    return _table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))


def prices_view(spark, d) -> DataFrame:
    """Float keys."""
    return _table(spark, d, "part").groupBy(F.col("p_retailprice").alias("key")).agg(F.max("p_name").alias("value"))


def mixed_view(spark, d) -> DataFrame:
    """Keys of every kind."""
    nation, region = _table(spark, d, "nation"), _table(spark, d, "region")
    row = lambda t, kind, c, v: t.select(keys.any_key(kind, c).alias("key"), v.alias("value"))
    return (
        row(nation, keys.NUMBER, F.col("n_nationkey"), F.col("n_name"))
        .unionByName(row(region, keys.STRING, F.col("r_name"), F.col("r_name")))
        .unionByName(row(region, keys.BYTES, F.col("r_name"), F.col("r_name")))
    )


def event_log(spark, d) -> DataFrame:
    """seq, key, op, value: the events as a log of puts and deletes."""
    op = F.when(F.col("event_type") == "error", fold.DELETE).otherwise(fold.PUT)
    return _table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), F.col("props").alias("value")
    )


def tx_log(spark, d) -> tuple[DataFrame, DataFrame]:
    """The event log cut into transactions (tx null: autocommit), and their outcomes (tx, op)."""
    txid = F.floor(F.col("seq") / 10).cast("long")
    log = event_log(spark, d).withColumn("txid", txid)
    tx = F.when(F.col("txid") % 7 == 0, F.lit(None)).otherwise(F.col("txid"))
    log = log.withColumn("tx", tx)
    outcome = F.when(F.col("tx") % 7 == 3, fold.ABORT).otherwise(fold.COMMIT)
    ended = log.where("tx is not null and tx % 7 <> 5").select("tx").distinct().select("tx", outcome.alias("op"))
    return log, ended


def _wanted(spark) -> DataFrame:
    return spark.createDataFrame([(k,) for k in WANTED], "key long")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Newest state of the event log, keys 2 to 9 in order."""
    return scan.key_range(fold.fold(event_log(spark, d), carry=["value"]), 2, 9, "int")


def tx_outcome_counts(spark, d) -> DataFrame:
    log, ended = tx_log(spark, d)
    per_tx = log.groupBy("txid", "tx").agg(F.count("*").alias("ops"))
    named = per_tx.join(ended, "tx", "left").select(
        F.when(F.col("tx").isNull(), "auto").otherwise(F.coalesce("op", F.lit("open"))).alias("outcome"), "ops"
    )
    return named.groupBy("outcome").agg(F.count("*").alias("n_tx"), F.sum("ops").alias("n_ops"))


def tx_dirty_keys(spark, d) -> DataFrame:
    log, ended = tx_log(spark, d)
    inside = log.where("tx is not null")
    return inside.join(ended.where(F.col("op") == fold.COMMIT), "tx", "left_anti").select("key").distinct()


def batch_apply(spark, d) -> DataFrame:
    return fold.apply_batch(orders_view(spark, d), event_log(spark, d))


def lsm_merge_levels(spark, d) -> DataFrame:
    slot = F.col("seq") % 1000
    lvl = F.when(slot >= 800, 0).when(slot >= 400, 1).otherwise(2)
    return compact.merge_levels(event_log(spark, d).withColumn("lvl", lvl)).select("key", "value")


def lsm_tombstone_purge(spark, d) -> DataFrame:
    """Tombstones of the newer half of the log, judged against its older half."""
    log = event_log(spark, d)
    half = log.agg(F.max("seq")).first()[0] or 0
    newer = log.where((F.col("op") == fold.DELETE) & (F.col("seq") * 2 >= half))
    return compact.purge_marks(newer, log.where(F.col("seq") * 2 < half))


def _compacted(spark, d):
    """A store with the event log in three flushed runs, merged into one; closed."""
    from ..store import Store

    log = event_log(spark, d)
    third = (log.agg(F.max("seq")).first()[0] or 0) // 3 + 1
    with Store(spark, scratch(spark), key="int", auto_flush=False) as store:
        for k in range(3):
            own = log.where(F.floor(F.col("seq") / third) == k)
            store.put_many(own.select("key", "value", "op", F.col("seq").alias("ord")))
            store.flush_log()
        store.compact(force=True)
        return store.view(), store.manifest.segments


def lsm_store_compaction(spark, d) -> DataFrame:
    """The event log written to a store, flushed, merged, purged and read back."""
    return _compacted(spark, d)[0].select("key", "value")


def lsm_store_segments(spark, d) -> DataFrame:
    """Keys, least and greatest key, and pairs of overlapping segments of that store's manifest."""
    segments = _compacted(spark, d)[1]
    ranges = [(s.id, s.lo[1], s.hi[1], s.rows) for s in segments]
    frame = spark.createDataFrame(ranges, "seg long, lo long, hi long, n long")
    pairs = compact.overlapping(frame.select("seg", "lo", "hi")).count()
    return frame.agg(F.sum("n").alias("n_keys"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.lit(pairs).cast("long").alias("overlaps"))


def log_replay_crc(spark, d) -> DataFrame:
    """The event log as a batch of a store's log in which some values are torn, read back and folded."""
    null = lambda kind: F.lit(None).cast(kind)
    rows = event_log(spark, d).select(
        "seq", F.lit(0).cast("long").alias("ord"), null("long").alias("tx"), "op", "key", "value", null("binary").alias("data")
    )
    torn = F.when(F.col("seq") % 97 == 0, F.concat("value", F.lit("x"))).otherwise(F.col("value"))
    path = scratch(spark)
    logs.with_crc(rows, "int").withColumn("value", torn).write.parquet(path)
    return fold.fold(logs.read_log(spark, [path], "int"), carry=["value"])


def key_decode_any(spark, d) -> DataFrame:
    """Keys of every kind, encoded and decoded again."""
    back = keys.decode(keys.encode(F.col("key"), "any"), "any")
    decoded = mixed_view(spark, d).select(back.alias("key"), "value")
    text = F.coalesce(F.col("key.str"), F.hex("key.bin"))
    return decoded.select(F.col("key.kind").cast("int").alias("kind"), F.col("key.num").alias("num"), text.alias("str"), "value")


def lsm_segment_manifest(spark, d) -> DataFrame:
    rows = _table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("bytes"))
    return compact.describe(compact.assign_segments(rows, 20_000))


def lsm_overlapping_segments(spark, d) -> DataFrame:
    ranges = _table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 250).cast("long").alias("seg")).agg(
        F.min("user_id").alias("lo"), F.max("user_id").alias("hi")
    )
    return compact.overlapping(ranges)


def log_replay_checksum(spark, d) -> DataFrame:
    log = event_log(spark, d).withColumn("digest", values.digest(F.col("value")))
    torn = F.when(F.col("seq") % 97 == 0, F.concat("value", F.lit("x"))).otherwise(F.col("value"))
    sound = log.where(values.digest(torn) == F.col("digest"))
    return fold.fold(sound, carry=["value"])


def any_key_order(spark, d) -> DataFrame:
    placed = scan.with_position(mixed_view(spark, d))
    text = F.coalesce(F.col("key.str"), F.hex("key.bin"))
    return placed.select(
        "pos", F.col("key.kind").cast("int").alias("kind"), F.col("key.num").alias("num"), text.alias("str"), "value"
    )


def _encoded(spark, d, mode: str) -> DataFrame:
    if mode == "int":
        key = F.col("o_orderkey")
        return _table(spark, d, "orders").select(key.alias("key"), keys.encode(key, "int").alias("enc"))
    name = F.col("r_name").cast("binary")
    return _table(spark, d, "region").select(F.col("r_regionkey").alias("id"), keys.encode(name, "buffer").alias("enc"))


def value_encode_base64(spark, d) -> DataFrame:
    v = values.encode_value(F.col("r_name").cast("binary"))
    return _table(spark, d, "region").select(F.col("r_regionkey").alias("id"), v["data"].alias("data"), v["type"].alias("type"))


def key_normalize_int(spark, d) -> DataFrame:
    return _table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), keys.normalize(F.col("c_acctbal"), "int").alias("key")
    )


def kv_put_overwrite(spark, d) -> DataFrame:
    rows = fold.overwrite(
        _table(spark, d, "lineitem"),
        ["l_orderkey", "l_linenumber"],
        ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"],
        ["l_partkey", "l_suppkey"],
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _position(df: DataFrame, reverse: bool = False) -> DataFrame:
    return scan.with_position(df, reverse)


QUERIES = {
    "kv_get": lambda s, d: scan.get(orders_view(s, d), 42, "int"),
    "kv_get_many": lambda s, d: scan.get_many(_wanted(s), orders_view(s, d)),
    "kv_exists": lambda s, d: scan.exists(_wanted(s), orders_view(s, d)),
    "kv_count": lambda s, d: scan.count(fold.fold(event_log(s, d), carry=[])),
    "kv_scan_all": lambda s, d: _position(customers_view(s, d)),
    "kv_scan_all_reverse": lambda s, d: _position(customers_view(s, d), True),
    "kv_scan_keys": lambda s, d: _position(orders_view(s, d).select("key")),
    "kv_scan_values": lambda s, d: _position(orders_view(s, d)).select("pos", "value"),
    "kv_range_int": lambda s, d: _position(scan.between(orders_view(s, d), 20, 50, "int")),
    "kv_range_int_reverse": lambda s, d: _position(scan.between(orders_view(s, d), 20, 50, "int"), True),
    "kv_range_float": lambda s, d: _position(scan.between(prices_view(s, d), 905.5, 910.5, "float")),
    "kv_range_string": lambda s, d: _position(
        scan.between(customers_view(s, d), "Customer#000000020", "Customer#000000050", "string")
    ),
    "kv_query_gt_lt": lambda s, d: _position(scan.query(orders_view(s, d), gt=20, lt=50, mode="int")),
    "kv_query_limit_reverse": lambda s, d: _position(
        scan.query(orders_view(s, d), lte=100, reverse=True, limit=7, mode="int"), True
    ),
    "kv_offset_limit": lambda s, d: _position(scan.page(orders_view(s, d), 100, 10)),
    "kv_offset_limit_reverse": lambda s, d: _position(scan.page(orders_view(s, d), 100, 10, True), True),
    "kv_latest_state": lambda s, d: fold.fold(event_log(s, d), carry=["value"]),
    "kv_tombstones": lambda s, d: fold.deleted(event_log(s, d)),
    "kv_state_as_of": lambda s, d: fold.fold(fold.as_of(event_log(s, d), 500), carry=["value"]),
    "kv_version_history": lambda s, d: fold.history(event_log(s, d)),
    "kv_put_overwrite": kv_put_overwrite,
    "tx_committed_state": lambda s, d: fold.fold(fold.committed_by(*tx_log(s, d)), carry=["value"]),
    "tx_outcome_counts": tx_outcome_counts,
    "tx_dirty_keys": tx_dirty_keys,
    "batch_apply": batch_apply,
    "lsm_merge_levels": lsm_merge_levels,
    "lsm_tombstone_purge": lsm_tombstone_purge,
    "lsm_segment_manifest": lsm_segment_manifest,
    "lsm_overlapping_segments": lsm_overlapping_segments,
    "lsm_store_compaction": lsm_store_compaction,
    "lsm_store_segments": lsm_store_segments,
    "log_replay_checksum": log_replay_checksum,
    "log_replay_crc": log_replay_crc,
    "key_rank": lambda s, d: scan.rank(customers_view(s, d)).where("rnk in (0, 10, 42, 149)").select("key", "rnk"),
    "any_key_order": any_key_order,
    "key_decode_any": key_decode_any,
    "key_encode_int": lambda s, d: _encoded(s, d, "int"),
    "key_encode_buffer": lambda s, d: _encoded(s, d, "buffer"),
    "value_encode_base64": value_encode_base64,
    "key_normalize_int": key_normalize_int,
    "record_checksum": lambda s, d: _table(s, d, "documents").select(
        F.col("doc_id").alias("key"), values.digest(F.col("text")).alias("digest")
    ),
}

# Oracle SQL: sub-selects by name, then one statement a query.
_ORD = "(SELECT o_orderkey AS key, o_orderpriority AS value FROM orders)"
_CUS = "(SELECT c_name AS key, c_mktsegment AS value FROM customer)"
_FLT = "(SELECT p_retailprice AS key, max(p_name) AS value FROM part GROUP BY p_retailprice)"
_ANY = (
    "(SELECT 0 AS kind, CAST(n_nationkey AS DOUBLE) AS num, CAST(NULL AS VARCHAR(64)) AS str, n_name AS value FROM nation"
    " UNION ALL SELECT 1, NULL, r_name, r_name FROM region"
    " UNION ALL SELECT 2, NULL, upper(hex(encode(r_name))), r_name FROM region)"
)
_OP = "CASE WHEN event_type='error' THEN 'del' ELSE 'put' END"
_LOG = f"(SELECT event_id AS seq, user_id AS key, {_OP} AS op, props AS value FROM events)"
_TX = (
    f"(SELECT *, CASE txid%7 WHEN 0 THEN 'auto' WHEN 3 THEN 'abort' WHEN 5 THEN 'open' ELSE 'commit' END AS outcome"
    f" FROM (SELECT *, CAST(floor(seq/10) AS BIGINT) AS txid FROM {_LOG} e) f)"
)


def _state(src: str, cond: str = "true") -> str:
    return (
        "(SELECT key, value, seq FROM (SELECT key, op, value, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn"
        f" FROM {src} l WHERE {cond}) r WHERE rn=1 AND op='put')"
    )


def _placed(src: str, columns: str = "key,value", where: str = "true", way: str = "") -> str:
    return f"SELECT row_number() OVER (ORDER BY key {way}) AS pos,{columns} FROM {src} t WHERE {where}"


_LAST = "(SELECT max(event_id) FROM events)"
_KEYS = "(VALUES (CAST(1 AS BIGINT)),(42),(-5),(99999999)) k(key)"
_RANGES = (
    "(SELECT CAST(floor(event_id/250) AS BIGINT) AS seg,min(user_id) AS lo,max(user_id) AS hi FROM events"
    " GROUP BY 1)"
)
_SEG = (
    "(SELECT CAST(floor(before/20000) AS BIGINT) AS seg,key,bytes FROM (SELECT key,bytes,sum(bytes) OVER (ORDER BY key"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)-bytes AS before"
    " FROM (SELECT doc_id AS key, n_chars AS bytes FROM documents) d) c)"
)
ORACLE = {
    "kv_get": f"SELECT key,value FROM {_ORD} t WHERE key=42",
    "kv_get_many": f"SELECT k.key, t.value FROM {_KEYS} LEFT JOIN {_ORD} t ON t.key=k.key",
    "kv_exists": f"SELECT k.key, t.key IS NOT NULL AS present FROM {_KEYS} LEFT JOIN {_ORD} t ON t.key=k.key",
    "kv_count": f"SELECT count(*) AS n FROM {_state(_LOG)} s",
    "kv_scan_all": _placed(_CUS),
    "kv_scan_all_reverse": _placed(_CUS, way="DESC"),
    "kv_scan_keys": _placed(_ORD, "key"),
    "kv_scan_values": _placed(_ORD, "value"),
    "kv_range_int": _placed(_ORD, where="key>=20 AND key<=50"),
    "kv_range_int_reverse": _placed(_ORD, where="key>=20 AND key<=50", way="DESC"),
    "kv_range_float": _placed(_FLT, where="key>=905.5 AND key<=910.5"),
    "kv_range_string": _placed(_CUS, where="key>='Customer#000000020' AND key<='Customer#000000050'"),
    "kv_query_gt_lt": _placed(_ORD, where="key>20 AND key<50"),
    "kv_query_limit_reverse": _placed(
        f"(SELECT * FROM {_ORD} x WHERE key<=100 ORDER BY key DESC LIMIT 7)", way="DESC"
    ),
    "kv_offset_limit": _placed(f"(SELECT * FROM {_ORD} x ORDER BY key LIMIT 10 OFFSET 100)"),
    "kv_offset_limit_reverse": _placed(f"(SELECT * FROM {_ORD} x ORDER BY key DESC LIMIT 10 OFFSET 100)", way="DESC"),
    "kv_latest_state": f"SELECT key,value FROM {_state(_LOG)} s",
    "kv_tombstones": f"SELECT key,seq FROM (SELECT key,op,seq,row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {_LOG} l) r WHERE rn=1 AND op='del'",
    "kv_state_as_of": f"SELECT key,value FROM {_state(_LOG, 'seq<500')} s",
    "kv_version_history": f"SELECT key,seq,op,row_number() OVER (PARTITION BY key ORDER BY seq) AS version, lag(value) OVER (PARTITION BY key ORDER BY seq) AS prev_value FROM {_LOG} l",
    "kv_put_overwrite": "SELECT l_orderkey,l_linenumber,l_partkey,l_suppkey FROM (SELECT *,row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_shipdate DESC,l_partkey DESC,l_suppkey DESC,l_extendedprice DESC) AS rn FROM lineitem) r WHERE rn=1",
    "tx_committed_state": f"SELECT key,value FROM {_state(_TX, 'outcome IN (' + chr(39) + 'auto' + chr(39) + ',' + chr(39) + 'commit' + chr(39) + ')')} s",
    "tx_outcome_counts": f"SELECT outcome,count(DISTINCT txid) AS n_tx,count(*) AS n_ops FROM {_TX} t GROUP BY outcome",
    "tx_dirty_keys": f"SELECT DISTINCT key FROM {_TX} t WHERE outcome IN ('abort','open')",
    "batch_apply": f"SELECT key,value FROM (SELECT key,op,value,row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM (SELECT CAST(-1 AS BIGINT) AS seq,key,'put' AS op,value FROM {_ORD} o UNION ALL SELECT event_id,user_id,{_OP},props FROM events) u) r WHERE rn=1 AND op='put'",
    "lsm_merge_levels": f"SELECT key,value FROM (SELECT key,op,value,row_number() OVER (PARTITION BY key ORDER BY lvl,seq DESC) AS rn FROM (SELECT CASE WHEN seq%1000>=800 THEN 0 WHEN seq%1000>=400 THEN 1 ELSE 2 END AS lvl,* FROM {_LOG} l) u) r WHERE rn=1 AND op='put'",
    "lsm_tombstone_purge": f"SELECT l0.key, (deep.key IS NOT NULL) AS keep FROM (SELECT DISTINCT key FROM {_LOG} a WHERE op='del' AND seq*2>={_LAST}) l0 LEFT JOIN (SELECT DISTINCT key FROM {_LOG} b WHERE seq*2<{_LAST}) deep ON l0.key=deep.key",
    "lsm_segment_manifest": f"SELECT seg,min(key) AS lo,max(key) AS hi,count(*) AS n_keys,CAST(sum(bytes) AS BIGINT) AS bytes FROM {_SEG} s GROUP BY seg",
    "lsm_overlapping_segments": f"SELECT a.seg AS seg_a,b.seg AS seg_b FROM {_RANGES} a JOIN {_RANGES} b ON a.lo<=b.hi AND b.lo<=a.hi AND a.seg<b.seg",
    "log_replay_checksum": f"SELECT key,value FROM {_state(_LOG, 'sha1(CASE WHEN seq%97=0 THEN concat(value,chr(120)) ELSE value END)=sha1(value)')} s",
    "lsm_store_compaction": f"SELECT key,value FROM {_state(_LOG)} s",
    "lsm_store_segments": f"SELECT CAST(count(*) AS BIGINT) AS n_keys,min(key) AS lo,max(key) AS hi,CAST(0 AS BIGINT) AS overlaps FROM {_state(_LOG)} s",
    "log_replay_crc": f"SELECT key,value FROM {_state(_LOG, 'seq%97<>0 OR op=' + chr(39) + 'del' + chr(39))} s",
    "key_decode_any": f"SELECT kind,num,str,value FROM {_ANY} t",
    "key_rank": f"SELECT key,rnk FROM (SELECT key,row_number() OVER (ORDER BY key)-1 AS rnk FROM {_CUS} t) x WHERE rnk IN (0,10,42,149)",
    "any_key_order": f"SELECT row_number() OVER (ORDER BY kind,num,str) AS pos,kind,num,str,value FROM {_ANY} t",
    "key_encode_int": "SELECT o_orderkey AS key, concat('n>',CAST(o_orderkey AS VARCHAR(32))) AS enc FROM orders",
    "key_encode_buffer": "SELECT r_regionkey AS id, concat('b>',lower(hex(encode(r_name)))) AS enc FROM region",
    "value_encode_base64": "SELECT r_regionkey AS id, base64(encode(r_name)) AS data, 1 AS type FROM region",
    "key_normalize_int": "SELECT c_custkey AS id, CAST(trunc(c_acctbal) AS BIGINT) AS key FROM customer",
    "record_checksum": "SELECT doc_id AS key, sha1(text) AS digest FROM documents",
}
