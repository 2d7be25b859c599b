"""Sinks: versioned snapshots, partition overwrite/append, read-back."""

import pytest
from pyspark.sql import functions as F

from batchwright.session import scratch_path
from batchwright.sources import snapshots as SN
from batchwright.sources import writers as W


def _docs(spark):
    return spark.createDataFrame(
        [(1, "héllo ✓ 🚀"), (2, "plain"), (3, "")], "doc_id long, text string")


def test_version_roundtrip_and_conflict(spark):
    root = scratch_path(spark, "t-snap")
    meta = SN.write_version(_docs(spark), root, "dev", "task-1", "v1",
                            meta={"project_var_versions": {"prj.a": 2}}, text_col="text")
    assert meta["status"] == "ok" and meta["n_rows"] == 3
    back = SN.read_version(spark, root, "dev", "task-1", "v1")
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in _docs(spark).collect())
    m = SN.read_manifest(spark, root, "dev", "task-1", "v1").first()
    assert m["project_var_versions"] == {"prj.a": 2}
    assert m["byte_size"] == len("héllo ✓ 🚀".encode()) + len(b"plain")
    with pytest.raises(SN.VersionConflict):
        SN.write_version(_docs(spark), root, "dev", "task-1", "v1")


def test_missing_version(spark):
    with pytest.raises(FileNotFoundError):
        SN.read_version(spark, scratch_path(spark, "t-none"), "dev", "t", "v9")


def test_failed_manifest_is_refused(spark):
    root = scratch_path(spark, "t-failed")
    path = SN.version_path(root, "dev", "t", "v1")
    _docs(spark).write.parquet(f"{path}/data")
    SN._write_manifest(spark, path, {"env": "dev", "task_id": "t", "version_id": "v1", "status": "failed"})
    with pytest.raises(SN.VerificationFailed):
        SN.read_version(spark, root, "dev", "t", "v1")


def test_digest_is_order_independent_and_sensitive(spark):
    df = _docs(spark)
    a = SN.digest(df, "text").first()
    b = SN.digest(df.repartition(3).orderBy(F.desc("doc_id")), "text").first()
    c = SN.digest(df.withColumn("text", F.upper("text")), "text").first()
    assert a == b
    assert a["hash_sum"] != c["hash_sum"]


@pytest.mark.parametrize("seg,ok", [("v1", True), ("a.b-c_d", True), ("..", False), (".", False),
                                    ("../etc", False), ("a/b", False), ("", False), ("a\x00b", False)])
def test_segments(spark, seg, ok):
    df = spark.createDataFrame([(seg,)], "s string")
    assert df.select(SN.valid_segment("s")).first()[0] is ok
    if not ok:
        with pytest.raises(ValueError):
            SN.version_path("/tmp", "dev", seg, "v1")


def test_partition_overwrite_only_touches_its_partition(spark):
    path = scratch_path(spark, "t-part")
    rows = [(i, f"2026061{d}", f"0{h}") for i, (d, h) in enumerate([(1, 0), (1, 1), (2, 0), (3, 0)])]
    df = spark.createDataFrame(rows, "id long, dt string, hr string")
    W.overwrite_partition(df, path, partition_cols=["dt", "hr"])
    W.overwrite_partition(spark.createDataFrame([(99,)], "id long"), path, {"dt": "20260611", "hr": "00"})
    got = sorted(tuple(r) for r in W.read_table(spark, path, partition_cols=["dt", "hr"]).collect())
    assert got == [(1, "20260611", "01"), (2, "20260612", "00"), (3, "20260613", "00"), (99, "20260611", "00")]


def test_append_partition_and_rows(spark):
    path = scratch_path(spark, "t-append")
    W.append_partition(spark.createDataFrame([(1, "a")], "id long, biz string"), path, {"dt": "20260613", "m": "202606"})
    W.append_partition(spark.createDataFrame([(2, "b")], "id long, biz string"), path, {"dt": "20260613", "m": "202606"})
    t = W.read_table(spark, path, partition_cols=["dt", "m"])
    assert sorted(r["id"] for r in t.collect()) == [1, 2]
    assert {r["dt"] for r in t.collect()} == {"20260613"}


def test_insert_into_partitioned_table_by_position(spark):
    import uuid
    table = f"bw_t_{uuid.uuid4().hex[:10]}"
    path = scratch_path(spark, table)
    spark.sql(f"CREATE TABLE {table} (id BIGINT, v STRING, dt STRING, hr STRING) "
              f"USING parquet PARTITIONED BY (dt, hr) LOCATION '{path}'")
    # names differ from the table's: only positions count
    rows = spark.createDataFrame([(1, "a", "20260613", "01"), (2, "b", "20260613", "02"),
                                  (3, "c", "20260614", "01")], "k long, x string, day string, hour string")
    W.insert_into(rows, table, overwrite=True)
    W.insert_into(rows.filter("k = 2").withColumn("x", F.lit("B")), table, overwrite=False)
    got = sorted(tuple(r) for r in spark.table(table).collect())
    assert got == [(1, "a", "20260613", "01"), (2, "B", "20260613", "02"), (2, "b", "20260613", "02"),
                   (3, "c", "20260614", "01")]


def test_read_table_keeps_partition_text(spark):
    path = scratch_path(spark, "t-text")
    df = spark.createDataFrame([(1, "20260613", "03"), (2, "20260613", "10")], "id long, dt string, hr string")
    W.overwrite_table(df, path, partition_cols=["dt", "hr"])
    back = W.read_table(spark, path, partition_cols=["dt", "hr"])
    assert dict(back.dtypes) == {"id": "bigint", "dt": "string", "hr": "string"}
    assert sorted(r["hr"] for r in back.collect()) == ["03", "10"]
    # the session setting is left as it was
    assert spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == "true"


def test_corrupt_manifest_is_refused(spark):
    import os
    root = scratch_path(spark, "t-corrupt")
    SN.write_version(_docs(spark), root, "dev", "task-1", "v1", text_col="text")
    manifest_dir = SN.version_path(root, "dev", "task-1", "v1").replace("file:", "") + "/_manifest"
    with open(os.path.join(manifest_dir, "part-corrupt.json"), "w") as fh:
        fh.write("not json\n")
    with pytest.raises(Exception):
        SN.read_version(spark, root, "dev", "task-1", "v1")


def test_empty_load_empties_its_partition(spark):
    path = scratch_path(spark, "t-empty")
    df = spark.createDataFrame([(1, "20260611", "a/b"), (2, "20260612", "a/b")], "id long, dt string, hr string")
    W.overwrite_table(df, path, partition_cols=["dt", "hr"])
    W.overwrite_partition(df.select("id").where("false"), path, {"dt": "20260611", "hr": "a/b"})
    back = W.read_table(spark, path, partition_cols=["dt", "hr"])
    assert [tuple(r) for r in back.collect()] == [(2, "20260612", "a/b")]
    # as the statement on a catalog table does
    import uuid
    table, where = f"bw_t_{uuid.uuid4().hex[:10]}", scratch_path(spark, "t-empty-table")
    spark.sql(f"CREATE TABLE {table} (id BIGINT, dt STRING) USING parquet PARTITIONED BY (dt) LOCATION '{where}'")
    W.insert_into(df.select("id", "dt"), table, overwrite=True)
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (dt='20260611') SELECT id FROM range(5) WHERE id < 0")
    assert [r["id"] for r in spark.table(table).collect()] == [2]
    spark.sql(f"DROP TABLE {table}")


def test_manifest_without_versions_reads_an_empty_map(spark):
    root = scratch_path(spark, "t-map")
    path = SN.version_path(root, "dev", "t", "v1")
    SN._write_manifest(spark, path, {"env": "dev", "task_id": "t", "version_id": "v1", "status": "ok"})
    assert SN.read_manifest(spark, root, "dev", "t", "v1").first()["project_var_versions"] == {}


def test_a_version_is_claimed_once(spark):
    root = scratch_path(spark, "t-claim")
    path = SN.version_path(root, "dev", "t", "v1")
    assert SN._claim(spark, path) and not SN._claim(spark, path)
    with pytest.raises(SN.VersionConflict):
        SN.write_version(_docs(spark), root, "dev", "t", "v1")


def test_retention_drops_months_and_keeps_what_runs(spark, tmp_path):
    import datetime as dt
    path = str(tmp_path / "archive")
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=3 * i)) for i in range(60)] + [(100, None)]
    W.archive_by_month(spark.createDataFrame(rows, "id long, at timestamp_ntz"), "at", path)

    def files(month):
        return {f.name for f in (tmp_path / "archive" / f"m={month}").glob("*.parquet")}

    later = {m: files(m) for m in ("202405", "202406")}
    keep = spark.createDataFrame([(2,), (2,), (99,), (None,), (59,)], "id long")
    for again in (False, True):
        dropped = W.drop_expired(spark, path, "at", 30, "2024-05-10 00:00:00", keep=keep, keys=["id"])
        assert dropped == ([] if again else ["202402", "202403"])
        got = sorted(r["id"] for r in W.read_table(spark, path, partition_cols=["m"]).collect())
        limit = dt.datetime(2024, 4, 10)
        assert got == sorted(i for i, t in rows if t is None or t >= limit or i == 2)
        assert {m: files(m) for m in later} == later and not files("202402") and files("202401")
    assert W.drop_expired(spark, path, "at", 30, "2024-05-10 00:00:00") == ["202401"]
    assert W.drop_expired(spark, path, "at", 3000, "2024-05-10 00:00:00") == []
