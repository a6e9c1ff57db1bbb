"""seen_buckets on more ids than the given tables have."""

import duckdb
from compare import duck_rows, spark_rows

from keelspark.plans import registry


def told(spark, tmp_path, ids):
    duckdb.sql(f"copy (select user_id from ({ids}) t(user_id)) to '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    return spark_rows(registry.queries()["seen_buckets"](spark, str(tmp_path))), duck_rows(con.sql(registry.oracle_sql()["seen_buckets"]))


def test_sums_of_many_hashes_do_not_overflow(spark, tmp_path):
    found, wanted = told(spark, tmp_path, "select range from range(100000)")
    assert found == wanted


def test_null_ids_are_no_members(spark, tmp_path):
    found, wanted = told(spark, tmp_path, "select unnest([null, 1, 1, 2])")
    assert found == wanted


def test_shards_grow_with_the_ids_and_hold_all_members(spark, tmp_path):
    (cols, found), wanted = told(spark, tmp_path, "select range % 20000 from range(30000)")
    assert (cols, found) == wanted
    rows = [dict(zip(cols, r, strict=True)) for r in found]
    assert len(rows) == -(-20_000 // 244) and max(r["members"] for r in rows) <= 512
    held = [(int(h), r["bucket"]) for r in rows for h in r["added"].split()]
    assert len(set(held)) == len(held) == 20_000 and all(h % len(rows) == b for h, b in held)
