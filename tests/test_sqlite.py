"""The SQLite source against the tables that it was filled from."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, StringStartsWith

from veloquent.sources.sqlite import SqliteReader, clause, read_sqlite, spark_type

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "store.db")
    db = sqlite3.connect(path)
    for name, kinds in (("nation", "n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER"), ("region", "r_regionkey INTEGER, r_name TEXT"), ("orders", "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus TEXT, o_totalprice DOUBLE")):
        columns = [k.split()[0] for k in kinds.split(", ")]
        rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(*columns).collect()]
        db.execute(f"CREATE TABLE {name} ({kinds})")
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", rows)
    db.execute('CREATE TABLE "odd ""name" ("a b" TEXT, c BLOB)')
    db.execute("INSERT INTO \"odd \"\"name\" VALUES (NULL, x'00ff'), ('x', NULL)")
    db.execute("CREATE TABLE empty (a INTEGER)")
    db.commit()
    db.close()
    return path


def test_whole_tables_by_eight_partitions(spark, store):
    orders = read_sqlite(spark, store, "orders")
    assert orders.rdd.getNumPartitions() == 8
    want = spark.read.parquet(f"{DATA}/orders.parquet").select(*orders.columns)
    assert orders.exceptAll(want).count() == 0 and want.exceptAll(orders).count() == 0
    assert dict(orders.dtypes) == {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double"}


def test_joins_and_filters_reach_the_reader(spark, store):
    nation, region = read_sqlite(spark, store, "nation", 3), read_sqlite(spark, store, "region", 1)
    got = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA' and n_nationkey > 8").select("n_name")
    n, r = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("nation", "region"))
    want = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA' and n_nationkey > 8").select("n_name")
    assert sorted(got.collect()) == sorted(want.collect())
    assert read_sqlite(spark, store, "orders").where("o_totalprice > 100000 and o_orderstatus in ('F', 'O')").count() == spark.read.parquet(f"{DATA}/orders.parquet").where("o_totalprice > 100000 and o_orderstatus in ('F', 'O')").count()


def test_what_the_reader_asks(store):
    reader = SqliteReader(store, "orders", ["o_orderkey"], 8)
    left = list(reader.pushFilters([EqualTo(("o_orderstatus",), "F"), GreaterThan(("o_totalprice",), 10.0), IsNull(("o_custkey",)), EqualTo(("a", "b"), 1), In(("o_orderkey",), (1, 2))]))
    assert left == [EqualTo(("a", "b"), 1)]
    assert reader.query() == 'SELECT "o_orderkey" FROM "orders" WHERE rowid >= ? AND rowid < ? AND "o_orderstatus" = ? AND "o_totalprice" > ? AND "o_custkey" IS NULL AND "o_orderkey" IN (?, ?)'
    parts = reader.partitions()
    assert len(parts) == 8 and all(a.after == b.first for a, b in zip(parts, parts[1:]))
    assert clause(StringStartsWith(("a",), "x%")) == ('substr("a", 1, ?) = ?', [2, "x%"])
    assert [spark_type(t) for t in ("INTEGER", "varchar(9)", "DOUBLE", "blob", "")] == ["bigint", "string", "double", "binary", "string"]


def test_odd_and_empty_tables(spark, store):
    got = read_sqlite(spark, store, 'odd "name').collect()
    assert sorted(((r["a b"], None if r["c"] is None else bytes(r["c"])) for r in got), key=str) == [("x", None), (None, b"\x00\xff")]
    assert read_sqlite(spark, store, "empty").count() == 0
    with pytest.raises(Exception, match="no such table"):
        read_sqlite(spark, store, "nothing").count()
