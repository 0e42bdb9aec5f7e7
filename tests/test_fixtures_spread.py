"""The businesses are worked out by several tasks, however few files and bytes the customers come in."""

from leadquarry import fixtures as fx


def test_customers_of_one_small_file_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    n = 400
    tables = {
        "customer": ([(i if i % 50 else None, i % 3, "M") for i in range(n)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "nation": ([(i, f"N{i}") for i in range(3)], "n_nationkey int, n_name string"),
        "part": ([(i, f"old plate {i % 5}", "T") for i in range(40)], "p_partkey long, p_name string, p_type string"),
        "pages": ([(i, f"http://h{i}.tn/a") for i in range(20)], "page_id long, url string"),
        "orders": ([(i, i % 90) for i in range(500)], "o_orderkey long, o_custkey long"),
        "supplier": ([(i,) for i in range(30)], "s_suppkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    key = lambda df: sorted(map(repr, df.collect()))
    plain = fx.businesses(spark, str(tmp_path))
    one, rows = plain.rdd.getNumPartitions(), key(plain)
    assert one == 1 and len(rows) > 300
    monkeypatch.setattr(fx, "ROWS_PER_TASK", 100)
    dealt = fx.businesses(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 4 and key(dealt) == rows
