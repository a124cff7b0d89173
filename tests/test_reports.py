from parity import TABLES, connection, spark_rows, sql_rows

from chronomill.plans.queries import QUERIES, SQL


def test_reports_of_orders_with_lines_alike(spark, small, tmp_path):
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    (tmp_path / "lineitem.parquet").unlink()
    c = connection(small)
    c.execute(f"copy (select * from lineitem union all select * replace (l_suppkey + 1 as l_suppkey) from lineitem where l_orderkey % 2 = 0 union all select * from lineitem where l_orderkey % 3 = 0) to '{tmp_path}/lineitem.parquet' (format parquet)")
    columns, rows = spark_rows(QUERIES["diff_reports"](spark, str(tmp_path)))
    assert (columns, rows) == sql_rows(connection(tmp_path), SQL["diff_reports"])
    assert len(rows) == c.execute("select count(*) from orders").fetchone()[0]
