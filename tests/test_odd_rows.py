"""Queries against their SQL on odd rows that the given tables do not hold."""

import duckdb

from colloquy.plans import registry


def both_sides(spark, folder, name, table, rows_sql):
    con = duckdb.connect()
    con.execute(f"COPY ({rows_sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    return sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))), sorted(map(str, want.fetchall()))


def test_addresses_end_at_their_last_character(spark, tmp_path):
    texts = ["a@b.com1", "a@b.com", "x a@b.com a@c.org y", "a@b.com@c.org@x.com", "a@x_y@c.org", "a@b.com-", "(a@b.com)(a@b.com)", "a@@b.com", "é a@b.com，z@w.cn", "a@b.com\nc@d.net", ""]
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts)) + f", ({len(texts)}, NULL)"
    got, want = both_sides(spark, tmp_path, "fn_protected_identifiers", "documents", f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text FROM (VALUES {values}) v(doc_id, text)")
    assert got == want and "(0, 0)" in want and "(2, 2)" in want and f"({len(texts)}, 0)" in want


def test_last_assignment_counts_with_its_nulls(spark, tmp_path):
    """The last row of a cell has neither confidence nor store, an earlier one has both."""
    rows = "(1, 11, 1), (1, 20, 9), (2, 20, 9), (2, 10, 18), (3, 7, 2)"
    lineitem = f"""SELECT CAST(o AS BIGINT) AS l_orderkey, CAST(p AS BIGINT) AS l_partkey, CAST(s AS BIGINT) AS l_suppkey, 1 AS l_linenumber, 5.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax,
      'A' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '2024-01-01' AS l_shipdate FROM (VALUES {rows}) v(o, p, s)"""
    got, want = both_sides(spark, tmp_path, "tag3_insight_report", "lineitem", lineitem)
    assert [r for r in got if "coverage" not in r and "agreement" not in r] == [r for r in want if "coverage" not in r and "agreement" not in r]
    assert "('confidence', 2)" in want


def test_lines_of_an_order_with_one_tag_are_repeats(spark, tmp_path):
    """Lines 1 and 5 bear one tag, whatever their parts; a part key of seven digits leaves them in their order."""
    rows = "(7, 1, 11), (7, 5, 22), (7, 2, 33), (8, 1, 1199999), (8, 5, 6), (9, 3, 8), (19, 1, 11)"
    lineitem = f"""SELECT CAST(o AS BIGINT) AS l_orderkey, CAST(p AS BIGINT) AS l_partkey, 1::BIGINT AS l_suppkey, n AS l_linenumber, 5.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax,
      'A' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '2024-01-01' AS l_shipdate FROM (VALUES {rows}) v(o, n, p)"""
    got, want = both_sides(spark, tmp_path, "ev16_prediction_integrity", "lineitem", lineitem)
    assert got == want and [r[:16] for r in want] == ["('tag1', 5, 0, 2", "('tag2', 1, 1, 0", "('tag3', 1, 0, 0"]
