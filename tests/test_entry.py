"""The driver's contract."""

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"child", "parent", "containment", "mutual"} <= set(df.columns)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_match_their_oracles(spark):
    import duckdb

    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    from valprint.plans.registry import ORACLES, QUERIES

    clean = lambda x: round(x, 9) if isinstance(x, float) else x
    for name in ORACLES:
        df = QUERIES[name](spark, folder)
        names = sorted(df.columns)
        got = sorted((tuple(clean(r[c]) for c in names) for r in df.collect()), key=repr)
        rel = con.sql(ORACLES[name])
        want = sorted((tuple(clean(dict(zip(rel.columns, r, strict=True))[c]) for c in names) for r in rel.fetchall()), key=repr)
        assert got == want, name


def differing(spark, name, folder, tables):
    """A query's rows and those of its SQL over sf0.001 with other tables, as SELECT statements, in place of some; both counted."""
    import os
    from collections import Counter

    import duckdb

    from valprint.plans.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for f in os.listdir("/root/testdata/sf0.001"):
        t = f.removesuffix(".parquet")
        if t in tables:
            con.sql(f"COPY ({tables[t]}) TO '{folder}/{f}'")
        else:
            os.symlink(f"/root/testdata/sf0.001/{f}", f"{folder}/{f}")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{f}'")
    df = QUERIES[name](spark, str(folder))
    rel = con.sql(ORACLES[name])
    return Counter(map(tuple, df.collect())), Counter(tuple(dict(zip(rel.columns, r, strict=True))[c] for c in df.columns) for r in rel.fetchall())


#: Whole numbers of which two pairs have one 32-bit hash.
COLLIDING = "SELECT unnest([40186, 797189, 40187, 797188])"


def test_fingerprint_store_counts_values_of_one_hash(spark, tmp_path):
    got, want = differing(spark, "fingerprint_store", tmp_path, {"orders": f"SELECT * REPLACE (k AS o_orderkey) FROM '/root/testdata/sf0.001/orders.parquet', ({COLLIDING} AS k)"})
    assert got == want and ("second", "orders.o_orderkey", "pk", None, 4, 4, "c20240201000000") in got


def test_stored_fingerprints_count_values_of_one_hash(spark, tmp_path):
    tables = {
        "part": f"SELECT * REPLACE (k AS p_partkey) FROM '/root/testdata/sf0.001/part.parquet', ({COLLIDING} AS k)",
        "supplier": "SELECT * REPLACE (k AS s_suppkey) FROM '/root/testdata/sf0.001/supplier.parquet', (SELECT unnest([797189, 797188, 5]) AS k)",
        "lineitem": "SELECT * REPLACE (k AS l_suppkey) FROM '/root/testdata/sf0.001/lineitem.parquet', (SELECT unnest([40186, 40187, 5]) AS k)",
    }
    got, want = differing(spark, "stored_fingerprints", tmp_path, tables)
    assert got == want and ("part.p_partkey", 4, 2, round(2 / 3, 6)) in got and ("supplier.s_suppkey", 3, 1, round(1 / 3, 6)) in got
