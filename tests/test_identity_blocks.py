"""Both identity queries against brute force, with a block above the bound."""

import datetime as dt
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tessera.operators import identity
from tessera.plans import registry

BLOCKS = """SELECT c_custkey AS id, 'First' || (c_custkey % 40) AS first, c_mktsegment[1] || 'ame' || (c_custkey % 37) AS last, CAST(DATE '1950-01-01' + CAST(c_custkey % 211 AS INT) AS VARCHAR) AS dob,
 lpad(CAST(c_custkey % 90 AS VARCHAR), 5, '1') AS zip, CASE WHEN c_custkey % 3 > 0 THEN '555-' || lpad(CAST(c_custkey % 500 AS VARCHAR), 4, '0') END AS phone FROM customer"""
PAIRS = f"""WITH p AS ({BLOCKS}), j AS (SELECT l.id AS a, r.id AS b, l.first AS f1, r.first AS f2, l.last AS l1, r.last AS l2, l.dob AS d1, r.dob AS d2, l.phone AS p1, r.phone AS p2, l.zip AS z1, r.zip AS z2 FROM p l JOIN p r ON l.id < r.id)
 SELECT *, 1 - levenshtein(upper(f1), upper(f2)) / greatest(length(f1), length(f2)) AS sf, 1 - levenshtein(upper(l1), upper(l2)) / greatest(length(l1), length(l2)) AS sl, 1 - levenshtein(d1, d2) / 10 AS sd, CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN 1 - levenshtein(p1, p2) / 8 END AS sp
 FROM j WHERE l1[1] = l2[1] OR (d1 = d2 AND f1[1] = f2[1] AND z1[1:3] = z2[1:3]) OR p1 = p2"""


def customers(spark, path):
    rows = [(k, "BUILDING" if k % 8 else "MACHINERY") for k in range(1, 1001)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}/customer.parquet/*.parquet'")
    return con


def test_pairs_of_blocks_above_the_bound(spark, tmp_path):
    con = customers(spark, tmp_path)
    want = dict(con.execute(f"SELECT a % 10, count(*) FROM ({PAIRS}) GROUP BY 1").fetchall())
    assert sum(want.values()) > 875 * 874 // 2
    assert {r.digit: r.n for r in registry.queries()["identity_pairs"](spark, str(tmp_path)).collect()} == want


def test_people_of_blocks_above_the_bound(spark, tmp_path):
    con = customers(spark, tmp_path)
    score = "round((2 * sf + 2 * sl + 2 * sd + coalesce(sp, 0)) / CASE WHEN sp IS NULL THEN 6 ELSE 7 END, 6)"
    links = con.execute(f"SELECT a, b FROM ({PAIRS}) WHERE {score} >= 0.9 AND NOT (d1 = d2 AND l1 = l2 AND sf < 0.8)").fetchall()
    root = {k: k for k in range(1, 1001)}
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = {k: low if r == high else r for k, r in root.items()}
    assert len(set(root.values())) < 900
    assert {r.id: r.person_key for r in registry.queries()["identity_people"](spark, str(tmp_path)).collect()} == root


def test_every_bound_makes_the_same_pairs(spark):
    d = dt.date(1950, 1, 1)
    rows = [(k, f"A{k % 3}", "DOE" if k % 5 else "ROE", d, "12207", str(k % 7)) for k in range(60)] + [(3, "B", "DOE", d, "12207", "4"), (None, "B", "DOE", d, "12207", "4")]
    p = spark.createDataFrame(rows, "id long, first string, last string, dob date, zip string, phone string")
    whole = Counter(tuple(r) for r in identity.candidate_pairs(p, 10_000)[0].collect())
    assert set(whole.values()) == {1} and len(whole) == 60 * 59 // 2
    for most in (1, 7, 20):
        pairs, over = identity.candidate_pairs(p, most)
        assert Counter(tuple(r) for r in pairs.collect()) == whole and over.where(F.col("n") <= most).count() == 0 < over.count()
