from pathlib import Path

from tessera.plans import registry, scratch


def test_customers_land_as_many_files(spark, tmp_path, monkeypatch):
    rows = [(k, f"Customer#{k}", "BUILDING") for k in range(1, 41)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").repartition(4).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"{tmp_path}/shared")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        got = registry.queries()["landing_csv"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.id, r.name, r.segment, r.blank, r.all_written) for r in got) == [(*r, "", True) for r in rows]
    assert len(list(Path(tmp_path, "shared/tessera").glob("landing-*/in/part-*.csv"))) > 1
