import pytest
from pyspark.sql import functions as F

from driftpanel import materialize, session
from driftpanel.sources import tables


def test_materialize_returns_the_same_rows(spark):
    df = spark.range(100).select("id", F.sqrt("id").alias("v"))
    stored = materialize(df)
    assert stored.schema.names == df.schema.names
    assert sorted(stored.collect()) == sorted(df.collect())


def test_scratch_lies_in_the_named_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    path = session.scratch_path(spark, "t")
    assert path.startswith(configured or session.shared_dir(spark))
    assert path != session.scratch_path(spark, "t")


def test_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"
        applicationId = "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_csv_keeps_nulls_and_digits(spark):
    schema = "GEOID20 bigint, NDVI double, season string"
    df = spark.createDataFrame([(530330001001000, 0.1 + 0.2, "Dormant_Season"), (1, None, "x")], schema)
    path = session.scratch_path(spark, "csv")
    tables.write_csv(df, path)
    assert sorted(tables.read_csv(spark, path, schema).collect()) == sorted(df.collect())
    assert "NA" in "".join(r[0] for r in spark.read.text(path).collect())


def test_csv_header_is_checked(spark):
    path = session.scratch_path(spark, "csv")
    tables.write_csv(spark.createDataFrame([(1, 2.0)], "a int, b double"), path)
    with pytest.raises(Exception):
        tables.read_csv(spark, path, "b int, a double").collect()


def test_parquet_round_trip(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    path = session.scratch_path(spark, "parquet")
    tables.write_parquet(df, path, ["g"])
    assert tables.read_parquet(spark, path).filter("g = 'b'").first()["v"] == 2.0


@pytest.mark.parametrize("schema,columns", [(tables.BLOCK_PANEL, 8), (tables.TRACT_PANEL, 6), (tables.TRACT_AREA, 6)])
def test_declared_schemas(spark, schema, columns):
    df = spark.createDataFrame([], schema).withColumnsRenamed(tables.TRACT_RENAMES)
    assert len(df.columns) == columns
