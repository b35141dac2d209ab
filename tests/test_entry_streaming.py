import duckdb
import pytest

import __spark_entry__
from samphire.streaming import counts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
CORE = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


def shown(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query_against_sql(spark, duck, name):
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streams(spark, tmp_path):
    spark.createDataFrame([(0, ["a", "b"]), (1, ["a"])], "sample_id long, tags array<string>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sample_id long, tags array<string>").parquet(str(tmp_path / "in"))
    query = counts.running_term_frequency(stream).writeStream.outputMode("complete").format("memory").queryName("tags").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.tag: r.n for r in spark.table("tags").collect()} == {"a": 2, "b": 1}
    counts.merge_counts(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert {r.tag: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": 2, "b": 1}
