"""Work that grows with the input, not with its square or the number of times that a value is named; rare values."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tracelake import more_queries
from tracelake.functions import normalize as n
from tracelake.plans.catalog import BOUNDED, HUNTS
from tracelake.plans.store import GraphStore
from tracelake.sources import raw


def test_a_balance_of_zero_stays_zero(spark, tmp_path):
    rows = [(0, 0.0), (1, 0.0), (2, None), (3, None), (4, -0.0), (5, 12.5), (None, 0.0), (7, float("nan"))]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    customer = duckdb.read_parquet(f"{tmp_path}/customer.parquet/*.parquet")  # noqa: F841
    want = duckdb.sql(more_queries.oracle_sql()["n20_coordinate"]).fetchall()
    assert sorted(map(str, map(tuple, more_queries.queries()["n20_coordinate"](spark, str(tmp_path)).collect()))) == sorted(map(str, want))


def test_lines_and_their_xml_are_read_once(spark, tmp_path):
    """However many conditions name a field."""
    (tmp_path / "a.json").write_text('{"event_id": 1}\n')
    found = raw.events(raw.records(raw.numbered(spark, [f"file://{tmp_path}"])))
    plan = found.where("event_id = 1 AND image <> '' AND process_guid <> ''")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 == plan.count("from_xml(")


def test_fields_of_an_event_are_parsed_once(spark):
    """And not once for each of them, in the lambda that looks for equal names."""
    plan = spark.range(1).select(n.event_fields(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_xml(") == 1


@pytest.mark.parametrize("least", [0, 25])
def test_resolutions_of_a_domain_are_not_multiplied(spark, least):
    """A domain that many URLs have and that was resolved often: the first rows, of few rows of the join."""
    feature = spark.range(300).selectExpr("'H' || id % 3 AS hostname", "CASE id % 10 WHEN 9 THEN 'File' ELSE 'URL' END AS type", "'u' || id % 150 AS id", "'U' || id % 150 AS value")
    same = spark.range(150).where(f"id >= {least}").selectExpr("'u' || id AS url_id", "'d' || id % 2 AS domain")
    dns = spark.range(500).selectExpr("'H1:' || id AS id", "'d' || id % 3 AS domain", "'i' || id AS image", "cast(id % 7 AS string) AS timestamp")
    store = GraphStore(spark, {"feature": feature, "same_domain": same, "dns": dns})
    want = spark.sql(HUNTS["bulk_dns_corroboration"], feature=feature, same_domain=same, dns=dns)
    got = store.hunt("bulk_dns_corroboration")
    assert got.collect() == want.collect() and got.count() == 30
    joined = spark.sql(BOUNDED["bulk_dns_corroboration"].rsplit("ORDER BY", 1)[0], feature=feature, same_domain=same, dns=dns)
    assert joined.count() <= 30 * feature.count()
