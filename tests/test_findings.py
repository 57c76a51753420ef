"""Findings that many writers merge, and what the layout of a graph lets queries skip."""

import threading

import pytest
from pyspark.sql import functions as F

from tests.test_cli import command
from tracelake.operators import statistics as v
from tracelake.plans import store
from tracelake.sources.findings import Findings

COLUMNS = "id string, case_id string, hypothesis string, verdict string, nth long"


def test_the_last_writer_counts(spark, tmp_path):
    found = Findings(spark, f"file://{tmp_path}/f", buckets=4)
    assert found.read().collect() == []
    found.merge(spark.createDataFrame([("a", "c", "H", "inconclusive", 1), ("a", "c", "H", "supported", 2), ("b", "c", "H", "x", 1)], COLUMNS))
    found.merge(spark.createDataFrame([("a", "c", "H", "inconclusive", 0), ("d", "c", "G", "inconclusive", 0)], COLUMNS))
    assert sorted((r["id"], r["verdict"]) for r in found.read().collect()) == [("a", "inconclusive"), ("b", "x"), ("d", "inconclusive")]
    assert sorted(map(tuple, found.summary().collect())) == [("c", "G", "inconclusive", 1), ("c", "H", "inconclusive", 2)]
    assert found.merge(spark.createDataFrame([], COLUMNS)) == 0
    with pytest.raises(Exception, match="without an id"):
        found.merge(spark.createDataFrame([(None, "c", "H", "x", 1)], COLUMNS))


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    def write(k):
        Findings(spark, f"file://{tmp_path}/f", buckets=1).merge(spark.createDataFrame([(f"{k}-{i}", "c", "H", "x", 0) for i in range(5)], COLUMNS))

    writers = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    got = Findings(spark, f"file://{tmp_path}/f", buckets=1)
    assert sorted(r["id"] for r in got.read().collect()) == sorted(f"{k}-{i}" for k in range(5) for i in range(5))
    assert got.ledger.current("findings-0000").version == 5 and len(got.ledger.store.names(f"{got.ledger.root}/findings-0000/data")) == 5


def test_queries_of_a_host_read_its_folders(spark, tmp_path):
    loaded = store.loaded(spark, "/root/testdata/sf0.001")
    plan = v.host_edges(loaded, "H1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(hostname#") == 5 == plan.count("FileScan")
    triage = loaded.only("H1", frozenset({"security_auth"}))
    plan = triage["event"]._jdf.queryExecution().executedPlan().toString()
    assert "pack#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert {r["event_id"] for r in triage["event"].select("event_id").distinct().collect()} <= {4624, 4625, 4688}
    assert triage["dns"].isEmpty() and not loaded.only("H1")["dns"].isEmpty()


def test_a_tier_of_a_host(spark, tmp_path):
    loaded = store.loaded(spark, "/root/testdata/sf0.001")
    told = command(loaded, "load-tier", "triage", "--host", "H2", "--case-type", "account_compromise", "--out", str(tmp_path / "t"))
    assert told["packs"] == ["security_auth"] and told["host"] == "H2"
    saved = store.GraphStore.load(spark, str(tmp_path / "t"))["event"]
    want = loaded["event"].where((F.col("hostname") == "H2") & F.col("event_id").isin(4624, 4625, 4688))
    assert saved.count() == want.count() > 0 and saved.select("hostname").distinct().count() == 1
