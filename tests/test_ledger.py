"""The load ledger: what readers see after crashes, failures, changed inputs and second loaders."""

import pytest
from pyspark.sql import functions as F

from tracelake.plans import store
from tracelake.sources import ledger as ledgers
from tracelake.sources.ledger import Ledger, fingerprint


@pytest.fixture()
def ledger(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/graph", tries=3, first_wait_s=0)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_load_is_skipped_while_its_input_stays(spark, ledger):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    first = ledger.load("t", "a", build)
    assert ledger.load("t", "a", build) == first and len(built) == 1
    assert ledger.load("t", "b", build).version == 2 and len(built) == 2
    assert ledger.load("t", "b", build, force=True).version == 3
    assert ledger.report == [("t", "loaded"), ("t", "skipped"), ("t", "loaded"), ("t", "loaded")]


def test_a_crash_before_publishing_leaves_the_old_rows(spark, ledger, monkeypatch):
    ledger.load("t", "a", lambda: spark.range(3))
    monkeypatch.setattr(ledger, "publish", lambda commit: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        ledger.load("t", "b", lambda: spark.range(30))
    monkeypatch.undo()
    assert ledger.table("t").count() == 3 and ledger.current("t").version == 1
    assert len(ledger.vacuum()) == 1 and ledger.table("t").count() == 3
    assert ledger.load("t", "b", lambda: spark.range(30)).rows == 30 and ledger.table("t").count() == 30


def test_a_failure_is_recorded_and_raised(spark, ledger):
    ledger.load("t", "a", lambda: spark.range(3))
    with pytest.raises(Exception, match="no such number"):
        ledger.load("t", "b", lambda: spark.range(3).select(F.when(F.col("id") < 9, F.raise_error(F.lit("no such number"))).cast("long").alias("id")))
    assert ledger.last("t").status == "failed" and "no such number" in ledger.last("t").reason
    assert ledger.table("t").count() == 3
    assert rows(ledger.status().select("table", "version", "status")) == [("t", 2, "failed")]
    assert ledger.load("t", "b", lambda: spark.range(4)).version == 3


def test_errors_that_pass_are_tried_again(spark, ledger, monkeypatch):
    tried = []

    def flaky():
        tried.append(1)
        if len(tried) < 3:
            raise OSError("connection reset by peer")
        return spark.range(7)

    assert ledger.load("t", "a", flaky).rows == 7 and len(tried) == 3
    assert len(ledger.store.names(f"{ledger.root}/t/data")) == 1 and ledger.table("t").count() == 7
    tried.clear()
    with pytest.raises(OSError, match="Connection refused"):
        ledger.load("u", "a", lambda: tried.append(1) or (_ for _ in ()).throw(OSError("Connection refused")))
    assert len(tried) == 3 and ledger.last("u").status == "failed"
    with pytest.raises(KeyError):
        ledger.table("u")
    with pytest.raises(ValueError):  # not an error of storage: once
        ledger.load("u", "a", lambda: tried.append(1) or (_ for _ in ()).throw(ValueError("timeout")))
    assert len(tried) == 4


def test_the_second_of_two_loaders_sees_the_first(spark, ledger):
    other = Ledger(spark, ledger.root)

    def build():
        if not other.report:
            other.load("t", "a", lambda: spark.range(5))
        return spark.range(5)

    commit = ledger.load("t", "a", build)
    assert commit.version == 1 and ledger.table("t").count() == 5 and len(ledger.store.names(f"{ledger.root}/t/data")) == 1
    assert not ledger.publish(commit)  # the number is taken


def test_counts_are_observed_while_rows_are_written(spark, ledger, monkeypatch):
    written = []
    real = spark.range(0).write.__class__.parquet

    def parquet(self, path, *args, **more):
        written.append(self._df._jdf.queryExecution().toString())
        return real(self, path, *args, **more)

    monkeypatch.setattr(spark.range(0).write.__class__, "parquet", parquet)
    df = spark.range(100).selectExpr("id", "concat('h', id % 3) AS hostname")
    commit = ledger.load("t", "a", lambda: df, ("hostname",), {"even": "count_if(id % 2 = 0)"})
    assert commit.rows == 100 and commit.metrics == {"even": 50}
    assert len(written) == 1 and "CollectMetrics" in written[0]
    assert rows(ledger.metrics()) == [("even", 50)]
    assert rows(ledger.table("t").groupBy("hostname").count()) == [("h0", 34), ("h1", 33), ("h2", 33)]
    none = ledger.load("e", "a", lambda: df.limit(0), (), {"even": "count_if(id % 2 = 0)"})
    assert none.rows == 0 and none.metrics == {"even": 0} and ledger.table("e").count() == 0


def test_a_ledger_without_loads(spark, ledger):
    assert ledger.tables() == [] and ledger.history().collect() == [] and ledger.vacuum() == [] and ledger.current("t") is None


def test_fingerprints_follow_files(spark, tmp_path):
    (tmp_path / "a.parquet").mkdir()
    (tmp_path / "a.parquet" / "x").write_text("1")
    first = fingerprint(spark, f"{tmp_path}/*.parquet")
    assert first == fingerprint(spark, f"{tmp_path}/*.parquet") != fingerprint(spark, f"{tmp_path}/*.parquet", code="other")
    (tmp_path / "a.parquet" / "x").write_text("22")
    second = fingerprint(spark, f"{tmp_path}/*.parquet")
    (tmp_path / "a.parquet" / "y").write_text("3")
    assert len({first, second, fingerprint(spark, f"{tmp_path}/*.parquet")}) == 3


def test_a_graph_follows_its_input(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/events.parquet")
    before = store.loaded(spark, str(tmp_path))["event"].count()
    events.limit(10).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert before > 10 >= store.loaded(spark, str(tmp_path))["event"].count()
    assert ledgers.Ledger(spark, store.ledger_of(spark, str(tmp_path)).root).current("event").version == 2
