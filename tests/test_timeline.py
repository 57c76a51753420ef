"""A recorded export: what scans push down, what is skipped, and the order that limits follow."""

import json

from tracelake.sources.timeline import Timeline


def lines():
    rows = [{"datetime": f"2020-01-0{1 + i % 4}T0{i % 10}:00:00Z", "data_type": ["fs:stat", "windows:prefetch:execution", "windows:evtx"][i % 3], "event_identifier": i % 5, "filename": f"/f{i % 7}", "file_size": i, "i": i} for i in range(60)]
    rows[10].pop("datetime")
    text = [json.dumps(r) for r in rows]
    return rows, [*text[:20], "", "not json", "[1]", *text[20:]]


def test_scans(spark, tmp_path):
    rows, text = lines()
    (tmp_path / "a.jsonl").write_text("\n".join(text))
    timeline = Timeline(spark, f"file://{tmp_path}/store")
    done = timeline.record([f"file://{tmp_path}/a.jsonl"], {f"file://{tmp_path}/a.jsonl": "H"})
    assert done.metrics == {"skipped": 2, "without_time": 1} and timeline.record([f"file://{tmp_path}/a.jsonl"]) == done
    ids = lambda df: sorted(json.loads(r["text"])["i"] for r in df.collect())
    assert ids(timeline.scan()) == list(range(60))
    at = lambda r: r.get("datetime", "")
    assert ids(timeline.scan(since="2020-01-02T05:00:00Z", until="2020-01-04T03:00:00Z")) == [r["i"] for r in rows if "2020-01-02T05" <= at(r)[:13] and at(r) < "2020-01-04T03:00:00Z"]
    assert ids(timeline.scan(["PREFETCH", "stat"], event_ids=[1, 2])) == [r["i"] for r in rows if r["i"] % 3 < 2 and r["event_identifier"] in (1, 2)]
    assert ids(timeline.scan(["prefetch"], limit=4)) == [1, 4, 7, 10]
    assert [(r["path"], r["size"]) for r in timeline.catalog(limit=3).orderBy("seq").collect()] == [("/f0", 0), ("/f3", 3), ("/f6", 6)]
    assert timeline.catalog().count() == 7 and {r["hostname"] for r in timeline.catalog().collect()} == {"H"}


def test_ranges_prune_days_and_are_pushed(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(lines()[1]))
    timeline = Timeline(spark, f"file://{tmp_path}/store")
    timeline.record([f"file://{tmp_path}/a.jsonl"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = timeline.scan(["prefetch"], since="2020-01-02", until="2020-01-03", event_ids=[1])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    partition, pushed = plan.split("PartitionFilters: [")[1].split("PushedFilters: [")
    assert "day#" in partition and "2020-01-02" in partition and "2020-01-03" in partition
    assert "GreaterThanOrEqual(timestamp" in pushed and "EqualTo(event_id,1)" in pushed and "StringContains(kind,prefetch)" in pushed
