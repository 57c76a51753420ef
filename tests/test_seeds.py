"""Seeds against brute force, with thousands of them, and their plan."""

import random

from pyspark.sql import functions as F

from tracelake.operators import seeds


def brute(path, wanted):
    norm = path.replace("/", "\\").lower()
    for s in (w.lower() for w in wanted if w is not None and len(w) >= 3):
        last = s.split("\\")[-1]
        if s in norm or ("\\" in s and last and norm.endswith(last)):
            return True
    return False


def test_thousands_of_seeds_equal_brute_force(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdeÉ.") for _ in range(n))
    paths = ["C:/" + "/".join(word(rnd.randint(1, 7)) for _ in range(4)) for _ in range(600)] + ["", "x", "C:\\A", None, None]
    wanted = [word(rnd.randint(1, 8)) for _ in range(3000)] + ["zz\\" + word(rnd.randint(0, 3)) for _ in range(60)] + ["E\\A", "qq\\a", "long\\", None, "ab"]
    files = spark.createDataFrame([(i, p, "s", "g") for i, p in enumerate(paths * 2)], "id long, path string, seed string, _n string").repartition(4)
    got = sorted(r["id"] for r in seeds.matching(files, "path", spark.createDataFrame([(w,) for w in wanted], "seed string")).collect())
    want = [i for i, p in enumerate(paths * 2) if p is not None and brute(p, wanted)]
    assert got == want and 0 < len(want) < len(paths * 2)
    assert seeds.matching(files, "path", spark.createDataFrame([], "seed string")).collect() == []
    assert seeds.matching(files.limit(0), "path", spark.createDataFrame([("abc",)], "seed string")).collect() == []


def test_no_nested_loop(spark):
    files = spark.range(5).selectExpr("'H' AS hostname", "cast(id AS string) || '.exe' AS path")
    plan = seeds.matching(files, "path", files.selectExpr("hostname", "path AS seed"), ("hostname",))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_seeds_stay_on_their_host(spark):
    files = spark.createDataFrame([("A", "C:/tools/x.exe"), ("B", "C:/tools/x.exe"), ("B", "C:/y")], "hostname string, path string")
    asked = spark.createDataFrame([("A", "TOOLS"), ("C", "tools"), (None, "tools")], "hostname string, seed string")
    assert [tuple(r) for r in seeds.matching(files, "path", asked, ("hostname",)).collect()] == [("A", "C:/tools/x.exe")]


def test_seeds_of_a_graph(spark):
    events = spark.createDataFrame(
        [("A", 1, 'C:\\t\\a.exe "x y"', "b.exe"), ("A", 23, None, "D:\\c.exe"), ("A", 11, '"C:\\quoted.exe" -k', "x"), ("A", 3, "C:\\no.exe", "C:\\no.exe"), ("B", 1, "plain", None)],
        "hostname string, event_id int, command_line string, image string",
    )
    assert {tuple(r) for r in seeds.event_seeds(events).collect()} == {("A", "C:\\t\\a.exe "), ("A", "D:\\c.exe")}
    assert seeds.case_seeds(["C:/r"], ["abc", "long"], {"n": ["m"]}, ["*/x/*9*", "*"]) == sorted(["C:\\r", "long", "n", "m", "x/9"])
    files = spark.createDataFrame([("B", "C:/f"), ("B", ""), ("B", None)], "hostname string, path string")
    hosts = spark.createDataFrame([("A",), ("B",)], "hostname string")
    got = {tuple(r) for r in seeds.discovery_seeds(hosts, events, files, ["long"]).collect()}
    assert got == {("A", "long"), ("B", "long"), ("B", "C:\\f"), ("A", "C:\\t\\a.exe "), ("A", "D:\\c.exe")}
    assert seeds.discovery_seeds(hosts, events, files, []).where(F.col("seed") == "long").collect() == []
