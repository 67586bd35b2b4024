"""Stored findings: whole snapshots, half-written batches, two writers; scans that contain failures and go on."""

import pytest
from pyspark.sql import functions as F

from srcloom.operators import findings, scan, store
from srcloom.sources.corpora import language

SCHEMA = "id string, status string, run_id long"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def held(df):
    return sorted(tuple(r) for r in df.select("run_id", "id", "status").collect())


@pytest.fixture
def stored(spark, tmp_path):
    s = store.FindingStore(spark, str(tmp_path / "store"), SCHEMA)
    assert s.version() == 0 and s.read().count() == 0
    assert s.write(rows(spark, ("a", "open", 1), ("b", "open", 1), ("a", "open", 2))) == 1
    return s


def test_only_touched_runs_are_rewritten(spark, stored, tmp_path):
    assert stored.write(rows(spark, ("c", "fixed", 2))) == 2
    assert held(stored.read()) == [(1, "a", "open"), (1, "b", "open"), (2, "c", "fixed")]
    assert held(stored.read(1)) == [(1, "a", "open"), (1, "b", "open"), (2, "a", "open")]
    assert len(list((tmp_path / "store/data").glob("batch=*/run_id=1"))) == 1
    assert stored.clear(spark.createDataFrame([(1,)], "run_id int")) == 3 and held(stored.read()) == [(2, "c", "fixed")]
    assert stored.update(lambda f: f.withColumn("status", F.lit("stale"))) == 4 and held(stored.read()) == [(2, "c", "stale")]
    assert stored.update(lambda f: findings.pruned(f)) == 5 and stored.read().count() == 0


def test_a_write_that_stops_half_way_is_not_seen(spark, stored, monkeypatch):
    @F.udf("string")
    def stops(x):
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        stored.write(rows(spark, ("z", "open", 1)).withColumn("status", stops("id")))
    assert held(stored.read()) == [(1, "a", "open"), (1, "b", "open"), (2, "a", "open")]
    monkeypatch.setattr(stored, "_publish", lambda *a: (_ for _ in ()).throw(OSError("gone before publishing")))
    with pytest.raises(OSError, match="gone"):
        stored.write(rows(spark, ("z", "open", 1)))
    monkeypatch.undo()
    assert stored.version() == 1 and held(stored.read()) == [(1, "a", "open"), (1, "b", "open"), (2, "a", "open")]


def test_two_writers(spark, stored):
    other = store.FindingStore(spark, stored.folder, SCHEMA)
    base = other.version()
    stored.write(rows(spark, ("a", "fixed", 1)))
    # another run: both are kept
    assert other.write(rows(spark, ("n", "open", 3)), base=base) == 3
    assert held(stored.read()) == [(1, "a", "fixed"), (2, "a", "open"), (3, "n", "open")]
    # the same run: the later one is told
    with pytest.raises(store.ConflictError):
        other.write(rows(spark, ("b", "ignored", 1)), base=base)
    assert held(stored.read()) == [(1, "a", "fixed"), (2, "a", "open"), (3, "n", "open")]


def test_the_second_to_publish_tries_again(spark, stored, monkeypatch):
    other = store.FindingStore(spark, stored.folder, SCHEMA)
    publish, first = other._publish, []

    def late(version, name):
        if not first:
            first.append(stored.write(rows(spark, ("q", "open", 9))))
        return publish(version, name)

    monkeypatch.setattr(other, "_publish", late)
    assert other.write(rows(spark, ("p", "open", 8))) == 3
    assert {r.run_id for r in stored.read().collect()} == {1, 2, 8, 9}


def inputs(spark):
    code = {"a.ts": "export const usedThing = 1;\nexport const deadThing = 1;\ndebugger;\n", "b.ts": "import { usedThing } from './a';\nimport { gone } from './c';\nusedThing();\n", "package.json": '{"dependencies": {"left-pad": "1"}}'}
    files = spark.createDataFrame(list(code.items()), "path string, content string").withColumn("language", language(F.col("path")))
    return scan.Inputs(files.filter("language IS NOT NULL"), files)


def test_scan_contains_failures_and_resumes(spark, tmp_path):
    ran = []

    def broken(x):
        raise ValueError("kernel broke\nat length")

    def counted(name):
        return lambda x: (ran.append(name), scan.KERNELS[name](x))[1]

    at = str(tmp_path / "scan")
    kernels = {"dead-exports": counted("dead-exports"), "unused-imports": broken, "unused-dependencies": counted("unused-dependencies")}
    got, warnings = scan.scan(inputs(spark), kernels=kernels, at=at)
    assert {(r.check_name, r.symbol, r.suggestion) for r in got.collect()} == {("dead-export", "deadThing", "Remove the export or verify it is consumed externally."), ("unused-dep", ":left-pad", "Remove the dependency or verify it is used via dynamic require.")}
    assert [tuple(r) for r in warnings.collect()] == [("unused-imports", "kernel broke")]
    again, warnings = scan.scan(inputs(spark), kernels={**kernels, "unused-imports": counted("unused-imports")}, at=at)
    assert ran == ["dead-exports", "unused-dependencies", "unused-imports"] and warnings.count() == 0
    assert {r.check_name for r in again.collect()} == {"dead-export", "unused-dep", "unused-import"}
    assert {r.id for r in got.collect()} < {r.id for r in again.collect()}
    off, _ = scan.scan(inputs(spark), ["dead-export", "unused-import"], kernels=kernels, at=at)
    assert {r.check_name for r in off.collect()} == {"unused-dep"}


def test_all_kernels_run_on_a_small_project(spark):
    got, warnings = scan.scan(inputs(spark))
    assert warnings.collect() == []
    assert {"dead-export", "unused-import", "unused-dep"} <= {r.check_name for r in got.collect()}


def test_findings_are_found_by_any_of_their_files(spark):
    place = lambda f: (f, 1, 2)
    data = [("one", [place("a.js")]), ("pair", [place("/root/a.js"), place("/root\\b.js")]), ("none", []), ("null", None), ("other", [place("c.js")])]
    df = findings.relative_locations(spark.createDataFrame(data, "id string, locations array<struct<file:string,start_line:int,end_line:int>>"), "/root")
    index = findings.file_index(df)
    asked = lambda *files: spark.createDataFrame([(f,) for f in files], "file string")
    assert [r.id for r in findings.in_files(df, asked("b.js"), index).collect()] == ["pair"]
    assert sorted(r.id for r in findings.in_files(df, asked("a.js", "c.js", "a.js"), index).collect()) == ["one", "other", "pair"]
    stale = index.union(spark.createDataFrame([("z.js", "one")], "file string, id string"))
    assert findings.in_files(df, asked("z.js"), stale).count() == 0


def test_groups_by_count(spark):
    data = [("f1", "b.ts", "open", "low"), ("f2", "b.ts", "open", "critical"), ("f3", "a.ts", "open", "low"), ("f4", "c.ts", "open", "high"), ("f5", "a.ts", "stale", "high")]
    df = spark.createDataFrame(data, "id string, file string, status string, severity string")
    got = [(r.file, r.n, r.ids, r.total_groups, r.total_findings) for r in findings.file_groups(df, 0, 2).orderBy(F.desc("n"), "file").collect()]
    assert got == [("b.ts", 2, ["f1", "f2"], 3, 4), ("a.ts", 1, ["f3"], 3, 4)]
