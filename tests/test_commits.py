"""Blocks of iterations: restarts, more iterations, more scenarios, other seeds, half-made commits."""

import pytest
from pyspark.sql import functions as F

from gridpanel.sources import commits


class Run:
    """Rows (scenario, iteration, seed), every third iteration of "b c" without any."""

    def __init__(self, spark, path):
        self.spark, self.path, self.asked = spark, str(path), []

    def rows_of(self, seed, die_at=None):
        def rows(first, last, names):
            self.asked.append((first, last, names))
            if die_at is not None and first <= die_at <= last:
                raise RuntimeError("lost")
            out = self.spark.range(first, last + 1).selectExpr("CAST(id AS INT) AS iteration", "explode(split('{}', ','))".format(",".join(names)) + " AS scenario")
            return out.where("scenario <> 'b c' OR iteration % 3 > 0").withColumn("seed", F.lit(seed))

        return rows

    def go(self, n, names, seed=1, block=10, **more):
        digests = {s: commits.digest_of(s, seed) for s in names}
        done = commits.write_blocks(self.spark, self.rows_of(seed, more.pop("die_at", None)), self.path, n, digests, block, **more)
        return done, self.read(digests, n)

    def read(self, digests=None, n=None):
        return sorted((r["scenario"], r["iteration"], r["seed"]) for r in commits.read_iterations(self.spark, self.path, digests, n).collect())


def want(n, names, seed=1):
    return sorted((s, i, seed) for s in names for i in range(1, n + 1) if s != "b c" or i % 3)


@pytest.fixture
def run(spark, tmp_path):
    return Run(spark, tmp_path / "t")


def test_more_iterations(run):
    assert run.go(15, ["a"])[1] == want(15, ["a"])
    done, rows = run.go(20, ["a"])
    assert rows == want(20, ["a"]) and done == [("a", 11, 20)]
    assert run.go(20, ["a"]) == ([], rows)
    assert run.go(5, ["a"]) == ([("a", 1, 5)], want(5, ["a"]))  # a block of another length
    assert run.go(20, ["a"])[1] == rows


def test_more_scenarios(run):
    run.go(15, ["a"])
    done, rows = run.go(15, ["a", "b c"])
    assert rows == want(15, ["a", "b c"]) and {d[0] for d in done} == {"b c"}
    assert run.go(15, ["b c"]) == ([], want(15, ["b c"]))


def test_another_seed(run):
    run.go(15, ["a", "b c"])
    with pytest.raises(ValueError, match="another seed"):
        run.go(15, ["a"], seed=2, changed="raise")
    done, rows = run.go(15, ["a"], seed=2)
    assert rows == want(15, ["a"], 2) and len(done) == 2
    assert run.read() == sorted(want(15, ["a"], 2) + want(15, ["b c"]))


def test_a_run_that_dies_with_another_seed_is_not_mixed_with_the_old_one(run):
    run.go(30, ["a"])
    with pytest.raises(RuntimeError):
        run.go(30, ["a"], seed=2, die_at=15)
    assert run.read() == want(10, ["a"], 2)
    assert run.go(30, ["a"], seed=2)[0] == [("a", 11, 20), ("a", 21, 30)]
    assert run.read() == want(30, ["a"], 2)


def test_a_run_that_died_goes_on(run):
    with pytest.raises(RuntimeError):
        run.go(30, ["a", "b c"], die_at=25)
    assert run.read() == want(20, ["a", "b c"])
    run.asked.clear()
    assert run.go(30, ["a", "b c"])[1] == want(30, ["a", "b c"])
    assert run.asked == [(21, 30, ["a", "b c"])]


def test_a_half_made_commit_is_not_there(run, monkeypatch):
    run.go(10, ["a", "b c"])

    def dies(*args):
        raise RuntimeError("killed before the manifest")

    with monkeypatch.context() as m:
        m.setattr(commits, "_record", dies)
        with pytest.raises(RuntimeError):
            run.go(20, ["a", "b c"])
    assert run.read() == want(10, ["a", "b c"])  # its folder is ignored
    assert run.go(20, ["a", "b c"])[1] == want(20, ["a", "b c"])
    assert len(commits.vacuum(run.spark, run.path)) == 1
    assert run.read() == want(20, ["a", "b c"]) and commits.vacuum(run.spark, run.path) == []


def test_a_half_written_manifest_file_is_not_read(run):
    run.go(10, ["a"])
    fs, staged = commits._files(run.spark, f"{run.path}/manifest/000000000009-x.json.tmp")
    out = fs.create(staged)
    out.write(bytearray(b'{"order": 9, "scen'))
    out.close()
    assert run.go(20, ["a"])[1] == want(20, ["a"])


def test_other_block_length(run):
    run.go(30, ["a"], block=10)
    assert run.go(30, ["a"], block=7)[1] == want(30, ["a"])
    assert run.read() == want(30, ["a"])


def test_blocks_without_rows_are_done(run):
    digests = {"b c": "x"}
    for _ in range(2):
        done = commits.write_blocks(run.spark, lambda a, b, s: run.rows_of(1)(a, b, s).where("iteration > 5"), run.path, 9, digests, 3)
        run.asked.append(done)
    assert run.asked[-1] == [] and run.read() == [("b c", 7, 1), ("b c", 8, 1)]
    assert run.read({"nobody": "x"}) == []


def test_rewritten_blocks_replace_their_rows(spark, tmp_path):
    rows = [(s, i, float(i)) for s in ("a", "b c", "1", "x/y:z%20é") for i in range(1, 7)]
    df = spark.createDataFrame(rows, "scenario string, iteration int, v double")
    path = str(tmp_path / "t")
    commits.write_iterations(df, path, 2)
    commits.write_iterations(df.where("iteration IN (3, 4) AND scenario = 'a'").withColumn("v", F.lit(0.0)), path, 2)
    read = commits.read_iterations(spark, path)
    got = {(r["scenario"], r["iteration"]): r["v"] for r in read.collect()}
    assert got == {(s, i): (0.0 if s == "a" and i in (3, 4) else v) for s, i, v in rows}
    assert commits.read_iterations(spark, path, scenario="1").count() == 6
    with pytest.raises(ValueError, match="no manifest"):
        commits.read_iterations(spark, str(tmp_path / "none"))


def test_rows_outside_their_block_are_refused(run):
    with pytest.raises(ValueError, match="outside"):
        commits.write_blocks(run.spark, lambda a, b, s: run.rows_of(1)(a, b + 10, s), run.path, 10, {"a": "x"}, 10)


def test_content_hash(spark):
    rows = [(i, None if i % 3 else "x", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    same = commits.content_hash(df)
    assert commits.content_hash(df.repartition(7).orderBy("b").select("c", "a", "b")) == same
    assert commits.content_hash(df.where("a <> 4")) != same
    assert commits.content_hash(df.withColumn("b", F.coalesce("b", F.lit("")))) != same
    assert commits.content_hash(df.withColumnRenamed("b", "d")) != same
    assert commits.content_hash(df.unionByName(df)) != same
    assert commits.content_hash(df.limit(0)) != same


def test_many_blocks_do_not_make_many_files(spark, tmp_path):
    """A commit of 300 blocks has no more files than one of few, is made from one pass, and its rewritten blocks are left out."""
    df = spark.range(1, 3001).selectExpr("IF(id % 2 = 0, 'a', NULL) AS scenario", "CAST(id AS INT) AS iteration", "0 AS v")
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    path = str(tmp_path / "t")
    made = commits.write_iterations(df.mapInArrow(counted, df.schema), path, 10)
    assert passes.value == 3000 and len(made) == 600
    assert len(list((tmp_path / "t" / "blocks").rglob("*.parquet"))) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    commits.write_iterations(df.where("iteration <= 25 AND scenario IS NULL").withColumn("v", F.lit(1)), path, 10)
    got = [tuple(r) for r in commits.read_iterations(spark, path).select("scenario", "iteration", "iter_block", "v").collect()]
    # the third block is replaced by the one of iterations 21 to 25
    want = [("a" if i % 2 == 0 else None, i, (i - 1) // 10, int(i <= 25 and i % 2 == 1)) for i in range(1, 3001) if i % 2 == 0 or not 25 < i <= 30]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_commits_with_a_folder_a_block_are_read_on(run):
    """As commits were laid out before: their folders and a manifest without the block's number."""
    import json

    old = f"{run.path}/blocks/commit_id=c000000000001-x"
    rows = run.rows_of(1)(1, 20, ["a"]).withColumn("iter_block", F.floor((F.col("iteration") - 1) / 10).cast("int"))
    rows.write.partitionBy("scenario", "iter_block").parquet(old)
    digest, fs = commits.digest_of("a", 1), commits._files(run.spark, f"{run.path}/manifest/000000000001-x.json")
    out = fs[0].create(fs[1])
    for k in range(2):
        entry = dict(order=1, scenario="a", first=10 * k + 1, last=10 * k + 10, digest=digest, rows=10, folder=f"commit_id=c000000000001-x/scenario=a/iter_block={k}", schema=rows.schema.json())
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
    out.close()
    assert run.go(30, ["a"]) == ([("a", 21, 30)], want(30, ["a"]))
    commits.write_iterations(run.rows_of(5)(11, 20, ["a"]), run.path, 10, digest=digest)
    assert run.read() == sorted([x if not 10 < x[1] <= 20 else ("a", x[1], 5) for x in want(30, ["a"])])


def test_what_counts_among_many_entries():
    """Against the plain rule: newest first, none that overlaps one already there."""
    import random
    import time

    rng = random.Random(3)
    some = [commits.Entry(rng.randint(1, 9), "a", f, f + rng.randint(0, 6), "d", 1, None, "") for f in (rng.randint(1, 60) for _ in range(200))]
    kept = []
    for e in sorted(some, key=lambda e: -e.order):
        if all(e.last < k.first or e.first > k.last for k in kept):
            kept.append(e)
    assert commits.current(some) == sorted(kept, key=lambda e: e.first)
    many = [commits.Entry(1, "a", 20 * i + 1, 20 * i + 20, "d", 1, None, "") for i in range(20_000)]
    begin = time.time()
    assert commits.current(many) == many and time.time() - begin < 5
