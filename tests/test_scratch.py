import pytest

from gridpanel.sources import scratch


def test_landed_tables_are_read_from_the_shared_folder_and_can_be_cleared(spark):
    stored = scratch.landed(spark.range(5).selectExpr("id", "CAST(NULL AS STRING) AS name"), "numbers")
    assert sorted(r["id"] for r in stored.collect()) == list(range(5))
    assert all(f.startswith("file:") and scratch.shared_folder(spark) in f for f in stored.inputFiles())
    scratch.clear(spark)
    with pytest.raises(Exception, match="(?i)not exist|not found|no such file"):
        spark.read.parquet(*stored.inputFiles()).count()


def test_a_session_without_a_shared_folder_is_refused():
    class Unset:
        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_folder(Unset)


def test_tables_that_are_done_with_can_be_removed(spark):
    before = scratch.made(spark)
    one, two = (scratch.landed(spark.range(n), "t") for n in (3, 4))
    made = scratch.made(spark)[len(before):]
    assert len(made) == 2
    scratch.remove(spark, made[:1])
    assert two.count() == 4 and scratch.made(spark) == [*before, made[1]]
    with pytest.raises(Exception, match="(?i)not.exist|PATH_NOT_FOUND"):
        spark.read.parquet(made[0]).count()
