import corpus_pipeline
from gridpanel.llm import queries
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import SF
from tests.llm.test_packing import check


def test_stages_against_plain_versions(spark):
    docs = queries.table(spark, SF, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "substring", "decontamination", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), stage(spark, kept, SF).schema)
        if name == "packing":
            break
        assert kept.columns == columns
        after = {r["doc_id"]: r for r in kept.collect()}
        rows = [(d, r["text"]) for d, r in before.items()]
        if name == "toxicity":
            toxic = {r["doc_id"] for r in queries.op9_toxicity(spark, SF).collect() if r["toxic"]}
            assert after.keys() == before.keys() - toxic
        if name == "simhash":
            assert after.keys() == brute.one_of_each(rows)
        if name == "substring":
            plain = {d: (removed, text) for d, _, removed, text in brute.without_repeats(rows)}
            assert {d: r["text"] for d, r in after.items()} == {d: plain[d][1] if plain[d][0] else t for d, t in rows}
            assert all(r["n_chars"] == len(r["text"]) for d, r in after.items() if plain[d][0])
        if name == "decontamination":
            items = [f" {' '.join(brute.alnum(r['text']))} " for r in queries.table(spark, SF, "benchmark").collect()]
            whole = {d for d, t in rows if any(i in f" {' '.join(brute.alnum(t))} " for i in items)}
            assert whole.isdisjoint(after) and len(before) - len(after) <= len(whole) + 2
    import zlib

    pieces = [(r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in kept.collect()]
    assert check([(d, r["text"]) for d, r in before.items()], pieces) < 2048


def test_stages_on_odd_tables(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 5000, None, "s", None)]
    docs = spark.createDataFrame(rows, queries.table(spark, SF, "documents").schema)
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, some, SF)
            assert found.count() >= (0 if some is not docs else 1), name


def test_run_equals_its_stages(spark):
    """Each stage's rows handed to the next one by hand give the rows of ``run``."""
    docs = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, docs, SF)
        docs = spark.createDataFrame(step.collect(), step.schema)
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == docs.columns
    columns = ["doc_id", "start", "length", "doc_tokens", "tier", "offset"]
    placed = [r["doc_tokens"] for r in found.select("doc_id", "doc_tokens").distinct().collect()]
    assert sum(r["length"] for r in found.collect()) == sum(placed)
    whole = lambda df: sorted((r["doc_id"], r["n"], r["ids"]) for r in df.groupBy("doc_id").agg(F.first("doc_tokens").alias("n"), F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("ids")).collect())
    joined = lambda df: [(d, n, b"".join(bytes(p["ids"]) for p in ids)) for d, n, ids in whole(df)]
    assert joined(found) == joined(docs) and set(columns) <= set(found.columns)


def test_cut_repeats_with_odd_columns(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{passage} end", "a", 1), (2, f"start {passage}", "b", 2), (3, None, "c", 3), (4, "alone", "d", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, `_dedup` int")
    found = corpus_pipeline.cut_repeats(spark, frame, SF)
    assert found.columns == frame.columns
    assert sorted(map(tuple, found.collect())) == [(1, "end", "a", 1), (2, "start", "b", 2), (3, None, "c", 3), (4, "alone", "d", 4)]
