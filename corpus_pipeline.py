"""Documents to packed training sequences, in five stages.

Each stage gets the rows its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage to the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.llm import decontaminate, packing, simhash, substring, toxicity
from gridpanel.llm.queries import table
from gridpanel.sources import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity grade is likelier above 0 than 0 go. Null and empty texts stay,
    repeated rows are judged alike."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.severity(model, F.col("text"))["p_toxic"] < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints of four-word shingles are linked at 4 or fewer differing bits, one
    stays: that with the smallest id, null last. Null texts count as empty, and empty ones as alike."""
    return simhash.one_of_each(docs, shingle=4, max_bits=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in a passage of 35 words that occurs again are cut; a document that loses
    none, or has no text, keeps it as it is. ``n_chars``, where there is such a column, follows the
    text. Repeated rows stay, cut alike; other columns may have any names."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row")
    own = docs.select(row, F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    marked = substring.without_repeats(own, result="dedup")
    changed = F.col("dedup.n_removed") > 0
    now = {"text": F.when(changed, F.col("dedup.kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(changed, F.length("dedup.kept").cast("long")).otherwise(F.col("row").getField("n_chars"))
    return marked.select(*[now.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, edited ones included, go; those without text stay,
    as all do for an empty benchmark."""
    return decontaminate.without_passages(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its ids and its place in a sequence. A null text is
    an end alone; repeated rows are packed each."""
    return packing.pack(docs).withColumnRenamed("key", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substring", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# No SQL says what the first two and the fourth stage do; tests hold each stage against
# a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has landed on its way goes once its output is written, and
    that output once the next one's is."""
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before = len(scratch.made(spark)) - len(held)
        docs = scratch.landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
        *done, output = scratch.made(spark)[before:]
        scratch.remove(spark, done)
        held = [output]
    return docs
