"""Result tables that are written in blocks of iterations, with a manifest of what is whole.

A commit is a folder of its own, ``blocks/commit_id=.../scenario=...``, and then one small
file in ``manifest`` that says which scenarios and iterations it holds and under which digest
(seed, settings and inputs) they were made. Blocks are a column of the files, so their number does not
add to that of the files (commits made before that have a folder each, which is read as it is). Readers go by the manifest alone: a folder that no file
names, of a run that died, is not there for them, and a commit counts for all of its
scenarios or for none. Nothing is moved or overwritten, so this holds on object stores too.

Of a scenario's entries the newest one's digest counts, and among those of that digest a newer entry
replaces older ones whose iterations it overlaps. One writer at a time.

The manifest has an entry for each scenario, block and commit; it is read by the driver.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Entry:
    """Iterations ``first`` to ``last`` of a scenario, in a folder below ``blocks``; None where
    they have no rows. ``block`` is their number in that folder, None where the folder is theirs alone."""

    order: int
    scenario: str
    first: int
    last: int
    digest: str
    rows: int
    folder: str | None
    schema: str
    block: int | None = None


def digest_of(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def content_hash(df: DataFrame) -> str:
    """The same for the same rows in any order and partitioning."""
    columns = sorted(df.columns)
    row = F.xxhash64(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in columns]).cast("decimal(20,0)")
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("sum"), F.bit_xor(F.xxhash64(row)).alias("mixed")).first()
    return digest_of([(c, df.schema[c].dataType.simpleString()) for c in columns], found["n"], str(found["sum"]), found["mixed"])


def _files(spark: SparkSession, path: str):
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def _record(spark: SparkSession, path: str, entries: list[Entry]) -> None:
    """The commit itself: a file appears under its final name when it is whole."""
    fs, target = _files(spark, f"{path}/manifest/{entries[0].order:012d}-{uuid.uuid4().hex}.json")
    staged = target.suffix(".tmp")
    lines = "".join(json.dumps(asdict(e)) + "\n" for e in entries)
    out = fs.create(staged)
    try:
        out.write(bytearray(lines.encode()))
    finally:
        out.close()
    if not fs.rename(staged, target):
        raise OSError(f"the manifest in {path} can't be written")


def entries(spark: SparkSession, path: str) -> list[Entry]:
    """All entries, oldest first."""
    fs, folder = _files(spark, f"{path}/manifest")
    if not fs.exists(folder) or not any(f.getPath().getName().endswith(".json") for f in fs.listStatus(folder)):
        return []
    kinds = {"int": T.LongType(), "str": T.StringType(), "str | None": T.StringType(), "int | None": T.LongType()}
    schema = T.StructType([T.StructField(k, kinds[t]) for k, t in Entry.__annotations__.items()])
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{path}/manifest").collect()
    return sorted((Entry(**r.asDict()) for r in rows), key=lambda e: (e.order, str(e.scenario), e.first))


def current(found: Iterable[Entry], digests: dict[str, str] | None = None) -> list[Entry]:
    """The entries that count, at most one for an iteration of a scenario. ``digests`` by scenario
    asks for these scenarios and digests alone."""
    kept: dict[str, list[Entry]] = {}
    starts: dict[str, list[int]] = {}
    wanted = dict(digests or {})
    for e in sorted(found, key=lambda e: -e.order):
        if digests is not None and e.scenario not in digests or e.digest != wanted.setdefault(e.scenario, e.digest):
            continue
        own, first = kept.setdefault(e.scenario, []), starts.setdefault(e.scenario, [])
        # those kept are apart and in order, so only the last one that begins in time can reach into this one
        at = bisect.bisect_right(first, e.last)
        if at == 0 or own[at - 1].last < e.first:
            own.insert(at, e)
            first.insert(at, e.first)
    return sorted((e for own in kept.values() for e in own), key=lambda e: (str(e.scenario), e.first))


Spans = dict[tuple[str, int], tuple[int, int]]


def commit(df: DataFrame, path: str, ranges: Spans | Callable[[set], Spans], digests: dict[str, str] | str, files: int = 8) -> list[Entry]:
    """Write rows with ``scenario, iteration, iter_block`` and record them. ``ranges`` has the
    iterations that each (scenario, block) stands for, or tells them for those that were written; those
    without rows are recorded too. ``digests`` are by scenario or one for all. A
    scenario's block is dealt over ``files`` tasks."""
    spark = df.sparkSession
    order = max((e.order for e in entries(spark, path)), default=0) + 1
    target = f"{path}/blocks/commit_id=c{order:012d}-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("iteration"), F.lit(files))
    df.repartition("scenario", "iter_block", part).write.partitionBy("scenario").parquet(target)
    written = spark.read.schema(df.schema).parquet(target)
    folder = F.min(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")).alias("folder")
    held = {(r["scenario"], r["iter_block"]): r for r in written.groupBy("scenario", "iter_block").agg(F.count("*").alias("n"), folder).collect()}
    spans = ranges(set(held)) if callable(ranges) else ranges
    if extra := held.keys() - spans.keys():
        raise ValueError(f"rows outside the blocks to be written: {sorted(map(str, extra))}")
    schema = df.schema.json()
    made = [
        Entry(
            order, scenario, *span, digests if isinstance(digests, str) else digests[scenario], r["n"] if (r := held.get((scenario, block))) else 0,
            unquote(r["folder"]).rsplit("/blocks/", 1)[1] if r else None, schema, block,
        )
        for (scenario, block), span in spans.items()
    ]
    if made:
        _record(spark, path, made)
    return made


def with_block(df: DataFrame, block: int = 1000) -> DataFrame:
    """Number of the run of iterations a row belongs to."""
    return df.withColumn("iter_block", F.floor((F.col("iteration") - 1) / block).cast("int"))


def write_iterations(df: DataFrame, path: str, block: int = 1000, files: int = 8, digest: str = "") -> list[Entry]:
    """Write whole blocks of iterations in one commit; blocks that are written again are
    replaced, the others stay. The rows are made once."""

    def whole(there):
        return {(scenario, number): (number * block + 1, (number + 1) * block) for scenario, number in there}

    return commit(with_block(df, block), path, whole, digest, files)


def write_blocks(
    spark: SparkSession, rows_of: Callable[[int, int, list[str]], DataFrame], path: str, n: int, digests: dict[str, str],
    block: int = 1000, changed: str = "rewrite",
) -> list[tuple[str, int, int]]:
    """Have iterations 1 to n of every scenario in ``digests``, each block in a commit of its own.

    What the manifest has under the same digest for the same iterations is left out, so a run
    started again goes on where it died, and more iterations or scenarios add what is missing. Where a
    scenario's digest is another one (seed, settings or inputs changed), all its blocks are written
    anew, or, with ``changed="raise"``, nothing is. ``rows_of(first, last, scenarios)`` gives a
    block's rows. Returns what was written: (scenario, first, last).
    """
    found = entries(spark, path)
    if changed == "raise":
        newest = {e.scenario: e.digest for e in found}
        if other := sorted(s for s, d in digests.items() if newest.get(s, d) != d):
            raise ValueError(f"{path} holds results of another seed, settings or inputs for {other}")
    done = {(e.scenario, e.first, e.last) for e in current(found, digests)}
    written = []
    for number, first in enumerate(range(1, n + 1, block)):
        last = min(first + block - 1, n)
        missing = [s for s in digests if (s, first, last) not in done]
        if missing:
            rows = with_block(rows_of(first, last, missing), block)
            commit(rows, path, {(s, number): (first, last) for s in missing}, digests)
            written += [(s, first, last) for s in missing]
    return written


def read_iterations(
    spark: SparkSession, path: str, digests: dict[str, str] | None = None, n: int | None = None, scenario: str | None = None
) -> DataFrame:
    """The rows that count: of all scenarios or of one, of the ``digests`` asked for, of iterations
    up to ``n``. Only folders of what is asked for are read."""
    found = entries(spark, path)
    if not found:
        raise ValueError(f"{path} has no manifest")
    some = [e for e in current(found, digests) if scenario is None or e.scenario == scenario]
    schema = T.StructType.fromJson(json.loads(found[-1].schema))
    folders = sorted({e.folder for e in some if e.folder and (n is None or e.first <= n)})
    if not folders:
        return spark.createDataFrame([], schema)
    blocks, depths = f"{path}/blocks", {f.count("/") for f in folders}
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField("commit_id", T.StringType())])).option("basePath", blocks)
    parts = [read.parquet(*[f"{blocks}/{f}" for f in folders if f.count("/") == depth]) for depth in sorted(depths)]
    out = _without(reduce(DataFrame.unionByName, parts), set(found) - set(some), set(folders)).select(*schema.names)
    return out if n is None else out.where(F.col("iteration") <= n)


def _without(rows: DataFrame, replaced: set[Entry], folders: set[str]) -> DataFrame:
    """Leave out the blocks that do not count, of folders that others share with them."""
    gone = [(e.folder.split("/")[0].removeprefix("commit_id="), e.scenario, e.block) for e in replaced if e.folder in folders and e.block is not None]
    if not gone:
        return rows
    # as many rows as the driver has read from the manifest
    named = F.broadcast(rows.sparkSession.createDataFrame(gone, "commit_id string, scenario string, iter_block int")).alias("gone")
    on = [F.col(f"rows.{c}").eqNullSafe(F.col(f"gone.{c}")) for c in named.columns]
    return rows.alias("rows").join(named, on, "left_anti")


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove the folders of commits that no entry that counts lies in; returns them. For when
    no run writes or reads there."""
    fs, blocks = _files(spark, f"{path}/blocks")
    if not fs.exists(blocks):
        return []
    kept = {e.folder.split("/")[0] for e in current(entries(spark, path)) if e.folder}
    gone = []
    for status in fs.listStatus(blocks):
        if status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)
            gone.append(status.getPath().getName())
    return gone
