"""Hierarchical packing of token ids into windows of several lengths.

Documents are tokenized and cut into full windows of the longest tier; what remains
of each is routed to the shortest tier that holds it. Remainders are dealt to blocks
of bounded size and each block is packed from its longest tier down: a remainder
opens a window of its tier, and the window's gap is filled from shorter tiers, with
the longest piece that fits first. Only if no piece fits is one cut to close the gap.
So every window is full but the last of a block. Windows, longest first, then fill
step groups of equal token counts.

Full windows go through the same blocks, dealt one by one, so neither a long document
nor a frequent one meets in a task; pieces equal in key, place and ids are dealt by how many of them the
task has had, so rows that repeat, a third of the table even, go to all blocks. Null text counts as empty: such a document is its
end id alone. Repeated rows are packed once each; an empty table gives an empty result. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm import words
from gridpanel.llm.tokens import tokenizer
from gridpanel.llm.workers import lean

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16_384
BLOCK_BYTES = 4 << 20
SHIFT = 32
SLICE = 1 << 20  # bytes of text worked on at once


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, key: str, text: str, path: str, end_id: int, longest: int, blocks: int) -> DataFrame:
    """Each document's ids in runs of up to ``longest``, with the block they are dealt to."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    picked = docs.select(F.col(f"`{key}`").alias("key"), t.alias("text"))
    key_type = picked.schema["key"].dataType.simpleString()
    names = ["block", "key", "start", "doc_tokens", "crc", "ids"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = tokenizer(path).batch
        seen: dict[int, int] = {}  # equal pieces of this task so far
        for batch in batches:
            for part in words.slices(batch, "text", SLICE):
                found, bounds = encode(*words.flat(part.column("text")))
                raw, bounds = found.astype("<u4").tobytes(), (4 * bounds).tolist()
                row, start, total, crc, ids = [], [], [], [], []
                for i in range(part.num_rows):
                    doc = raw[bounds[i] : bounds[i + 1]] + end
                    for at in range(0, len(doc), 4 * longest):
                        piece = doc[at : at + 4 * longest]
                        row.append(i)
                        start.append(at // 4)
                        total.append(len(doc) // 4)
                        crc.append(zlib.crc32(piece))
                        ids.append(piece)
                keys = part.column("key").take(pa.array(row, pa.int64()))
                mixed = words.mix((np.array(crc, np.uint64) << np.uint64(24)) + np.array(start, np.uint64))
                salt = np.array([zlib.crc32(str(k).encode()) for k in keys.to_pylist()], np.uint64)
                own = words.mix(mixed ^ salt)
                turn = np.zeros(len(own), np.uint64)
                for i, piece in enumerate(own.tolist()):
                    turn[i] = seen[piece] = seen.get(piece, -1) + 1
                block = (words.mix(own + turn * words.BASE) % np.uint64(blocks)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), keys, pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())],
                    names,
                )

    return picked.mapInArrow(run, f"block bigint, key {key_type}, start bigint, doc_tokens bigint, crc bigint, ids binary")


def plan(lengths: list[int], tiers: tuple[int, ...]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, [(piece, from, length), ...]) that hold all pieces, longest tier first."""
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(tiers[-1] + 1)]
    lengths_there = 0  # bit l is set while a piece of length l waits

    def put(piece: int, start: int, length: int) -> None:
        nonlocal lengths_there
        waiting[length].append((piece, start))
        lengths_there |= 1 << length

    def take(length: int) -> tuple[int, int]:
        nonlocal lengths_there
        out = waiting[length].pop()
        if not waiting[length]:
            lengths_there &= ~(1 << length)
        return out

    for i, n in enumerate(lengths):
        put(i, 0, n)
    windows = []
    while lengths_there:
        longest = lengths_there.bit_length() - 1
        tier = next(t for t in tiers if t >= longest)
        inside = [(*take(longest), longest)]
        gap = tier - longest
        while gap and lengths_there:
            fits = (lengths_there & ((1 << (gap + 1)) - 1)).bit_length() - 1
            if fits > 0:
                inside.append((*take(fits), fits))
                gap -= fits
                continue
            shortest = (lengths_there & -lengths_there).bit_length() - 1
            piece, start = take(shortest)
            inside.append((piece, start, gap))
            put(piece, start + gap, shortest - gap)
            gap = 0
        windows.append((tier, inside))
    return windows


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each piece: ``key, start, length, ids`` (little-endian unsigned
    32-bit), ``doc_tokens``, its place ``sequence_id, offset``, the window's ``tier``
    and the ``step_group`` of the window.

    Tiers are powers of two in rising order; ``block_bytes`` of text make a block.
    """
    if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be rising powers of two")
    lean(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = pieces(docs, key, text, path or default_tokenizer(), end_id, tiers[-1], blocks)
    names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]

    def packed(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = group[0].as_py()
        order = [("crc", "ascending"), ("start", "ascending"), ("key", "ascending")]
        table = table.sort_by(order).combine_chunks()
        ids = table.column("ids").to_pylist()
        starts = table.column("start").to_pylist()
        row, start, length, out, sequence, offset, size, step = [], [], [], [], [], [], [], []
        filled, group_no = 0, 0
        for n, (tier, inside) in enumerate(plan([len(x) // 4 for x in ids], tiers)):
            if filled + tier > step_tokens:
                filled, group_no = 0, group_no + 1
            filled += tier
            at = 0
            for piece, first, count in inside:
                row.append(piece)
                start.append(starts[piece] + first)
                length.append(count)
                out.append(ids[piece][4 * first : 4 * (first + count)])
                sequence.append((block << SHIFT) + n)
                offset.append(at)
                size.append(tier)
                step.append((block << SHIFT) + group_no)
                at += count
        rows = pa.array(row, pa.int64())
        long = pa.int64()
        return pa.Table.from_arrays(
            [
                table.column("key").take(rows), pa.array(start, long), pa.array(length, long), pa.array(out, pa.binary()),
                table.column("doc_tokens").take(rows), pa.array(sequence, long), pa.array(offset, long),
                pa.array(size, long), pa.array(step, long),
            ],
            names,
        )

    key_type = dealt.schema["key"].dataType.simpleString()
    return dealt.groupBy("block").applyInArrow(
        packed,
        f"key {key_type}, start bigint, length bigint, ids binary, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, tier bigint, step_group bigint",
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, tier, step_group, ids, lengths``: the windows themselves, with the
    lengths of their pieces (for attention masks)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = packed.groupBy("sequence_id", "tier", "step_group").agg(parts.alias("parts"))
    joined = F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b))
    return rows.select("sequence_id", "tier", "step_group", joined.alias("ids"), F.col("parts.length").alias("lengths"))
