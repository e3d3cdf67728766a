"""Conversations rendered by a compiled template, with loss spans, and read back.

Texts and roles are escaped so that no control string of the template can come from
them: a backslash is put before every backslash and before the ``|`` of every ``<|``.
``read_back`` splits at the control strings and takes the backslashes away again.

Rows are taken by turn (null first), then role, then text; repeated rows are turns of
their own. Null text or role is empty; a null conversation id is a conversation of its
own. Other columns, whatever their names, are not read; an empty table gives no rows.

``format_turns`` renders turns on their own, for templates that are a loop over messages. Turns are dealt
by ranges of (conversation, turn, role, text), so one conversation, however long, is rendered by as many
tasks as its share of the rows; offsets are carried from range to range. ``digests_of_turns`` reads each piece back where it
lies; only the running digests of a conversation, which are sequential by nature, see its turns
one after the other, and hold none. ``format_conversations`` takes any template and gives one text a
conversation, which has to fit in a task's memory.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.llm.templates import compile_template, compile_turns
from gridpanel.sources.scratch import landed

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape_role }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
SPECIAL = re.compile(r"\\|<\|")
ESCAPED = re.compile(r"\\(.)", re.S)
HEAD = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else "<\\|", text)


def escape_role(role: str) -> str:
    """Like ``escape``, and with a backslash before line breaks, which end a role."""
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


FILTERS = {"escape": escape, "escape_role": escape_role}


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a text rendered by ``TEMPLATE``."""
    turns = []
    for block in formatted.split(START)[1:]:
        head = HEAD.match(block)
        turns.append((unescape(head[1]), unescape(block[head.end() : block.rindex(END)])))
    return turns


def _picked(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    empty = F.lit("")
    return turns.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), empty).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), empty).alias("text"),
    )


ORDER = ["conv", "turn", "role", "text"]
HELD = 4 << 20  # characters of a batch of pieces


def format_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: str = TEMPLATE
) -> DataFrame:
    """``conv, nth, start, piece, spans``: each turn's rendering, its number from 1, the code
    point it starts at in the conversation's text, and the (start, end) of its parts under the loss mask there.

    The pieces of a conversation in order of ``nth`` are its text.
    """
    if compile_turns(template, FILTERS) is None:
        raise ValueError("turns can be rendered on their own only where the template is a loop over messages")
    picked = _picked(turns, conv, turn, role, text)
    key = picked.schema["conv"].dataType.simpleString()

    def run(batches):
        render, at, part = compile_turns(template, FILTERS), (), TaskContext.get().partitionId()
        nth = start = size = 0
        rows: list[tuple] = []

        def flush():
            keys, nths, starts, pieces, spans = zip(*rows)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [
                pa.array(keys, conv_type), pa.array([part] * len(rows), pa.int32()), pa.array(nths), pa.array(starts),
                pa.array(pieces), pa.array([len(p) for p in pieces]), pa.array(spans, kind),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["conv", "part", "nth", "start", "piece", "size", "spans"])

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for own, who, said in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text"))):
                if at != (own,):
                    at, nth, start = (own,), 0, 0
                piece, marks = render({"role": who, "text": said})
                nth += 1
                rows.append((own, nth, start, piece, [{"start": a, "end": b} for a, b in marks]))
                start += len(piece)
                size += len(piece)
                if size > HELD:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = picked.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    schema = f"conv {key}, part int, nth bigint, start bigint, piece string, size bigint, spans array<struct<start:bigint,end:bigint>>"
    pieces = landed(dealt.select("conv", "role", "text").mapInArrow(run, schema), "turns")
    # where a conversation goes on in a later range: one row a conversation and range
    ends = pieces.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumns({"_n": F.sum("n").over(before), "_size": F.sum("size").over(before)}).where("_n IS NOT NULL")
    carried = landed(carried.select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), "_n", "_size"), "carried")
    both = pieces.join(carried, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    both = both.withColumn("_from", F.col("start") + F.coalesce("_size", F.lit(0)))
    start = F.col("_from")
    moved = F.transform("spans", lambda s: F.struct((s["start"] + start).alias("start"), (s["end"] + start).alias("end")))
    return both.select("conv", (F.col("nth") + F.coalesce("_n", F.lit(0))).alias("nth"), start.alias("start"), "piece", moved.alias("spans"))


def digests_of_turns(pieces: DataFrame) -> DataFrame:
    """``digests`` of the conversations whose pieces these are."""
    key = pieces.schema["conv"].dataType.simpleString()

    def back(batches):
        for batch in batches:
            rows = []
            for piece, start, spans in zip(*(batch.column(n).to_pylist() for n in ("piece", "start", "spans"))):
                turns = read_back(piece)
                loss = "".join(unescape(piece[s["start"] - start : s["end"] - start]) for s in spans)
                rows.append((len(turns), "".join(f"{who}\n{said}\n" for who, said in turns), loss, len(piece)))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("nth"), *arrays], ["conv", "nth", "n", "whole", "loss", "size"])

    def running(batches):
        at, state, done, conv_type = (), None, [], None

        def flush():
            names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done), kinds)], names)

        def end():
            done.append((at[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for own, n, whole, loss, size in zip(*(batch.column(c).to_pylist() for c in ("conv", "n", "whole", "loss", "size"))):
                if at != (own,):
                    if at:
                        end()
                    if len(done) >= 10_000:
                        yield flush()
                        done = []
                    at, state = (own,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(whole.encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += size
        if at:
            end()
            yield flush()

    read = pieces.mapInArrow(back, f"conv {key}, nth bigint, n bigint, whole string, loss string, size bigint")
    dealt = read.repartition("conv").sortWithinPartitions("conv", "nth")
    return dealt.mapInArrow(running, f"conv {key}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: str = TEMPLATE
) -> DataFrame:
    """``conv, formatted, spans``: the rendered conversation and the (start, end) code
    points under the loss mask."""
    picked = _picked(turns, conv, turn, role, text)
    schema = f"conv {picked.schema['conv'].dataType.simpleString()}, formatted string, spans array<struct<start:bigint,end:bigint>>"
    def run(batches):
        render = compile_template(template, FILTERS)
        conv_type, at, messages, done, size = None, None, [], [], 0

        def flush():
            keys, texts, marks = zip(*done)
            spans = [[{"start": a, "end": b} for a, b in m] for m in marks]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, conv_type), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv", "formatted", "spans"]
            )

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            columns = (batch.column(n).to_pylist() for n in ("conv", "role", "text"))
            for key, who, said in zip(*columns):
                if messages and key != at:
                    done.append((at, *render({"messages": messages})))
                    size += len(done[-1][1])
                    messages = []
                    if size > 4 << 20:
                        yield flush()
                        done, size = [], 0
                at = key
                messages.append({"role": who, "text": said})
        if messages:
            done.append((at, *render({"messages": messages})))
        if done:
            yield flush()

    dealt = picked.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.select("conv", "role", "text").mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from the rendered texts: ``conv, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars``."""
    conv_type = formatted.schema["conv"].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist()):
                turns = read_back(text)
                whole = hashlib.sha256()
                for who, said in turns:
                    whole.update(f"{who}\n{said}\n".encode())
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *arrays], names)

    return formatted.mapInArrow(
        run, f"conv {conv_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
