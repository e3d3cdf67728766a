"""Personal data, and the terms that give it away, taken out of texts.

Protected entities are the values (by kind, written alike) of four patterns: e-mail
addresses, IP addresses, card numbers and phone numbers. The corpus then tells which terms
reveal them, by the pointwise mutual information of a term t and an entity e:

    PMI(t; e) = log2(N * together(t, e) / (documents(t) * documents(e)))

where ``together`` counts documents with t among the ``AROUND`` words to either side of e,
and a document counts as often as it is there. Of e's information, log2(N / documents(e)), a
reader of t still lacks -log2(together / documents(t)) bits. A term is disclosing if it gives
at least ``gain`` bits of some entity and leaves at most ``left`` bits of it. What one text alone shows
proves nothing, so ``support`` different texts are asked for; copies of a text are one.

A disclosing term is generalised to the class of all terms with its first ``STEM`` code points,
where that class, counted alike, isn't disclosing itself; else it is removed. Both hold
wherever the term occurs.

Only terms with enough support are counted over the corpus: they are put in a Bloom filter
of bounded size, which is broadcast; what passes is joined exactly. The same holds for the
disclosing terms and their places. So nothing is broadcast that grows without bound, and no document is
shuffled for its text.

Terms are runs of letters and digits, lower-cased (A-Z), known by 64-bit hashes. Null text
is empty; rows with the same key and text share a result, which each of them gets. Texts
may be of any length. An empty table gives an empty result. Other columns are kept by ``sanitise``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm import words
from gridpanel.sources.scratch import landed

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
AROUND = 8
STEM = 3
SUPPORT = 2
GAIN = 3.0
LEFT = 1.0
MAX_BITS = 1 << 28  # of a Bloom filter: 32 MB
PIECE = 1 << 18  # bits of a filter that a row holds
PROBES = 4
HELD = 1 << 18
CLASS = words.U64(0x5851F42D4C957F2D)

# Possessive, and from the first digit of a run on: the same matches as without, in linear time.
DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = bytes(c for c in range(256) if not 0x30 <= c <= 0x39)
LOCAL = np.zeros(256, bool)
LOCAL[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"]] = True

SPAN = "struct<kind:string,start:bigint,end:bigint>"


def luhn(digits: bytes) -> bool:
    own = [d - 48 for d in digits]
    return (sum(own[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in own[-2::-2])) % 10 == 0


def _emails(data: bytes, local: np.ndarray, signs: np.ndarray) -> list[tuple[int, int]]:
    """``local`` is where the run of bytes before an address's sign begins."""
    out, last = [], 0
    for at, begin in zip(signs.tolist(), local.tolist()):
        begin = max(begin, last)
        if begin < at and (found := DOMAIN.match(data, at + 1)):
            out.append((begin, found.end()))
            last = found.end()
    return out


def base_spans(joined: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(start, kind number, end, value) in texts end to end with a zero byte behind each, in order."""
    data = joined.tobytes()
    signs = np.flatnonzero(joined == 0x40)
    out = []
    if len(signs):
        outside = np.concatenate([[-1], np.flatnonzero(~LOCAL[joined])])
        local = outside[np.searchsorted(outside, signs) - 1] + 1
        out += [(a, 0, b, data[a:b].lower()) for a, b in _emails(data, local, signs)]
    for m in IP.finditer(data):
        if all(len(p) < 4 or not p[:-3].strip(b"0") for p in m.groups()) and all(int(p[-3:]) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end(), m[0]))
    for m in CARD.finditer(data):
        digits = m[0].translate(None, NO_DIGIT)
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), digits))
    for m in PHONE.finditer(data):
        digits = m[0].translate(None, NO_DIGIT)
        if 10 <= len(digits) <= 15:
            out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


class _Texts:
    """A slice of texts: their bytes with a zero behind each and base spans; ``split`` adds
    words, their hashes and those of their classes."""

    def __init__(self, texts: pa.Array):
        data, offsets = words.flat(texts)
        n = len(offsets) - 1
        self.begin = offsets + np.arange(n + 1)
        joined = np.zeros(len(data) + n, np.uint8)
        joined[words.runs(self.begin[:-1], np.diff(offsets))] = data
        self.joined, self.spans = joined, base_spans(joined)
        self.row_of_span = np.searchsorted(self.begin, np.array([s[0] for s in self.spans], np.int64), side="right") - 1
        points = (joined & 0xC0) != 0x80
        self._lead = np.concatenate([[0], np.cumsum(points)])

    def split(self) -> _Texts:
        joined, lead = self.joined, self._lead
        lowered = words.LOWER[joined]
        self.starts, self.ends, self.rows = words.spans(lowered, self.begin, words.ALNUM)
        self.hashes = words.word_hashes(lowered, self.starts, self.ends)
        points = np.append(np.flatnonzero((joined & 0xC0) != 0x80), len(joined))
        stem = points[np.minimum(lead[self.starts] + STEM, len(points) - 1)]
        self.classes = words.word_hashes(lowered, self.starts, np.minimum(stem, self.ends)) ^ CLASS
        return self

    def points(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Places in code points of the row."""
        return self._lead[place] - self._lead[self.begin[row]]

    def plain(self) -> np.ndarray:
        """Which words touch no base span."""
        out = np.ones(len(self.starts), bool)
        for a, _, b, _ in self.spans:
            out[np.searchsorted(self.ends, a, side="right") : np.searchsorted(self.starts, b)] = False
        return out


def _marks(texts: pa.Array) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True) for t in (x or "" for x in texts.to_pylist())]


def contexts(texts: DataFrame, around: int = AROUND) -> DataFrame:
    """``entity, term, mark, n``: terms and classes of terms (``term``) near an entity, by
    the text's hash, and the documents; ``term`` is null for the entity itself."""

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "text"):
                t = _Texts(part.column("text"))
                if not t.spans:
                    continue
                own = part.column("text").take(pa.array(np.unique(t.row_of_span)))
                t = _Texts(own).split()
                plain, mark = t.plain(), _marks(own)
                found: dict[tuple[int, bytes], set] = {}
                for (a, kind, b, value), row in zip(t.spans, t.row_of_span.tolist()):
                    entity = hashlib.blake2b(b"%d:%b" % (kind, value), digest_size=16).digest()
                    before = int(np.searchsorted(t.ends, a, side="right"))
                    behind = int(np.searchsorted(t.starts, b))
                    first, last = max(before - around, int(t.rows[row])), min(behind + around, int(t.rows[row + 1]))
                    near = [i for i in [*range(first, before), *range(behind, last)] if plain[i]]
                    mine = found.setdefault((row, entity), {None})
                    mine.update(t.hashes[near].view(np.int64).tolist(), t.classes[near].view(np.int64).tolist())
                rows = [(e, term, mark[row]) for (row, e), terms in found.items() for term in terms]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                    ["entity", "term", "mark"],
                )

    rows = texts.select("text").mapInArrow(run, "entity binary, term bigint, mark bigint")
    return rows.groupBy("entity", "term", "mark").agg(F.count("*").alias("n"))


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    one = words.mix(hashes)
    step = words.mix(one) | words.U64(1)
    return np.stack([(one + words.U64(i) * step) & words.U64(bits - 1) for i in range(PROBES)])


def bloom(terms: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a column of 64-bit hashes, as bytes: at least 16 bits a value, up to ``MAX_BITS``
    (beyond that it lets more pass, none is lost). Made in pieces; only they meet on the driver."""
    n = terms.count()
    bits = PIECE
    while bits < min(16 * n, MAX_BITS):
        bits *= 2

    def probes(batches):
        for batch in batches:
            at = np.unique(_probes(batch.column(0).to_numpy().view(np.uint64), bits)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // PIECE), pa.array((at % PIECE).astype(np.int32))], ["piece", "at"])

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = np.zeros(PIECE, bool)
        own[table.column("at").to_numpy()] = True
        return pa.table({"piece": [key[0].as_py()], "bytes": pa.array([np.packbits(own).tobytes()], pa.binary())})

    places = terms.select(column).mapInArrow(probes, "piece bigint, at int").distinct()
    pieces = places.groupBy("piece").applyInArrow(build, "piece bigint, bytes binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces:
        out[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = np.frombuffer(r["bytes"], np.uint8)
    return out


def passes(filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _probes(hashes, 8 * len(filter_bytes))
    out = np.ones(len(hashes), bool)
    for probe in at:
        bit = words.U64(7) - (probe & words.U64(7))
        out &= (filter_bytes[(probe >> words.U64(3)).view(np.int64)] >> bit.astype(np.uint8) & 1).astype(bool)
    return out


def _spread(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """``term, documents`` of terms and classes that are ``listed``, and of some others that the
    filter lets pass. A task adds up its own counts before it hands them on."""
    shared = texts.sparkSession.sparkContext.broadcast(bloom(listed, "term"))

    def run(batches):
        seen, held = [], []

        def added() -> tuple[np.ndarray, np.ndarray]:
            held.append(np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            seen.clear()
            term, number = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            n = np.zeros(len(term), np.int64)
            np.add.at(n, number, np.concatenate([c for _, c in held]))
            held[:] = [(term, n)]
            return term, n

        def batch_of(term, n):
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])

        size = 0
        for batch in batches:
            for part in words.slices(batch, "text"):
                t = _Texts(part.column("text")).split()
                plain = t.plain()
                row = np.repeat(np.arange(part.num_rows), np.diff(t.rows))[plain]
                for hashes in (t.hashes[plain], t.classes[plain]):
                    here = passes(shared.value, hashes)
                    order = np.lexsort((hashes[here], row[here]))
                    h, r = hashes[here][order], row[here][order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                    seen.append(h[new])
                    size += len(seen[-1])
                if size > HELD:
                    term, n = added()
                    size = 0
                    if len(term) > HELD:
                        yield batch_of(term, n)
        yield batch_of(*added())

    partial = texts.select("text").mapInArrow(run, "term bigint, n bigint")
    return partial.groupBy("term").agg(F.sum("n").alias("documents"))


def disclosing(texts: DataFrame, support: int = SUPPORT, gain: float = GAIN, left: float = LEFT) -> DataFrame:
    """``entity, term, together, documents, pmi, left``: pairs of an entity and a term, or class of
    terms, that discloses it."""
    near = contexts(texts).groupBy("entity", "term").agg(F.count("*").alias("different"), F.sum("n").alias("together"))
    near = landed(near, "near-entities")
    enough = near.where(F.col("term").isNotNull() & (F.col("different") >= support))
    listed = landed(enough.select("term").distinct(), "near-terms")
    total = texts.count()
    own = near.where(F.col("term").isNull()).select("entity", F.col("together").alias("with_entity"))
    known = enough.join(own, "entity").join(_spread(texts, listed), "term")
    pmi = F.log2(F.lit(float(total)) * F.col("together") / (F.col("documents") * F.col("with_entity")))
    lacks = -F.log2(F.col("together") / F.col("documents"))
    judged = known.select("entity", "term", "together", "documents", pmi.alias("pmi"), lacks.alias("left"))
    return judged.where((F.col("pmi") >= gain) & (F.col("left") <= left))


def _numbered(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", **thresholds: float) -> DataFrame:
    """``key, mark, base, terms``: for each row its text's hash, the spans (kind, start, end) of the patterns by start and kind,
    and those of disclosing terms by start, which also say whether the term's class may stay (``general``). Places are code
    points from 0, the end is the first one behind."""
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    bad = landed(disclosing(texts, **thresholds).groupBy("term").agg(F.max("pmi").alias("pmi")), "disclosing").select("term")
    shared = texts.sparkSession.sparkContext.broadcast(bloom(bad, "term"))
    key_type = texts.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "text"):
                t = _Texts(part.column("text")).split()
                base: list[list] = [[] for _ in range(part.num_rows)]
                a, b = (np.array([s[i] for s in t.spans], np.int64) for i in (0, 2))
                for row, (_, kind, _, _), x, y in zip(t.row_of_span.tolist(), t.spans, t.points(t.row_of_span, a).tolist(), t.points(t.row_of_span, b).tolist()):
                    base[row].append((x, kind, y))
                at = np.flatnonzero(passes(shared.value, t.hashes) & t.plain())
                row = np.searchsorted(t.rows, at, side="right") - 1
                maybe: list[list] = [[] for _ in range(part.num_rows)]
                columns = (t.hashes[at].view(np.int64), t.classes[at].view(np.int64), t.points(row, t.starts[at]), t.points(row, t.ends[at]))
                for r, h, c, x, y in zip(row.tolist(), *(x.tolist() for x in columns)):
                    maybe[r].append({"term": h, "class": c, "start": x, "end": y})
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(_marks(part.column("text")), pa.int64()),
                        pa.array([_numbered(s) for s in base], SPANS),
                        pa.array(maybe, MAYBE),
                    ],
                    ["key", "mark", "base", "maybe"],
                )

    found = landed(texts.mapInArrow(run, f"key {key_type}, mark bigint, base array<{SPAN}>, maybe array<struct<term:bigint,class:bigint,start:bigint,end:bigint>>"), "spans")
    marked = found.where(F.size("maybe") > 0).select("key", "mark", "maybe").distinct()
    places = marked.select("key", "mark", F.explode("maybe").alias("m")).select("key", "mark", "m.*").join(bad, "term")
    general = bad.select(F.col("term").alias("class"), F.lit(False).alias("general"))
    places = places.join(general, "class", "left").withColumn("general", F.coalesce("general", F.lit(True)))
    spans = F.sort_array(F.collect_list(F.struct("start", "end", "general"))).alias("terms")
    gathered = places.groupBy("key", "mark").agg(spans)
    none = F.array().cast("array<struct<start:bigint,end:bigint,general:boolean>>")
    joined = found.drop("maybe").alias("f").join(gathered.alias("g"), F.col("f.key").eqNullSafe(F.col("g.key")) & (F.col("f.mark") == F.col("g.mark")), "left")
    return joined.select("f.key", "f.mark", "f.base", F.coalesce("g.terms", none).alias("terms"))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
MAYBE = pa.list_(pa.struct([("term", pa.int64()), ("class", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def count_of(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans(base: Column, terms: Column) -> Column:
    """Base spans and those of terms by start, base ones first."""
    order = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    named = F.transform(terms, lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    keyed = F.transform(F.concat(base, named), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("turn"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _cleaned(text: str, base: list[dict], terms: list[dict]) -> str:
    cuts = sorted([(s["start"], s["end"], f"<{s['kind']}>") for s in base] + [(s["start"], s["end"], f"{text[s['start']:min(s['start'] + STEM, s['end'])]}*" if s["general"] else "<term>") for s in terms])
    out, last = [], 0
    for start, end, instead in cuts:
        if start >= last:
            out += [text[last:start], instead]
        last = max(last, end)
    return "".join([*out, text[last:]])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **thresholds: float) -> DataFrame:
    """The table with base spans replaced by their kind (of overlapping ones by the first's), disclosing terms by their
    class (``abc*``) or ``<term>``. Rows without any keep their text as it is."""
    found = find(docs, key, text, **thresholds)
    found = found.where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["key", "mark"])

    @F.pandas_udf("string")
    def clean(texts, base, terms):
        import pandas as pd

        return pd.Series([x if b is None else _cleaned(x, list(b), list(t)) for x, b, t in zip(texts, base, terms)])

    @F.pandas_udf("bigint")
    def mark(texts):
        import pandas as pd

        return pd.Series(_marks(pa.array(texts, pa.string())))

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("whole"), F.col(f"`{key}`").alias("own"))
    own = own.withColumn("own_mark", mark("whole"))
    joined = own.join(found, F.col("own").eqNullSafe(F.col("key")) & (F.col("own_mark") == F.col("mark")), "left")
    cleaned = F.when(F.col("base").isNull(), F.col("whole")).otherwise(clean("whole", "base", "terms"))
    return joined.withColumn("cleaned", cleaned).select(*[F.col("cleaned").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
