"""SentencePiece encoding and decoding by a relational lattice.

A text, with one space before it, is cut into units wherever two bytes stand side by side in no
piece; no piece can cross such a place, so units are encoded on their own and each distinct one
once. For the distinct units the lattice is relational: their substrings up to the longest piece
are exploded and equi-joined to the piece table (a fixed file's rows, so the broadcast is bounded),
characters without a piece fall back to their bytes' pieces, edges are grouped by unit, and a
higher-order aggregate folds them by Viterbi to the path with the highest sum of scores. Of equal
sums the longer last piece wins.

Texts are then put together from their units' ids. The most widespread units of up to ``KNOWN_BYTES``
bytes, ``KNOWN`` of them at most, go out as sorted arrays, mostly of about 20 bytes each; a unit
beyond them, or a longer one, reaches its documents by a join.
Decoding turns ids into their pieces' bytes and drops the leading space.

The model file may hold a byte-pair model, whose own library merges pairs in order of rank instead
of seeking the best sum; ids then differ from the library's for some words, while decoding is the
same. The scores are the file's, in either case.

Defined results: null and empty texts have no ids. The sign U+2581 stands for a space and decodes
as one, so ``round_trip`` compares with such a text. Units are told apart by 64-bit hashes; should
two units share one, encoding stops with an error. Repeated rows each get a row; extra columns
are ignored; empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _P, _P_INV, _power, cut, give_back, let, mix, passing, short_batches, text_buffers, tidy, written
from .tokencount import SPACE, model_path

KNOWN = 1 << 22
KNOWN_BYTES = 64
UNITS = 32_000
CHUNK = 1 << 20
SHORT = 40
BATCH = 128
FALLBACK = -1e7


class Vocabulary:
    """Pieces, their scores and bytes, and where texts may be cut."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids = np.uint16 if n <= 1 << 16 else np.uint32
        self.pieces = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.scores = [FALLBACK] * n
        for _, i, score in self.pieces:
            self.scores[i] = float(score)
        self.longest = max(len(p) for p, _, _ in self.pieces)
        if self.longest > 255 or n > 1 << 24:
            raise ValueError("edges hold pieces of up to 255 characters and 2^24 pieces")
        self.first_byte = next(i for i in range(n) if sp.is_byte(i))
        raw = [b""] * n
        for p, i, _ in self.pieces:
            raw[i] = p.replace(SPACE, " ").encode()
        for k in range(256):
            raw[self.first_byte + k] = bytes([k])
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        beside, used = set(), set()
        for p, _, _ in self.pieces:
            p = p.replace(SPACE, " ")
            used |= set(p)
            beside |= set(zip(p, p[1:], strict=False))
        #: Whether a text may be cut between two bytes. Bytes of other than ASCII characters count as side by side with all that is used; see wide for two of them.
        self.safe = np.zeros((256, 256), bool)
        wide = any(ord(a) > 127 for a in used)
        spaced = any(b == " " and a != " " for a, b in beside)
        for a in range(256):
            for b in range(256):
                if a < 128 and b < 128:
                    self.safe[a, b] = (chr(a), chr(b)) not in beside
                elif a < 128 or b < 128:
                    one = chr(min(a, b))
                    self.safe[a, b] = not wide or one not in used or (b == 32 and not spaced)
        #: Neighbours in pieces of which neither is ASCII. Texts may be cut between any others.
        self.wide = np.array(sorted((ord(a) << 21) + ord(b) for a, b in beside if ord(a) > 127 and ord(b) > 127), np.int64)
        self._value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the units of texts that lie end to end."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        cut = np.zeros(n + 1, bool)
        cut[1:-1] = self.safe[data[:-1], data[1:]]
        cut[self._wide_cuts(data)] = True
        cut[bounds] = True
        edges = np.flatnonzero(cut)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self._value[data] * _power("p", _P, n)[:n], dtype=np.uint64, out=total[1:])
        starts, ends = edges[:-1], edges[1:]
        h = (total[ends] - total[starts]) * _power("i", _P_INV, n + 1)[starts]
        return starts, ends, mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def _wide_cuts(self, data: np.ndarray) -> np.ndarray:
        """Where a character that is not ASCII follows another that no piece has before it."""
        lead = np.flatnonzero(data >= 0xC0)
        after = np.flatnonzero(data[lead - 1] >= 0x80) if len(lead) else lead
        after = after[lead[after] > 0]
        if not len(after):
            return after
        d = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
        first = d[lead]
        code = np.where(first < 0xE0, (first & 31) << 6 | d[lead + 1] & 63, np.where(first < 0xF0, (first & 15) << 12 | (d[lead + 1] & 63) << 6 | d[lead + 2] & 63, (first & 7) << 18 | (d[lead + 1] & 63) << 12 | (d[lead + 2] & 63) << 6 | d[lead + 3] & 63))
        pair = (code[after - 1] << 21) + code[after]
        at = np.minimum(np.searchsorted(self.wide, pair), max(0, len(self.wide) - 1))
        known = self.wide[at] == pair if len(self.wide) else np.zeros(len(pair), bool)
        return lead[after[~known]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a text's ids, with the leading space."""
        size = self.sizes[ids]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.bytes[np.repeat(self.starts[ids], size) + step].tobytes()


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _spaced(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("doc_id", F.when(F.length("text") > 0, F.concat(F.lit(" "), F.replace(F.col("text"), F.lit(SPACE), F.lit(" ")))).otherwise("").alias("t"), *more)


def distinct_units(docs: DataFrame, path: str) -> DataFrame:
    """unit and tasks (how many tasks saw it) of every distinct unit."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = vocabulary(path), np.zeros(0, np.uint64)
        for batch in cut(batches, BATCH):
            for _, _, data, bounds in text_buffers(batch.column(0), CHUNK):
                starts, ends, h = own.units(data, bounds)
                h, first = np.unique(h, return_index=True)
                if len(seen):
                    new = seen[np.minimum(np.searchsorted(seen, h), len(seen) - 1)] != h
                    h, first = h[new], first[new]
                if len(seen) > 1 << 20:  # bounded; a unit may be reported again
                    seen = np.zeros(0, np.uint64)
                seen = np.sort(np.concatenate((seen, h)))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.string())], names=["unit"])

    return _spaced(docs).select("t").mapInArrow(run, "unit string").groupBy("unit").agg(F.count(F.lit(1)).alias("tasks"))


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(p.replace(SPACE, " "), i) for p, i, _ in vocabulary(path).pieces], "piece string, id int")


def lattice(units: DataFrame, path: str) -> DataFrame:
    """unit, tasks and edges, sorted longs of end, len and piece id (0 where a character falls back to its bytes)."""
    own = vocabulary(path)
    n = F.length("unit")
    starts = units.select("unit", "tasks", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    sub = starts.select("unit", "tasks", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(own.longest), n - F.col("s") + 1))).alias("len"))
    sub = sub.select("unit", "tasks", "s", "len", F.substr("unit", F.col("s"), F.col("len")).alias("piece"))
    table = F.broadcast(piece_table(units.sparkSession, path))  # the rows of one fixed file
    met = sub.join(table, "piece", "left").where("id is not null or len = 1")
    edge = F.shiftleft((F.col("s") + F.col("len") - 1).cast("long"), 32) + F.shiftleft(F.col("len").cast("long"), 24) + F.coalesce("id", F.lit(0))
    return met.select("unit", "tasks", edge.alias("e")).groupBy("unit", "tasks").agg(F.sort_array(F.collect_list("e")).alias("edges"))


def _end(e: Column) -> Column:
    return F.shiftright(e, 32).cast("int")


def _len(e: Column) -> Column:
    return F.shiftright(e, 24).bitwiseAND(F.lit(255)).cast("int")


def _id(e: Column) -> Column:
    return e.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")


def viterbi(unit: Column, edges: Column, own: Vocabulary) -> Column:
    """The ids along the best path.

    Units of up to SHORT characters go end by end, over the edges that stop there. Longer ones go
    edge by edge in order of ends, with the scores of the last ``longest`` ends at hand, so that
    the work grows with the edges.
    """
    scores = F.split(F.lit(",".join(map(repr, own.scores))), ",").cast("array<double>")
    # bound once, so that the plan, which the driver keeps as text too, holds the table once
    return let(scores, lambda table: _best_path(unit, edges, own, table))


def _best_path(unit: Column, edges: Column, own: Vocabulary, table: Column) -> Column:
    start = F.struct(F.lit(1).alias("end"), F.array(F.lit(0.0)).alias("near"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("bigint").alias("by"), F.array().cast("array<bigint>").alias("out"))

    def closed(a: Column) -> Column:
        near = F.concat(a["near"], F.array(a["best"]))
        near = F.when(F.size(near) > own.longest, F.slice(near, F.lit(2), F.lit(own.longest))).otherwise(near)
        return F.struct(near.alias("near"), F.concat(a["out"], F.array(a["by"])).alias("out"))

    def step(a: Column, x: Column) -> Column:
        moved = _end(x) > a["end"]

        def put(c: Column) -> Column:
            score = F.element_at(c["near"], -_len(x)) + table[_id(x)]
            better = moved | a["best"].isNull() | (score >= a["best"])
            return F.struct(_end(x).alias("end"), c["near"].alias("near"), F.when(better, score).otherwise(a["best"]).alias("best"), F.when(better, x).otherwise(a["by"]).alias("by"), c["out"].alias("out"))

        return let(F.when(moved, closed(a)).otherwise(F.struct(a["near"].alias("near"), a["out"].alias("out"))), put)

    def end_by_end(a: Column, e: Column) -> Column:
        here = F.filter(edges, lambda x: F.shiftright(x, 32) == e)
        best = F.array_max(F.transform(here, lambda x: F.struct((a["near"][e.cast("int") - _len(x)] + table[_id(x)]).alias("s"), x.alias("x"))))
        return let(best, lambda b: F.struct(F.concat(a["near"], F.array(b["s"])).alias("near"), F.concat(a["out"], F.array(b["x"])).alias("out")))

    ends = F.sequence(F.lit(1).cast("long"), F.length(unit).cast("long"))
    short = F.aggregate(ends, F.struct(F.array(F.lit(0.0)).alias("near"), F.array().cast("array<bigint>").alias("out")), end_by_end, lambda a: a["out"])
    steps = F.when(F.length(unit) <= SHORT, short).otherwise(F.aggregate(edges, start, step, lambda a: F.concat(a["out"], F.array(a["by"]))))

    def one(a: Column, x: Column) -> Column:
        here = a["at"].isNull() | (a["at"] == _end(x))
        return F.struct(F.when(here, _end(x) - _len(x)).otherwise(a["at"]).alias("at"), F.when(here, F.concat(F.array(x), a["path"])).otherwise(a["path"]).alias("path"))

    back = F.struct(F.lit(None).cast("int").alias("at"), F.array().cast("array<bigint>").alias("path"))
    path = F.aggregate(F.reverse(steps), back, one, lambda a: a["path"])

    def spelt(x: Column) -> Column:
        hexed = F.hex(F.encode(F.substr(unit, _end(x), F.lit(1)), "utf-8"))
        return F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda k: F.conv(F.substr(hexed, k, F.lit(2)), 16, 10).cast("int") + own.first_byte)

    return let(path, lambda p: F.when(F.exists(p, lambda x: _id(x) == 0), F.flatten(F.transform(p, lambda x: F.when(_id(x) == 0, spelt(x)).otherwise(F.array(_id(x)))))).otherwise(F.transform(p, _id)))


def encode_units(docs: DataFrame, path: str) -> DataFrame:
    """unit, ids and tasks of every distinct unit of the documents, written to the shared folder."""
    own, units = vocabulary(path), written(distinct_units(docs, path))
    # few units a task, as the grouping sorts all their edges at once
    units = units.repartition(max(1, -(-units.count() // UNITS)), "unit")
    return written(lattice(units, path).select("unit", "tasks", let(F.col("edges"), lambda e: viterbi(F.col("unit"), e, own)).alias("ids")))


class Known:
    """Units' hashes, sorted, and their ids end to end."""

    def __init__(self, h: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        first = np.cumsum(size, dtype=np.uint32) - size
        order = np.argsort(h).astype(np.uint32)
        self.h, self.size, self.first, self.ids = h[order], size[order], first[order], ids
        if (self.h[1:] == self.h[:-1]).any():
            raise ValueError("two units share a hash")

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes, and whether they are there."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        distinct, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.h, distinct), len(self.h) - 1)
        return at[back], (self.h[at] == distinct)[back]

    def gather(self, at: np.ndarray) -> np.ndarray:
        size = self.size[at].astype(np.int64)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.ids[np.repeat(self.first[at].astype(np.int64), size) + step]


def _packed(rows: DataFrame, path: str) -> Known:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            h = np.concatenate([own.units(data, bounds)[2] for _, _, data, bounds in text_buffers(batch.column(0), CHUNK)])
            ids = batch.column(1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (h, np.diff(ids.offsets.to_numpy()).astype(np.uint32), ids.flatten().to_numpy().astype(own.ids))], names=["h", "size", "ids"])

    kinds = np.uint64, np.uint32, vocabulary(path).ids
    # at most KNOWN units of KNOWN_BYTES bytes, a partition at a time
    with short_batches(rows.sparkSession):
        parts = [[np.frombuffer(x, t) for x, t in zip(r, kinds, strict=True)] for r in rows.select("unit", "ids").mapInArrow(run, "h binary, size binary, ids binary").toLocalIterator()]
    give_back()
    h, size, ids = (np.concatenate([p.pop(0) for p in parts]) if parts else np.zeros(0, t) for t in kinds)
    return Known(h, size, ids)


def _common(units: DataFrame, known: int) -> tuple[DataFrame, bool]:
    """The most widespread units of at most KNOWN_BYTES bytes, ``known`` at most, and whether others are left."""
    short = F.octet_length("unit") <= KNOWN_BYTES
    counts = units.groupBy(F.when(short, F.col("tasks")).alias("tasks")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each number of tasks
    total, least = 0, None
    for r in sorted((r for r in counts if r.tasks is not None), key=lambda r: -r.tasks):
        if total + r.n > known:
            break
        total, least = total + r.n, r.tasks
    return units.where(short & (F.col("tasks") >= least) if least else F.lit(False)), sum(r.n for r in counts) > total


def _missing(docs: DataFrame, path: str, sent) -> DataFrame:
    """key and unit of the units of each document that are not among the known."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for at, rows, data, bounds in text_buffers(batch.column(0), CHUNK):
                starts, ends, h = own.units(data, bounds)
                gone, raw = np.flatnonzero(~sent.value.find(h)[1]), data.tobytes()
                key = keys[at : at + rows][np.searchsorted(bounds, starts[gone], side="right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([raw[a:b].decode() for a, b in zip(starts[gone].tolist(), ends[gone].tolist(), strict=True)], pa.string())], names=["key", "unit"])

    return docs.select("t", "key").mapInArrow(run, "key long, unit string").distinct()


def _encoded(docs: DataFrame, path: str, known: int | None, finish: Callable, schema: str) -> DataFrame:
    """What finish(vocabulary, doc_ids, texts as encoded, ids of each) gives for every batch; one Python stage from text to result."""
    spark, known = docs.sparkSession, KNOWN if known is None else known
    docs = docs.select("doc_id", "text")
    units = encode_units(docs, path)
    common, rare = _common(units, known)
    sent = spark.sparkContext.broadcast(_packed(common, path))
    rows = _spaced(docs, F.xxhash64("text").alias("key"))
    if rare:
        rest = _missing(rows, path, sent).join(units, "unit").groupBy("key").agg(F.collect_list("unit").alias("hs"), F.collect_list("ids").alias("lists"))
        rows = rows.join(rest.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left").select("doc_id", "t", "key", "hs", "lists")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in cut(batches, BATCH):
            texts, out = batch.column(1), []
            for at, n, data, bounds in text_buffers(texts, CHUNK):
                starts, ends, h = own.units(data, bounds)
                place, there = sent.value.find(h)
                row = np.searchsorted(bounds, starts, side="right") - 1
                if there.all():
                    ids = sent.value.gather(place)
                    size = np.bincount(row, weights=sent.value.size[place], minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
                    out += np.split(ids, np.cumsum(size)[:-1])
                    continue
                raw = data.tobytes()
                for k in range(n):  # some units came by the join
                    mine = np.flatnonzero(row == k)
                    extra = dict(zip(batch.column(3)[at + k].as_py() or (), batch.column(4)[at + k].as_py() or (), strict=True))
                    part = [sent.value.ids[int(sent.value.first[p]) : int(sent.value.first[p]) + int(sent.value.size[p])] if ok else extra[raw[a:b].decode()] for p, ok, a, b in zip(place[mine], there[mine], starts[mine].tolist(), ends[mine].tolist(), strict=True)]
                    out.append(np.concatenate([np.asarray(p, own.ids) for p in part]) if part else np.zeros(0, own.ids))
            yield finish(own, batch.column(0), texts, out)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, known: int | None = None) -> DataFrame:
    """doc_id, t (the text as encoded) and ids of every document."""
    def finish(_: Vocabulary, doc: pa.Array, texts: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([doc, texts, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "t", "ids"])

    return _encoded(docs, path or model_path(), known, finish, "doc_id long, t string, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of ids."""
    path = path or model_path()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            texts = [own.decode(x.values.to_numpy().astype(np.int64))[1:].decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, path: str | None = None, known: int | None = None) -> DataFrame:
    """Digests of every document's ids, and whether decoding them gives the text again."""
    def finish(own: Vocabulary, doc: pa.Array, texts: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        raw = [x.as_buffer().to_pybytes() if len(x.as_buffer()) else b"" for x in texts]
        same = [own.decode(x.astype(np.int64)) == t for x, t in zip(ids, raw, strict=True)]
        sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        return pa.RecordBatch.from_arrays([doc, pa.array([max(0, len(t) - 1) for t in raw], pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_bytes", "n_pieces", "ids_crc32", "round_trip"])

    with passing(docs.sparkSession) as lasting:
        return lasting(_encoded(docs, path or model_path(), known, finish, "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, round_trip boolean"))
