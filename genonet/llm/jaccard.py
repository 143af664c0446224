"""N-gram Jaccard join: near duplicates by shared word shingles, exact, with their components.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Two documents link
when 100 * |A & B| >= 75 * |A | B|. The steps, none of which gathers a group in one task:

1. Shingles are ranked in one fixed order, rare first as far as a sketch of ``SKETCH`` counters
   can tell. The order bears on speed only.
2. Equal sets form a class; its smallest doc_id stands for it from here on.
3. Linked sets share a shingle among the first |A| - ceil(0.75 |A|) + 1 of each (the prefix).
   First only a few shingles of each prefix are looked at: within a size band, each document
   is paired with one leader of the shingle, and the pairs that pass exact intersection give
   first components. That joins groups of copies along stars, not by all pairs.
4. Whole prefixes then show which shingles stand in several components. Mostly these are passages
   that otherwise different documents share, so the order is refined: a bitmap of those shingles
   moves them behind all others, and the prefixes they stood in are made anew. Only shingles new
   in some prefix, or moved and still in one, can now hide a link. Their documents meet in
   size-banded tiles, split further where a shingle is common;
   pairs of different components are bounded there by hashed bitmap signatures: bits that only
   one side has count shingles that only one side has, which bounds the overlap from above.
   Before that, stars along these shingles join what they can, so that the tiles mostly hold
   documents that only share passages.
5. What the bound lets pass is checked by exact sorted-array intersection; all links found give
   the components.

Documents whose sets are needed for step 5 are picked by a bitmap of their ids of ``ID_BITS`` bits,
so what goes to the driver and back is bounded; a bit set by another id costs time only.

Defined results: null or empty text has an empty set, links with nothing and is its own
component. Texts of one to four words have one shingle, the whole sequence. Rows that repeat a
doc_id count as documents with that id; where their texts differ, the id links what each links. A null doc_id gets n_shingles and a null component.
Extra columns are ignored by near_duplicates() and passed through by keep_one().
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_words, mix, passing, short_batches, shuffles_dropped, text_buffers, tidy, written

WORDS = 5
SKETCH = 1 << 16
KEYS = 4
TILE = 256
SMALL = 4
TILE_ROWS = 2048
LISTED = 256
FORESTS = 1
CHUNK = 1 << 20
BATCH = 256
ID_BITS = 1 << 26
MAX_BITS = 1 << 13
#: Pairs for a row of a chunk of a tile, over which the last pass takes wide bitmaps; their bits for a shingle, and at most.
CROWDED, WIDE, WIDEST = 32, 16, 1 << 17

_Q = [np.uint64(q) for q in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
SIGS = "doc_id long, n long, d1 long, d2 long, keys array<long>, prefix array<long>, bits binary"


def flat_sets(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct shingle hashes of texts end to end, text k's at at[k]:at[k+1], for one run of texts after the other."""
    for _, rows, data, bounds in text_buffers(column, CHUNK):
        _, _, h, text = hash_words(data, bounds, alnum=False)
        size = np.bincount(text, minlength=rows)
        first = np.cumsum(size) - size
        m = max(len(h) - WORDS + 1, 0)
        s = np.zeros(len(h), np.uint64)
        for k, q in enumerate(_Q):
            s[:m] += h[k : k + m] * q
        s = mix(s)
        for k in np.flatnonzero((size > 0) & (size < WORDS)).tolist():
            own = h[first[k] : first[k] + size[k]]
            s[first[k]] = mix(np.array([sum(int(x) * int(q) for x, q in zip(own, _Q, strict=False)) + len(own) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
        count = np.where(size < WORDS, np.minimum(size, 1), size - WORDS + 1)  # the words behind start no shingle
        _sort_each(s, first, first + count)
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        new[first[size > 0]] = True
        new &= _places(size) < np.repeat(count, size)
        yield s[new], np.concatenate(([0], np.cumsum(np.bincount(text[new], minlength=rows))))


def _sort_each(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        s[a:b].sort()


def _places(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of lists that lie end to end."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def shingle_sets(column) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for s, at in flat_sets(column):
        bounds = at.tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield s[a:b]


def _sketch(docs: DataFrame) -> np.ndarray:
    """The rank of every counter: of how many shingles it holds, fewest first."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SKETCH, np.int64)
        for batch in cut(batches, BATCH):
            for s, _ in flat_sets(batch.column(0)):
                count += np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["b", "n"])

    with short_batches(docs.sparkSession):
        rows = docs.select("text").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()  # SKETCH rows at most
    count = np.zeros(SKETCH, np.int64)
    for b, n in rows:
        count[b] = n
    rank = np.empty(SKETCH, np.uint64)
    rank[np.lexsort((np.arange(SKETCH), count))] = np.arange(SKETCH, dtype=np.uint64)
    return rank


def ordered(s: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Renames shingles one to one so that their numbers follow the order, and sorts each text's."""
    out = (rank[(s & np.uint64(SKETCH - 1)).astype(np.int64)] << np.uint64(48)) | (s >> np.uint64(16))
    _sort_each(out, at[:-1], at[1:])
    return out


def signatures(mixed: np.ndarray, at: np.ndarray, per: int = 2, most: int = MAX_BITS) -> pa.Array:
    """For each text a bitmap of about ``per`` bits for each shingle, a power of two wide; mixed: mix() of the shingles."""
    size = np.diff(at)
    width = np.clip(1 << np.frexp(np.maximum(per * size - 1, 0))[1].astype(np.int64), 64, most) * (size > 0)
    to = np.cumsum(width)
    bits = np.zeros(width.sum(), np.uint8)
    bits[(mixed & np.repeat(width - 1, size).astype(np.uint64)).astype(np.int64) + np.repeat(to - width, size)] = 1
    offsets = np.concatenate(([0], to // 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(bits, bitorder="little"))])


def signature(s: np.ndarray, per: int = 2, most: int = MAX_BITS) -> bytes:
    """The bitmap of one set."""
    return signatures(mix(s), np.array([0, len(s)]), per, most)[0].as_py()


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat.view(np.int64)))


def _prefix(n: np.ndarray) -> np.ndarray:
    """How many shingles of a set of n make up its prefix."""
    return (n - (3 * n + 3) // 4 + 1) * (n > 0)


def _signatures(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rank)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, BATCH):
            row = 0
            for s, at in flat_sets(batch.column(1)):
                s, size = ordered(s, at, sent.value), np.diff(at)
                mixed, some = mix(s), size > 0
                d1, d2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                if some.any():
                    d1[some] = np.add.reduceat(mixed, at[:-1][some])
                    d2[some] = np.bitwise_xor.reduceat(mix(s * _Q[1]), at[:-1][some])
                place, prefix = _places(size), _prefix(size)
                keys = np.minimum(prefix, KEYS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(size)), pa.array(size, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                        _lists(s[place < np.repeat(keys, size)], keys), _lists(s[place < np.repeat(prefix, size)], prefix), signatures(mixed, at),
                    ],
                    names=["doc_id", "n", "d1", "d2", "keys", "prefix", "bits"],
                )
                row += len(size)

    return docs.select("doc_id", "text").mapInArrow(run, SIGS)


def _band(n: Column) -> Column:
    """Size band: sizes that differ by a factor of 4/3 at most lie in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(4.0 / 3)) + 1e-9).cast("int")


def _comparable(a: Column, b: Column) -> Column:
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


class Bitmap:
    """ID_BITS bits in words of 64. Broadcasts lie as files on the driver and every executor, and most bits are 0: it is pickled compressed."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def __reduce__(self) -> tuple:
        return _unpacked, (zlib.compress(self.words.tobytes(), 1),)

    def has(self, bits: np.ndarray) -> np.ndarray:
        return ((self.words[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _unpacked(data: bytes) -> Bitmap:
    return Bitmap(np.frombuffer(zlib.decompress(data), np.uint64))


def _bitmap(bits: DataFrame) -> Bitmap:
    """ID_BITS bits, of which those numbered in column ``bit`` are set."""
    words = bits.select(F.shiftright("bit", 6).alias("w"), F.col("bit").bitwiseAND(F.lit(63)).cast("int").alias("k"))
    rows = words.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, k))").alias("m")).toArrow()  # ID_BITS / 64 rows at most
    out = np.zeros(ID_BITS // 64, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    return Bitmap(out.view(np.uint64))


def _id_bit(c: str) -> Column:
    return F.xxhash64(c).bitwiseAND(F.lit(ID_BITS - 1)).alias("bit")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small):
        return 0
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())


def _texts(docs: DataFrame, ids: DataFrame, names: list[str], then: Callable | None = None, schema: str = "") -> DataFrame:
    """Ids (named like the column of ``ids``) and texts of the documents whose ids' bits are set: those of ``ids``, and few others. then: what to make of them in the same task."""
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(ids.select(_id_bit(names[0]))))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = pa.array(sent.value.has(batch.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(here), batch.column(1).filter(here)], names=names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from then(picked(batches)) if then else picked(batches)

    return docs.where("doc_id is not null").select("doc_id", "text", _id_bit("doc_id")).mapInArrow(run, schema or f"{names[0]} long, {names[1]} string")


def _links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents that link, by exact intersection of their whole sets.

    Texts travel, not sets: they are smaller, and hashing them again is cheap.
    """
    pairs = written(pairs)
    both = pairs.join(_texts(docs, pairs, ["b", "tb"]), "b").join(_texts(docs, pairs, ["a", "ta"]), "a")

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, BATCH):
            _, first, back = np.unique(batch.column(3).to_numpy(), return_index=True, return_inverse=True)
            # a document that stands for many is hashed once a batch; rows that repeat an id may differ in text
            tb = batch.column(1)
            lead = list(shingle_sets(tb.take(pa.array(first))))
            same = tb.equals(tb.take(pa.array(first[back])))
            right = [lead[k] for k in back] if same else list(shingle_sets(tb))
            common, union = np.zeros(len(back), np.int64), np.zeros(len(back), np.int64)
            for k, (x, y) in enumerate(zip(shingle_sets(batch.column(2)), right, strict=True)):
                common[k] = _common(x, y)
                union[k] = len(x) + len(y) - common[k]
            fine = pa.array((100 * common >= 75 * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fine), batch.column(3).filter(fine)], names=["a", "b"])

    return written(both.select("a", "tb", "ta", "b").mapInArrow(meet, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node reachable, of every node of the links (a, b). Labels and labels' labels until nothing changes."""
    with passing(links.sparkSession) as lasting:
        edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct())
        labels = written(edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("comp")).withColumnRenamed("u", "node"))
        while True:
            near = edges.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("other"))
            step = labels.join(near, labels.node == near.u).select("node", "comp", F.least("comp", "other").alias("new"))
            root = labels.select(F.col("node").alias("r"), F.col("comp").alias("rc"))
            step = written(step.join(root, F.col("new") == F.col("r"), "left").select("node", "comp", F.least("new", F.coalesce("rc", "new")).alias("new")))
            labels = step.select("node", F.col("new").alias("comp"))
            if step.where("new <> comp").isEmpty():
                return lasting(labels)


def _first_pairs(reps: DataFrame) -> DataFrame:
    """Each document with one leader for each of its first shingles, within a size band."""
    keyed = reps.select("doc_id", "n", _band(F.col("n")).alias("band"), F.explode("keys").alias("k"))
    leaders = keyed.groupBy("k", "band").agg(F.min(F.struct("n", "doc_id")).alias("l"), F.count(F.lit(1)).alias("m")).where("m > 1").select("k", "band", F.col("l.doc_id").alias("b"), F.col("l.n").alias("bn"))
    pairs = keyed.join(written(leaders), ["k", "band"]).where((F.col("doc_id") != F.col("b")) & _comparable(F.col("n"), F.col("bn")))
    return pairs.select(F.col("doc_id").alias("a"), "b").distinct()


def _bound_pairs(group: np.ndarray, doc: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: list[bytes], side: np.ndarray, main: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one tile that may link: another component, comparable sizes, and an overlap that the bitmaps allow.

    Rows come tile by tile (group numbers the tiles), by width of their bitmaps within a tile.
    side: 3 throughout in a tile of one chunk, else 1 or 2 by chunk, and a pair has one row of each.
    main: whether the row is of the tile's own band; a pair has one such row at least.
    Returns the rows of each pair, and the highest similarity that the bitmaps allow (1 where there are none).
    """
    none = np.zeros(0, np.int64)
    if not len(group):
        return none, none, none.astype(float)
    last = np.searchsorted(group, group, side="right")
    ahead = last - np.arange(len(group)) - 1
    i = np.repeat(np.arange(len(group)), ahead)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
    fine = (comp[i] != comp[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & (main[i] | main[j]) & ((side[i] == 3) | (side[i] != side[j]))
    i, j = i[fine], j[fine]
    bare = np.array([b is None for b in bits])  # rows of small tiles, whose bitmaps come later
    loose = bare[i]
    li, lj, i, j = i[loose], j[loose], i[~loose], j[~loose]
    width = np.array([0 if b is None else len(b) // 8 for b in bits])
    swap = width[i] > width[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    most = np.zeros(len(i), np.int64)
    slot = np.zeros(len(bits), np.int64)
    maps = {}
    narrowest = width[~bare].min(initial=1 << 30)
    for w in np.unique(width[~bare]).tolist():
        at = np.flatnonzero(width == w)
        slot[at] = np.arange(len(at))
        m, narrow = np.frombuffer(b"".join(bits[x] for x in at), np.uint64).reshape(len(at), w), w
        maps[w, w] = m
        while narrow > narrowest:  # a wide bitmap folds to the narrow one of the same set
            narrow //= 2
            m = m[:, :narrow] | m[:, narrow:]
            maps[w, narrow] = m
    for w, wide in np.unique(np.stack((width[i], width[j]), axis=1), axis=0).tolist() if len(i) else ():
        of = np.flatnonzero((width[i] == w) & (width[j] == wide))
        for at in np.array_split(of, max(1, len(of) * w // 1_000_000)):
            a, b = maps[w, w][slot[i[at]]], maps[wide, w][slot[j[at]]]
            most[at] = np.minimum(n[i[at]] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), n[j[at]] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
    both = n[i] + n[j]
    keep = 7 * most >= 3 * both
    i, j, most = i[keep], j[keep], most[keep]
    return np.concatenate((li, i)), np.concatenate((lj, j)), np.concatenate((np.ones(len(li)), most / np.maximum(both[keep] - most, 1)))


def forest(group: np.ndarray, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> list[int]:
    """Of pairs (a, b) of components, those that a spanning forest of each group takes, lowest rank first."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    best = np.lexsort((rank, high, low, group))
    g, x, y = group[best], low[best], high[best]
    best = best[np.concatenate(([True], (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))] if len(best) else best
    best = best[np.lexsort((rank[best], group[best]))]
    up: dict[tuple[int, int], tuple[int, int]] = {}

    def top(x: tuple[int, int]) -> tuple[int, int]:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for k, g, x, y in zip(best.tolist(), group[best].tolist(), a[best].tolist(), b[best].tolist(), strict=True):
        x, y = top((g, x)), top((g, y))
        if x != y:
            up[x] = y
            out.append(k)
    return out


def _each(lists: pa.ListArray) -> list[np.ndarray | None]:
    """The values of each list; None for null."""
    flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
    return [flat[a:b] if there else None for a, b, there in zip(bounds[:-1], bounds[1:], lists.is_valid().to_pylist(), strict=True)]


def _distinct(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distinct pairs (the smaller first), in order."""
    pairs = np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate((np.ones(min(len(pairs), 1), bool), (pairs[1:] != pairs[:-1]).any(1)))]


def _owned(i: np.ndarray, j: np.ndarray, k: np.ndarray, keys: list[np.ndarray | None]) -> np.ndarray:
    """Whether the tile's shingle is the smallest that both rows stand under; unknown (too many to send) counts as yes."""
    sets: dict[int, frozenset | None] = {}

    def below(x: int) -> frozenset | None:
        if x not in sets:
            sets[x] = None if keys[x] is None else frozenset(keys[x][keys[x] < k[x]].tolist())
        return sets[x]

    return np.array([(a := below(x)) is None or (b := below(y)) is None or a.isdisjoint(b) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)


def _tile_pairs(postings: DataFrame, bits: DataFrame, trees: int | None = None, wide: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs (a, b) out of the tiles of postings (k, comp, doc_id, n); bits has doc_id and its bitmap.

    A tile is a shingle and a size band, with the next band beside it. Where it has more than
    TILE rows it is cut into chunks by a hash, and each pair of chunks is a tile of its own. Tiles
    are dealt by their keys and stand one after another in a partition, so that small ones share
    a batch. In tiles of more than SMALL rows bitmaps travel with the rows and bound the pairs on
    the spot; pairs of smaller ones, many of which are the same, meet their bitmaps once each.

    trees: hand on no more than a spanning forest of each chunk's components (fewer pairs than
    rows), likeliest pairs first for 0, in another order for each other number. None: every pair,
    out of one tile each, which the documents' lists of shingles decide.

    wide: makes wide bitmaps (doc_id, n, bits) of documents (a). Chunks in which the bitmaps let more than CROWDED pairs a
    row pass hand on none; they come again with wide bitmaps, which the other chunks never carry.
    """
    banded = postings.withColumn("own", _band(F.col("n"))).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    size = written(banded.groupBy("k", "band").agg(
        F.count(F.lit(1)).alias("m"), F.max((F.col("own") == F.col("band")).cast("int")).alias("some"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
    ).where("some = 1 and lo < hi").select("k", "band", "m", F.ceil(F.col("m") / TILE).cast("int").alias("chunks")))
    dealt = written(banded.join(size, ["k", "band"]).select("k", "band", "m", "chunks", "comp", "doc_id", "n", "own"))
    held = bits.select(F.col("doc_id").alias("bit_id"), "bits")
    if trees is None:
        lists = postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("of"), F.sort_array(F.collect_set("k")).alias("ks")).where(F.col("of") <= LISTED)
        held = held.join(lists.select(F.col("doc_id").alias("list_id"), "ks"), F.col("bit_id") == F.col("list_id"), "left").drop("list_id")
    else:
        held = held.withColumn("ks", F.lit(None).cast("array<bigint>"))
    large = dealt.where(F.col("m") > SMALL).join(held, F.col("doc_id") == F.col("bit_id")).drop("bit_id")
    small = dealt.where(F.col("m") <= SMALL).withColumns({"bits": F.lit(None).cast("binary"), "ks": F.lit(None).cast("array<bigint>")})
    dealt = small.unionByName(large).withColumn("c", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1) if trees is None else F.array("c")))
    dealt = dealt.select(
        "k", "band", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), "comp", "doc_id", "n", "bits", "ks",
        F.when(F.col("c") == F.col("o"), 3).when(F.col("c") < F.col("o"), 1).otherwise(2).alias("side"), (F.col("own") == F.col("band")).alias("main"),
    )
    tile = ["k", "band", "c1", "c2"]

    names = ["a", "b", *tile]
    kind = "a long, b long, k long, band int, c1 int, c2 int"

    def pairs(table: pa.Table, tiles: np.ndarray, crowded: bool) -> pa.RecordBatch:
        """Pairs (a, b, nulls) and, where asked for, crowded chunks (nulls, their keys)."""
        group = np.concatenate(([0], np.cumsum((tiles[1:] != tiles[:-1]).any(1)))) if len(tiles) else np.zeros(0, np.int64)
        t = {c: table.column(c).to_numpy() for c in ("doc_id", "comp", "n", "side", "main")}
        i, j, like = _bound_pairs(group, t["doc_id"], t["comp"], t["n"], table.column("bits").to_pylist(), t["side"], t["main"])
        again = np.zeros((0, 4), np.int64)
        if crowded:
            over = np.bincount(group[i], minlength=group[-1] + 1) > CROWDED * np.bincount(group)
            again = tiles[np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))][over]
            free = ~over[group[i]]
            i, j = i[free], j[free]
        if trees is None:
            some = _owned(i, j, tiles[:, 0], _each(table.column("ks").combine_chunks()))
        else:
            low, high = (f(t["doc_id"][i], t["doc_id"][j]) for f in (np.minimum, np.maximum))
            order = mix(low.astype(np.uint64) * _Q[0] + high.astype(np.uint64) * _Q[1] + np.uint64(trees)) >> np.uint64(24)
            likely = np.zeros(len(i), np.int64) if trees else ((1 << 20) * (2 - like)).astype(np.int64)
            some = forest(group[i], t["comp"][i], t["comp"][j], (likely << 40) + order.astype(np.int64))
        found = _distinct(t["doc_id"][i[some]], t["doc_id"][j[some]])
        n, m = len(found), len(again)
        own = [pa.concat_arrays([pa.array(found[:, c], pa.int64()), pa.nulls(m, pa.int64())]) for c in (0, 1)]
        keys = [pa.concat_arrays([pa.nulls(n, x), pa.array(again[:, c], x)]) for c, x in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*own, *keys], names=names)

    def met(rows: DataFrame, crowded: bool) -> DataFrame:
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest = None
            for batch in cut(batches, TILE_ROWS):
                table = pa.Table.from_batches([batch])
                table = table if rest is None else pa.concat_tables([rest, table])
                tiles = np.stack([table.column(c).to_numpy() for c in tile], axis=1)
                whole = int(np.flatnonzero((tiles != tiles[-1]).any(1)).max(initial=-1)) + 1  # the last tile may go on
                rest = table.slice(whole)
                if whole:
                    yield pairs(table.slice(0, whole), tiles[:whole], crowded)
            if rest is not None and rest.num_rows:
                yield pairs(rest, np.stack([rest.column(c).to_numpy() for c in tile], axis=1), crowded)

        return rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, kind)

    if wide is None:
        return _bounded(met(dealt, False).select("a", "b").distinct(), bits)
    first = written(met(dealt, True))
    out = _bounded(first.where("a is not null").select("a", "b").distinct(), bits)
    again = written(first.where("a is null").select(*tile).distinct())
    if again.isEmpty():
        return out
    rows = written(dealt.join(again, tile, "left_semi").drop("bits"))
    maps = written(wide(rows.select(F.col("doc_id").alias("a")).distinct()))
    rows = rows.join(maps.select(F.col("doc_id").alias("bit_id"), "bits"), F.col("doc_id") == F.col("bit_id")).select(*dealt.columns)
    return out.unionByName(_bounded(met(rows, False).select("a", "b").distinct(), maps)).distinct()


def _bounded(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs whose bitmaps allow a link."""
    for s in "ab":
        pairs = pairs.join(bits.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits{s}")), s)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            both = lambda x, y: np.stack((np.asarray(x), np.asarray(y)), axis=1).ravel()
            m = batch.num_rows
            maps = [b for pair in zip(t["bitsa"].to_pylist(), t["bitsb"].to_pylist(), strict=True) for b in pair]
            i, _, _ = _bound_pairs(np.repeat(np.arange(m), 2), both(t["a"], t["b"]), np.tile([0, 1], m), both(t["na"], t["nb"]), maps, np.full(2 * m, 3), np.ones(2 * m, bool))
            fine = pa.array(np.unique(i // 2))
            yield pa.RecordBatch.from_arrays([t["a"].take(fine), t["b"].take(fine)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    with passing(docs.sparkSession) as lasting, shuffles_dropped(docs.sparkSession):
        docs = docs.select("doc_id", "text")
        rank = _sketch(docs)
        sigs = written(_signatures(docs, rank))
        filled = sigs.where("n > 0 and doc_id is not null")
        classes = written(filled.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))
        key = (F.col("doc_id") == F.col("rep")) & (F.col("n") == F.col("rn")) & (F.col("d1") == F.col("r1")) & (F.col("d2") == F.col("r2"))
        reps = filled.join(classes.select("rep", F.col("n").alias("rn"), F.col("d1").alias("r1"), F.col("d2").alias("r2")), key, "left_semi")
        links = _links(docs, _first_pairs(reps)).unionByName(_repeated(filled, classes))
        found = components(links)
        copies = filled.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).where("doc_id <> rep").select("doc_id", F.lit(None).cast("long").alias("comp"))
        marks = written(found.select(F.col("node").alias("doc_id"), "comp").unionByName(copies.distinct()))
        labelled = _labelled(filled.select("doc_id", "n", "prefix"), marks)
        spread = labelled.select("comp", F.explode("prefix").alias("k")).groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        spread = written(spread.select("k"))
        if not spread.isEmpty():
            postings, bits = _postings(docs, filled, marks, spread, rank), filled.select("doc_id", "n", "bits")
            # again along stars first: what is left for the tiles are shingles that unlike documents share
            links = links.unionByName(_links(docs, _bounded(_star_pairs(postings), bits)))
            found = components(links)
            # then along spanning forests inside tiles, so that a group of copies hands on as many pairs as rows; last, all that is left
            for trees in (*range(FORESTS), None):
                postings = _spread_on(postings, found)
                if postings.isEmpty():
                    break
                wide = (lambda ids: _wide_bits(docs, ids)) if trees is None else None
                links = links.unionByName(_links(docs, _tile_pairs(postings, bits, trees, wide)))
                found = components(links)
        named = classes.join(found, F.col("rep") == F.col("node"), "left").select("n", "d1", "d2", F.coalesce("comp", "rep").alias("component"))
        out = sigs.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
        return lasting(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id")).alias("component_id")))


def _wide_bits(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, n and a wide bitmap of the documents of ``ids`` (a).

    A bitmap of two bits a shingle hides two in five of the shingles that only one side has, and so lets a pair
    of 0.70 pass; one of 16 hides one in sixteen, and refutes pairs of up to 0.73.
    """
    @tidy
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, BATCH):
            row = 0
            for s, at in flat_sets(batch.column(1)):
                size = np.diff(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(size)), pa.array(size, pa.int64()), signatures(mix(s), at, WIDE, WIDEST)], names=["doc_id", "n", "bits"])
                row += len(size)

    ids = written(ids)
    wide = _texts(docs, ids, ["a", "ta"], again, "doc_id long, n long, bits binary").where("n > 0")
    return wide.join(ids, F.col("doc_id") == F.col("a"), "left_semi")


def _repeated(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) from each doc_id that stands in several classes to their representatives."""
    several = filled.groupBy("doc_id").agg(F.min(F.struct("n", "d1", "d2")).alias("lo"), F.max(F.struct("n", "d1", "d2")).alias("hi")).where("lo <> hi").select("doc_id")
    rows = filled.select("doc_id", "n", "d1", "d2").join(several, "doc_id", "left_semi").join(classes, ["n", "d1", "d2"])
    return written(rows.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())


def _labelled(sigs: DataFrame, marks: DataFrame) -> DataFrame:
    """The representatives with their component so far as ``comp``: their own id, or what ``marks`` has; null there drops a copy.

    Only documents whose id's bit is set by a mark go through a join; the rest stay where they are.
    """
    sent = sigs.sparkSession.sparkContext.broadcast(_bitmap(marks.select(_id_bit("doc_id"))))

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                here = pa.array(sent.value.has(batch.column(3).to_numpy()) == wanted)
                yield pa.RecordBatch.from_arrays([c.filter(here) for c in batch.columns[:3]], names=batch.schema.names[:3])

        return sigs.select("doc_id", "n", "prefix", _id_bit("doc_id")).mapInArrow(run, "doc_id long, n long, prefix array<long>")

    marked = part(True).join(marks.select(F.col("doc_id").alias("m_id"), F.col("comp").alias("m")), F.col("doc_id") == F.col("m_id"), "left")
    marked = marked.where("m_id is null or m is not null").select("doc_id", "n", "prefix", F.coalesce("m", "doc_id").alias("comp"))
    return part(False).withColumn("comp", F.col("doc_id")).unionByName(marked)


def _shingle_bit(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit(ID_BITS - 1)).alias("bit")


def _postings(docs: DataFrame, sigs: DataFrame, marks: DataFrame, spread: DataFrame, rank: np.ndarray) -> DataFrame:
    """k, comp, doc_id and n of the shingles that stand in prefixes of several components once those of ``spread`` come last."""
    context = docs.sparkSession.sparkContext
    moved = context.broadcast(_bitmap(spread.select(_shingle_bit("k"))))
    ranks = context.broadcast(rank)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            some = np.unique(row[moved.value.has(lists.flatten().to_numpy() & (ID_BITS - 1))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some))], names=["a"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, BATCH):
            row = 0
            for s, at in flat_sets(batch.column(1)):
                s, n = ordered(s, at, ranks.value), np.diff(at)
                last = moved.value.has((s & np.uint64(ID_BITS - 1)).astype(np.int64))
                before = np.concatenate(([0], np.cumsum(last)))  # moved ones
                moves = np.diff(before[at])
                place, length = _places(n), np.repeat(_prefix(n), n)
                ahead = before[:-1] - np.repeat(before[at[:-1]], n)
                new = np.where(last, np.repeat(n - moves, n) + ahead, place - ahead) < length
                new &= last | (place >= length)  # moved ones, and what was behind the first prefix
                count = np.diff(np.concatenate(([0], np.cumsum(new)))[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n, pa.int64()), _lists(s[new], count)], names=["doc_id", "n", "prefix"])
                row += len(n)

    ids = written(sigs.select("doc_id", "prefix").mapInArrow(touched, "a long"))
    remade = written(_texts(docs, ids, ["a", "ta"], again, "doc_id long, n long, prefix array<long>"))
    wanted = context.broadcast(_bitmap(remade.select(F.explode("prefix").alias("k")).select(_shingle_bit("k"))))

    def stayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            k = lists.flatten().to_numpy()
            bit = k & (ID_BITS - 1)
            here = wanted.value.has(bit) & ~moved.value.has(bit)
            size = np.bincount(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[here], minlength=len(lists))
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(k[here]))
            some = pa.array(size > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(1).filter(some), kept.filter(some)], names=["doc_id", "n", "prefix"])

    old = sigs.select("doc_id", "n", "prefix").mapInArrow(stayed, "doc_id long, n long, prefix array<long>")
    rows = _labelled(written(old.unionByName(remade)), marks)
    postings = written(rows.select(F.explode("prefix").alias("k"), "comp", "doc_id", "n"))
    return _several(postings)


def _several(postings: DataFrame) -> DataFrame:
    """The postings of shingles that stand in more than one component."""
    several = postings.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("k")
    return written(postings.join(written(several), "k", "left_semi"))


def _star_pairs(postings: DataFrame) -> DataFrame:
    """Each posting's document with the leader of its shingle and size band, where they are of different components."""
    banded = postings.withColumn("band", _band(F.col("n")))
    leaders = banded.groupBy("k", "band").agg(F.min(F.struct("n", "doc_id", "comp")).alias("l")).select("k", "band", F.col("l.doc_id").alias("b"), F.col("l.n").alias("bn"), F.col("l.comp").alias("bc"))
    pairs = banded.join(written(leaders), ["k", "band"]).where((F.col("comp") != F.col("bc")) & _comparable(F.col("n"), F.col("bn")))
    return pairs.select(F.col("doc_id").alias("a"), "b").distinct()


def _spread_on(postings: DataFrame, found: DataFrame) -> DataFrame:
    """The postings under new components, as far as their shingles still stand in several."""
    named = postings.join(found.withColumnRenamed("comp", "now"), F.col("doc_id") == F.col("node"), "left")
    return _several(named.select("k", F.coalesce("now", "doc_id").alias("comp"), "doc_id", "n"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those of a component but its smallest doc_id; all columns stay. Null doc_ids stay."""
    gone = near_duplicates(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
