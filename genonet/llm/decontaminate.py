"""Benchmark decontamination with suffix arrays over shards of training words.

Documents are cut into shards of bounded size. Each shard gets a suffix array of its word
sequence (prefix doubling), and every suffix of every benchmark item is binary-searched in it,
all suffixes at once. That gives each suffix's longest verbatim match and its places, and the
places where a whole window of the item stands.

Nothing is shuffled: the benchmark goes to the documents. It is sent in blocks of at most
``block_bytes`` of text, so that a broadcast has a fixed bound whatever the benchmark's size;
with several blocks each document's hits are merged by an aggregation on its row key.

Defined results: a null or empty text has no words and is never contaminated. A benchmark item
without words (null, empty, signs only) has no window, and one with a null item_id is not looked
for. Repeated document rows each get a row.
Repeated items count each by their own id. Extra columns of either table are ignored by scan()
and passed through by decontaminate(). Empty tables give empty or uncontaminated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, hash_words, text_buffers, tidy, written

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
SHARD_WORDS = 1 << 20

HITS = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("runs", T.ArrayType(T.LongType(), False), False),
    T.StructField("items", T.ArrayType(T.StringType(), False), False),
    T.StructField("longest", T.LongType(), False),
    T.StructField("longest_at", T.LongType()),
])


class Benchmark:
    """A block of the benchmark: its words, its items' ids and where each window starts."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int) -> None:
        raw = [(t or "").encode() for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.starts, self.ends, self.hashes, self.item = hash_words(self.data, bounds, alnum=True)
        self.ids = ids
        size = np.bincount(self.item, minlength=len(ids)).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(size)))[:-1]
        at = np.arange(len(self.hashes)) - first[self.item]
        #: Words from a suffix's start to its item's end, and the length of the window there (0: none starts).
        self.left = size[self.item] - at
        self.wide = np.minimum(window, size)[self.item]
        self.wide = np.where(self.left >= self.wide, self.wide, 0)
        self.deepest = int(self.left.max(initial=0))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``ids`` by their suffixes, compared over ``depth`` ids at least. Prefix doubling; only ties are sorted again."""
    n = len(ids)
    order = np.argsort(ids)
    key = ids[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head  # the first place of a group names it, so ranks stay right when groups split
    size = 1
    while size < depth:
        last = np.concatenate((new[1:], [True]))
        tied = np.flatnonzero(~(new & last))
        if not len(tied):
            break
        at = order[tied]
        ahead = at + size
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = rank[at] * (n + 1) + second
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[tied] = at
        differ = np.concatenate(([True], pair[1:] != pair[:-1]))
        new[tied] |= differ
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[at] = head[tied]
        size *= 2
    return order


def search(ids: np.ndarray, order: np.ndarray, query: np.ndarray, left: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Binary-searches all suffixes of ``query`` (with ``left`` ids each) in the suffix array at once.

    Returns each suffix's longest match and one place of it, and the interval of the array where
    its first ``wide`` ids stand. Every round fixes one more id and narrows the intervals.
    """
    m, n = len(query), len(order)
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    longest, where = np.zeros(m, np.int64), np.full(m, -1, np.int64)
    wlo, whi = np.zeros(m, np.int64), np.zeros(m, np.int64)
    live, depth = np.flatnonzero((left > 0) & (query >= 0)), 0
    padded = np.append(ids, -2)
    while len(live):
        want = query[live + depth]
        edges = []
        for right in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                got = padded[np.minimum(order[np.minimum(mid, n - 1)] + depth, n)]
                up = ((got <= want) if right else (got < want)) & open_
                a = np.where(up, mid + 1, a)
                b = np.where(open_ & ~up, mid, b)
            edges.append(a)
        some = (edges[0] < edges[1]) & (want >= 0)
        live = live[some]
        lo[live], hi[live] = edges[0][some], edges[1][some]
        depth += 1
        longest[live], where[live] = depth, order[lo[live]]
        full = live[wide[live] == depth]
        wlo[full], whi[full] = lo[full], hi[full]
        live = live[left[live] > depth]
    return longest, where, wlo, whi


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bench: Benchmark, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether words ``at`` of the shard and words ``q`` of the benchmark have the same letters."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    size = ends[at] - starts[at]
    equal = size == bench.ends[q] - bench.starts[q]
    k = np.flatnonzero(equal)
    size = size[k]
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    differ = fold[data[np.repeat(starts[at[k]], size) + step]] != fold[bench.data[np.repeat(bench.starts[q[k]], size) + step]]
    equal[k[np.repeat(np.arange(len(k)), size)[differ]]] = False
    return equal


def scan_shard(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, text: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of windows in a shard (shard word, benchmark word), and every benchmark suffix's longest match and its place."""
    none = np.zeros(0, np.int64)
    known, ids = np.unique(hashes, return_inverse=True)
    # a separator, smaller than any word, stands between texts: no match runs across them
    jump = np.concatenate(([0], np.cumsum(text[1:] != text[:-1])))
    seq = np.zeros(len(ids) + int(jump[-1]), np.int64)
    place = np.arange(len(ids)) + jump
    seq[place] = ids + 1
    back = np.zeros(len(seq), np.int64)
    back[place] = np.arange(len(ids))
    at = np.searchsorted(known, bench.hashes)
    query = np.where(known[np.minimum(at, len(known) - 1)] == bench.hashes, at + 1, -1)
    order = suffix_array(seq, bench.deepest)
    longest, where, lo, hi = search(seq, order, query, bench.left, bench.wide)
    count = hi - lo
    q = np.repeat(np.arange(len(query)), count)
    if not len(q):
        return none, none, longest, np.where(where >= 0, back[where], -1)
    w = back[order[np.repeat(lo, count) + np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)]]
    # hashes brought these together; letters decide
    wide = bench.wide[q]
    step = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    pairs = np.unique(np.stack((np.repeat(w, wide) + step, np.repeat(q, wide) + step), axis=1), axis=0)
    if not (same := same_words(data, starts, ends, bench, pairs[:, 0], pairs[:, 1])).all():
        wrong = {tuple(x) for x in pairs[~same].tolist()}
        fine = np.array([not any((a + k, b + k) in wrong for k in range(n)) for a, b, n in zip(w.tolist(), q.tolist(), wide.tolist(), strict=True)], bool)
        w, q = w[fine], q[fine]
    return w, q, longest, np.where(where >= 0, back[where], -1)


def _scan_texts(column, bench: Benchmark) -> list[tuple[int, list[int], list[str], int, int | None]]:
    """For each text: words, hit runs [from, to, ...], items, longest match and its first word."""
    out = []
    for _, rows, data, bounds in text_buffers(column, SHARD_BYTES):
        starts, ends, hashes, text = hash_words(data, bounds, alnum=True)
        size = np.bincount(text, minlength=rows)
        first = np.concatenate(([0], np.cumsum(size)))
        cover = np.zeros(len(hashes) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(rows)]
        best, best_at = np.zeros(rows, np.int64), np.full(rows, -1, np.int64)
        step = SHARD_WORDS
        for a in range(0, len(hashes) if bench.deepest else 0, step):
            b = min(len(hashes), a + step + bench.deepest)  # a very long text is cut; pieces overlap by the longest match
            w, q, longest, where = scan_shard(data, starts[a:b], ends[a:b], hashes[a:b], text[a:b], bench)
            w = w + a
            np.add.at(cover, w, 1)
            np.add.at(cover, w + bench.wide[q], -1)
            for t, i in np.unique(np.stack((text[w], bench.item[q]), axis=1), axis=0).tolist() if len(w) else ():
                items[t].add(bench.ids[i])
            some = np.flatnonzero(where >= 0)
            t = text[where[some] + a]
            for k in np.lexsort((-where[some], longest[some])):
                if longest[some[k]] >= best[t[k]]:
                    best[t[k]], best_at[t[k]] = longest[some[k]], where[some[k]] + a - first[t[k]]
            if b == len(hashes):
                break
        hit = np.concatenate((np.cumsum(cover[:-1]) > 0, [False]))
        for k in range(rows):
            own = hit[first[k] : first[k + 1]]
            turn = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8))) if own.any() else ()
            out.append((int(size[k]), [int(x) for x in turn], sorted(items[k]), int(best[k]), int(best_at[k]) if best_at[k] >= 0 else None))
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Benchmark]:
    """The benchmark in blocks of about block_bytes of text; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null")
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = int(total // block_bytes) + 1
    for k in range(n):
        rows = (items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k) if n > 1 else items).collect()
        yield Benchmark([r[0] for r in rows], [r[1] for r in rows], window)


def _free(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _annotated(docs: DataFrame, keep: list[str], hits: str, bench: Benchmark) -> DataFrame:
    """Columns ``keep`` of docs and, as struct ``hits``, what one block of the benchmark finds in the text."""
    sent = docs.sparkSession.sparkContext.broadcast(bench)
    wanted = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    schema = T.StructType([*[wanted.schema[c] for c in keep], T.StructField(hits, HITS, False)])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64())])
        for batch in cut(batches):
            found = _scan_texts(batch.column(batch.schema.get_field_index("text")), sent.value)
            rows = pa.array([dict(zip(("n_words", "runs", "items", "longest", "longest_at"), x, strict=True)) for x in found], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], rows], names=[*keep, hits])

    return wanted.mapInArrow(run, schema)


def _merged(parts: DataFrame, key: str, hits: str) -> DataFrame:
    """Hits of several blocks as one: runs that overlap or touch are joined."""
    flat = parts.groupBy(key).agg(
        F.max(f"{hits}.n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.expr(f"filter(transform({hits}.runs, (x, k) -> if(k % 2 = 0, struct(x as a, {hits}.runs[k+1] as b), null)), x -> x is not null)")))).alias("r"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{hits}.items")))).alias("items"),
        F.max(F.struct(F.col(f"{hits}.longest"), (-F.col(f"{hits}.longest_at")).alias("m"))).alias("l"),
    )
    runs = F.expr(
        "aggregate(r, cast(array() as array<bigint>), (s, x) -> case when size(s) > 0 and x.a <= s[size(s)-1]"
        " then concat(slice(s, 1, size(s)-1), array(greatest(x.b, s[size(s)-1]))) else concat(s, array(x.a, x.b)) end)"
    )
    return flat.select(key, F.struct("n_words", runs.alias("runs"), "items", F.col("l.longest").alias("longest"), (-F.col("l.m")).alias("longest_at")).alias(hits))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id and struct ``hits`` (n_words, runs of hit words, items, longest match and its place)."""
    found = blocks(benchmark, window, block_bytes)
    first, second = next(found), next(found, None)
    if second is None:
        return _annotated(docs, ["doc_id"], "hits", first)
    # 256 bits of the text beside the id: rows with the same key are the same document
    keyed = docs.select("doc_id", "text", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256)).alias("k"))
    rows = keyed.groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    parts = None
    for b in chain((first, second), found):
        part = written(_annotated(keyed, ["k"], "hits", b).dropDuplicates(["k"]))  # done with the block before the next is read
        parts = part if parts is None else parts.unionByName(part)
    merged = _merged(parts, "k", "hits").join(rows, "k")
    return merged.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc_id", "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a hit, with all their columns. Block by block, so no shuffle at all."""
    columns, hits = docs.columns, _free(docs, "hits")
    found = blocks(benchmark, window, block_bytes)
    b = next(found)
    while b is not None:
        docs = _annotated(docs, columns, hits, b).where(F.size(f"{hits}.runs") == 0).select(*[F.col(f"`{c}`") for c in columns])
        if (b := next(found, None)) is not None:
            docs = written(docs)
    return docs


def report(hits: DataFrame) -> DataFrame:
    """The digest columns of scan()."""
    n_hit = F.expr("aggregate(hits.runs, 0L, (s, x) -> x - s)")  # runs alternate from, to: the alternating sum is their length
    return hits.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (F.size("hits.runs") > 0).alias("contaminated"),
    )

