"""Token ids in ORC files.

Documents are range-partitioned and sorted by doc_id, encoded batch by batch, and written as ORC:
integer run-length encoding for the ids, row indexes, and Bloom filters on doc_id, so that readers
take stripes in parallel and skip those whose indexes or filters rule out a document. Each file
knows its place (``part``, the range's number), and rows in it know theirs (``row``), ascending by
doc_id. Where documents start in the stream of all ids is worked out from what is read back: sums
per part, added up over the parts, then running sums in order of rows inside each part.

Encoding cuts a text at white space, and plain words from their commas and full stops, where the
vocabulary's own pre-tokenizer separates too. Each distinct run is encoded once by the tokenizers
library and kept by its 64-bit hash (at most about ``KNOWN_RUNS`` per Python worker); texts are put
together from the runs' ids by array operations. Texts with special tokens, and all texts of a
vocabulary that does not cut this way, go to the library whole.

Defined results: null and empty texts hold just the end id. Rows that repeat a doc_id are ordered
by their text. A null doc_id sorts first and keeps its row. Extra columns are ignored. An empty
table writes no row. Spark's ORC writer commits by rename, so that a lost executor's task is
simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hash_words, scratch_dir, text_buffers

END_ID = 2
KNOWN_RUNS = 1_500_000
STRIPE_BYTES = 64 << 20
INDEX_ROWS = 1000

def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Bytes of letters (ASCII and U+00C0 to U+023F, lead and trail bytes), and of the stops that stand alone."""
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:192] = letter[0xC3:0xC9] = True
    return letter, np.isin(np.arange(256), (44, 46))


_LETTER, _STOP = _tables()


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes (A-Z lower-cased) and texts of the runs to encode by themselves.

    Texts are cut at spaces and new lines; what is left between them is cut further around commas
    and full stops if it has, besides letters, only such signs and no two side by side.
    """
    n = len(data)
    shown = ~np.isin(data, (32, 10))
    odd = np.zeros(n + 1, np.int64)
    bad = ~(_LETTER | _STOP)[data]
    if n > 1:
        a, b = data[:-1], data[1:]
        bad[1:] |= (_STOP[a] & _STOP[b]) | ((a == 0xC3) & ((b == 0x97) | (b == 0xB7))) | ((a == 0xC4) & (b == 0xB0))
    np.cumsum(bad & shown, out=odd[1:])
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(shown & (np.concatenate(([True], ~shown[:-1])) | edge[:-1])) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(shown & (np.concatenate((~shown[1:], [True])) | edge[1:])) + 1 if n else starts
    plain = odd[ends] == odd[starts]
    stops = np.flatnonzero(_STOP[data])
    stops = stops[plain[np.searchsorted(starts, stops, side="right") - 1]] if len(stops) else stops
    return hash_words(data, bounds, flag=~np.isin(np.arange(256), (32, 10)), cuts=np.concatenate((stops, stops + 1)))


class Encoder:
    """Ids by hash of a run: sorted hashes, and the ids end to end. Holds KNOWN_RUNS runs at most and then starts anew."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        ends = [i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        one = lambda t: self.library.encode(t, add_special_tokens=False).ids
        self.cut = bool(ends) and one("A, b") == one("a") + one(",") + one("b")
        self.clear()

    def clear(self) -> None:
        self.h, self.first, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Ids by the library. Words of letters go side by side, many to a call: each ends with an id that ends a word."""
        out: dict[int, np.ndarray] = {}
        words = [k for k, t in enumerate(texts) if t.isalpha()] if self.cut else []
        if words:
            lines = [" ".join(texts[k] for k in words[i : i + 100]) for i in range(0, len(words), 100)]
            ids = np.array([i for e in self.library.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(words) and stops[-1] == len(ids):
                out = dict(zip(words, np.split(ids, stops[:-1]), strict=True))
        rest = [k for k in range(len(texts)) if k not in out]
        for k, e in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
        return [out[k] for k in range(len(texts))]

    def places(self, h: np.ndarray, texts_of) -> np.ndarray:
        """Places of distinct sorted hashes; texts_of gives the runs of those that are new."""
        if len(self.h) > KNOWN_RUNS:
            self.clear()
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        new = np.flatnonzero(self.h[at] != h) if len(self.h) else np.arange(len(h))
        if not len(new):
            return at
        raw = self.encoded(texts_of(new))
        size = np.array([len(x) for x in raw], np.int64)
        first = np.cumsum(size) - size + len(self.ids)
        self.ids = np.concatenate((self.ids, *raw))
        all_h = np.concatenate((self.h, h[new]))
        order = np.argsort(all_h)
        self.h, self.first, self.size = all_h[order], np.concatenate((self.first, first))[order], np.concatenate((self.size, size))[order]
        return np.searchsorted(self.h, h)

    def column(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column's texts end to end, each text's followed by the end id, and their numbers."""
        flat, sizes, end = [], [], np.array([end_id], np.uint32)
        for at, rows, data, bounds in text_buffers(column):
            special = (data[:-1] == 60) & (data[1:] == 124)  # <|, as special tokens begin
            apart = np.unique(np.searchsorted(bounds, np.flatnonzero(special), side="right") - 1).tolist() if self.cut else range(rows)
            starts, ends, h, text = runs(data, bounds)
            if len(apart):
                keep = ~np.isin(text, apart)
                starts, ends, h, text = starts[keep], ends[keep], h[keep], text[keep]
            h, first, back = np.unique(h, return_index=True, return_inverse=True)
            raw, s, e = data.tobytes(), starts[first], ends[first]
            place = self.places(h, lambda new, raw=raw, s=s, e=e: [raw[a:b].decode() for a, b in zip(s[new].tolist(), e[new].tolist(), strict=True)])[back]
            size = self.size[place]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            ids = self.ids[np.repeat(self.first[place], size) + step]
            n = np.bincount(text, weights=size, minlength=rows).astype(np.int64) if len(text) else np.zeros(rows, np.int64)
            others = dict(zip(apart, self.encoded([column[at + k].as_py() or "" for k in apart]), strict=True))
            to = np.cumsum(n)
            for k in range(rows):
                flat += [others[k] if k in others else ids[to[k] - n[k] : to[k]], end]
                sizes.append(len(flat[-2]) + 1)
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.array(sizes, np.int64)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, row (from 0 in its part) and ids (with the end id), in the rows' order. Keeps the partitions of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in cut(batches):
            ids, sizes = encoder(path or vocabulary()).column(batch.column(1), end_id)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            rows, row = pa.array(np.arange(row, row + len(sizes), dtype=np.int64)), row + len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), rows, lists], names=["doc_id", "part", "row", "ids"])

    return docs.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, "doc_id long, part int, row long, ids array<int>")


def write_ids(docs: DataFrame, out: str, path: str | None = None, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Writes the ORC files of all documents to folder ``out`` in ascending doc_id order."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (encode(ordered, path).write
        .option("compression", "zstd").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .orc(out))


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """The files' rows: doc_id, part, row, ids. Filters on doc_id use the stripes' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, part int, row long, ids array<int>").orc(out)


def report(docs: DataFrame, path: str | None = None, out: str | None = None) -> DataFrame:
    """Writes the files, reads them back and gives each document's place, length and checksum."""
    spark = docs.sparkSession
    out = out or scratch_dir(spark)
    write_ids(docs, out, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, offs = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offs).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    rows = read_ids(spark, out).mapInArrow(run, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    # one row per range: as many as partitions, not documents
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    base = sums.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, "part")
        .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )
