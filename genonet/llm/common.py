"""Helpers that the operators share: shared scratch tables, word expressions, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of either kind, as a Java and RE2 character class.
NON_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACES = r"[\x20\x09-\x0D]+"

_own: dict[str, str] = {}
#: Folders made inside the innermost passing() block.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder path that the driver and all executors can reach.

    It lies in ``spark.checkpoint.dir``. Where that is unset, a local master (tests, one machine)
    takes a temporary folder of this process, also for checkpoint(); on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault("dir", tempfile.mkdtemp(prefix="genonet-"))
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/genonet-{uuid.uuid4().hex}"
    if (mine := _passing.get()) is not None:
        mine.append(path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Scratch folders made inside go at the end, also after a failure. Gives lasting(), which writes a table that stays.

    What comes out must not read what goes: hand on plain values, or a table by lasting().
    """
    outer, mine = _passing.get(), []
    token = _passing.set(mine)

    def lasting(df: DataFrame) -> DataFrame:
        inner = _passing.set(outer)
        try:
            return written(df)
        finally:
            _passing.reset(inner)

    try:
        yield lasting
    finally:
        _passing.reset(token)
        for path in mine:
            drop_folder(spark, path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside drop their shuffle files as they end, not when the driver happens to collect its garbage; the session's own setting comes back after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, own)


@contextlib.contextmanager
def short_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Actions inside send Arrow batches of at most ``size`` bytes to Python workers; the session's own bound comes back after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(key, own)


def written(df: DataFrame, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage."""
    path = path or scratch_dir(df.sparkSession)
    give_back()  # the driver's Python waits beside its JVM, too
    with short_batches(df.sparkSession), shuffles_dropped(df.sparkSession):
        df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches in pieces of at most ``rows`` rows. Spark bounds the bytes of what arrives."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Hands freed memory of this process back to the machine."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after whose end the worker gives freed memory back to the machine: it waits for further tasks beside the JVM."""
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _powers.update(p=np.ones(1, np.uint64), i=np.ones(1, np.uint64))
            give_back()

    return wrapped


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Texts without other letters take the faster built-in way."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_array(c: Column, separators: str) -> Column:
    """The words between separators; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(c, separators), ""), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_spans() -> Column:
    return F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")


def match_spans(text: Column, pattern: str | Column, rank: int | Column, block: int = 128) -> Column:
    """Leftmost non-overlapping matches as structs s, k (the rank), e, m; places count code points.

    What stands between the matches gives their places by running sums. The sums go by blocks, as
    an array that grows by one is copied each time.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    rank = F.lit(rank) if isinstance(rank, int) else rank

    def placed(m: Column, gaps: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            s = a["at"] + F.length(F.get(gaps, i))
            e = s + F.length(F.get(m, i))
            span = F.struct(s.alias("s"), rank.alias("k"), e.alias("e"), F.get(m, i).alias("m"))
            return F.struct(e.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        def some(a: Column, b: Column) -> Column:
            last = F.least(b * block + block - 1, F.size(m) - 1)
            part = F.aggregate(F.sequence(b * block, last), F.struct(a["at"].alias("at"), no_spans().alias("out")), one)
            return let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(a["out"], F.array(p["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array(no_spans()).alias("out"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / block).cast("int"))
        return F.when(F.size(m) > 0, F.flatten(F.aggregate(blocks, start, some, lambda a: a["out"]))).otherwise(no_spans())

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda g: placed(m, g)))


# ---- vectorised word hashing for Arrow batches ----

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    value = mix((fold.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    alnum = np.zeros(256, bool)
    alnum[48:58] = alnum[97:123] = alnum[65:91] = alnum[128:] = True
    printed = np.ones(256, bool)
    printed[[32, 9, 10, 11, 12, 13]] = False
    return value, alnum, printed


_VALUE, _ALNUM, _PRINTED = _byte_tables()
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), np.uint64(base))
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind]


def hash_words(data: np.ndarray, bounds: np.ndarray, alnum: bool = True, flag: np.ndarray | None = None, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie end to end in ``data`` (uint8, text k at bounds[k]:bounds[k+1]).

    alnum: words of digits, letters and non-ASCII characters, else all but white space.
    flag: instead, which bytes words have; cuts: where words end besides.
    Returns starts, ends, 64-bit hashes with A-Z lower-cased, and the text of each word.
    """
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e.astype(np.uint64), e
    flag = ((_ALNUM if alnum else _PRINTED) if flag is None else flag).take(data, mode="clip")
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    if cuts is not None:
        cut[cuts] = True
    before = np.concatenate(([False], flag[:-1]))
    starts = np.flatnonzero(flag & (~before | cut[:-1]))
    after = np.concatenate((flag[1:], [False]))
    ends = np.flatnonzero(flag & (~after | cut[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power("p", _P, n)[:n], dtype=np.uint64, out=total[1:])
    h = (total[ends] - total[starts]) * _power("i", _P_INV, n + 1)[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return starts, ends, h, np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds)))


def text_buffers(column, limit: int = 4 << 20):
    """Cuts an Arrow string column (null: empty) into runs of rows of about ``limit`` bytes.

    Yields first row, rows, the bytes as uint8 and the texts' bounds in them. A text longer
    than the limit is a run of its own.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, to - at, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to
