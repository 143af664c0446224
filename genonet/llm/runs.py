"""Periodic runs in word sequences: Lyndon arrays and extensions in linear time, without suffix structures or hashes of substrings.

A run is a stretch with smallest period q of at least two periods that no neighbour extends. Its
Lyndon root, in the order of words or in the reverse one, is the stretch from a place to its next
smaller suffix (nss). lyndon() finds all of these from left to right with a stack of previous
smaller suffixes and, with each, how far the two suffixes agree. Two facts keep it linear:

* along the stack, what is known of a suffix and the one below it decides a comparison, or says
  from where it goes on;
* a match that reaches the rightmost place read so far is remembered with its distance. What lies
  inside it is a copy of what lies that distance before, so that comparisons which end inside
  are looked up; all others go on at that rightmost place. Each word is thus matched once.

A root whose extensions to both sides add up to its length makes a run; only the leftmost root of a
run looks left, and no farther than one period.

No shuffle: a document is worked on where it is read. What can hold no run of the wanted length
and exponent is ruled out first, exactly: behind its first period each word of a run stands at most
a period after an equal word, so that a run's tail is a stretch of words whose equals lie
within the stretch's length over (exponent - 1). The Lyndon arrays are worked out for what is left,
with the room before it in which such a run can begin; this never loses or shortens one.

Words are what stands between white space (``[\\x20\\x09-\\x0D]+``). Defined results: null or empty
texts have no words, no runs and an empty collapsed text; equal rows give equal rows; extra columns
are ignored; an empty table gives an empty table. Very long texts are one task's work, in memory
proportional to the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import SPACES, cut, let, tidy, word_array

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Rounds of ruling out at most; what is left after them is searched.
ROUNDS = 32


def lyndon(t: list[int]) -> tuple[list[int], list[int]]:
    """nss and lce: for each place the next smaller suffix (len(t): the end, which is smaller than all) and how far the two agree."""
    n = len(t)
    nss, lce = [n] * n, [0] * n
    pss, plce = [-1] * n, [0] * n  # the previous smaller suffix, and how far it agrees
    reach, block, shift = 0, 0, 0  # t[block:reach] equals what stands ``shift`` before; the match cannot go on
    for y in range(1, n):
        c, e, inside = y - 1, 0, y < reach
        while c >= 0:
            known = -1
            if inside and c >= block and y + e < reach:
                c2, y2 = c - shift, y - shift
                known = lce[c2] if nss[c2] == y2 else plce[y2]
                if y + known >= reach:
                    e, known = reach - y, -1
            if known >= 0:
                e, smaller = known, nss[c - shift] == y - shift
            else:
                at = y + e
                while at < n and t[c + at - y] == t[at]:
                    at += 1
                e = at - y
                smaller = at >= n or t[at] < t[c + e]
                if at >= reach:
                    reach, block, shift, inside = at, y, y - c, False
            if not smaller:
                pss[y], plce[y] = c, e
                break
            nss[c], lce[c] = y, e
            below = pss[c]
            # the suffix below c and suffix y are both smaller than c: where they leave it decides
            while below >= 0 and e < plce[c]:
                c = below
                nss[c], lce[c] = y, e
                below = pss[c]
            if below >= 0 and e > plce[c]:
                pss[y], plce[y] = below, plce[c]
                break
            c = below
    return nss, lce


def all_runs(t: list[int]) -> set[tuple[int, int, int]]:
    """start, length and period of every run of a sequence of numbers."""
    found, n = set(), len(t)
    for order in (t, [-x for x in t]):
        nss, lce = lyndon(order)
        for i in range(n):
            j = nss[i]
            right, p = lce[i], j - i
            if not right or i >= p and nss[i - p] == i and lce[i - p] >= p:
                continue
            left, most = 0, min(i, p)
            while left < most and t[i - 1 - left] == t[j - 1 - left]:
                left += 1
            if left + right >= p:
                found.add((i - left, p + left + right, p))
    return found


def _stretches(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def windows(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int]]:
    """Parts of a sequence that hold every run of at least that length and exponent, whole."""
    n, k = len(codes), min_exponent - 1
    if n < min_length:
        return []
    order = np.argsort(codes, kind="stable")
    before = np.full(n, n + 1)
    again = codes[order[1:]] == codes[order[:-1]]
    before[order[1:][again]] = (order[1:] - order[:-1])[again]
    alive, tail = before <= n, -(-min_length * k // min_exponent)
    starts, ends = _stretches(alive)
    for _ in range(ROUNDS):
        size = ends - starts
        fine = size >= tail
        starts, ends, size = starts[fine], ends[fine], size[fine]
        if not len(starts):
            return []
        own = np.repeat(np.arange(len(starts)), size)
        at = starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        dead = before[at] * k > size[own]
        flag = np.zeros(n, bool)
        flag[at[~dead]] = True
        starts, ends = _stretches(flag)
        if not dead.any():
            break
    out: list[tuple[int, int]] = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a < tail:
            continue
        a = max(0, a - (b - a) // k)
        if out and a <= out[-1][1]:
            out[-1] = (min(a, out[-1][0]), max(b, out[-1][1]))
            while len(out) > 1 and out[-1][0] <= out[-2][1]:
                last = out.pop()
                out[-1] = (out[-1][0], max(last[1], out[-1][1]))
        else:
            out.append((a, b))
    return out


def long_runs(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """start, length and period of the runs of at least that length and exponent, by start and period."""
    code = {w: k for k, w in enumerate(set(words))}  # any order of the words serves
    codes = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    found = set()
    for a, b in windows(codes, min_length, min_exponent):
        found |= {(a + s, size, p) for s, size, p in all_runs(codes[a:b].tolist()) if size >= max(min_length, min_exponent * p)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that stand in a run behind its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, size, p in runs:
        keep[start + p : start + size] = False
    return [words[k] for k in np.flatnonzero(keep)]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exponent; of equal ones the first, then the shortest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def each_text(docs: DataFrame, columns: str, row: Callable[[Any, list[bytes], list[tuple[int, int, int]]], tuple]) -> DataFrame:
    """row(doc_id, words, runs) of every document: doc_id and the given columns."""
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(columns)])
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                words = (text or b"").split()  # bytes are split at the six ASCII white spaces
                rows.append(row(i, words, long_runs(words)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), wanted, strict=True)], schema=wanted)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, text with every run cut to its first period and words joined by one space, and the runs."""

    def row(i, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
        return i, b" ".join(collapsed(words, runs)).decode(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]

    return each_text(docs, "text string, runs array<struct<start: bigint, length: bigint, period: bigint>>", row)


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of every document's runs and collapsed text."""

    def row(i, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
        top = strongest(runs)
        listed = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
        return (
            i, len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
        )

    return each_text(docs, "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string", row)


def repeated(docs: DataFrame) -> DataFrame:
    """docs where every tenth text, by the CRC-32 of its doc_id in decimals, ends in repeats of a stretch of its own words: what report() is tried on.

    With h the CRC and g = h // 10: words from a = g % n on become those of the first
    1 + (n - a) // (3 + g % 8) of them, over and over. A null doc_id leaves the text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), tail), " ")).otherwise(F.col("text"))

    return docs.withColumn("text", F.when(h % 10 == 0, let(word_array(F.col("text"), SPACES), planted)).otherwise(F.col("text")))
