"""Token counts by heap-and-linked-list byte-pair merging.

A text's symbols start as its characters, in a doubly linked list. A heap holds the adjacent
pairs that the vocabulary can merge, best score first, then leftmost; the best is popped and
merged until none is left. The count is the initial symbols minus the merges, plus the extra
bytes of characters that the vocabulary lacks (byte fallback). No identifiers are made.

Texts are cut into units that merging cannot cross, so that each distinct unit is merged once per
cache: between two characters that stand side by side in no piece no merge can happen. The cut
classes come from the vocabulary itself, and so hold for any model file. A cache has at most
``CACHE_UNITS`` entries per Python worker and is then emptied; units longer than
``CACHE_CHARS`` are never kept. Nothing is shuffled or sent to the driver.

Defined results: null and empty texts have 0 bytes and 0 tokens. Begin, end and special-token
strings inside texts are ordinary characters, as is the library's default. Repeated rows each get
a row; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACE = "▁"
LIMIT = 4096
CACHE_UNITS = 400_000
CACHE_CHARS = 64


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def merged_count(text: str, score: dict[str, float]) -> int:
    """Symbols left of ``text`` after all merges, by a heap over a linked list."""
    n = len(text)
    if n < 2:
        return n
    piece = list(text)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-score[p], i, p) for i in range(n - 1) if (p := piece[i] + piece[i + 1]) in score]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, p = heapq.heappop(heap)
        if not piece[i] or (j := after[i]) >= n or piece[i] + piece[j] != p:
            continue  # one side has been merged meanwhile
        merges += 1
        piece[i], piece[j] = p, ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (q := p + piece[k]) in score:
                heapq.heappush(heap, (-score[q], i, q))
        if (h := before[i]) >= 0 and (q := piece[h] + p) in score:
            heapq.heappush(heap, (-score[q], h, q))
    return n - merges


class Counter(dict):
    """Token counts by unit; a missing unit is merged and kept."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        self.single = {p for p in self.score if len(p) == 1}
        self.units = self._units()

    def _units(self) -> re.Pattern:
        """Characters that share a piece, directly or through others, form a class; a unit is spaces, then a run of one class."""
        up: dict[str, str] = {}

        def top(c: str) -> str:
            while up.setdefault(c, c) != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        inside = False
        for p in self.score:
            inside |= SPACE in p.lstrip(SPACE)
            p = p.lstrip(SPACE)
            for a, b in zip(p, p[1:], strict=False):
                up[top(a)] = top(b)
        if inside:  # pieces that go on past a space: texts stay whole
            return re.compile("(?s).+")
        classes: dict[str, list[str]] = {}
        for c in up:
            classes.setdefault(top(c), []).append(c)
        runs = ["".join(map(re.escape, sorted(x))) for x in sorted(classes.values(), key=lambda x: (-len(x), x))]
        any_run = "".join(runs)
        return re.compile("|".join([*(f"{SPACE}*[{r}]+" for r in runs), f"(?s:{SPACE}*[^{any_run}{SPACE}])", f"{SPACE}+"]))

    def __missing__(self, unit: str) -> int:
        count = merged_count(unit, self.score)
        for c in unit:
            if c not in self.single:
                count += len(c.encode("utf-8", "surrogatepass")) - 1
        if len(unit) <= CACHE_CHARS:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = count
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.units.findall(SPACE + text.replace(" ", SPACE))))


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model or model_path())
        for batch in cut(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([own.count(t) for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def report(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Counts and whether they pass the limit."""
    return count_tokens(docs, model).withColumn("over_limit", F.col("n_tokens") > limit)
