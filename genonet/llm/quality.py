"""Quality rules: base counts and a hashed n-gram likelihood ratio, in DataFrame functions only.

The verdict on a document is the mean, over its words and word pairs, of
log p_target(bucket) - log p_raw(bucket). Words and pairs are hashed to ``BUCKETS`` buckets.
Trusted documents are all those labelled with quality 1. The target multinomial is counted over all
of them, the raw one over all documents; both get one count more in each bucket. A document is kept
when its mean is not under the threshold, the ``QUANTILE`` quantile of the means of all trusted
documents that pass the base rules, less ``SLACK``. For it the trusted documents fall in two halves
by a bit of doc_id's hash, and each is scored with the target counts of the other half, as its text is then as new
to the model as any unlabelled text; if the other half has no words, with those of both.

A bitmap of the trusted ids' hashes goes out by broadcast: 8 to 16 bits an id, at most ``FILTER_BITS``
in all, beyond which it only lets more documents through. Documents that it rules out are surely not
trusted. The others are joined with the trusted ids by a merge join, which settles them exactly, and are
written to the shared folder for both uses; no other text is shuffled. Else what travels is one count per
bucket and task, and for the threshold the share ``QUANTILE`` of the trusted means.

A caller that gives ``bound`` fits on at most that many trusted documents, those with the smallest
hash of doc_id: by turns one counts for the target, one for the threshold. No query does.

Defined results: a null or empty text has no words, so it fails the base rules. Without trusted
documents every document that passes the base rules is kept. Repeated rows each get a row and
count as often as they stand there; labels that repeat count once. Extra columns are ignored by
report() and passed through by keep(). Empty tables give empty tables. Windows are compared by
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, let, passing, word_array, written

BUCKETS = 1 << 14
FILTER_BITS = 1 << 27
QUANTILE = 0.002
SLACK = 0.02
MIN_WORDS = 50


def pair_hashes(words: Column) -> Column:
    """64-bit hashes of every word and the next."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def buckets(words: Column, pairs: Column) -> Column:
    """The bucket of every word, then of every pair of neighbours."""
    last = F.lit(BUCKETS - 1)
    return F.concat(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(last)), F.transform(pairs, lambda h: h.bitwiseAND(last)))


def repeated_words(pairs: Column) -> Column:
    """Words that lie in a window of three that stands twice or more in the text. Two pairs that overlap name a window."""
    n = F.greatest(F.size(pairs) - 1, F.lit(0))
    hashes = F.zip_with(F.slice(pairs, F.lit(1), n), F.slice(pairs, F.lit(2), n), lambda a, b: F.xxhash64(a, b))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["h"] == x["h"])))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("e"))
        return F.aggregate(let(ordered, places), start, lambda a, x: F.struct((a["c"] + x + 3 - F.greatest(x, a["e"])).alias("c"), (x + 3).alias("e")), lambda a: a["c"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))


def short_counts(text: Column, score: Callable[[Column, Column], Column]) -> Column:
    """A struct of what the threshold needs: n_words, n_repeat_words and the value of a function of the words and pairs as ``score``."""
    def counts(words: Column, pairs: Column) -> Column:
        return F.struct(F.size(words).alias("n_words"), repeated_words(pairs).alias("n_repeat_words"), score(words, pairs).alias("score"))

    return let(word_array(F.coalesce(text, F.lit("")), SPACES), lambda w: let(pair_hashes(w), lambda p: counts(w, p)))


def base_counts(text: Column, score: Callable[[Column, Column], Column] | None = None) -> Column:
    """A struct of the base counts and, where a function of the words and pairs is given, its value as ``score``."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column, pairs: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(pairs).cast("long").alias("n_repeat_words"),
            (score(words, pairs) if score else F.lit(None).cast("double")).alias("score"),
        )

    return let(word_array(text, SPACES), lambda w: let(pair_hashes(w), lambda p: counts(w, p)))


def trusted_ids(labels: DataFrame, bound: int | None = None) -> DataFrame:
    """t_id and half (0 or 1) of every document with quality 1, or of at most ``bound`` of them."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("t_id")).distinct()
    if bound is None:
        return good.withColumn("half", F.xxhash64("t_id").bitwiseAND(F.lit(1)).cast("int"))
    order = [F.xxhash64("t_id"), F.col("t_id")]
    return good.orderBy(*order).limit(bound).withColumn("half", (F.row_number().over(Window.orderBy(*order)) - 1) % 2)


def halved(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """half (null if not trusted) and text of all documents: those that a bitmap of the ids rules out, and the written others."""
    ids = written(ids)
    bits = min(max(1 << 15, 1 << (8 * ids.count()).bit_length()), FILTER_BITS)
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))
    maps = ids.select(place("t_id").alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
    maps = F.broadcast(maps)  # at most FILTER_BITS / 8 bytes
    at = F.bitmap_bit_position(place("doc_id"))
    byte = F.conv(F.hex(F.substring("map", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False)) & F.col("doc_id").isNotNull()
    tried = docs.select("doc_id", "text").join(maps, F.shiftright(place("doc_id"), 15) == F.col("part"), "left").select("doc_id", "text", found.alias("found"))
    settled = tried.where("found").join(ids.hint("merge"), F.col("doc_id") == F.col("t_id"), "left")
    others = tried.where("not found").select(F.lit(None).cast("int").alias("half"), "text")
    return others, written(settled.select("half", "text"))


class Ratio:
    """The fitted model: a weight for each bucket and a threshold."""

    def __init__(self, docs: DataFrame, labels: DataFrame, bound: int | None = None, quantile: float = QUANTILE, slack: float = SLACK) -> None:
        with passing(docs.sparkSession):
            others, tried = halved(docs, trusted_ids(labels, bound))
            words = word_array(F.coalesce("text", F.lit("")), SPACES)
            grams = others.unionByName(tried).select("half", F.explode(let(words, lambda w: let(pair_hashes(w), lambda p: buckets(w, p)))).alias("b"))
            rows = grams.groupBy("b").agg(F.count(F.lit(1)), *[F.count_if(F.col("half") == k) for k in (0, 1)]).collect()  # a row for each bucket at most
            raw, *halves = ({r[0]: r[k] for r in rows if r[k]} for k in (1, 2, 3))
            both = {b: halves[0].get(b, 0) + halves[1].get(b, 0) for b in {**halves[0], **halves[1]}}
            self.weights = weights(raw, both if bound is None else halves[0])
            self.threshold = None
            if both:
                trusted = tried.where("half = 1" if bound is not None and halves[1] else "half is not null")
                mine, other = (_literal(weights(raw, h) if h else self.weights) for h in halves)
                scored = trusted.select(short_counts(F.col("text"), lambda w, p: mean_weight(w, p, F.when(F.col("half") == 0, other).otherwise(mine))).alias("q"))
                low = quantile_of(written(scored).where(~base_failed(F.col("q"))).select("q.score"), quantile)
                self.threshold = None if low is None else low - slack
        self._weights = _literal(self.weights)

    def score(self, words: Column, pairs: Column) -> Column:
        """The mean log ratio of a text's words and pairs; null without words."""
        return mean_weight(words, pairs, self._weights)

    def judged(self, docs: DataFrame, name: str = "q") -> DataFrame:
        """docs with a struct column of the counts, base_failed and kept."""
        def verdict(q: Column) -> Column:
            failed = base_failed(q)
            good = F.lit(True) if self.threshold is None else q["score"] >= F.lit(self.threshold)
            return q.withField("base_failed", failed).withField("kept", ~failed & good)

        return docs.withColumn(name, let(base_counts(F.col("text"), self.score), verdict))


def weights(raw: dict[int, int], target: dict[int, int]) -> list[float]:
    """log p_target - log p_raw of every bucket."""
    if not target:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw.values()) + BUCKETS) - math.log(sum(target.values()) + BUCKETS)
    return [math.log(target.get(b, 0) + 1) - math.log(raw.get(b, 0) + 1) + shift for b in range(BUCKETS)]


def _literal(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def mean_weight(words: Column, pairs: Column, values: Column) -> Column:
    """The mean of values, one for each bucket, over a text's words and pairs; null without words."""
    last = F.lit(BUCKETS - 1)

    def mean(v: Column) -> Column:
        of_words = F.aggregate(words, F.lit(0.0), lambda s, w: s + v[F.xxhash64(w).bitwiseAND(last)])
        total = F.aggregate(pairs, of_words, lambda s, h: s + v[h.bitwiseAND(last)])
        return F.when(F.size(words) > 0, total / (F.size(words) + F.size(pairs)))

    return let(values, mean)


def quantile_of(values: DataFrame, q: float) -> float | None:
    """The exact quantile of the one column, between two values by interpolation; null if there is none. The values up to it are sorted, not all."""
    (name,), n = values.columns, values.count()
    if not n:
        return None
    place = q * (n - 1)
    at = int(place)
    low = values.orderBy(name).limit(at + 2).groupBy(name).count().orderBy(F.desc(name)).limit(2).collect()  # the last two values, the larger first
    if n == at + 1:
        return low[0][0]
    below = low[0][0] if low[0][1] > 1 else low[1][0]
    return below + (low[0][0] - below) * (place - at)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    own = docs.select("doc_id", "text")
    return Ratio(own, labels).judged(own).select("doc_id", *[F.col(f"q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")])


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    name = "q"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return Ratio(docs, labels).judged(docs, name).where(f"{name}.kept").drop(name)
