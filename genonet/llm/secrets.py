"""Secret scan: base patterns and a character Markov model, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three patterns. The method adds spans of
kind ``random``: tokens of ``MIN_TOKEN`` characters or more, outside all base spans, whose bigrams are
likelier under a Markov model of random strings than under one of ordinary identifiers, by
``THRESHOLD`` nats a bigram. Both models are first-order over ASCII characters, backed off to the
classes of characters (lower case, upper case, digits, signs): how often one class follows another, and how
frequent a character is in its class, or how often one comes again. So letters after letters speak little for a random
string in whatever language, and changes between classes much. The models are trained on labelled samples made here: digests in every
alphabet that tokens may have for random strings; for ordinary ones joined words in the usual
spellings, paths, dates, numbers, and runs of one character, of an alphabet and of a keyboard's row.
shapes() makes strings of other shapes, which the threshold is held against.
The table of log ratios has 128 x 128 cells whatever the data, and goes into the plan as a
literal. The scan is one pass without a shuffle; a text is only cut up where a cheap test finds a
candidate. A token is split into its characters once, so that time goes with its length.

Positions count code points; ends are exclusive. Defined results: null and empty texts have no
span. Equal rows give equal rows; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, match_spans, no_spans

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: Kind, pattern, its group whose length counts, least length, and a cheaper test that any match passes.
BASE = (
    ("assign", ASSIGN, 1, 6, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    ("access", ACCESS, 0, 20, "AKIA"),
    ("hex", HEX, 0, 24, "[0-9a-f]{24}"),
)
MIN_TOKEN = 20
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 0.3
SAMPLES = 7000
#: Share of the classes' estimate in that of a pair of characters.
BACK_OFF = 0.3
#: What identifiers of the training sample are made of.
WORDS = (
    "account active address agent alert amount archive array author batch block board buffer build button cache call card case channel "
    "chart check class client clock cluster code color column command comment config connect content context control copy count cursor "
    "data date default delete detail device dialog digest display document domain driver editor element email engine entry error event "
    "export factory feature field file filter folder format frame function gateway graph group handler header height history image import "
    "index info input item job label language layer layout length level library limit line link list loader local location logger manager "
    "map marker member memory message method metric model module monitor name network node notice number object offset option order output "
    "owner package page panel parameter parent parser path pattern person pixel player plugin point policy position price process product "
    "profile project property provider queue range reader record region report request resource response result route rule sample scale "
    "schedule schema scope screen search section select sensor server service session setting shape signal size source stack state status "
    "storage stream string style subject summary switch symbol system table target task template text theme thread ticket time title total "
    "track traffic transfer tree trigger type unit update user value vector version video view visitor volume widget window worker writer "
    "ungen heit keit lich schaft ment tion amiento cion ados eaux elle aient ouer"
).split()


#: Rows of alphabets and keyboards, forwards and backwards.
RUNS = [r for row in (LOWER, UPPER, "0123456789", "qwertyuiop", "asdfghjkl", "zxcvbnm", "QWERTYUIOP", "ASDFGHJKL", "ZXCVBNM", "qwertyuiopasdfghjklzxcvbnm") for r in (row, row[::-1])]


def _char(pool: str, number: Column) -> Column:
    return F.substr(F.lit(pool), 1 + F.pmod(number, F.lit(len(pool))).cast("int"), F.lit(1))


def _digest(salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512)


def _base64(salt: str) -> Column:
    return F.translate(F.base64(F.unhex(_digest(salt))), "=\r\n", "")


def _words(salt: int, n: int = 4) -> Column:
    pool = F.split(F.lit(" ".join(WORDS)), " ")
    return F.array(*[F.get(pool, F.pmod(F.xxhash64("id", F.lit(salt + k)), F.lit(len(WORDS))).cast("int")) for k in range(n)])


def _one_of(kinds: list[Column]) -> Column:
    """Every kind in turn."""
    return F.get(F.array(*kinds), (F.col("id") % len(kinds)).cast("int"))


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """n labelled strings of either kind: s, label (1 random, 0 ordinary). Random ones cover every alphabet that TOKEN admits."""
    ids = spark.range(n)
    plain = F.translate(_base64("b"), "+/", "")
    random = ids.select(_one_of([_digest("a"), F.upper(_digest("a")), _base64("b"), F.translate(_base64("b"), "+/", "-_"), plain, F.lower(plain), F.upper(plain)]).alias("s"), F.lit(1).alias("label"))
    parts, title = _words(0), F.transform(_words(0), F.initcap)
    number = (F.col("id") % 97).cast("string")
    signs = "-_=+/" + LOWER + UPPER + "0123456789"
    line = F.repeat(_char(signs, F.xxhash64("id", F.lit(9))), 40)
    rows = F.split(F.lit(" ".join(RUNS)), " ")
    row = F.get(rows, F.pmod(F.xxhash64("id", F.lit(11)), F.lit(len(RUNS))).cast("int"))
    row = F.substr(F.repeat(row, 3), 1 + F.pmod(F.xxhash64("id", F.lit(12)), F.length(row)).cast("int"), F.lit(30))
    long_number = F.translate(F.substr(F.repeat(F.abs(F.xxhash64("id", F.lit(13))).cast("string"), F.lit(2)), F.lit(1), F.lit(26)), "-", "")
    stamp = F.concat(F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit(14)), F.lit(2_000_000_000))), "yyyy-MM-dd_HH-mm-ss"), F.lit("-"), number)
    twice = F.repeat(F.substr(F.get(parts, F.lit(1)), F.lit(1), 2 + (F.col("id") % 3).cast("int")), 8)
    dated = F.concat(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") % 15000).cast("int")), "yyyy-MM-dd"), F.lit("-"), F.array_join(parts, "-"))
    ordinary = ids.select(_one_of([
        F.array_join(parts, "_"), F.array_join(title, ""), F.upper(F.array_join(parts, "_")), F.array_join(parts, ""), F.concat(F.array_join(parts, "-"), F.lit("-"), number),
        F.concat(F.lit("/"), F.array_join(parts, "/")), F.concat(F.get(parts, F.lit(0)), F.array_join(F.slice(title, 2, 3), ""), number), F.initcap(F.array_join(parts, "")), line, dated, row, long_number, stamp, twice,
    ]).alias("s"), F.lit(0).alias("label"))
    return random.unionByName(ordinary)


def shapes(spark: SparkSession, n: int = 300) -> DataFrame:
    """Strings of shapes that the training samples lack: s, shape, label. The threshold is held against these."""
    ids, hexed, plain, url = spark.range(n), _digest("q"), F.translate(_base64("q"), "+/", ""), F.translate(_base64("q"), "+/", "-_")
    cut = lambda c, at, size: F.substr(c, F.lit(at), F.lit(size))
    number = F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("string")
    words, title = _words(70, 5), F.transform(_words(70, 5), F.initcap)
    rule = F.get(F.split(F.lit("-_=+/"), ""), (F.col("id") % 5).cast("int"))
    found = {
        "uuid": (1, F.concat_ws("-", cut(hexed, 1, 8), cut(hexed, 9, 4), cut(hexed, 13, 4), cut(hexed, 17, 4), cut(hexed, 21, 12))),
        "jwt": (1, F.concat(F.lit("eyJ"), cut(url, 1, 60))), "prefixed": (1, F.concat(F.lit("ghp_"), cut(plain, 1, 36))), "base64": (1, cut(_base64("r"), 1, 40)),
        "chat": (1, F.concat(F.lit("xoxb-"), number, F.lit("-"), cut(plain, 1, 24))), "short": (1, cut(plain, 1, 24)), "dashed": (1, F.concat_ws("-", cut(plain, 1, 6), cut(plain, 7, 6), cut(plain, 13, 6), cut(plain, 19, 6))),
        "rule": (0, F.repeat(rule, 20 + 3)), "mixed rule": (0, F.repeat(F.concat(rule, F.lit("-=")), 9)), "path": (0, F.concat(F.lit("/usr/lib/"), F.array_join(words, "/"))),
        "compound": (0, F.array_join(words, "")), "camel": (0, F.concat(F.get(words, F.lit(0)), F.array_join(F.slice(title, 2, 4), ""))), "constant": (0, F.upper(F.array_join(words, "_"))),
        "file": (0, F.concat(F.array_join(F.slice(words, 1, 3), "-"), F.lit("_v2_"), F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")), "yyyyMMdd"))),
    }
    return ids.select(F.explode(F.array(*[F.struct(v.alias("s"), F.lit(k).alias("shape"), F.lit(label).alias("label")) for k, (label, v) in found.items()])).alias("x")).select("x.*")


def _bigrams(s: Column) -> Column:
    """Numbers of the bigrams of an ASCII string of two characters or more."""
    codes = F.transform(F.split(s, ""), lambda x: F.ascii(x))
    return let(codes, lambda c: F.zip_with(F.slice(c, 1, F.length(s) - 1), F.slice(c, 2, F.length(s) - 1), lambda x, y: x * 128 + y))


def class_of(a: int) -> int:
    """0 lower case, 1 upper case, 2 digits, 3 all else."""
    return 0 if 97 <= a <= 122 else 1 if 65 <= a <= 90 else 2 if 48 <= a <= 57 else 3


def log_ratios(labelled: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for all characters a, b, by a * 128 + b.

    A pair's share is mixed, to the part BACK_OFF, with how often the class of b follows that of a
    times the share of b in its class; for the same character again, with how often characters of
    its class come again (signs apart). These are counted from one up.
    """
    import math

    grams = labelled.where(F.length("s") >= 2).select("label", F.explode(_bigrams(F.col("s"))).alias("g"))
    count = {(r["label"], r["g"]): r["n"] for r in grams.groupBy("label", "g").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 x 128 x 128 rows at most
    kind = [class_of(a) for a in range(128)]
    size = sorted(set(kind))
    of = lambda k, a, b: count.get((k, a * 128 + b), 0)
    logs = []
    for k in (0, 1):
        row = [sum(of(k, a, b) for b in range(128)) for a in range(128)]
        second = [sum(of(k, a, b) for a in range(128)) + 1 for b in range(128)]
        again, same = len(size), lambda a, b: a == b and kind[a] < 3
        steps = {(c, d): 1 for c in size for d in (*size, again)}
        for a in range(128):
            for b in range(128):
                steps[kind[a], again if same(a, b) else kind[b]] += of(k, a, b)
        out = {c: sum(steps[c, d] for d in (*size, again)) for c in size}
        share = {c: sum(second[b] for b in range(128) if kind[b] == c) for c in size}
        back = lambda a, b: (steps[kind[a], again] if same(a, b) else steps[kind[a], kind[b]] * second[b] / share[kind[b]]) / out[kind[a]]  # noqa: B023, E731
        logs.append([math.log((1 - BACK_OFF) * of(k, a, b) / max(row[a], 1) + BACK_OFF * back(a, b)) for a in range(128) for b in range(128)])
    return [x - y for x, y in zip(logs[1], logs[0], strict=True)]


def score(s: Column, ratios: list[float]) -> Column:
    """Mean log ratio of an ASCII string's bigrams."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    return F.aggregate(_bigrams(s), F.lit(0.0), lambda t, g: t + F.get(table, g)) / (F.length(s) - 1)


def _spans(text: Column, rank: int, pattern: str, group: int, least: int, hint: str) -> Column:
    """Spans of the matches that are long enough, as an array of structs s, k (rank), e, m."""
    fine = F.filter(match_spans(text, pattern, rank), lambda x: F.length(F.regexp_extract(x["m"], pattern, group)) >= least)
    return F.when(text.rlike(hint), fine).otherwise(no_spans())


def _text_of(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and spans: arrays of structs (s, k, e, m), k the kind's number (3: random), both sorted."""
    ratios = ratios or log_ratios(samples(docs.sparkSession))
    text = F.coalesce("text", F.lit(""))

    def random(t: Column, base: Column) -> Column:
        likely = F.filter(match_spans(t, TOKEN, len(BASE)), lambda x: score(x["m"], ratios) > threshold)
        free = F.filter(likely, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        return F.when(t.rlike(f"[A-Za-z0-9+/_=-]{{{MIN_TOKEN}}}"), free).otherwise(no_spans())

    def found(t: Column) -> Column:
        base = F.array_sort(F.concat(*[_spans(t, k, p, g, n, h) for k, (_, p, g, n, h) in enumerate(BASE)]))
        return let(base, lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, random(t, b))).alias("spans")))

    return docs.select("doc_id", let(text, found).alias("f")).select("doc_id", "f.base", "f.spans")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of scan()."""
    kinds = [k for k, *_ in BASE] + ["random"]
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return scan(docs).select(
        "doc_id", *[of(k).alias(f"n_{kinds[k]}") for k in range(len(BASE))],
        F.sha2(_text_of(F.col("base"), kinds), 256).alias("base_sha256"), _text_of(F.col("spans"), kinds).alias("spans"),
    )
