import random
import time
import zlib
from functools import lru_cache

import numpy as np
import sentencepiece

from genonet.llm import pieces
from genonet.llm.tokencount import SPACE, model_path

PATH = model_path()
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
SCORES = {p: (i, s) for p, i, s in pieces.vocabulary(PATH).pieces}
LONGEST = max(map(len, SCORES))


@lru_cache(None)
def brute_part(text):
    """Viterbi over a whole text, character by character."""
    best, last = [0.0], [(0, [])]
    for e in range(1, len(text) + 1):
        top = None
        for n in range(1, min(e, LONGEST) + 1):
            piece = text[e - n : e]
            if piece in SCORES:
                i, s = SCORES[piece]
                ids = [i]
            elif n == 1:
                s, ids = pieces.FALLBACK, [3 + b for b in piece.encode()]
            else:
                continue
            if top is None or best[e - n] + s >= top[0]:
                top = (best[e - n] + s, n, ids)
        best.append(top[0])
        last.append(top[1:])
    out, e = [], len(text)
    while e:
        n, ids = last[e]
        out.append(ids)
        e -= n
    return [i for ids in reversed(out) for i in ids]


def brute(text):
    return brute_part(SPACE + text.replace(" ", SPACE)) if text else []


EDGE = [(1, None), (2, ""), (3, "Hello, the world isn't new."), (3, "Hello, the world isn't new."), (4, "a\nb  c\t<s> é 😀 ​ 中²."), (5, " "), (6, "x" * 400), (7, "thing " * 3000), (8, f"a{SPACE}b"), (10, "日本語のテキスト。" * 40), (11, "é" * 300 + "ab"), (9, "1234,5.6e7 über straße «q» “x”")]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in EDGE], "doc_id long, text string, ids string")
    texts = dict(EDGE)
    for known in (pieces.KNOWN, 7, 0):
        rows = pieces.encode(docs, known=known).collect()
        assert len(rows) == len(EDGE)
        for r in rows:
            assert r.ids == brute(texts[r.doc_id] or ""), r.doc_id
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert back == {i: (t or "").replace(SPACE, " ") for i, t in EDGE}
    assert all(r.round_trip for r in pieces.report(docs).collect())
    assert pieces.report(docs.limit(0)).count() == 0


def test_decoding_is_the_librarys(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pieces.encode(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert SP.decode(r.ids) == texts[r.doc_id]
        assert r.ids == brute(texts[r.doc_id]), r.doc_id
    digests = {r.doc_id: r for r in pieces.report(docs).collect()}
    for r in rows:
        d = digests[r.doc_id]
        assert (d.n_pieces, d.ids_crc32, d.round_trip, d.n_bytes) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()), True, len(texts[r.doc_id].encode()))


def test_runs_of_wide_characters_are_cut(spark):
    """A text of 50,000 characters without a space: cut where no piece spans, by the same ids, in time that goes with its length."""
    own, rng = pieces.vocabulary(PATH), random.Random(3)
    used = sorted({c for p in SCORES for c in p if ord(c) > 127})
    texts = ["".join(rng.choice(["日", "本", "語", "の", "テ", "キ", "ス", "ト", "。", "é", "ü", "😀", "Д", "а", rng.choice(used)]) for _ in range(n)) for n in (5_000, 50_000)]
    data = np.frombuffer(texts[0].encode(), np.uint8)
    starts, ends, _ = own.units(data, np.array([0, len(data)]))
    assert (ends - starts).max() < 200 and starts[0] == 0 and (starts[1:] == ends[:-1]).all() and ends[-1] == len(data)
    took = []
    for k, text in enumerate(texts):
        began = time.time()
        row = pieces.encode(spark.createDataFrame([(k, text)], "doc_id long, text string")).first()
        took.append(time.time() - began)
        assert row.ids == brute(text)
    assert took[1] < 10 * took[0]
