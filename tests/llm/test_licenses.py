import re

from genonet.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = WORD.findall((text or "").translate(FOLD))
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))


def brute_rules(text):
    """The method again: all matches, then suppression, one by one."""
    norm = " " + " ".join(WORD.findall((text or "").translate(FOLD))) + " "
    spans = []
    for k, (_, p, word, e) in enumerate(licenses.rules()):
        if f" {word} " in norm:
            spans += [(m.start(), -m.end(), p, k) for m in re.finditer(f"(?<= )(?:{e})(?= )", norm)]
    kept = []
    for s, n, p, k in sorted(spans):
        if kept and -n <= kept[-1][1]:
            continue
        if kept and s < kept[-1][1]:
            if p >= kept[-1][2]:
                continue
            kept.pop()
        kept.append((s, -n, p, k))
    return {licenses.rules()[k][0] for *_, k in kept}


EDGE = [
    (1, None), (2, ""), (3, "All rights RESERVED. all rights reserved, all rights"), (3, "CC-BY 4.0"), (4, "Released under the MIT License."),
    (5, "This work is licensed under the GNU General Public License, version 3."), (6, "Licensed under the Apache License, Version 2.0; cc by cc by"), (7, "er ist mit der"),
    (8, "SPDX-License-Identifier: GPL-2.0-or-later"), (9, "cc by-nc 4.0 " * 800), (10, "Cc By é general\npublic\tlicense K licence"), (11, "word " * 50000 + "all rights reserved"),
]


def test_rules_are_many_and_compile():
    assert len(licenses.rules()) > 250 and all(re.compile(r[3]) for r in licenses.rules())
    assert all(k in r[3] or r[2] in ("license", "licence") for r in licenses.rules() for k in [r[2][:3]])


def test_base_and_labels(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in EDGE], "doc_id long, text string, labels string")
    rows = licenses.report(docs).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in rows))) == sorted(map(repr, ((i, *brute(t)) for i, t in EDGE)))
    texts = dict(EDGE)
    for r in rows:
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        if r.doc_id != 3:
            base = set(r.base_labels.split(",")) - {""}
            assert set(r.labels.split(",")) - {""} == base | brute_rules(texts[r.doc_id])
    by = {r.doc_id: r.labels for r in rows if r.doc_id != 3}
    assert by[4] == "mit" and by[5] == "gpl,gpl-3.0" and by[7] == "" and by[8] == "gpl-2.0-or-later"
    assert licenses.report(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.report(docs).collect():
        assert tuple(r)[1:6] == brute(texts[r.doc_id])
        assert set(r.labels.split(",")) - {""} == (set(r.base_labels.split(",")) - {""}) | brute_rules(texts[r.doc_id])


def ungated(text):
    """brute_rules() with every rule tried on every text."""
    norm = " " + " ".join(WORD.findall((text or "").translate(FOLD))) + " "
    kept = []
    for s, n, p, k in sorted((m.start(), -m.end(), r[1], k) for k, r in enumerate(licenses.rules()) for m in re.finditer(f"(?<= )(?:{r[3]})(?= )", norm)):
        if kept and (-n <= kept[-1][1] or s < kept[-1][1] and p >= kept[-1][2]):
            continue
        if kept and s < kept[-1][1]:
            kept.pop()
        kept.append((s, -n, p, k))
    return {licenses.rules()[k][0] for *_, k in kept}


def test_rules_are_tried_wherever_they_match(spark):
    """Each text matches a rule by another word than the rule's first keyword."""
    texts = [
        "Released under the MIT licence", "the ISC Licence", "X11 licence", "open software licence 3.0", "open software licence 2.1", "licence: mpl 2.0", "free licence", "0BSD", "FreeBSD", "dually licensed", "dually licenced",
        "copyrighted", "Copr. 2001", "GPLed", "gplv2.0", "gplv3.0", "GNU library general public licence 2", "sublicensed to", "Unauthorised copying is strictly prohibited", "unauthorized use (un)strictly prohibited",
        "unauthorized use, unstrictly prohibited",
    ]
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in licenses.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got.values()) and [got[i] for i in (0, 7, 9, 11, 12)] == [{"mit"}, {"0bsd"}, {"dual-license"}, {"copyright"}, {"copyright"}]
    assert got == {i: ungated(t) for i, t in enumerate(texts)}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.report(docs).collect():
        assert set(r.labels.split(",")) - {""} == (set(r.base_labels.split(",")) - {""}) | ungated(texts[r.doc_id])
