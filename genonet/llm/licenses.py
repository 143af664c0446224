"""License scan: ordered signature rules, in DataFrame functions only.

A text becomes its words (A-Z lower-cased) with one space between. A rule is a regular expression
over that, with a label, a priority and keywords, of which every match holds one as a whole word; it
is tried only where the text has one of them. All matches of the rules that are tried are sorted by start and then length; a match
inside an earlier one is suppressed, of two equal or overlapping ones the better priority stays.
The labels of what stays are the method's. Base phrases are looked for on the words themselves
and always stay. The score is the best weight of what was found: 1 for a grant or an identifier,
less for titles, notices and single terms; 0 for nothing.

One pass without a shuffle. Rules and keywords are constants of the plan. Defined results: null
and empty texts have no words and no labels. Repeated rows each get a row; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_ALNUM, ascii_lower, let, match_spans, word_array

#: Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Weight of each priority, best first.
WEIGHTS = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}
V = "(?:version |v )?"
L = "licen[cs]e"
#: Rules by hand: label | priority | keywords, of which every match holds one | expression. {V} is an optional "version", {L} either spelling of license.
RULES = """
mit | 2 | license,licence | (?:the )?(?:mit|expat) {L}
mit | 1 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 3 | substantial | shall be included in all copies or substantial portions of the software
mit | 1 | license,licence | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:mit|expat) {L}
mit-0 | 2 | attribution | mit no attribution(?: {L})?
x11 | 2 | license,licence | x11 {L}
x11 | 3 | consortium | except as contained in this notice the name of the x consortium
apache-2.0 | 1 | apache | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?{L} {V}2(?: 0)?
apache-2.0 | 2 | apache | apache (?:software )?{L} {V}2(?: 0)?
apache-2.0 | 3 | apache | (?:http|https) www apache org {L}s {L} 2 0
apache-1.1 | 2 | apache | apache (?:software )?{L} {V}1 1
apache-1.0 | 2 | apache | apache (?:software )?{L} {V}1 0
apache | 3 | apache | apache (?:software )?{L}
apache-2.0 | 3 | limitations | see the {L} for the specific language governing permissions and limitations
apache | 3 | apache | this product includes software developed by the apache software foundation
bsd-2-clause | 2 | bsd,freebsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: {L})?
bsd-2-clause | 2 | freebsd | freebsd {L}
bsd-3-clause | 2 | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: {L})?
bsd-4-clause | 2 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: {L})?
bsd | 3 | bsd | bsd (?:style )?{L}
bsd | 1 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 2 | endorse | neither the name of .{{1,80}}? may be used to endorse or promote products
bsd-4-clause | 2 | advertising | all advertising materials mentioning features or use of this software must display
0bsd | 2 | bsd,0bsd | (?:zero clause bsd|bsd zero clause|0bsd)(?: {L})?
gpl-2.0 | 1 | gnu | under the (?:terms of the )?gnu (?:general public {L}|gpl) (?:{V}|as published by the free software foundation (?:either )?version )2(?: 0)?
gpl-3.0 | 1 | gnu | under the (?:terms of the )?gnu (?:general public {L}|gpl) (?:{V}|as published by the free software foundation (?:either )?version )3(?: 0)?
gpl-1.0 | 2 | gnu | gnu (?:general public {L}|gpl) {V}1(?: 0)?
gpl-2.0 | 2 | gnu | gnu (?:general public {L}|gpl) {V}2(?: 0)?
gpl-3.0 | 2 | gnu | gnu (?:general public {L}|gpl) {V}3(?: 0)?
gpl-2.0 | 2 | gpl,gplv2 | (?:gpl {V}|gpl ?v)2(?: 0)?
gpl-3.0 | 2 | gpl,gplv3 | (?:gpl {V}|gpl ?v)3(?: 0)?
gpl-2.0 | 2 | gplv2 | gplv2
gpl-3.0 | 2 | gplv3 | gplv3
gpl | 3 | gnu | (?:the )?gnu (?:general public {L}|gpl)
gpl | 3 | gpl,gpled | gpl(?:ed| {L})?
gpl | 4 | public | general public {L}
gpl | 3 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public {L}
gpl-linking | 3 | exception | (?:classpath|linking|gcc runtime library|font) exception
lgpl-2.0 | 2 | lesser,library | (?:gnu )?(?:lesser|library) general public {L} {V}2(?: 0)?
lgpl-2.0 | 2 | library | (?:gnu )?library general public {L} {V}2(?: 0)?
lgpl-2.1 | 2 | lesser | (?:gnu )?lesser general public {L} {V}2 1
lgpl-3.0 | 2 | lesser | (?:gnu )?lesser general public {L} {V}3(?: 0)?
lgpl | 3 | lesser | (?:gnu )?lesser general public {L}
lgpl | 3 | library | gnu library general public {L}
lgpl-2.1 | 2 | lgpl | lgpl {V}2 1
lgpl-3.0 | 2 | lgpl | lgpl {V}3(?: 0)?
lgpl | 3 | lgpl | lgpl(?: {L})?
agpl-3.0 | 2 | affero | (?:gnu )?affero general public {L} {V}3(?: 0)?
agpl-1.0 | 2 | affero | affero general public {L} {V}1(?: 0)?
agpl | 3 | affero | (?:gnu )?affero general public {L}
agpl-3.0 | 2 | agpl | agpl {V}3(?: 0)?
agpl | 3 | agpl | agpl(?: {L})?
gfdl-1.1 | 2 | documentation | (?:gnu )?free documentation {L} {V}1 1
gfdl-1.2 | 2 | documentation | (?:gnu )?free documentation {L} {V}1 2
gfdl-1.3 | 2 | documentation | (?:gnu )?free documentation {L} {V}1 3
gfdl | 3 | documentation | (?:gnu )?free documentation {L}
gfdl | 3 | gfdl | gfdl
mpl-1.0 | 2 | mozilla | mozilla public {L} {V}1 0
mpl-1.1 | 2 | mozilla | mozilla public {L} {V}1 1
mpl-2.0 | 2 | mozilla | mozilla public {L} {V}2(?: 0)?
mpl | 3 | mozilla | mozilla public {L}
mpl-2.0 | 1 | mozilla | this source code form is subject to the terms of the mozilla public {L} v 2 0
mpl-2.0 | 2 | mpl | mpl {V}2(?: 0)?
mpl-1.1 | 2 | mpl | mpl {V}1 1
npl-1.1 | 2 | netscape | netscape public {L}(?: {V}1 1)?
epl-1.0 | 2 | eclipse | eclipse public {L} {V}1 0
epl-2.0 | 2 | eclipse | eclipse public {L} {V}2 0
epl | 3 | eclipse | eclipse public {L}
edl-1.0 | 2 | eclipse | eclipse distribution {L}(?: {V}1 0)?
cpl-1.0 | 2 | common | common public {L}(?: {V}1 0)?
ipl-1.0 | 2 | ibm | ibm public {L}(?: {V}1 0)?
cddl-1.0 | 2 | cddl | cddl(?: {V}1 0)?
cddl-1.1 | 2 | cddl | cddl {V}1 1
cddl-1.0 | 2 | common | common development and distribution {L}(?: {V}1 0)?
cddl-1.1 | 2 | common | common development and distribution {L} {V}1 1
cpal-1.0 | 2 | attribution | common public attribution {L}(?: {V}1 0)?
cc0-1.0 | 1 | cc0 | (?:licensed|released|dedicated|available|published) (?:under|to) (?:the )?cc0(?: 1 0)?
cc0-1.0 | 2 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 2 | dedication | (?:cc0 )?(?:1 0 universal )?public domain dedication
cc-by | 2 | cc | cc by(?: [1-4] [05])?
cc-by-sa | 2 | cc | cc by sa(?: [1-4] [05])?
cc-by-nc | 2 | cc | cc by nc(?: [1-4] [05])?
cc-by-nd | 2 | cc | cc by nd(?: [1-4] [05])?
cc-by-nc-sa | 2 | cc | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 2 | cc | cc by nc nd(?: [1-4] [05])?
cc-by | 1 | cc | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by(?: [1-4] [05])?(?: {L})?
cc-by-sa | 1 | cc | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by sa(?: [1-4] [05])?(?: {L})?
cc-by-nc | 1 | cc | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by nc(?: [1-4] [05])?(?: {L})?
cc-by-nd | 1 | cc | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by nd(?: [1-4] [05])?(?: {L})?
cc-by-nc-sa | 1 | cc | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by nc sa(?: [1-4] [05])?(?: {L})?
cc-by-nc-nd | 1 | cc | (?:licensed|released|distributed|available|published) under (?:the |a )?cc by nc nd(?: [1-4] [05])?(?: {L})?
cc-by | 2 | creative | creative commons attribution(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: {L})?
cc-by-sa | 2 | creative | creative commons attribution share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: {L})?
cc-by-nc | 2 | creative | creative commons attribution non ?commercial(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: {L})?
cc-by-nd | 2 | creative | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: {L})?
cc-by-nc-sa | 2 | creative | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: {L})?
cc-by-nc-nd | 2 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: {L})?
cc | 3 | creative | creative commons(?: {L}s?)?
cc | 3 | creativecommons | creativecommons org {L}s
cc-by | 2 | creativecommons | creativecommons org {L}s by [1-4] [05]
cc-by-sa | 2 | creativecommons | creativecommons org {L}s by sa [1-4] [05]
cc-by-nc | 2 | creativecommons | creativecommons org {L}s by nc [1-4] [05]
cc-by-nd | 2 | creativecommons | creativecommons org {L}s by nd [1-4] [05]
cc-by-nc-sa | 2 | creativecommons | creativecommons org {L}s by nc sa [1-4] [05]
cc-by-nc-nd | 2 | creativecommons | creativecommons org {L}s by nc nd [1-4] [05]
cc0-1.0 | 2 | creativecommons | creativecommons org publicdomain zero 1 0
isc | 2 | license,licence | (?:the )?isc {L}
isc | 1 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee
ntp | 2 | permission | permission to use copy modify and distribute this software and its documentation for any purpose
zlib | 2 | zlib | zlib(?: libpng)? {L}
zlib | 1 | freely | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib | 3 | misrepresented | the origin of this software must not be misrepresented
libpng | 2 | libpng | libpng {L}
unlicense | 2 | unlicense | (?:the )?unlicense
unlicense | 1 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 2 | wtfpl | wtfpl(?: {V}2)?
wtfpl | 1 | want | do what the f\\w+ you want to(?: public {L})?
beerware | 2 | beer | (?:the )?beer ware {L}
beerware | 2 | beerware | beerware
artistic-1.0 | 2 | artistic | artistic {L} {V}1 0
artistic-2.0 | 2 | artistic | artistic {L} {V}2 0
artistic | 3 | artistic | artistic {L}
perl | 2 | perl | same terms as perl(?: itself)?
bsl-1.0 | 2 | boost | boost software {L}(?: {V}1 0)?
busl-1.1 | 2 | business | business source {L}(?: {V}1 1)?
elastic-2.0 | 2 | elastic | elastic {L}(?: {V}2(?: 0)?)?
sspl-1.0 | 2 | server | server side public {L}(?: {V}1)?
python-2.0 | 2 | python | python software foundation {L}(?: {V}2)?
python-2.0 | 3 | psf | psf {L}(?: agreement)?
cnri-python | 2 | cnri | cnri (?:python |open source )?{L}(?: agreement)?
ofl-1.1 | 2 | sil | sil open font {L}(?: {V}1 1)?
ofl-1.0 | 2 | sil | sil open font {L} {V}1 0
ofl-1.1 | 2 | ofl | ofl {V}1 1
eupl-1.1 | 2 | eupl | eupl {V}1 1
eupl-1.2 | 2 | eupl | eupl(?: {V}1 2)?
eupl | 3 | european | european union public {L}
ms-pl | 2 | microsoft | microsoft public {L}
ms-rl | 2 | microsoft | microsoft reciprocal {L}
vim | 2 | vim | vim {L}
ruby | 2 | ruby | ruby {L}
php-3.01 | 2 | php | php {L}(?: {V}3(?: 01| 0)?)?
zend-2.0 | 2 | zend | zend (?:engine )?{L}
curl | 2 | curl | curl {L}
openssl | 2 | openssl | openssl {L}
openssl | 3 | openssl | this product includes software developed by the openssl project
ssleay | 3 | cryptographic | this product includes cryptographic software written by
postgresql | 2 | postgresql | postgresql {L}
ncsa | 2 | ncsa | (?:university of illinois )?ncsa(?: open source)? {L}
afl-3.0 | 2 | academic | academic free {L}(?: {V}3 0)?
afl-2.1 | 2 | academic | academic free {L} {V}2 1
ecl-2.0 | 2 | educational | educational community {L}(?: {V}2 0)?
osl-3.0 | 2 | license,licence | open software {L}(?: {V}3 0)?
osl-2.1 | 2 | license,licence | open software {L} {V}2 1
cecill-2.1 | 2 | cecill | cecill(?: {V}2 1)?
cecill-b | 2 | cecill | cecill b
cecill-c | 2 | cecill | cecill c
qpl-1.0 | 2 | public | q public {L}(?: {V}1 0)?
apsl-2.0 | 2 | apple | apple public source {L}(?: {V}2 0)?
sleepycat | 2 | sleepycat | sleepycat {L}
sisl | 2 | sun | sun industry standards source {L}
spl-1.0 | 2 | sun | sun public {L}(?: {V}1 0)?
watcom-1.0 | 2 | watcom | sybase open watcom public {L}
w3c | 2 | w3c | w3c (?:software(?: notice)?(?: and)? )?{L}
odbl-1.0 | 2 | database | open (?:data commons open )?database {L}(?: {V}1 0)?
odc-by-1.0 | 2 | commons | open data commons attribution {L}(?: {V}1 0)?
pddl-1.0 | 2 | commons | open data commons public domain dedication(?: and {L})?
cdla-permissive | 2 | community | community data {L} agreement permissive
cdla-sharing | 2 | community | community data {L} agreement sharing
ogl-uk | 2 | government | open government {L}(?: {V}[123] 0)?
lppl-1.3c | 2 | latex | latex project public {L}(?: {V}1 3c)?
mulan-2.0 | 2 | mulan | mulan (?:permissive software|psl) {L}(?: {V}2)?
blueoak-1.0 | 2 | blue | blue oak model {L}(?: 1 0 0)?
hippocratic | 2 | hippocratic | hippocratic {L}(?: {V}[123](?: [01])?)?
json | 2 | evil | the software shall be used for good not evil
llama | 2 | community | llama [234](?: [0-9])? community {L}(?: agreement)?
openrail | 2 | openrail | (?:creativeml |bigscience )?openrail(?: m)?
public-domain | 2 | domain | (?:released|placed|dedicated|donated|is|are) (?:in|into|to) the public domain
public-domain | 3 | domain | public domain
public-domain | 3 | copyright | no (?:known )?copyright(?: restrictions)?
proprietary | 2 | proprietary | proprietary and confidential
proprietary | 3 | proprietary | proprietary (?:software|information|{L})
proprietary | 3 | confidential | confidential (?:and proprietary|information)
proprietary | 2 | prohibited | unauthori[sz]ed (?:copying|use|reproduction|distribution) .{{1,60}}?strictly prohibited
proprietary | 3 | permission | (?:without|except with) (?:the )?(?:prior |express |prior written |express written |written )permission
commercial | 3 | commercial | commercial {L}
evaluation | 3 | evaluation | evaluation {L}
eula | 2 | end | end user {L} agreement
eula | 3 | eula | eula
freeware | 3 | freeware | freeware
shareware | 3 | shareware | shareware
dual-license | 3 | dual,dually | dual(?:ly)? licen[cs]ed
reserved | 2 | reserved | (?:all|some|no) rights reserved
reserved | 2 | reservados | (?:todos los )?derechos reservados
reserved | 2 | vorbehalten | alle rechte vorbehalten
reserved | 2 | droits | tous droits r.serv.s
copyright | 3 | copyright,copr | (?:copyright|copr) (?:c )?(?:19|20)[0-9][0-9]
copyright | 4 | copyright | copyright (?:holders?|owners?|notice)
copyright | 4 | copyright,copyrighted | copyrighted|copyright
no-warranty | 3 | warranty | (?:without|no) (?:any )?warranty(?: of any kind)?
no-warranty | 3 | warranties | without warranties or conditions of any kind
no-warranty | 3 | merchantability | (?:warranty|warranties) of merchantability
no-liability | 3 | liable | in no event shall .{{1,120}}? be (?:held )?liable
unknown | 4 | licensed,sublicensed | (?:licensed|sublicensed) (?:under|to)
unknown | 4 | license,licence | (?:open source|free|public|software|see|this) {L}
unknown | 4 | licence | (?:open source|free|public|software|see|this) licence
"""
#: Identifiers that tag lines name; each gives two rules.
IDENTIFIERS = (
    "mit apache-2.0 bsd-2-clause bsd-3-clause gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later lgpl-2.1 lgpl-2.1-only "
    "lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cc0-1.0 "
    "cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 isc zlib unlicense artistic-2.0 bsl-1.0 python-2.0 ofl-1.1 eupl-1.2 ms-pl ncsa"
).split()


@cache
def _gated() -> tuple[tuple[str, int, tuple[str, ...], str], ...]:
    """label, priority, keywords and expression of every rule."""
    out = []
    for line in RULES.strip().split("\n"):
        label, priority, keywords, expression = line.split(" | ", 3)
        out.append((label, int(priority), tuple(keywords.split(",")), expression.format(V=V, L=L)))
    for name in IDENTIFIERS:
        said = name.replace("-", " ").replace(".", " ")
        out.append((name, 1, ("spdx",), f"spdx {L} identifier {said}"))
        out.append((name, 3, ("license", "licence"), f"{L} {said}"))
    return tuple(out)


@cache
def rules() -> tuple[tuple[str, int, str, str], ...]:
    """label, priority, first keyword and expression of every rule."""
    return tuple((label, priority, words[0], e) for label, priority, words, e in _gated())


def _rule_table() -> Column:
    return F.array(*[F.struct(F.lit(k).alias("id"), F.array(*map(F.lit, words)).alias("words"), F.lit(f"(?<= )(?:{e})(?= )").alias("re")) for k, (_, _, words, e) in enumerate(_gated())])


def _detected(text: Column, present: Column) -> Column:
    """Spans of all rules one of whose keywords the text has; k is the rule's number."""
    tried = F.filter(_rule_table(), lambda r: F.arrays_overlap(present, r["words"]))
    return F.flatten(F.transform(tried, lambda r: match_spans(text, r["re"], r["id"])))


def _resolved(spans: Column) -> Column:
    """Numbers of the rules that keep a span, after suppression; one pass over the spans by start, longest first.

    A span inside the one that holds falls; one that reaches over its end takes its place if its priority is better,
    else it falls. What a span replaced or kept out does not come back where that span is replaced later.
    """
    priority = F.array(*[F.lit(p) for _, p, _, _ in rules()])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), F.get(priority, x["k"]).alias("p"), x["k"].alias("k"))))
    start = F.struct(F.lit(-1).alias("e"), F.lit(9).alias("p"), F.lit(-1).alias("k"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        e = -x["n"]
        inside, overlap = e <= a["e"], x["s"] < a["e"]
        better = ~inside & overlap & (x["p"] < a["p"])
        free = ~overlap & ~inside
        take = better | free
        flushed = F.when(free & (a["k"] >= 0), F.array_union(a["out"], F.array(a["k"]))).otherwise(a["out"])
        return F.struct(F.when(take, e).otherwise(a["e"]).alias("e"), F.when(take, x["p"]).otherwise(a["p"]).alias("p"), F.when(take, x["k"]).otherwise(a["k"]).alias("k"), flushed.alias("out"))

    return F.aggregate(ordered, start, step, lambda a: F.when(a["k"] >= 0, F.array_union(a["out"], F.array(a["k"]))).otherwise(a["out"]))


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand, from 0."""
    first, *rest = phrase.split(" ")

    def here(i: Column) -> Column:
        same = F.get(words, i) == first
        for k, w in enumerate(rest, 1):
            same = same & (F.get(words, i + k) == w)
        return F.coalesce(same, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _numbered(places: Column, k: int) -> Column:
    return F.transform(places, lambda w: F.struct(w.alias("w"), F.lit(k).alias("p")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (of base phrases: word, phrase number) and rules (numbers of the rules that stay)."""
    keywords = F.array(*map(F.lit, sorted({w for _, _, words, _ in _gated() for w in words} | {p.split(" ")[-1] for p in PHRASES})))
    none, no_rule = F.array().cast("array<struct<w:int,p:int>>"), F.array().cast("array<int>")

    def of_text(words: Column, present: Column) -> Column:
        def found(text: Column) -> Column:
            places = [F.when(text.contains(f" {p} "), _numbered(_places(words, p), k)).otherwise(none) for k, p in enumerate(PHRASES)]
            return F.struct(F.concat(*places).alias("places"), _resolved(_detected(text, present)).alias("rules"))

        return let(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), found)

    def of_words(words: Column) -> Column:
        some = let(F.array_intersect(keywords, words), lambda k: F.when(F.size(k) > 0, of_text(words, k)).otherwise(F.struct(none.alias("places"), no_rule.alias("rules"))))
        return F.struct(F.size(words).cast("long").alias("n_words"), some.alias("f"))

    rows = docs.select("doc_id", let(word_array(ascii_lower(F.col("text")), NON_ALNUM), of_words).alias("r"))
    return rows.select("doc_id", "r.n_words", "r.f.places", "r.f.rules")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of scan()."""
    names, base_names = F.array(*[F.lit(r[0]) for r in rules()]), F.array(*map(F.lit, PHRASES.values()))
    weight = F.array(*[F.lit(WEIGHTS[r[1]]) for r in rules()])
    base = F.array_distinct(F.transform("places", lambda x: F.get(base_names, x["p"])))
    own = F.transform("rules", lambda k: F.get(names, k))
    best = F.coalesce(F.array_max(F.transform("rules", lambda k: F.get(weight, k))), F.lit(0.0))
    return scan(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["w"])).cast("long").alias("first_word"), F.array_max(F.transform("places", lambda x: x["w"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.greatest(best, F.lit(0.5))).otherwise(best).alias("score"),
    )
