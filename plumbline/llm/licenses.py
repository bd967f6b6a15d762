"""License scans with ordered signature rules.

Rules are regexes over a document's words (lower-cased, one blank between). A rule is tried only
where one of its keywords is among the document's words (or a © in the text): whatever a rule
matches has one of them. Rules have priorities: matches are taken in
order of priority, then length, then place, and a match that lies inside one already taken is
suppressed. Base phrases are found wherever their words stand one after another; they keep their
labels whatever the rules say.

A null or empty text has no words, no matches and score 0. Repeated rows are separate documents.
Empty tables give no rows; other columns are passed on, those named like results are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WORD_BYTES, documents, slices

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE_WEIGHT = 0.95

#: label, its identifier as words, names as regexes over words, keyword of the names.
LICENSES = (
    ("mit", "mit", r"mit licen[sc]e|expat licen[sc]e", "mit|expat"),
    ("mit-0", "mit 0", r"mit no attribution(?: licen[sc]e)?", "attribution"),
    ("x11", "x11", r"x11 licen[sc]e|mit x11(?: licen[sc]e)?", "x11"),
    ("apache-1", "apache 1 1", r"apache(?: software)? licen[sc]e(?: version)? 1(?: [01])?", "apache"),
    ("apache-2", "apache 2 0", r"apache(?: software)? licen[sc]e(?: version)? (?:v ?)?2(?: 0)?|apache 2 0", "apache"),
    ("bsd-2", "bsd 2 clause", r"(?:2|two) clause bsd(?: licen[sc]e)?|bsd (?:2|two) clause(?: licen[sc]e)?|simplified bsd licen[sc]e|freebsd licen[sc]e", "bsd|freebsd"),
    ("bsd-3", "bsd 3 clause", r"(?:3|three) clause bsd(?: licen[sc]e)?|bsd (?:3|three) clause(?: licen[sc]e)?|(?:new|revised|modified) bsd licen[sc]e", "bsd"),
    ("bsd-4", "bsd 4 clause", r"(?:4|four) clause bsd(?: licen[sc]e)?|bsd (?:4|four) clause(?: licen[sc]e)?|original bsd licen[sc]e", "bsd"),
    ("bsd-0", "0bsd", r"zero clause bsd(?: licen[sc]e)?|bsd zero clause(?: licen[sc]e)?", "zero"),
    ("isc", "isc", r"isc licen[sc]e|internet systems consortium licen[sc]e", "isc|consortium"),
    ("gpl-1", "gpl 1 0", r"gnu general public licen[sc]e version 1|gpl ?v?1(?: 0)?", "gpl|gnu|gplv1|gpl1"),
    ("gpl-2", "gpl 2 0", r"gnu general public licen[sc]e(?: version)? v?2(?: 0)?|gnu gpl(?: version)? v?2|gpl ?v2(?: 0)?|gpl (?:version )?2(?: 0)?", "gpl|gnu|gplv2"),
    ("gpl-3", "gpl 3 0", r"gnu general public licen[sc]e(?: version)? v?3(?: 0)?|gnu gpl(?: version)? v?3|gpl ?v3(?: 0)?|gpl (?:version )?3(?: 0)?", "gpl|gnu|gplv3"),
    ("lgpl-2", "lgpl 2 0", r"gnu library general public licen[sc]e(?: version)? 2(?: 0)?|lgpl ?v?2(?: 0)?", "library|lgpl|lgplv2|lgpl2"),
    ("lgpl-2.1", "lgpl 2 1", r"gnu lesser general public licen[sc]e(?: version)? v?2 1|lgpl ?v?2 1", "lesser|lgpl|lgplv2|lgpl2"),
    ("lgpl-3", "lgpl 3 0", r"gnu lesser general public licen[sc]e(?: version)? v?3(?: 0)?|lgpl ?v?3(?: 0)?", "lesser|lgpl|lgplv3|lgpl3"),
    ("agpl-3", "agpl 3 0", r"(?:gnu )?affero general public licen[sc]e(?: version)? v?3(?: 0)?|agpl ?v?3(?: 0)?", "affero|agpl|agplv3|agpl3"),
    ("gfdl", "gfdl 1 3", r"gnu free documentation licen[sc]e(?: version 1 [123])?", "documentation"),
    ("mpl-1.1", "mpl 1 1", r"mozilla public licen[sc]e(?: version)? 1 1|mpl 1 1", "mozilla|mpl"),
    ("mpl-2", "mpl 2 0", r"mozilla public licen[sc]e(?: version)? v?2(?: 0)?|mpl ?v?2(?: 0)?", "mozilla|mpl|mplv2|mpl2"),
    ("epl-1", "epl 1 0", r"eclipse public licen[sc]e(?: version)? v?1(?: 0)?", "eclipse"),
    ("epl-2", "epl 2 0", r"eclipse public licen[sc]e(?: version)? v?2(?: 0)?", "eclipse"),
    ("cddl-1", "cddl 1 0", r"common development and distribution licen[sc]e|cddl(?: 1 0)?", "cddl|distribution"),
    ("cpl-1", "cpl 1 0", r"common public licen[sc]e(?: version 1 0)?", "common"),
    ("artistic-1", "artistic 1 0", r"(?:perl )?artistic licen[sc]e(?: version)? 1(?: 0)?", "artistic"),
    ("artistic-2", "artistic 2 0", r"(?:perl )?artistic licen[sc]e(?: version)? 2(?: 0)?", "artistic"),
    ("bsl-1", "bsl 1 0", r"boost software licen[sc]e(?: version)?(?: 1 0)?", "boost"),
    ("busl-1.1", "busl 1 1", r"business source licen[sc]e(?: 1 1)?", "business"),
    ("sspl-1", "sspl 1 0", r"server side public licen[sc]e", "server"),
    ("elastic-2", "elastic 2 0", r"elastic licen[sc]e(?: 2 0)?", "elastic"),
    ("unlicense", "unlicense", r"the unlicense|unlicense org", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl|do what the fuck you want to public licen[sc]e", "wtfpl|fuck"),
    ("zlib", "zlib", r"zlib licen[sc]e|zlib libpng licen[sc]e", "zlib"),
    ("libpng", "libpng 2 0", r"libpng licen[sc]e", "libpng"),
    ("openssl", "openssl", r"openssl licen[sc]e|ssleay licen[sc]e", "openssl|ssleay"),
    ("curl", "curl", r"curl licen[sc]e", "curl"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("python-2", "python 2 0", r"python software foundation licen[sc]e(?: version 2)?|psf licen[sc]e", "python|psf"),
    ("php-3", "php 3 01", r"php licen[sc]e(?: version)?(?: 3(?: 01)?)?", "php"),
    ("ruby", "ruby", r"the ruby licen[sc]e", "ruby"),
    ("w3c", "w3c", r"w3c software(?: notice and)? licen[sc]e", "w3c"),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[sc]e|ncsa licen[sc]e", "ncsa"),
    ("afl-3", "afl 3 0", r"academic free licen[sc]e(?: version)?(?: 3 0)?", "academic"),
    ("osl-3", "osl 3 0", r"open software licen[sc]e(?: version)?(?: 3 0)?", "software"),
    ("ecl-2", "ecl 2 0", r"educational community licen[sc]e(?: version)?(?: 2 0)?", "educational"),
    ("eupl-1.2", "eupl 1 2", r"european union public licen[sc]e(?: version)?(?: v? ?1 2)?|eupl(?: 1 2)?", "european|eupl"),
    ("cecill-2.1", "cecill 2 1", r"cecill(?: b| c)?(?: licen[sc]e)?(?: 2 1)?", "cecill"),
    ("upl-1", "upl 1 0", r"universal permissive licen[sc]e", "universal"),
    ("ms-pl", "ms pl", r"microsoft public licen[sc]e", "microsoft"),
    ("ms-rl", "ms rl", r"microsoft reciprocal licen[sc]e", "microsoft"),
    ("ofl-1.1", "ofl 1 1", r"sil open font licen[sc]e(?: version)?(?: 1 1)?", "sil|font"),
    ("mulan-2", "mulanpsl 2 0", r"mulan permissive software licen[sc]e", "mulan"),
    ("vim", "vim", r"vim licen[sc]e", "vim"),
    ("icu", "icu", r"icu licen[sc]e|unicode licen[sc]e", "icu|unicode"),
    ("odbl-1", "odbl 1 0", r"open (?:data commons open )?database licen[sc]e(?: 1 0)?", "database"),
    ("odc-by-1", "odc by 1 0", r"open data commons attribution licen[sc]e", "commons"),
    ("pddl-1", "pddl 1 0", r"open data commons public domain dedication", "commons"),
    ("cc0", "cc0 1 0", r"cc0(?: 1 0)?|creative commons zero(?: 1 0)?|cc zero", "cc0|zero"),
    ("cc-by", "cc by 4 0", r"creative commons attribution(?: licen[sc]e)?|cc by [1-4] [05]|cc by licen[sc]e", "cc|attribution"),
    ("cc-by-sa", "cc by sa 4 0", r"creative commons attribution share ?alike|cc by sa(?: [1-4] [05])?", "cc|attribution"),
    ("cc-by-nd", "cc by nd 4 0", r"creative commons attribution no ?deriv(?:ative)?s|cc by nd(?: [1-4] [05])?", "cc|attribution"),
    ("cc-by-nc", "cc by nc 4 0", r"creative commons attribution non ?commercial|cc by nc(?: [1-4] [05])?", "cc|attribution"),
    ("cc-by-nc-sa", "cc by nc sa 4 0", r"creative commons attribution non ?commercial share ?alike|cc by nc sa(?: [1-4] [05])?", "cc|attribution"),
    ("cc-by-nc-nd", "cc by nc nd 4 0", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd(?: [1-4] [05])?", "cc|attribution"),
    ("rail-m", "openrail", r"(?:creativeml )?open ?rail(?: m)?(?: licen[sc]e)?", "openrail|rail"),
    ("llama-2", "llama2", r"llama 2 community licen[sc]e", "llama"),
)
#: Names that are one only where the wording around them is about a license.
LOOSE = {"mit": "mit", "x11": "x11", "isc": "isc", "cc-by": "cc by", "ruby": r"ruby licen[sc]e", "vim": "vim", "zlib": "zlib", "curl": "curl"}
#: label, regex, keyword, priority, weight: wording of notices and license texts.
NOTICES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby", 70, 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "notice", 70, 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", "permission", 70, 0.9),
    ("bsd-3", r"neither the name of .{1,80}? nor the names of its contributors may be used", "neither", 75, 0.95),
    ("bsd-2", r"redistributions of source code must retain the above copyright notice", "redistributions", 60, 0.8),
    ("bsd-4", r"all advertising materials mentioning features or use of this software", "advertising", 75, 0.9),
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", "gnu", 60, 0.9),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e", "lesser", 60, 0.9),
    ("agpl-3", r"under the terms of the gnu affero general public licen[sc]e", "affero", 60, 0.9),
    ("apache-2", r"you may not use this file except in compliance with the licen[sc]e", "compliance", 60, 0.8),
    ("apache-2", r"licensed to the apache software foundation asf", "apache", 60, 0.8),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public licen[sc]e", "mozilla", 60, 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 70, 0.95),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "warranty", 60, 0.8),
    ("bsl-1", r"boost software licen[sc]e version 1 0 august 17th 2003", "boost", 80, 0.95),
    ("ofl-1.1", r"this font software is licensed under the sil open font licen[sc]e", "sil", 70, 0.95),
    ("public-domain", r"(?:is|are|placed|dedicated) (?:hereby )?(?:in|into|to) the public domain", "domain", 40, 0.7),
    ("public-domain", r"no copyright is claimed|no rights reserved", "no", 30, 0.5),
    ("all-rights-reserved", r"all rights (?:are )?reserved", "reserved", 20, 0.5),
    ("all-rights-reserved", r"alle rechte vorbehalten", "vorbehalten", 20, 0.5),
    ("all-rights-reserved", r"tous droits réservés", "réservés", 20, 0.5),
    ("all-rights-reserved", r"todos los derechos reservados", "reservados", 20, 0.5),
    ("proprietary", r"proprietary and confidential|confidential and proprietary", "proprietary", 50, 0.7),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:of this file )?(?:is )?(?:strictly )?prohibited", "prohibited", 50, 0.7),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", "copyright", 10, 0.3),
    ("copyright", r"©(?: ?(?:19|20)\d\d)?", "©", 10, 0.3),
    ("cc", r"creativecommons org licenses", "creativecommons", 15, 0.4),
    ("gpl", r"gnu general public licen[sc]e|gnu gpl", "gnu", 15, 0.5),
    ("lgpl", r"gnu lesser general public licen[sc]e|lgpl", "lesser|lgpl", 15, 0.5),
    ("bsd", r"bsd (?:style )?licen[sc]e", "bsd", 12, 0.4),
    ("mpl", r"mozilla public licen[sc]e", "mozilla", 12, 0.4),
    ("apache", r"apache(?: software)? licen[sc]e", "apache", 12, 0.4),
    ("epl", r"eclipse public licen[sc]e", "eclipse", 12, 0.4),
    ("artistic", r"artistic licen[sc]e", "artistic", 12, 0.4),
)
#: Wordings around a license's name (N) or identifier (I): regex, priority, weight.
FORMS = (
    (r"spdx licen[sc]e identifier I(?: only| or later)?", 90, 0.98),
    (r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|made available) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:N)", 80, 0.9),
    (r"(?:opensource|choosealicense|spdx|gnu|creativecommons) (?:org|com) licenses? (?:I|N)", 70, 0.85),
    (r"(?:this|the) (?:software|work|file|code|project|content|data|page|article|document|dataset) (?:is|are) (?:under )?(?:the )?(?:N)", 65, 0.8),
    (r"licen[sc]e (?:is )?(?:the )?(?:N|I)", 55, 0.7),
    (r"(?:N)", 45, 0.6),
)


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    pattern: re.Pattern
    keywords: tuple[bytes, ...]
    priority: int
    weight: float


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules, by falling priority: each form for each license, and the notices."""
    found = []
    for label, ident, names, keys in LICENSES:
        for form, priority, weight in FORMS:
            # A form that only needs the identifier is gated by its first word.
            gate = ident.split()[0] if "I" in form and "N" not in form else f"{keys}|{ident.split()[0]}" if "I" in form else keys
            known = f"{names}|{LOOSE[label]}" if label in LOOSE and "licen[sc]e" in form.replace("(?:N)", "") else names
            found.append((label, form.replace("N", known).replace("I", ident), gate, priority + min(4, len(ident.split())), weight))
    found += NOTICES
    found.sort(key=lambda x: -x[3])
    return tuple(Rule(k, label, re.compile(rf"(?<= )(?:{body})(?= )"), tuple(w.encode() for w in keys.split("|")), priority, weight) for k, (label, body, keys, priority, weight) in enumerate(found))


@lru_cache(1)
def by_keyword() -> dict[bytes, tuple[Rule, ...]]:
    """Rules by each of their keywords; 'licen' stands for license, licence and licensed."""
    out = defaultdict(list)
    for rule in rules():
        for w in rule.keywords:
            for x in (b"license", b"licence", b"licensed") if w == b"licen" else (w,):
                out[x].append(rule)
    return {k: tuple(v) for k, v in out.items()}


def gated(present: set[bytes], text: str) -> dict[int, Rule]:
    """The rules that can match a text with these words, by order."""
    gates = by_keyword()
    tried = {r.order: r for w in gates.keys() & present for r in gates[w]}
    if "©" in text:  # a word may begin with it
        tried |= {r.order: r for r in gates["©".encode()]}
    return tried


def find(text: str | None):
    """(words, base places [(word, label)], taken matches [(first word, end word, label, weight)])."""
    words = text.encode().translate(WORD_BYTES).split() if text else []
    if not words:
        return 0, [], []
    present = set(words)
    tried = gated(present, text)
    starts = [(p, label) for p, label in BASE if present.issuperset(p.encode().split())]
    if not tried and not starts:
        return len(words), [], []
    line = f" {b' '.join(words).decode()} "
    spaces = [m.start() for m in re.finditer(" ", line)]
    word_at = lambda place: bisect_left(spaces, place)  # noqa: E731  word that follows the blank at this place
    base = []
    for phrase, label in starts:
        at = line.find(f" {phrase} ")
        while at >= 0:
            base.append((word_at(at), label))
            at = line.find(f" {phrase} ", at + 1)
    met = sorted(((r.priority, m.end() - m.start(), m.start(), m.end(), r) for r in tried.values() for m in r.pattern.finditer(line)), key=lambda x: (-x[0], -x[1], x[2], x[4].order))
    taken: list[tuple[int, int, Rule]] = []
    lows: list[int] = []  # intervals taken so far that lie in no other, by start and so by end
    highs: list[int] = []
    for _, _, a, b, rule in met:
        k = bisect_right(lows, a)
        if k and highs[k - 1] >= b:
            continue
        taken.append((a, b, rule))
        to = k = bisect_left(lows, a)
        while to < len(lows) and highs[to] <= b:
            to += 1
        lows[k:to], highs[k:to] = [a], [b]
    return len(words), base, [(word_at(a - 1), word_at(b), r.label, r.weight) for a, b, r in taken]


MATCH = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("weight", pa.float64())])
PLACE = pa.struct([("word", pa.int64()), ("label", pa.string())])
PLACE_TYPE = T.StructType().add("word", "long").add("label", "string")
MATCH_TYPE = T.StructType().add("first", "long").add("end", "long").add("label", "string").add("weight", "double")


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_words, base_places (word, label) and license_matches (first, end, label, weight)."""
    docs = docs.drop("n_words", "base_places", "license_matches")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("base_places", T.ArrayType(PLACE_TYPE)), T.StructField("license_matches", T.ArrayType(MATCH_TYPE))])

    def search(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [find(t) for t in part.column("text").to_pylist()]
                more = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([[{"word": w, "label": x} for w, x in b] for _, b, _ in found], pa.list_(PLACE)), pa.array([[dict(zip(("first", "end", "label", "weight"), m, strict=True)) for m in ms] for _, _, ms in found], pa.list_(MATCH))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "n_words", "base_places", "license_matches"])

    return docs.mapInArrow(search, schema)


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of every document."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.transform("base_places", lambda x: x["label"])
    labels = F.concat(base, F.transform("license_matches", lambda x: x["label"]))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    missed = F.aggregate("license_matches", F.when(F.size("base_places") > 0, F.lit(1 - BASE_WEIGHT)).otherwise(F.lit(1.0)), lambda a, x: a * (1 - x["weight"]))
    return found.select("doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min(F.transform("base_places", lambda x: x["word"])).alias("first_word"), F.array_max(F.transform("base_places", lambda x: x["word"])).alias("last_word"), joined(base).alias("base_labels"), joined(labels).alias("labels"), F.round(1 - missed, 6).alias("score"))
