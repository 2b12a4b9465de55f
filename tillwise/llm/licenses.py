"""License scans by ordered signature rules.

Rules are regular expressions over a text's words, one space between two. A rule is tried only where
all its gate words occur. Of overlapping detections those lying within one of higher priority, or of
the same priority and more words, are suppressed; detections of base phrases are always kept.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Confidence of a detection by the priority of its rule.
TAG, SITE, CLAUSE, NOTICE, NAME, PHRASE = 6, 5, 4, 3, 2, 1
CONFIDENCE = {TAG: 1.0, SITE: 0.95, CLAUSE: 0.95, NOTICE: 0.9, NAME: 0.75, PHRASE: 0.5}

# Phrases and labels of the base.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

LICENCE = "licen[cs]e"
V = "(?: (?:v|version|ver) ?| )"
# label, identifier, gate words of the name, name, gate word of the address, address (empty: none)
LICENSES = (
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", "gnu", f"(?:gnu general public {LICENCE}|gnu gpl){V}1(?: 0)?", "gnu", "gnu org licenses old licenses gpl 1 0"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", "gnu", f"(?:gnu general public {LICENCE}|gnu gpl)(?: as published by the free software foundation(?: either)?)?{V}2(?: 0)?", "gnu", "gnu org licenses(?: old licenses)? gpl 2 0"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", "gnu", f"(?:gnu general public {LICENCE}|gnu gpl)(?: as published by the free software foundation(?: either)?)?{V}3(?: 0)?", "gnu", "gnu org licenses gpl(?: 3 0)?"),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", "gnu", f"gnu (?:library|lesser) general public {LICENCE}{V}2 0", "gnu", "gnu org licenses(?: old licenses)? lgpl 2 0"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "gnu", f"(?:gnu lesser general public {LICENCE}|gnu lgpl)(?: as published by the free software foundation(?: either)?)?{V}2 1", "gnu", "gnu org licenses(?: old licenses)? lgpl 2 1"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", "gnu", f"(?:gnu lesser general public {LICENCE}|gnu lgpl)(?: as published by the free software foundation(?: either)?)?{V}3(?: 0)?", "gnu", "gnu org licenses lgpl(?: 3 0)?"),
    ("lgpl", "lgpl", "gnu", f"gnu (?:lesser|library) general public {LICENCE}", "", ""),
    ("agpl-1.0", "agpl 1 0(?: only| or later)?", "affero", f"affero general public {LICENCE}{V}1(?: 0)?", "affero", "affero org oagpl"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", "affero", f"gnu affero general public {LICENCE}(?: as published by the free software foundation(?: either)?)?{V}3(?: 0)?", "gnu", "gnu org licenses agpl(?: 3 0)?"),
    ("agpl", "agpl", "affero", f"(?:gnu )?affero general public {LICENCE}", "", ""),
    ("gfdl-1.1", "gfdl 1 1(?: only| or later)?", "documentation", f"gnu free documentation {LICENCE}{V}1 1", "gnu", "gnu org licenses(?: old licenses)? fdl 1 1"),
    ("gfdl-1.2", "gfdl 1 2(?: only| or later)?", "documentation", f"gnu free documentation {LICENCE}{V}1 2", "gnu", "gnu org licenses(?: old licenses)? fdl 1 2"),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?", "documentation", f"gnu free documentation {LICENCE}{V}1 3", "gnu", "gnu org licenses fdl 1 3"),
    ("gfdl", "gfdl", "documentation", f"gnu free documentation {LICENCE}", "gnu", "gnu org (?:copyleft|licenses) fdl"),
    ("apache-1.0", "apache 1 0", "apache", f"apache(?: software)? {LICENCE}{V}1 0", "apache", "apache org licenses license 1 0"),
    ("apache-1.1", "apache 1 1", "apache", f"apache(?: software)? {LICENCE}{V}1 1", "apache", "apache org licenses license 1 1"),
    ("apache-2.0", "apache 2 0", "apache", f"apache(?: software)? {LICENCE}{V}2 0|apache{V}2 0 {LICENCE}", "apache", "apache org licenses license 2 0"),
    ("mit", "mit", "mit", f"mit {LICENCE}", "mit", "opensource org licenses mit"),
    ("mit", "", "expat", f"expat {LICENCE}", "expat", "directory fsf org wiki license expat"),
    ("mit-0", "mit 0", "attribution", f"mit no attribution(?: {LICENCE})?", "mit", "opensource org licenses mit 0"),
    ("x11", "x11", "x11", f"x11 {LICENCE}", "", ""),
    ("0bsd", "0bsd", "0bsd", f"0bsd {LICENCE}|0bsd", "0bsd", "opensource org licenses 0bsd"),
    ("bsd-2-clause", "bsd 2 clause", "bsd", f"(?:2|two) clause(?: simplified)? bsd(?: {LICENCE})?|(?:simplified|freebsd) bsd {LICENCE}|bsd 2 clause(?: {LICENCE})?", "bsd", "opensource org licenses bsd (?:2 clause|license)"),
    ("bsd-3-clause", "bsd 3 clause", "bsd", f"(?:3|three) clause bsd(?: {LICENCE})?|(?:new|modified|revised) bsd {LICENCE}|bsd 3 clause(?: {LICENCE})?", "bsd", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause", "bsd", f"(?:4|four) clause bsd(?: {LICENCE})?|original bsd {LICENCE}|bsd 4 clause(?: {LICENCE})?", "", ""),
    ("bsd", "bsd", "bsd", f"bsd(?: style)? {LICENCE}", "", ""),
    ("isc", "isc", "isc", f"isc {LICENCE}", "isc", "opensource org licenses isc"),
    ("mpl-1.0", "mpl 1 0", "mozilla", f"mozilla public {LICENCE}{V}1 0", "mozilla", "mozilla org mpl 1 0"),
    ("mpl-1.1", "mpl 1 1", "mozilla", f"mozilla public {LICENCE}{V}1 1", "mozilla", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mpl 2 0", "mozilla", f"mozilla public {LICENCE}{V}2 0", "mozilla", "mozilla org mpl 2 0"),
    ("mpl", "mpl", "mozilla", f"mozilla public {LICENCE}", "mozilla", "mozilla org mpl"),
    ("epl-1.0", "epl 1 0", "eclipse", f"eclipse public {LICENCE}{V}1 0", "eclipse", "eclipse org legal epl v10"),
    ("epl-2.0", "epl 2 0", "eclipse", f"eclipse public {LICENCE}{V}2 0", "eclipse", "eclipse org legal epl (?:2 0|v20)"),
    ("epl", "epl", "eclipse", f"eclipse public {LICENCE}", "", ""),
    ("edl-1.0", "edl 1 0", "eclipse", f"eclipse distribution {LICENCE}{V}1 0", "eclipse", "eclipse org org documents edl v10"),
    ("cddl-1.0", "cddl 1 0", "distribution", f"common development and distribution {LICENCE}{V}1 0", "cddl", "opensource org licenses cddl 1 0"),
    ("cddl-1.1", "cddl 1 1", "distribution", f"common development and distribution {LICENCE}{V}1 1", "cddl", "glassfish java net public cddl"),
    ("cpl-1.0", "cpl 1 0", "common", f"common public {LICENCE}{V}1 0", "cpl", "opensource org licenses cpl 1 0"),
    ("ipl-1.0", "ipl 1 0", "ibm", f"ibm public {LICENCE}{V}1 0", "ibmpl", "opensource org licenses ibmpl"),
    ("cc0-1.0", "cc0 1 0", "cc0", f"cc0{V}1 0(?: universal)?|cc0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc-pdm-1.0", "cc pdm 1 0", "mark", "creative commons public domain mark(?: 1 0)?", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("unlicense", "unlicense", "unlicense", "the unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "wtfpl", f"(?:the )?wtfpl(?: {LICENCE})?", "wtfpl", "wtfpl net"),
    ("zlib", "zlib", "zlib", f"zlib(?: libpng)? {LICENCE}", "zlib", "(?:opensource org licenses zlib|zlib net zlib license)"),
    ("libpng", "libpng(?: 2 0)?", "libpng", f"libpng {LICENCE}(?:{V}2)?", "libpng", "libpng org pub png src libpng license"),
    ("bsl-1.0", "bsl 1 0", "boost", f"boost software {LICENCE}{V}1 0", "boost", "boost org license 1 0"),
    ("artistic-1.0", "artistic 1 0(?: perl| cl8)?", "artistic", f"artistic {LICENCE}{V}1 0", "artistic", "opensource org licenses artistic license 1 0"),
    ("artistic-2.0", "artistic 2 0", "artistic", f"artistic {LICENCE}{V}2 0", "artistic", "opensource org licenses artistic license 2 0"),
    ("artistic", "artistic", "artistic", f"(?:the )?(?:perl )?artistic {LICENCE}", "", ""),
    ("postgresql", "postgresql", "postgresql", f"postgresql {LICENCE}", "postgresql", "postgresql org about licen[cs]e"),
    ("ofl-1.0", "ofl 1 0", "sil", f"sil open font {LICENCE}{V}1 0", "", ""),
    ("ofl-1.1", "ofl 1 1", "sil", f"sil open font {LICENCE}{V}1 1", "sil", "scripts sil org ofl"),
    ("python-2.0", "(?:python|psf) 2 0", "python", f"python software foundation {LICENCE}(?:{V}2)?", "python", "docs python org 3 license"),
    ("eupl-1.1", "eupl 1 1", "european", f"european union public {LICENCE}{V}1 1", "", ""),
    ("eupl-1.2", "eupl 1 2", "european", f"european union public {LICENCE}{V}1 2", "eupl", "joinup ec europa eu collection eupl"),
    ("ms-pl", "ms pl", "microsoft", f"microsoft public {LICENCE}", "ms", "opensource org licenses ms pl"),
    ("ms-rl", "ms rl", "microsoft", f"microsoft reciprocal {LICENCE}", "ms", "opensource org licenses ms rl"),
    ("afl-2.1", "afl 2 1", "academic", f"academic free {LICENCE}{V}2 1", "", ""),
    ("afl-3.0", "afl 3 0", "academic", f"academic free {LICENCE}{V}3 0", "afl", "opensource org licenses afl 3 0"),
    ("osl-3.0", "osl 3 0", "open", f"open software {LICENCE}{V}3 0", "osl", "opensource org licenses osl 3 0"),
    ("ruby", "ruby", "ruby", f"ruby(?: s)? {LICENCE}", "ruby", "ruby lang org en about license"),
    ("php-3.01", "php 3 01", "php", f"php {LICENCE}{V}3 01", "php", "php net license 3 01"),
    ("openssl", "openssl", "openssl", f"openssl {LICENCE}", "openssl", "openssl org source license"),
    ("ncsa", "ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {LICENCE}", "ncsa", "opensource org licenses ncsa"),
    ("vim", "vim", "vim", f"vim {LICENCE}", "", ""),
    ("lppl-1.3c", "lppl 1 3c", "latex", f"latex project public {LICENCE}(?:{V}1 3c?)?", "latex", "latex project org lppl"),
    ("cecill-2.1", "cecill 2 1", "cecill", f"cecill(?: free software)? {LICENCE}(?: agreement)?(?:{V}2 1)?", "cecill", "cecill info licences"),
    ("odbl-1.0", "odbl 1 0", "database", f"open(?: data commons open)? database {LICENCE}(?:{V}1 0)?", "opendatacommons", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "odc by 1 0", "commons", f"open data commons attribution {LICENCE}(?:{V}1 0)?", "opendatacommons", "opendatacommons org licenses by"),
    ("pddl-1.0", "pddl 1 0", "dedication", f"public domain dedication and {LICENCE}(?:{V}1 0)?", "opendatacommons", "opendatacommons org licenses pddl"),
    ("busl-1.1", "busl 1 1", "business", f"business source {LICENCE}(?:{V}1 1)?", "mariadb", "mariadb com bsl11"),
    ("sspl-1.0", "sspl 1 0", "server", f"server side public {LICENCE}(?:{V}1(?: 0)?)?", "mongodb", "mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic 2 0", "elastic", f"elastic {LICENCE}{V}2 0", "elastic", "elastic co licensing elastic license"),
    ("w3c", "w3c", "w3c", f"w3c software(?: notice)?(?: and)? {LICENCE}", "w3", "w3 org consortium legal"),
    ("upl-1.0", "upl 1 0", "universal", f"universal permissive {LICENCE}(?:{V}1 0)?", "upl", "oss oracle com licenses upl"),
    ("zpl-2.1", "zpl 2 1", "zope", f"zope public {LICENCE}(?:{V}2 1)?", "zope", "zope org resources zpl"),
    ("sleepycat", "sleepycat", "sleepycat", f"sleepycat {LICENCE}", "", ""),
    ("ecl-2.0", "ecl 2 0", "educational", f"educational community {LICENCE}{V}2 0", "ecl", "opensource org licenses ecl 2 0"),
    ("qpl-1.0", "qpl 1 0", "q", f"q public {LICENCE}(?:{V}1 0)?", "qtpl", "opensource org licenses qtpl"),
    ("beerware", "beerware", "beer", f"(?:the )?beer ware {LICENCE}", "", ""),
    ("curl", "curl", "curl", f"curl {LICENCE}", "curl", "curl se docs copyright"),
    ("json", "json", "json", f"json {LICENCE}", "json", "json org license"),
    ("icu", "icu", "icu", f"icu {LICENCE}", "", ""),
    ("unicode-dfs", "unicode dfs 201[56]", "unicode", f"unicode(?: inc)? {LICENCE} agreement", "unicode", "unicode org copyright"),
    ("openldap-2.8", "oldap 2 8", "openldap", f"openldap public {LICENCE}(?:{V}2 8)?", "openldap", "openldap org software release license"),
)
# Creative Commons: every mix of conditions in every version.
CONDITIONS = {
    "by": "attribution",
    "by-sa": "attribution share ?alike",
    "by-nc": "attribution non ?commercial",
    "by-nd": "attribution no ?deriv(?:s|ative works|atives)",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:s|ative works|atives)",
}
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# label, gate words, sentence
CLAUSES = (
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "endorse promote", "neither the names? of [a-z0-9 ]{1,120}may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "hereby fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "hereby fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("gpl", "redistribute gnu", f"you can redistribute it and or modify it under the terms of the gnu general public {LICENCE}"),
    ("lgpl", "redistribute gnu", f"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public {LICENCE}"),
    ("agpl", "redistribute affero", f"you can redistribute it and or modify it under the terms of the gnu affero general public {LICENCE}"),
    ("gfdl", "invariant sections", "with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"),
    ("apache-2.0", "compliance apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at(?: https?)?(?: www)? apache org licenses license 2 0"),
    ("apache-2.0", "perpetual irrevocable", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("mpl-2.0", "mozilla mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file"),
    ("epl-2.0", "accompanying eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl-1.0", "obtain glassfish", "you can obtain a copy of the license at(?: https?)? glassfish"),
    ("unlicense", "unencumbered domain", "this is free and unencumbered software released into the public domain"),
    ("zlib", "altered misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", "accompanying hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("wtfpl", "fuck public", f"do what the fuck you want to public {LICENCE}"),
    ("wtfpl", "fuck just", "you just do what the fuck you want to"),
    ("cc0-1.0", "waived neighboring", "has waived all copyright and related or neighboring rights"),
    ("postgresql", "agreement hereby", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("beerware", "beer worth", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "good evil", "the software shall be used for good not evil"),
    ("ofl-1.1", "font sil", f"this font software is licensed under the sil open font {LICENCE} version 1 1"),
    ("vim", "vim distributing", "there are no restrictions on distributing unmodified copies of vim"),
)
# Words before a name that make it a notice.
NOTICED = " (?:licensed|released|distributed|available|published|provided|shared|covered)(?: to you)? (?:under|by)(?: the terms(?: and conditions)? of)?(?: the| an?)?(?: creative commons)? $"
LONGEST_NOTICE = 120  # characters that NOTICED may look back


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    gate: tuple[str, ...]
    pattern: str


def _creative_commons():
    for version in VERSIONS:
        number = version.replace(".", " ")
        for kind, words in CONDITIONS.items():
            label, short = f"cc-{kind}-{version}", kind.replace("-", " ")
            yield (label, f"cc {short} {number}", "cc by", f"cc {short} {number}", "creativecommons", f"creativecommons org licenses {short} {number}")
            middle = f"(?: international| generic| unported)?(?: public)?(?: {LICENCE})?"
            yield (label, "", "creative commons", f"creative commons {words}{middle}{V}{number}", "", "")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: of detections alike in priority and place the earlier rule's stays."""
    out = [Rule(f"{label}:phrase", label, PHRASE, tuple(phrase.split()), phrase) for label, phrase in BASE]
    for label, identifier, gate, name, domain, address in (*LICENSES, *_creative_commons()):
        if identifier:
            out.append(Rule(f"{label}:tag", label, TAG, ("spdx", "identifier"), f"spdx license identifier (?:{identifier})"))
        if address:
            out.append(Rule(f"{label}:site", label, SITE, (domain,), address))
        out.append(Rule(f"{label}:name", label, NAME, tuple(gate.split()), name))
    out += [Rule(f"{label}:clause", label, CLAUSE, tuple(gate.split()), sentence) for label, gate, sentence in CLAUSES]
    return tuple(out)


class Detection(NamedTuple):
    start: int  # words from 0
    end: int  # past the last word
    label: str
    rule: str
    priority: int


# Every byte that cannot be part of a word becomes a space, A-Z become a-z; bytes of other scripts stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


def words_of(raw: bytes) -> bytes:
    """The words of a text with one space around each; one space if there are none."""
    out = b" " + raw.translate(_FOLD) + b" "
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


@lru_cache(maxsize=None)
def _compiled(pattern: str) -> re.Pattern:
    # The space before is part of the match, so that patterns start with text the matcher can search for.
    return re.compile(f" (?:{pattern})(?= )".encode()) if "|" in pattern else re.compile(f" {pattern}(?= )".encode())


@lru_cache(maxsize=1)
def _gates() -> tuple[list[tuple[str, bytes]], list[Rule]]:
    return [(w, f" {w} ".encode()) for w in sorted({w for rule in rules() for w in rule.gate})], list(rules())


def detect(words: bytes, gated: bool = True) -> list[Detection]:
    """All detections in a text's words, overlapping ones included, by start, end and rule order."""
    gates, all_rules = _gates()
    present = {w for w, spaced in gates if spaced in words}
    tried = [r for r in all_rules if present.issuperset(r.gate)] if gated else all_rules
    found = []
    for order, rule in enumerate(tried):
        for match in _compiled(rule.pattern).finditer(words):
            found.append((match.start() + 1, match.end(), order, rule, rule.priority))
            if rule.priority == NAME:
                before = _notice().search(words, max(0, match.start() - LONGEST_NOTICE), match.start() + 1)
                if before:
                    found.append((before.start() + 1, match.end(), order, rule, NOTICE))
    if not found:
        return []
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    starts = np.searchsorted(spaces, [f[0] for f in found]) - 1
    ends = np.searchsorted(spaces, [f[1] for f in found])
    listed = sorted((int(a), int(b), f[2], f[3], f[4]) for a, b, f in zip(starts, ends, found))
    return [Detection(a, b, rule.label, rule.name if priority == rule.priority else f"{rule.label}:notice", priority) for a, b, _, rule, priority in listed]


@lru_cache(maxsize=1)
def _notice() -> re.Pattern:
    return re.compile(NOTICED.encode())


def kept(found: list[Detection]) -> list[bool]:
    """False for a detection within one of higher priority, or within another of its own that is longer or comes first."""
    out = [True] * len(found)
    by_level: dict[int, list[int]] = {}
    for i, d in enumerate(found):
        by_level.setdefault(d.priority, []).append(i)
    above: list[tuple[int, int]] = []  # (start, end) of all detections of higher priority
    for level in sorted(by_level, reverse=True):
        above.sort()
        starts = [a for a, _ in above]
        reach = np.maximum.accumulate([b for _, b in above]).tolist() if above else []
        last = -1
        for i in sorted(by_level[level], key=lambda i: (found[i].start, -found[i].end, i)):
            d = found[i]
            at = bisect_right(starts, d.start) - 1
            inside = d.end <= last or (at >= 0 and reach[at] >= d.end)
            out[i] = level == PHRASE or not inside
            last = max(last, d.end)
        above += [(found[i].start, found[i].end) for i in by_level[level]]
    return out


FOUND = "array<struct<start:long,end:long,label:string,rule:string,priority:int,kept:boolean>>"
BATCH_DOCS = 1000


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, found) of every row: all detections with their places in words and whether they stay.

    A null text is empty; repeated rows have a row each; a null doc_id stays null; other columns are
    ignored; an empty table gives no rows. Nothing is shuffled.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("kept", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(at, BATCH_DOCS)
                counts, listed = [], []
                for raw in part.column(1):
                    words = words_of(raw.as_py() or b"")
                    found = detect(words)
                    counts.append(words.count(b" ") - 1)
                    listed.append([{**d._asdict(), "kept": stays} for d, stays in zip(found, kept(found))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(listed, kind)], names=["doc_id", "n_words", "found"])

    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, f"{_typed(docs)}, n_words long, found {FOUND}")


def _typed(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def report(scanned: DataFrame) -> DataFrame:
    """Digest columns of scanned rows: places and labels of the base phrases, all labels that stay, and a score.

    The score is the confidence that goes with the highest priority among the detections that stay, 0 without any.
    """
    base = F.filter("found", lambda d: d["priority"] == PHRASE)
    stays = F.filter("found", lambda d: d["kept"])
    places = F.transform(base, lambda d: d["start"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(stays).alias("labels"),
        F.coalesce(confidence[F.array_max(F.transform(stays, lambda d: d["priority"]))], F.lit(0.0)).alias("score"),
    )
