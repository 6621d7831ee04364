"""License scans by ordered signature rules (operator 4), in DataFrame functions alone.

A text becomes its lower-case words, one blank between and at both ends.  Rules are regular
expressions over that, each with a priority class and a label:

1. texts that hold none of a few keywords, of which every rule needs one, skip the scan;
2. of the others, only the rules whose literal words the text holds are matched;
3. every match is an interval of the text; intervals are ordered by start, length, priority and
   rule, and one that lies within an interval of the same or a better class is suppressed;
4. the labels of what is left are the method's.

The base phrases of the contract are counted exactly and beside that; their labels always stay.
All of it happens within the row: no shuffle, no join, and no rows per match.

Defined results: a null text is an empty text (no words, score 0); texts with
any number of matches take time in proportion to it; null doc_ids and repeated rows
are rows like others; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, text_or_empty

#: Fixed by the contract: phrase and label.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Priority classes, best first, and the confidence that one match of the class gives.
NOTICE, TAG, LATER, VERSIONED, SHORT, NAME = range(6)
CONFIDENCE = (1.0, 1.0, 0.95, 0.9, 0.7, 0.5)

#: Matches of one rule whose places one fold adds up.
BLOCK = 256

_V = r"(?: version| ver| v| release)? v?"
_LATER = r" (?:or|and)(?: at your option)?(?: any)?(?: later| newer| above)(?: versions?)?"

#: label, full name, short name (or none), identifier (or none), address (or none), versions:
#: (suffix of the label, pattern).  Patterns are over words: "2.0" is "2 0".
FAMILIES = (
    ("apache", "apache(?: software)?(?: public)? licen[cs]e", "apache", "apache",
     "apache org licenses licen[cs]e", (("2", "2(?: 0)?"), ("1.1", "1 1"), ("1", "1 0"))),
    ("gpl", "gnu (?:general public|gp) licen[cs]e", "(?:gnu )?gpl", "gpl", "gnu org licenses gpl",
     (("3", "3(?: 0)?"), ("2", "2(?: 0)?"), ("1", "1(?: 0)?"))),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e", "(?:gnu )?lgpl", "lgpl", "gnu org licenses lgpl",
     (("3", "3(?: 0)?"), ("2.1", "2 1"), ("2", "2(?: 0)?"))),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "(?:gnu )?agpl", "agpl", "gnu org licenses agpl",
     (("3", "3(?: 0)?"), ("1", "1(?: 0)?"))),
    ("fdl", "gnu free documentation licen[cs]e", "(?:gnu )?g?fdl", "gfdl", "gnu org licenses fdl",
     (("1.3", "1 3"), ("1.2", "1 2"), ("1.1", "1 1"))),
    ("mpl", "mozilla public licen[cs]e", "mpl", "mpl", "mozilla org mpl",
     (("2", "2(?: 0)?"), ("1.1", "1 1"), ("1", "1 0"))),
    ("epl", "eclipse public licen[cs]e", "epl", "epl", "eclipse org legal epl",
     (("2", "2(?: 0)?"), ("1", "1 0|v10"))),
    ("edl", "eclipse distribution licen[cs]e", None, None, "eclipse org org documents edl", (("1", "1 0|v10"),)),
    ("eupl", "european union public licen[cs]e", "eupl", "eupl", None, (("1.2", "1 2"), ("1.1", "1 1"), ("1", "1 0"))),
    ("cddl", "common development and distribution licen[cs]e", "cddl", "cddl", None, (("1.1", "1 1"), ("1", "1 0"))),
    ("cpl", "common public licen[cs]e", None, "cpl", None, (("1", "1 0"), ("0.5", "0 5"))),
    ("cecill", "cecill(?: free software)? licen[cs]e(?: agreement)?", "cecill", "cecill", "cecill info licences licence cecill",
     (("2.1", "2 1"), ("2", "2(?: 0)?"), ("1", "1(?: 0)?"))),
    ("osl", "open software licen[cs]e", None, "osl", None, (("3", "3(?: 0)?"), ("2.1", "2 1"), ("1", "1 0"))),
    ("afl", "academic free licen[cs]e", None, "afl", None, (("3", "3(?: 0)?"), ("2.1", "2 1"), ("1.2", "1 2"))),
    ("apsl", "apple public source licen[cs]e", None, "apsl", "opensource apple com apsl", (("2", "2(?: 0)?"), ("1.2", "1 2"))),
    ("artistic", "artistic licen[cs]e", None, "artistic", "opensource org licenses artistic licen[cs]e", (("2", "2(?: 0)?"), ("1", "1 0"))),
    ("boost", "boost software licen[cs]e", None, "bsl", "boost org licen[cs]e", (("1", "1(?: 0)?"),)),
    ("busl", "business source licen[cs]e", None, "busl", None, (("1.1", "1 1"),)),
    ("sspl", "server side public licen[cs]e", "sspl", "sspl", None, (("1", "1(?: 0)?"),)),
    ("elastic", "elastic licen[cs]e", None, "elastic", None, (("2", "2(?: 0)?"),)),
    ("ofl", "(?:sil )?open font licen[cs]e", "ofl", "ofl", "scripts sil org ofl", (("1.1", "1 1"), ("1", "1 0"))),
    ("odbl", "open (?:data commons open )?database licen[cs]e", None, "odbl", "opendatacommons org licenses odbl", (("1", "1(?: 0)?"),)),
    ("odc-by", "open data commons attribution licen[cs]e", None, "odc by", "opendatacommons org licenses by", (("1", "1(?: 0)?"),)),
    ("pddl", "public domain dedication and licen[cs]e", None, "pddl", "opendatacommons org licenses pddl", (("1", "1(?: 0)?"),)),
    ("ogl", "open government licen[cs]e", None, "ogl", "nationalarchives gov uk doc open government licen[cs]e", (("3", "3(?: 0)?"), ("2", "2(?: 0)?"), ("1", "1(?: 0)?"))),
    ("psf", "(?:python software foundation|psf) licen[cs]e(?: agreement)?", None, "psf", None, (("2", "2(?: 0)?"),)),
    ("zope", "zope public licen[cs]e", None, "zpl", None, (("2.1", "2 1"), ("2", "2(?: 0)?"))),
    ("qpl", "q public licen[cs]e", None, "qpl", None, (("1", "1 0"),)),
    ("php", "php licen[cs]e", None, "php", "php net licen[cs]e", (("3.01", "3 01"), ("3", "3(?: 0)?"))),
    ("lppl", "latex project public licen[cs]e", None, "lppl", "latex project org lppl", (("1.3", "1 3[ac]?"), ("1.2", "1 2"))),
    ("ms-pl", "microsoft public licen[cs]e", None, "ms pl", None, ()),
    ("ms-rl", "microsoft reciprocal licen[cs]e", None, "ms rl", None, ()),
    ("mit", "(?:mit|expat)(?: x11)? licen[cs]e", None, "mit", "opensource org licenses? mit(?: licen[cs]e)?", ()),
    ("bsd", "bsd(?: style)? licen[cs]e", None, "bsd", "opensource org licenses? bsd(?: licen[cs]e)?", ()),
    ("bsd-2", "(?:2|two) clause (?:free)?bsd(?: licen[cs]e)?", "simplified bsd(?: licen[cs]e)?", "bsd 2 clause", "opensource org licenses? bsd 2 clause", ()),
    ("bsd-3", "(?:3|three) clause bsd(?: licen[cs]e)?", "(?:modified|new|revised) bsd(?: licen[cs]e)?", "bsd 3 clause", "opensource org licenses? bsd 3 clause", ()),
    ("bsd-4", "(?:4|four) clause bsd(?: licen[cs]e)?", "(?:original|old) bsd(?: licen[cs]e)?", "bsd 4 clause", None, ()),
    ("isc", "isc licen[cs]e", None, "isc", "opensource org licenses? isc(?: licen[cs]e)?", ()),
    ("zlib", "zlib(?: libpng)? licen[cs]e", None, "zlib", "zlib net zlib licen[cs]e", ()),
    ("unlicense", "the unlicen[cs]e", None, "unlicen[cs]e", "unlicen[cs]e org", ()),
    ("wtfpl", "wtfpl(?: licen[cs]e)?", None, "wtfpl", "wtfpl net", ()),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", None, "ncsa", None, ()),
    ("openssl", "openssl licen[cs]e", None, "openssl", None, ()),
    ("vim", "vim licen[cs]e", None, "vim", None, ()),
    ("ruby", "ruby licen[cs]e", None, "ruby", None, ()),
    ("postgresql", "postgresql licen[cs]e", None, "postgresql", None, ()),
    ("beerware", "beer ?ware licen[cs]e", None, "beerware", None, ()),
    ("mulan", "mulan(?: permissive software)? licen[cs]e", None, "mulanpsl", None, (("2", "2(?: 0)?"), ("1", "1(?: 0)?"))),
)
#: Creative Commons terms: label, full name, letters.
COMMONS = (("by", "attribution", "by"), ("by-sa", "attribution share ?alike", "by sa"),
           ("by-nd", "attribution no ?deriv(?:ative|ativ)e?s?", "by nd"),
           ("by-nc", "attribution non ?commercial", "by nc"),
           ("by-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"),
           ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative|ativ)e?s?", "by nc nd"))
#: Sentences of license texts and headers: label, pattern.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)? mit licen[cs]e"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the names? of .{1,80}? nor the names of (?:its|their|the) contributors may be used to endorse or promote products"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display"),
    ("bsd", "(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of)?(?: the| an?)? bsd(?: style)?(?: licen[cs]e)?"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "the origin of this software must not be misrepresented"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("apache-2", "licen[cs]ed under(?: the)?(?: terms of)?(?: the)? apache licen[cs]e version 2(?: 0)?"),
    ("apache-2", "you may not use this file except in compliance with the licen[cs]e you may obtain a copy"),
    ("apache-2", "grant of patent licen[cs]e subject to the terms and conditions of this licen[cs]e"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-3+", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3"),
    ("gpl-2+", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("fdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", "the contents of this file are subject to the mozilla public licen[cs]e"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "(?:released|placed|dedicated|put|is|are) (?:in|into|to) the public domain"),
    ("cc0", "waived all copyright and related or neighboring rights"),
    ("wtfpl", "do what the f[a-z]* you want to public licen[cs]e"),
    ("beerware", "you can buy me a beer in return"),
    ("ofl", "this font software is licensed under the sil open font licen[cs]e"),
    ("psf", "psf is making python available to licensee on an as is basis"),
    ("artistic", "under the(?: same)? terms of the artistic licen[cs]e"),
    ("perl", "under the same terms as perl(?: itself)?"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "confidential and proprietary"),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|document|software|material)"),
    ("proprietary", "without (?:the )?(?:prior |express )*written permission of"),
    ("non-commercial", "for non ?commercial (?:use|purposes) only"),
    ("eula", "end user licen[cs]e agreement"),
)


#: Every rule's pattern needs one of these; texts with none of them skip the scan.
GATE = ("licen", "gpl", "apache", " mpl", " epl", " eupl", "cddl", " ofl", "sspl", "bsd", " cc by", " cc0", "wtfpl",
        "creativecommons", "creative commons", "cecill", "fdl", " is hereby granted", "merchantability",
        " source and binary forms", " may be used to endorse", " advertising materials", " must not be misrepresented",
        " you can redistribute it", " public domain", " rights reserved", "proprietary", "unauthori",
        "written permission of", "commercial", " copyright and related", " me a beer", " terms as perl", " psf is making",
        " free and unencumbered", "the contents of this file are subject", "do what the f", " opensource ", " eclipse org ", " latex project org ", " zlib net ")


def keywords(pattern: str) -> list[str]:
    """The literal runs that every match of a pattern contains, longest first: what is left of it
    without groups, classes, optional characters and repeats."""
    text, before = f" {pattern} ", None
    while text != before:
        before, text = text, re.sub(r"\((?:\?:)?[^()]*\)[?+*]?", "\0", text)
    text = re.sub(r"\[[^\]]*\][?+*]?|.[?*]|\.\{[^}]*\}\??", "\0", text)
    runs = {run for run in re.split("[\0+]", text[:-1] if text.endswith("\0 ") else text) if run.strip()}
    return sorted(runs, key=lambda run: (-len(run), run))


@lru_cache(maxsize=1)
def rules() -> tuple[tuple[int, str, str], ...]:
    """(class, label, pattern) of all rules, in order."""
    found = [(NOTICE, label, pattern) for label, pattern in NOTICES]
    for label, name, short, tag, address, versions in FAMILIES:
        for suffix, version in versions:
            own, v = f"{label}-{suffix}", f"(?:{version})"
            if tag:
                found += [(TAG, own, f"spdx licen[cs]e identifier {tag} {v}(?: only)?"),
                          (TAG, f"{own}+", f"spdx licen[cs]e identifier {tag} {v}(?: or later)")]
            if address:
                found.append((TAG, own, f"{address}(?: v)? ?v?{v}"))
            found += [(LATER, f"{own}+", f"{name}{_V}{v}{_LATER}"), (VERSIONED, own, f"{name}{_V}{v}")]
            if short:
                found += [(LATER, f"{own}+", f"{short}(?: licen[cs]e)?(?:{_V}|v){v}{_LATER}"),
                          (SHORT, own, f"{short}(?: licen[cs]e)?(?:{_V}|v){v}")]
        if tag:
            found.append((TAG, label, f"spdx licen[cs]e identifier {tag}"))
        if address:
            found.append((TAG, label, address))
        found.append((NAME, label, name))
        if short and not versions:
            found.append((SHORT, label, short))
    for label, name, letters in COMMONS:
        own = f"cc-{label}"
        for version in ("4", "3", "2.5", "2", "1"):
            v = version.replace(".", " ") + ("" if "." in version else "(?: 0)?")
            found += [(TAG, f"{own}-{version}", f"spdx licen[cs]e identifier cc {letters} {v}"),
                      (TAG, f"{own}-{version}", f"creativecommons org licenses {letters} {v}"),
                      (VERSIONED, f"{own}-{version}", f"creative commons {name}(?: international| unported)?{_V}{v}"),
                      (VERSIONED, f"{own}-{version}", f"cc {letters}{_V}{v}")]
        found += [(TAG, own, f"creativecommons org licenses {letters}"),
                  (NAME, own, f"creative commons {name}"), (SHORT, own, f"cc {letters}")]
    found += [(SHORT, f"bsd-{n}", f"bsd {n} clause(?: licen[cs]e)?") for n in (2, 3, 4)]
    found += [(TAG, "cc0", "creativecommons org publicdomain zero(?: 1 0)?"),
              (SHORT, "cc0", "cc0(?: 1 0)?"), (NAME, "cc", "creative commons(?: public)? licen[cs]e")]
    return tuple(dict.fromkeys(found))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _let(value: Column, body) -> Column:
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def places(text: Column, pattern: Column, found: Column) -> Column:
    """(s, n): start from 1 and length of all matches ``found`` of a pattern.  A match starts after the
    pieces and matches before it; these sums run by blocks of ``BLOCK`` matches and over the blocks, so
    that no fold appends to a long array."""
    parts = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, match: F.struct(
        F.length(gap).alias("gap"), F.length(match).alias("n")))
    none = "array<struct<s:int,n:int>>"

    def block(items: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast(none).alias("out"))
        return F.aggregate(items, zero, lambda state, x: F.struct(
            (state.at + x.gap + x.n).alias("at"),
            F.concat(state.out, F.array(F.struct((state.at + x.gap).alias("s"), x.n.alias("n")))).alias("out")), lambda state: state.out)

    def whole(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(items, i, F.lit(BLOCK)))
        sums = _let(blocks, lambda cut: F.aggregate(
            cut, F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("firsts")),
            lambda state, part: F.struct(
                F.aggregate(part, state.at, lambda total, x: total + x.gap + x.n).alias("at"),
                F.concat(state.firsts, F.array(state.at)).alias("firsts")),
            lambda state: F.zip_with(cut, state.firsts, block)))
        return F.flatten(sums)

    return _let(parts, whole)


def detections(padded: Column, rule_set) -> Column:
    """Sorted (start, -end, class, rule, label) of all matches of the rules whose words occur."""
    literal = F.from_json(F.lit(json.dumps([
        {"c": c, "n": n, "l": label, "k": keywords(pattern), "p": f" (?:{pattern})(?= )"}
        for n, (c, label, pattern) in enumerate(rule_set)])), "array<struct<c:int,n:int,l:string,k:array<string>,p:string>>")

    def matches(rule: Column) -> Column:
        def intervals(found: Column) -> Column:
            return F.transform(places(padded, rule.p, found), lambda at: F.struct(
                at.s.alias("s"), (-at.s - at.n).alias("e"), rule.c.alias("c"), rule.n.alias("n"), rule.l.alias("l")))

        return _let(F.regexp_extract_all(padded, rule.p, F.lit(0)), lambda found: F.when(
            F.size(found) > 0, intervals(found)).otherwise(F.array().cast("array<struct<s:int,e:int,c:int,n:int,l:string>>")))

    return F.array_sort(F.flatten(F.transform(
        F.filter(literal, lambda r: F.forall(r.k, lambda key: F.contains(padded, key))), matches)))


def unsuppressed(found: Column) -> Column:
    """(classes, labels) of the matches that lie within no match of the same or a better class; in
    the order of starts and lengths, that is known from the farthest end of each class so far."""
    n = len(CONFIDENCE)
    zero = F.struct(F.array(*[F.lit(0)] * n).alias("ends"), F.array().cast("array<int>").alias("classes"),
                    F.array().cast("array<string>").alias("labels"))

    def keep(state: Column, d: Column) -> Column:
        within = F.array_max(F.slice(state.ends, F.lit(1), d.c + 1)) >= -d.e
        return F.when(within, state).otherwise(F.struct(
            F.transform(state.ends, lambda end, k: F.when(k == d.c, F.greatest(end, -d.e)).otherwise(end)).alias("ends"),
            F.array_union(state.classes, F.array(d.c)).alias("classes"),
            F.array_union(state.labels, F.array(d.l)).alias("labels")))

    return F.aggregate(found, zero, keep)


def scan(docs: DataFrame, rule_set=None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    rule_set = rules() if rule_set is None else rule_set
    words = F.trim(F.regexp_replace(F.lower(text_or_empty()), SEPARATORS, " "))
    rows = docs.select("doc_id", F.when(words == "", F.lit(" ")).otherwise(
        F.concat(F.lit(" "), words, F.lit(" "))).alias("w"))
    rows = rows.select("doc_id", "w", (_spaces(F.col("w")) - 1).cast("long").alias("n_words"))
    w, n = F.col("w"), F.col("n_words")
    count, first, last, base = [], [], [], []
    for phrase, label in BASE:
        there = F.contains(w, F.lit(f" {phrase} "))
        count.append(F.when(there, F.regexp_count(w, F.lit(f" {phrase}(?= )"))).otherwise(0))
        first.append(F.when(there, _spaces(F.substring_index(w, f" {phrase} ", 1))))
        last.append(F.when(there, n - _spaces(F.substring_index(w, f" {phrase} ", -1)) - len(phrase.split())))
        base.append(F.when(there, F.lit(label)))
    gate = F.lit(False)
    for key in GATE:
        gate = gate | F.contains(w, F.lit(key))
    nothing = F.struct(F.array().cast("array<int>").alias("classes"), F.array().cast("array<string>").alias("labels"))
    method = F.when(gate, _let(unsuppressed(detections(w, rule_set)), lambda s: F.struct(
        s.classes.alias("classes"), s.labels.alias("labels")))).otherwise(nothing)
    rows = rows.select("doc_id", "n_words", sum(count[1:], count[0]).cast("long").alias("n_base"),
                       F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
                       F.array_sort(F.array_compact(F.array(*base))).alias("base"), method.alias("method"))
    best = F.array_max(F.transform("method.classes", lambda c: F.element_at(
        F.array(*[F.lit(x) for x in CONFIDENCE]), c + 1)))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "method.labels")), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(CONFIDENCE[VERSIONED])).otherwise(
            F.lit(0.0))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
