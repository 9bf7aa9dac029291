"""License scans by ordered signature rules.

A rule is a regular expression over normalised words (lower-case A-Z, words
joined by single spaces), a label, a priority and a confidence.  A keyword
prefilter decides which rules are tried on a text.  Detections are then taken
in order of priority, longer first; one that lies inside a detection already
taken is suppressed.  The three base phrases are found apart and always stay.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_bytes

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_FOLD = bytearray(range(256))
for _b in range(256):
    if 65 <= _b <= 90:
        _FOLD[_b] = _b + 32
    elif _b < 48 or 58 <= _b <= 64 or 91 <= _b <= 96 or 123 <= _b <= 127:
        _FOLD[_b] = 32
_FOLD = bytes(_FOLD)

#: label: (names as patterns, tags as patterns).  A name is how the license is
#: called in prose, a tag its short form.
FAMILIES = {
    "mit": (("mit", "expat", "x11"), ("mit", "mit 0")),
    "apache-1.1": (("apache software license version 1 1",), ("apache 1 1",)),
    "apache-2.0": (("apache(?: software)? license(?: version)? 2(?: 0)?", "apache(?: license)? v?2(?: 0)?"), ("apache 2 0",)),
    "gpl-1.0": (("gnu general public license version 1", "gpl ?v?1"), ("gpl 1 0(?: or later| only)?",)),
    "gpl-2.0": (("gnu general public license(?: as published by the free software foundation)?(?: either)? version 2", "gpl ?v?2"), ("gpl 2 0(?: or later| only)?",)),
    "gpl-3.0": (("gnu general public license(?: as published by the free software foundation)?(?: either)? version 3", "gpl ?v?3"), ("gpl 3 0(?: or later| only)?",)),
    "lgpl-2.1": (("gnu (?:lesser|library) general public license version 2(?: 1)?", "lgpl ?v?2(?: 1)?"), ("lgpl 2 [01](?: or later| only)?",)),
    "lgpl-3.0": (("gnu lesser general public license version 3", "lgpl ?v?3"), ("lgpl 3 0(?: or later| only)?",)),
    "agpl-3.0": (("gnu affero general public license(?: version 3)?", "agpl ?v?3"), ("agpl 3 0(?: or later| only)?",)),
    "bsd-2-clause": (("(?:simplified|2 clause|two clause|freebsd) bsd",), ("bsd 2 clause",)),
    "bsd-3-clause": (("(?:new|modified|revised|3 clause|three clause) bsd",), ("bsd 3 clause",)),
    "bsd-4-clause": (("(?:original|old|4 clause|four clause) bsd",), ("bsd 4 clause",)),
    "bsd": (("bsd", "berkeley software distribution"), ("bsd",)),
    "isc": (("isc", "internet systems consortium"), ("isc",)),
    "mpl-1.1": (("mozilla public license(?: version)? 1 1",), ("mpl 1 1",)),
    "mpl-2.0": (("mozilla public license(?: version)? 2 0", "mpl ?v?2"), ("mpl 2 0",)),
    "epl-1.0": (("eclipse public license(?: version)? 1 0",), ("epl 1 0",)),
    "epl-2.0": (("eclipse public license(?: version)? 2 0",), ("epl 2 0",)),
    "cddl-1.0": (("common development and distribution license",), ("cddl 1 [01]",)),
    "artistic-2.0": (("artistic license(?: version)? 2(?: 0)?",), ("artistic 2 0",)),
    "artistic-1.0": (("artistic license",), ("artistic 1 0",)),
    "zlib": (("zlib(?: libpng)?",), ("zlib",)),
    "boost-1.0": (("boost software license(?: version 1 0)?",), ("bsl 1 0",)),
    "unlicense": (("unlicense",), ("unlicense",)),
    "wtfpl": (("do what the fuck you want to public license",), ("wtfpl",)),
    "python-2.0": (("python software foundation license", "psf license"), ("python 2 0", "psf 2 0")),
    "ruby": (("ruby",), ("ruby",)),
    "php-3.01": (("php license(?: version 3 0?1)?",), ("php 3 01",)),
    "postgresql": (("postgresql",), ("postgresql",)),
    "openssl": (("openssl",), ("openssl",)),
    "ncsa": (("university of illinois ncsa open source",), ("ncsa",)),
    "ms-pl": (("microsoft public license",), ("ms pl",)),
    "ms-rl": (("microsoft reciprocal license",), ("ms rl",)),
    "eupl-1.2": (("european union public license(?: v ?1 2)?",), ("eupl 1 [12]",)),
    "osl-3.0": (("open software license(?: version 3 0)?",), ("osl 3 0",)),
    "afl-3.0": (("academic free license(?: version 3 0)?",), ("afl 3 0",)),
    "cc0-1.0": (("creative commons zero", "cc0(?: 1 0)?(?: universal)?"), ("cc0 1 0",)),
    "cc-by-4.0": (("creative commons attribution(?: 4 0)?(?: international)?", "cc by(?: 4 0)?"), ("cc by 4 0",)),
    "cc-by-sa-4.0": (("creative commons attribution share ?alike(?: 4 0)?(?: international)?", "cc by sa(?: 4 0)?"), ("cc by sa 4 0",)),
    "cc-by-nc-4.0": (("creative commons attribution non ?commercial(?: 4 0)?(?: international)?", "cc by nc(?: 4 0)?"), ("cc by nc 4 0",)),
    "cc-by-nd-4.0": (("creative commons attribution no ?derivatives(?: 4 0)?(?: international)?", "cc by nd(?: 4 0)?"), ("cc by nd 4 0",)),
    "cc-by-nc-sa-4.0": (("creative commons attribution non ?commercial share ?alike(?: 4 0)?(?: international)?", "cc by nc sa(?: 4 0)?"), ("cc by nc sa 4 0",)),
    "cc-by-nc-nd-4.0": (("creative commons attribution non ?commercial no ?derivatives(?: 4 0)?(?: international)?", "cc by nc nd(?: 4 0)?"), ("cc by nc nd 4 0",)),
    "gfdl-1.3": (("gnu free documentation license(?: version 1 [123])?",), ("gfdl 1 [123](?: or later| only)?",)),
    "odbl-1.0": (("open database license(?: odbl)?(?: v ?1 0)?",), ("odbl 1 0",)),
    "ofl-1.1": (("sil open font license(?: version 1 1)?",), ("ofl 1 1",)),
}
#: frame around a name or tag: (pattern, priority, confidence); {} is the name.
NAME_FRAMES = (
    ("(?:released|licensed|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?{}(?: license)?", 90, 1.0),
    ("(?:governed|covered) by (?:the )?{}(?: license)?", 80, 0.95),
    ("license (?:is )?(?:the )?{}", 70, 0.9),
    ("{} license", 60, 0.85),
)
TAG_FRAMES = (("spdx license identifier {}", 100, 1.0), ("license {}", 65, 0.9))
#: whole sentences and notices: (label, pattern, priority, confidence)
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 95, 1.0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 95, 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 94, 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", 95, 1.0),
    ("wtfpl", "you just do what the fuck you want to", 95, 1.0),
    ("zlib", "altered source versions must be plainly marked as such", 94, 0.95),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu", 85, 0.95),
    ("gpl", "gnu (?:[a-z]+ ){0,2}general public license", 40, 0.8),
    ("public-domain", "(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", 50, 0.8),
    ("proprietary", "all rights reserved", 20, 0.4),
    ("proprietary", "confidential and proprietary", 45, 0.8),
    ("proprietary", "proprietary and confidential", 45, 0.8),
    ("proprietary", "unauthorized (?:copying|reproduction|distribution)", 45, 0.7),
    ("copyright", "copyright (?:c )?[0-9]{4}(?: [0-9]{4})?", 10, 0.3),
)


def rules() -> list[tuple[str, str, int, float, frozenset[str]]]:
    """(label, pattern, priority, confidence, words that every match holds), first to last."""
    out = []
    for label, (names, tags) in FAMILIES.items():
        for parts, frames in ((names, NAME_FRAMES), (tags, TAG_FRAMES)):
            # "gpl ?v?2" stands for "gpl 2", "gpl v 2", "gpl v2" and "gplv2"
            for part in dict.fromkeys(p.replace(" ?v?", v) for p in parts for v in (" (?:v )?", " v", "v")):
                for frame, priority, sure in frames:
                    out.append((label, frame.format(part), priority, sure))
    out += NOTICES
    out.sort(key=lambda r: -r[2])
    return [(*r, keywords(r[1])) for r in out]


def keywords(pattern: str) -> frozenset[str]:
    """Whole words outside groups, classes and optional letters."""

    def gone(m: re.Match) -> str:
        """A group's place, with the spaces that it has at its ends."""
        inside = re.sub(r"^\((?:\?:)?|\)[?*+]?(?:\{[^}]*\})?$", "", m[0]) if m[0][0] == "(" else "-"
        return " " * inside.startswith(" ") + "\0" + " " * inside.endswith(" ")

    plain = pattern
    while True:  # groups and classes go from the inside out
        less = re.sub(r"\((?:\?:)?[^()]*\)[?*+]?(?:\{[^}]*\})?|\[[^\]]*\](?:\{[^}]*\})?[?*+]?", gone, plain)
        if less == plain:
            break
        plain = less
    plain = re.sub(r".\?", "\0", plain)
    return frozenset(w for w in plain.split(" ") if re.fullmatch("[a-z0-9]+", w))


class Scanner:
    """The rules, filed under the longest word that each needs."""

    def __init__(self):
        self.by_word: dict[bytes, list] = {}
        for label, p, priority, sure, need in rules():
            rule = (label, re.compile(rf"(?<![^ ]){p}(?![^ ])".encode()), priority, sure, frozenset(w.encode() for w in need))
            self.by_word.setdefault(max(rule[4], key=lambda w: (len(w), w)), []).append(rule)
        self.words = frozenset(self.by_word)
        self.base = [(re.compile(rf"(?<![^ ]){p}(?![^ ])".encode()), label) for p, label in BASE]

    def scan(self, raw: bytes):
        """(n_words, n_base, first, last, base labels, labels, score, detections) of one text."""
        words = raw.translate(_FOLD).split()
        seen = {w.replace(b"licence", b"license") for w in set(words)}
        tried = [r for w in self.words & seen for r in self.by_word[w] if r[4] <= seen]
        if not tried and b"license" not in seen:  # which every base phrase holds
            return len(words), 0, None, None, "", "", 0.0, []
        text = b" ".join(words)
        places, base = [], set()
        for pattern, label in self.base:
            for m in pattern.finditer(text):
                places.append(m.start())
                base.add(label)
        one = text.replace(b"licence", b"license")  # of equal length, so places hold
        found = [(-priority, m.start() - m.end(), m.start(), m.end(), label, sure) for label, p, priority, sure, _ in tried for m in p.finditer(one)]
        taken: list[tuple[int, int, str, float]] = []
        for _, _, a, b, label, sure in sorted(found):
            if not any(s <= a and b <= e for s, e, _, _ in taken):
                taken.append((a, b, label, sure))
        score = max([s for *_, s in taken] + [0.85] * bool(base), default=0.0)
        at = [text.count(b" ", 0, p) for p in (min(places), max(places))] if places else (None, None)
        spans = [{"label": la, "first": text.count(b" ", 0, a), "last": text.count(b" ", 0, b), "confidence": c} for a, b, la, c in sorted(taken)]
        return len(words), len(places), *at, ",".join(sorted(base)), ",".join(sorted(base | {t[2] for t in taken})), score, spans


_scanner: list[Scanner] = []
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,confidence:double>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("confidence", pa.float64())]))


def _scan(batches):
    if not _scanner:
        _scanner.append(Scanner())
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
    for batch in batches:
        x, offs = text_bytes(batch.column("text"))
        for a in range(0, len(batch), 1024):
            b, out = min(a + 1024, len(batch)), []
            for i in range(a, b):
                out.append(_scanner[0].scan(x[offs[i] : offs[i + 1]].tobytes()))
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], [f.split()[0] for f in SCHEMA.split(", ")])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License detections in each whole text.

    docs: doc_id, text; other columns are ignored.  Returns a row for each row:
    doc_id, n_words, n_base (places of base phrases), first_word and last_word
    (word index of the first and last such place, else null), base_labels and
    labels (distinct, sorted, comma-joined), score (highest confidence, 0 to 1)
    and spans (detections with their first and last word).

    Null and empty texts have no words and empty labels.  Repeated rows are
    scanned each.  Empty table: empty result.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)
