"""License scans by ordered signature rules.

Each rule is a regular expression over a text's words (lower case, one space between), with a label, a priority, a
confidence and the keywords one of which it cannot match without. Words of a whole batch are hashed at once and looked
up among the keywords; only stretches of REACH words around a keyword are spelt out, and only rules of the keywords met
there are tried. Overlapping detections are resolved by priority: one that lies within the interval of a detection of
higher priority, or of the same priority and greater length, is suppressed. Base phrases, which the caller may give, are
never suppressed.

Texts are scanned whole, where they lie, and nothing is shuffled; a stretch is as long as its keywords lie dense.

Null text is empty: no words, no detections, empty label lists and score 0. Repeated rows are scanned each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from srcloom.llm.license_signatures import SIGNATURES
from srcloom.llm.textbytes import LOWER, LOWER_VALUE, byte_classes, text_slices, word_hashes, word_spans

WORD = byte_classes(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
#: Words spelt out on either side of a keyword; no rule spans more.
REACH = 20

#: Base phrases and their labels, where the caller gives no others.
BASE = (("mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licenses: label, names as patterns over words, keywords.
LICENSES = (
    ("mit", r"mit", ("mit",)),
    ("mit-0", r"mit (?:0|no attribution)", ("mit",)),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version)? v?1 1", ("apache",)),
    ("apache-2", r"apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?", ("apache",)),
    ("bsd-2-clause", r"(?:(?:simplified |freebsd )bsd|(?:bsd )?(?:2|two) clause(?: bsd)?)", ("bsd", "clause")),
    ("bsd-3-clause", r"(?:(?:new |modified |revised )bsd|(?:bsd )?(?:3|three) clause(?: bsd)?)", ("bsd", "clause")),
    ("bsd-4-clause", r"(?:original bsd|(?:bsd )?(?:4|four) clause(?: bsd)?)", ("bsd", "clause")),
    ("gpl-2", r"(?:gnu )?(?:gpl|general public license)(?: version)? v?2(?: 0)?", ("gpl", "public")),
    ("gpl-3", r"(?:gnu )?(?:gpl|general public license)(?: version)? v?3(?: 0)?", ("gpl", "public")),
    ("lgpl-2.1", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version)? v?2 1", ("lgpl", "lesser")),
    ("lgpl-3", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version)? v?3(?: 0)?", ("lgpl", "lesser")),
    ("agpl-3", r"(?:gnu )?(?:agpl|affero general public license)(?: version)? v?3(?: 0)?", ("agpl", "affero")),
    ("mpl-1.1", r"(?:mpl|mozilla public license)(?: version)? v?1 1", ("mpl", "mozilla")),
    ("mpl-2", r"(?:mpl|mozilla public license)(?: version)? v?2(?: 0)?", ("mpl", "mozilla")),
    ("epl-1", r"(?:epl|eclipse public license)(?: version)? v?1(?: 0)?", ("epl", "eclipse")),
    ("epl-2", r"(?:epl|eclipse public license)(?: version)? v?2(?: 0)?", ("epl", "eclipse")),
    ("eupl-1.2", r"(?:eupl|european union public licen[cs]e)(?: version)? v?1 2", ("eupl", "european")),
    ("cddl-1", r"(?:cddl|common development and distribution license)(?: version)?(?: v?1(?: 0)?)?", ("cddl", "common")),
    ("isc", r"isc", ("isc",)),
    ("zlib", r"zlib", ("zlib",)),
    ("bsl-1", r"boost software(?: license)?(?: version)?(?: 1(?: 0)?)?", ("boost",)),
    ("unlicense", r"unlicense", ("unlicense",)),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public license)", ("wtfpl", "public")),
    ("artistic-2", r"artistic(?: license)?(?: version)?(?: 2(?: 0)?)?", ("artistic",)),
    ("postgresql", r"postgresql", ("postgresql",)),
    ("psf-2", r"(?:psf|python software foundation)(?: license)?(?: version)?(?: 2(?: 0)?)?", ("psf", "python")),
    ("ofl-1.1", r"(?:sil )?(?:ofl|open font license)(?: version)?(?: 1 1)?", ("ofl", "font")),
    ("cc0", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", ("cc0", "zero")),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: [1-4] 0)?", ("cc", "commons")),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] 0)?", ("cc", "commons")),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:atives|s))(?: [1-4] 0)?", ("cc", "commons")),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] 0)?", ("cc", "commons")),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] 0)?", ("cc", "commons")),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:atives|s))(?: [1-4] 0)?", ("cc", "commons")),
)
#: Ways of naming a license: pattern around {name}, confidence.
PHRASINGS = (
    (r"spdx license identifier {name}", 1.0),
    (r"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{name}", 0.95),
    (r"(?:released|distributed|published|made available|available|provided) under (?:the )?(?:terms of (?:the )?)?{name}", 0.95),
    (r"(?:subject to|governed by|in accordance with) (?:the )?(?:terms of (?:the )?)?{name}", 0.9),
    (r"{name} licen[cs]ed?", 0.9),
    (r"licen[cs]e {name}", 0.85),
    (r"(?:under|see) (?:the )?{name} terms", 0.8),
)
#: Statements without a named license: pattern, label, keywords, confidence.
STATEMENTS = (
    (r"all rights reserved", "proprietary", ("reserved",), 0.7),
    (r"permission is hereby granted free of charge", "mit", ("hereby",), 0.9),
    (r"redistribution and use in source and binary forms", "bsd-3-clause", ("redistribution",), 0.7),
    (r"(?:dedicated to|released into|placed in) the public domain", "public-domain", ("domain",), 0.8),
    (r"this is free and unencumbered software", "unlicense", ("unencumbered",), 0.95),
)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    base: bool = False


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<= )(?:{pattern})(?= )")


def _base_rule(phrase: str, label: str, known: set[str]) -> Rule:
    """A phrase of lower-case words; a word that is a keyword already is its keyword, so no further places are looked at."""
    words = phrase.split()
    if not 0 < len(words) <= REACH or any(words[k:] == words[:-k] for k in range(1, len(words))):
        raise ValueError(f"A base phrase has 1 to {REACH} words and does not overlap itself: {phrase!r}")
    return Rule(label, _compiled(" ".join(map(re.escape, words))), (max(words, key=lambda w: (w in known, len(w), w)),), 100, 1.0, True)


def rules(base: tuple[tuple[str, str], ...] = BASE) -> list[Rule]:
    """Base phrases first, then signatures, every license in every phrasing, statements and bare names of several words."""
    out = [Rule(label, _compiled(pattern), keywords, 95, confidence) for label, pattern, keywords, confidence in SIGNATURES]
    for at, (phrasing, confidence) in enumerate(PHRASINGS):
        out += [Rule(label, _compiled(phrasing.replace("{name}", f"(?:{name})")), keywords, 90 - at, confidence) for label, name, keywords in LICENSES]
    out += [Rule(label, _compiled(pattern), keywords, 50, confidence) for pattern, label, keywords, confidence in STATEMENTS]
    out += [Rule(label, _compiled(name), keywords, 40, 0.6) for label, name, keywords in LICENSES if " " in name and label.startswith(("gpl", "lgpl", "agpl", "mpl", "epl", "eupl", "cc"))]
    known = {keyword for rule in out for keyword in rule.keywords}
    return [_base_rule(phrase, label, known) for phrase, label in base] + out


def resolved(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections (first word, word after the last, rule) that no stronger one contains.

    Detections of one priority and length are judged together, as none of them contains another but its equal. Of stronger
    ones those that no other contains are held by place: their beginnings and ends both increase, so the last that begins
    no later than a detection tells whether it is contained.
    """
    kept: list[tuple[int, int, Rule]] = []
    begins, ends = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    in_order = sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
    for _, alike in groupby(in_order, key=lambda x: (x[2].priority, x[1] - x[0])):
        some = list(alike)
        first, end = (np.array([x[k] for x in some], dtype=np.int64) for k in (0, 1))
        contained = np.zeros(len(some), dtype=bool)
        contained[1:] = first[1:] == first[:-1]
        if len(begins):
            at = np.searchsorted(begins, first, side="right")
            contained |= (at > 0) & (ends[np.maximum(at - 1, 0)] >= end)
        kept += [x for x, inside in zip(some, contained.tolist(), strict=True) if x[2].base or not inside]
        begins, ends = np.concatenate((begins, first[~contained])), np.concatenate((ends, end[~contained]))
        order = np.lexsort((-ends, begins))
        begins, ends = begins[order], ends[order]
        outer = np.ones(len(ends), dtype=bool)
        outer[1:] = ends[1:] > np.maximum.accumulate(ends)[:-1]
        begins, ends = begins[outer], ends[outer]
    return kept


class Scanner:
    def __init__(self, ordered: list[Rule]):
        words = sorted({k for r in ordered for k in r.keywords})
        spelt = "\n".join(words).encode()
        data = np.frombuffer(spelt, dtype=np.uint8)
        starts, stops, _ = word_spans(data, np.array([0, len(data)]), WORD)
        hashes = word_hashes(data, starts, stops, LOWER_VALUE)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.rules_of = [[r for r in ordered if words[k] in r.keywords] for k in order.tolist()]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[self.hashes & np.uint64(0xFFFF)] = True

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int, Rule]]]]:
        """Words of each text, and the resolved detections of the texts that have any."""
        starts, stops, first = word_spans(data, offsets, WORD)
        hashes = word_hashes(data, starts, stops, LOWER_VALUE)
        some = np.flatnonzero(self.maybe[hashes & np.uint64(0xFFFF)])
        at = np.searchsorted(self.hashes, hashes[some])
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == hashes[some]
        where, keyword = some[hit], at[hit]
        owner = np.searchsorted(first, where, side="right") - 1
        out: dict[int, list[tuple[int, int, Rule]]] = {}
        k = 0
        while k < len(where):
            text = owner[k]
            begin = max(first[text], where[k] - REACH)
            met = {int(keyword[k])}
            end = where[k] + REACH + 1
            k += 1
            while k < len(where) and owner[k] == text and where[k] - REACH <= end:
                met.add(int(keyword[k]))
                end = where[k] + REACH + 1
                k += 1
            end = min(end, first[text + 1])
            out.setdefault(int(text), []).extend(self._stretch(data, starts[begin:end], stops[begin:end], int(begin - first[text]), met))
        return np.diff(first), {t: resolved(found) for t, found in out.items() if found}

    def _stretch(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, begin: int, met: set[int]) -> Iterator[tuple[int, int, Rule]]:
        low = LOWER[data[starts[0] : stops[-1]]].tobytes()
        zero = int(starts[0])
        words = [low[a - zero : b - zero].decode() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        spelt = " " + " ".join(words) + " "
        begins = list(accumulate((len(w) + 1 for w in words), initial=1))  # of each word in `spelt`
        for rule in {id(r): r for m in met for r in self.rules_of[m]}.values():
            for match in rule.pattern.finditer(spelt):
                first = begin + bisect_left(begins, match.start())
                yield first, first + match.group().count(" ") + 1, rule


_FIELDS = (("doc_id", pa.int64(), "long"), ("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("last_word", pa.int64(), "long"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double"), ("detections", pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())])), "array<struct<first_word:long,end_word:long,label:string,confidence:double>>"))


def scanned(docs: DataFrame, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """Per row of docs: words, base phrases (phrase, label) and labels, and all resolved detections by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules(base))
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                n_words, found = scanner.scan(data, offsets)
                rows = []
                for k in range(b - a):
                    kept = found.get(k, [])
                    of_base = [d for d in kept if d[2].base]
                    places = [d[0] for d in of_base]
                    rows.append(
                        (
                            len(of_base),
                            min(places, default=None),
                            max(places, default=None),
                            ",".join(sorted({d[2].label for d in of_base})),
                            ",".join(sorted({d[2].label for d in kept})),
                            max((d[2].confidence for d in kept), default=0.0),
                            [{"first_word": s, "end_word": e, "label": r.label, "confidence": r.confidence} for s, e, r in sorted(kept, key=lambda d: (d[0], d[1], d[2].label))],
                        )
                    )
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(n_words, pa.int64())]
                columns += [pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(_FIELDS[2:])]
                yield pa.RecordBatch.from_arrays(columns, [f[0] for f in _FIELDS])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{name} {kind}" for name, _, kind in _FIELDS))


def report(docs: DataFrame, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """`scanned` without the detections."""
    return scanned(docs, base).drop("detections")
