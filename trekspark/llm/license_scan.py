"""License scans: ordered signature rules, gated by keywords, with priorities and interval containment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trekspark.llm.common import read_table, with_columns
from trekspark.llm.license_rules import WRITTEN

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Licence families. Label, SPDX stem in words, names (regexes over lower-case words), versions.
FAMILIES = [
    ("gpl", "gpl", r"gnu general public licen[sc]e|gnu gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "lgpl", r"gnu (?:lesser|library) general public licen[sc]e|gnu lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "agpl", r"gnu affero general public licen[sc]e|affero general public licen[sc]e|gnu agpl", ("1.0", "3.0")),
    ("gfdl", "gfdl", r"gnu free documentation licen[sc]e", ("1.1", "1.2", "1.3")),
    ("apache", "apache", r"apache software licen[sc]e|apache licen[sc]e", ("1.0", "1.1", "2.0")),
    ("mit", "mit", r"mit licen[sc]e|expat licen[sc]e|x11 licen[sc]e", ()),
    ("bsd", "bsd", r"(?:new |simplified |modified |original )?bsd licen[sc]e|(?:two|three|four|2|3|4) clause bsd(?: licen[sc]e)?", ("2-clause", "3-clause", "4-clause")),
    ("isc", "isc", r"isc licen[sc]e", ()),
    ("mpl", "mpl", r"mozilla public licen[sc]e", ("1.0", "1.1", "2.0")),
    ("epl", "epl", r"eclipse public licen[sc]e", ("1.0", "2.0")),
    ("edl", "edl", r"eclipse distribution licen[sc]e", ("1.0",)),
    ("cddl", "cddl", r"common development and distribution licen[sc]e", ("1.0", "1.1")),
    ("cpl", "cpl", r"common public licen[sc]e", ("1.0",)),
    ("eupl", "eupl", r"european union public licen[sc]e", ("1.0", "1.1", "1.2")),
    ("osl", "osl", r"open software licen[sc]e", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "afl", r"academic free licen[sc]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", "artistic", r"artistic licen[sc]e", ("1.0", "2.0")),
    ("bsl", "bsl", r"boost software licen[sc]e", ("1.0",)),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", ()),
    ("unlicense", "unlicense", r"the unlicense|unlicense org", ()),
    ("wtfpl", "wtfpl", r"do what the fuck you want to public licen[sc]e", ()),
    ("python", "python", r"python software foundation licen[sc]e|psf licen[sc]e", ("2.0",)),
    ("php", "php", r"php licen[sc]e", ("3.0", "3.01")),
    ("ruby", "ruby", r"ruby licen[sc]e", ()),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", ()),
    ("openssl", "openssl", r"openssl licen[sc]e", ()),
    ("ofl", "ofl", r"sil open font licen[sc]e|open font licen[sc]e", ("1.0", "1.1")),
    ("ms-pl", "ms pl", r"microsoft public licen[sc]e", ()),
    ("ms-rl", "ms rl", r"microsoft reciprocal licen[sc]e", ()),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[sc]e|ncsa open source licen[sc]e", ()),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e", ()),
    ("upl", "upl", r"universal permissive licen[sc]e", ("1.0",)),
    ("odbl", "odbl", r"open database licen[sc]e|open data commons open database licen[sc]e", ("1.0",)),
    ("odc-by", "odc by", r"open data commons attribution licen[sc]e", ("1.0",)),
    ("pddl", "pddl", r"public domain dedication and licen[sc]e", ("1.0",)),
    ("cecill", "cecill", r"cecill(?: [bc])? licen[sc]e|licence cecill", ("1.0", "2.0", "2.1")),
    ("sspl", "sspl", r"server side public licen[sc]e", ("1.0",)),
    ("busl", "busl", r"business source licen[sc]e", ("1.1",)),
    ("elastic", "elastic", r"elastic licen[sc]e", ("2.0",)),
    ("vim", "vim", r"vim licen[sc]e", ()),
    ("cc-by-sa", "cc by sa", r"creative commons attribution share ?alike|cc by sa", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "cc by nc", r"creative commons attribution non ?commercial|cc by nc", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", "cc by nd", r"creative commons attribution no ?deriv(?:ative)?s|cc by nd", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", "cc by nc sa", r"creative commons attribution non ?commercial share ?alike|cc by nc sa", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", "cc by nc nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by", "cc by", r"creative commons attribution|cc by", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc0", "cc0", r"creative commons zero|cc0(?: public domain dedication)?", ("1.0",)),
]

# Sentences of licence texts, and places where licences are kept.
PHRASES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 85),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 85),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 85),
    ("gpl", "gpl", r"licen[sc]ed under (?:the )?gpl", 70),
    ("lgpl", "lgpl", r"licen[sc]ed under (?:the )?lgpl", 70),
    ("agpl", "agpl", r"licen[sc]ed under (?:the )?agpl", 70),
    ("mit", "opensource", r"opensource org licenses mit", 90),
    ("bsd", "opensource", r"opensource org licenses bsd(?: license)?", 90),
    ("isc", "opensource", r"opensource org licenses isc", 90),
    ("apache-2.0", "apache", r"apache org licenses license 2 0", 90),
    ("gpl", "gnu", r"gnu org (?:licenses|copyleft) gpl", 90),
    ("lgpl", "gnu", r"gnu org (?:licenses|copyleft) lesser|gnu org (?:licenses|copyleft) lgpl", 90),
    ("agpl", "gnu", r"gnu org licenses agpl", 90),
    ("gfdl", "gnu", r"gnu org licenses fdl", 90),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0", 90),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0", 90),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa", 90),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc", 90),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd", 90),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa", 91),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd", 91),
    ("cc-by", "creativecommons", r"creativecommons org licenses by", 89),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """The rules, in order: each family's identifiers, grants and names, with and without version, then the sentences, headers,
    notices, exceptions and references that are written one by one."""
    out = []

    def add(label: str, keyword: str, pattern: str, priority: int) -> None:
        out.append(Rule(label, keyword, re.compile(f"(?<= )(?:{pattern})(?= )"), priority))

    for label, stem, names, versions in FAMILIES:
        keyword = min((re.sub(r"\(.*?\)\??|\[.*?\]|\\.", "\0", n).replace("?", "\0").split("\0")[0].split(" ")[0] or stem.split(" ")[0] for n in names.split("|")), key=len)
        words = [keyword] if len(names.split("|")) == 1 else sorted({_first_literal(n) for n in _alternatives(names)})
        for k in words:
            own = "|".join(n for n in _alternatives(names) if _first_literal(n) == k) if len(words) > 1 else names
            for v in versions:
                exact = v.replace(".", " ").replace("-", " ")
                number = exact if not exact.endswith(" 0") else f"{exact[:-2]}(?: 0)?"
                add(f"{label}-{v}", k, f"(?:{own})(?: international| unported| generic)? (?:version |v ?)?{number}(?: or later| only)?", 60)
                add(f"{label}-{v}", k, f"(?:licen[sc]ed|released|distributed|available|published) under (?:the terms of )?(?:the |a )?(?:{own}) (?:version |v ?)?{number}", 80)
            add(label, k, own, 40)
            add(label, k, f"(?:licen[sc]ed|released|distributed|available|published) under (?:the terms of )?(?:the |a )?(?:{own})", 70)
        for v in versions:
            add(f"{label}-{v}", "spdx", f"spdx licen[sc]e identifier {stem} {v.replace('.', ' ').replace('-', ' ')}(?: or later| only)?", 100)
        add(label, "spdx", f"spdx licen[sc]e identifier {stem}", 95)
    for label, keyword, pattern, priority in [*PHRASES, *WRITTEN]:
        add(label, keyword, pattern, priority)
    return tuple(out)


def _alternatives(names: str) -> list[str]:
    """The top-level alternatives of a pattern."""
    out, depth, first = [], 0, 0
    for i, c in enumerate(names):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(names[first:i])
            first = i + 1
    return [*out, names[first:]]


def _first_literal(name: str) -> str:
    """The first word of a pattern that every match holds."""
    bare = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??", "\0", name)
    for part in bare.split("\0"):
        for w in part.split():
            if re.fullmatch(r"[a-z0-9]+", w):
                return w
    return "licen"


_SEPARATED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@lru_cache(maxsize=1)
def _gate():
    import ahocorasick

    found = ahocorasick.Automaton()
    for r in rules():
        found.add_word(r.keyword, r.keyword)
    found.make_automaton()
    return found


def normal_words(text: str | None) -> str:
    """The words of a text, A-Z lower-cased, each after and before one space."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_SEPARATED).split()
    return f" {b' '.join(words).decode('utf-8', 'surrogatepass')} " if words else " "


def matches(normal: str, gated: bool = True) -> list[tuple[int, int, str, int, int]]:
    """(start, end, label, priority, rule order) of each match of the rules whose keyword is in ``normal``; of all rules if not
    ``gated``, which gives the same matches."""
    here = {k for _, k in _gate().iter(normal)}
    return [(m.start(), m.end(), r.label, r.priority, order) for order, r in enumerate(rules()) if not gated or r.keyword in here for m in r.pattern.finditer(normal)]


def detections(normal: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) in characters of ``normal_words``, after suppression: a detection
    goes if another's interval contains its own and that one has a higher priority, or the same and is longer or earlier in rule order."""
    found = matches(normal)
    found.sort(key=lambda x: (-x[3], -(x[1] - x[0]), x[4], x[0]))
    longest = max((x[1] - x[0] for x in found), default=0)
    kept: dict[int, list[tuple]] = {}  # by start // 256, so that only near intervals are compared
    for x in found:
        near = range((x[1] - longest) >> 8, (x[0] >> 8) + 1)
        if not any(k[0] <= x[0] and x[1] <= k[1] for b in near for k in kept.get(b, ())):
            kept.setdefault(x[0] >> 8, []).append(x)
    return sorted(x[:4] for b in kept.values() for x in b)


def scan_text(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score of a text."""
    normal = normal_words(text)
    places, base = [], set()
    for phrase, label in BASE.items():
        at = normal.find(f" {phrase} ")
        while at >= 0:
            places.append(at)
            base.add(label)
            at = normal.find(f" {phrase} ", at + 1)
    found = detections(normal)
    first = normal.count(" ", 0, min(places)) if places else None
    last = normal.count(" ", 0, max(places)) if places else None
    labels = base | {x[2] for x in found}
    score = max([0.4 * bool(base), *(x[3] / 100 for x in found)])
    return normal.count(" ") - 1, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), float(score)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score. Null and empty texts have no words, no labels and score 0; repeated rows stay; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(scan_text(t.as_py()) for t in batch.column("text"))) if batch.num_rows else [()] * len(_SCANNED)
            yield with_columns(batch, {n: pa.array(x, t) for (n, t), x in zip(_SCANNED.items(), columns)}, drop=("text",))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


_SCANNED = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, n_words, label, priority, matched): each detection that stays, by word. Null and empty
    texts have none; ids may be null or repeat, and each row counts; an empty table gives an empty result; other
    columns are not read."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column("text")):
                normal = normal_words(t.as_py())
                rows += [(i, normal.count(" ", 0, a) - 1, normal.count(" ", a, b) + 1, label, priority, normal[a:b]) for a, b, label, priority in detections(normal)]
            at, *columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, y) for x, y in zip(columns, types))], names=["doc_id", "first_word", "n_words", "label", "priority", "matched"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, first_word long, n_words long, label string, priority int, matched string")


def op8_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
