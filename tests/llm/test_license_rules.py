"""Licence rules: the keyword gate against all rules, suppression against brute force, whole headers."""

import random
import re
import warnings

from trekspark.llm import license_scan as scan
from trekspark.llm.license_rules import WRITTEN

with warnings.catch_warnings():  # the standard library's own parser of patterns
    warnings.simplefilter("ignore")
    from re import _constants as codes
    from re import _parser as parser


def example(parsed, r) -> str:
    """A random text that a pattern matches."""
    out = ""
    for op, arg in parsed:
        if op is codes.LITERAL:
            out += chr(arg)
        elif op is codes.IN:
            out += {codes.LITERAL: lambda x: chr(x), codes.CATEGORY: lambda x: "7" if "DIGIT" in str(x) else "w", codes.RANGE: lambda x: chr(r.randint(*x))}[arg[0][0]](r.choice(arg)[1] if all(a[0] is codes.LITERAL for a in arg) else arg[0][1])
        elif op is codes.BRANCH:
            out += example(r.choice(arg[1]), r)
        elif op is codes.SUBPATTERN:
            out += example(arg[3], r)
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT):
            out += "".join(example(arg[2], r) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif op is codes.NOT_LITERAL:
            out += "w"
        elif op not in (codes.ASSERT, codes.AT):
            raise ValueError(op)
    return out


def texts(seed, n):
    r, rules = random.Random(seed), scan.rules()
    for _ in range(n):
        parts = [example(parser.parse(r.choice(rules).pattern.pattern), r) for _ in range(r.randint(1, 6))]
        yield scan.normal_words(" ".join(p + r.choice(["", " and", " of this file"]) for p in parts))


def test_every_rule_matches_with_its_keyword():
    r = random.Random(1)
    for rule in scan.rules():
        for _ in range(6):
            normal = scan.normal_words(example(parser.parse(rule.pattern.pattern), r))
            assert rule.pattern.search(normal), (rule, normal)
            assert rule.keyword in normal, (rule, normal)


def test_gated_equals_ungated():
    for normal in texts(2, 120):
        assert scan.matches(normal) == scan.matches(normal, gated=False)


def test_suppression_against_all_pairs():
    for normal in texts(3, 120):
        found = scan.matches(normal, gated=False)
        rank = {x: (-x[3], -(x[1] - x[0]), x[4], x[0]) for x in found}
        left = [x[:4] for x in found if not any(y[0] <= x[0] and x[1] <= y[1] and rank[y] < rank[x] for y in found)]
        assert sorted(scan.detections(normal)) == sorted(left)


def test_headers_notices_and_references():
    def labels(text):
        return scan.scan_text(text)[5].split(",")

    gpl = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
    Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""
    assert labels(gpl) == ["gpl", "gpl-2.0-or-later"]
    assert "bsd-3-clause" in labels("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")
    assert "gpl with classpath-exception-2.0" in labels("GPL v2 with the Classpath Exception")
    assert "mit or gpl" in labels('MODULE_LICENSE("Dual MIT/GPL");')
    assert "mit" in labels("Classifier: License :: OSI Approved :: MIT License")
    assert labels("They arrived in the public square, of course, without a licence.") == [""]
    assert len(WRITTEN) >= 190 and len({(a, c) for a, _, c, _ in WRITTEN}) == len(WRITTEN)
    assert all(re.compile(c) for _, _, c, _ in WRITTEN)
