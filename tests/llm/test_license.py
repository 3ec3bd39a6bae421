import re

import pytest

from docket.llm.license_rules import BASE, rules
from docket.llm.license_scan import base_places, detections, license_scan, resolve, words

TEXT = """SPDX-License-Identifier: Apache-2.0
Licensed under the Apache License, Version 2.0. Released under the MIT License. This work is
licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0. All rights reserved.
Permission is hereby granted, free of charge, to any person obtaining a copy. admit licenses"""


def labels(text):
    return sorted({d[5] for d in resolve(detections(" ".join(w.decode() for w in words(text))))})


def test_hundreds_of_rules_with_their_keywords():
    all_rules = rules()
    assert 300 <= len(all_rules) <= 999
    assert all(r.keyword and not re.search(r"[\[\](){}|?*+]", r.keyword) for r in all_rules)


def test_labels():
    assert labels(TEXT) == ["apache-2", "cc-by-nc", "gpl-3", "mit", "proprietary"]
    assert labels("dual licensed: LGPL v2.1 license or the MPL 2.0 license") == ["lgpl-2.1", "mpl-2"]
    assert labels("I admit licenses are a limit license holders commit to; the transit license") == []
    assert labels("") == []


def test_containment_matches_brute_force():
    found = detections(" ".join(w.decode() for w in words(TEXT * 3)))
    rank = lambda d: (-d[2], d[0] - d[1], d[3])
    kept = []
    for d in sorted(found, key=lambda d: (*rank(d), d[0])):
        if not any(k[0] <= d[0] and d[1] <= k[1] and rank(k) < rank(d) for k in kept):
            kept.append(d)
    assert resolve(found) == sorted(kept) and 0 < len(kept) < len(found)


def test_base_places_match_brute_force():
    text = TEXT + " under the mit license under the mit license cc by nc cc by nc sa éunder the mit license"
    got = words(text)
    want = []
    for label, phrase in BASE:
        p = [w.encode() for w in phrase.split()]
        want += [(i, label) for i in range(len(got)) if got[i:i + len(p)] == p]
    assert base_places(b" ".join(got).decode()) == sorted(want) and len(want) == 7
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    assert [w.decode() for w in got] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


@pytest.mark.parametrize("char", ["\u00a0", "\u0085", "\u3000", "\u2003", "\u2028"])
def test_characters_beyond_ascii_belong_to_words(char):
    for label, phrase in BASE:
        for text in (f"{char}{phrase}", f"{phrase}{char}", f"x {phrase}{char} y", f"x{char}{phrase} y"):
            line = " ".join(w.decode() for w in words(text))
            assert base_places(line) == [] and len(line.split(" ")) == len(text.split(" "))
        assert base_places(f"{char} {phrase} {char}") == [(1, label)]
    for text in (f"mit license{char}", f"{char}gplv3 license", f"all rights reserved{char}"):
        assert labels(text) == []
    assert labels(f"{char} gplv3 license {char}") == ["gpl-3"]


def test_odd_rows(spark, odd_docs):
    rows = license_scan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.labels == r.base_labels == "" and r.first_word is None and r.score == 0
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    r = {x.doc_id: x for x in license_scan(docs).collect()}
    assert (r[1].n_base, r[1].base_labels, r[1].labels) == (3, "apache-2,cc-by-nc,mit", "apache-2,cc-by-nc,gpl-3,mit,proprietary")
    assert r[2].n_words == 0 and r[2].findings == []
    assert license_scan(odd_docs.limit(0)).count() == 0
