"""The signature rules of the license scan, as patterns over words in lower case with one space between.

A license is one line: label, the words of its SPDX identifier, its names. Every license yields the
templates below, so the rule set is this table times the templates, a few hundred regexes in all.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: The labels and phrases every scan counts as base places.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Label | words of the SPDX identifier | names, alternatives after commas.
LICENSES = """
mit | mit | mit, expat, mit x11
mit-0 | mit 0 | mit no attribution, mit zero
isc | isc | isc, internet systems consortium
bsd-2 | bsd 2 clause | bsd 2 clause, simplified bsd, freebsd, two clause bsd
bsd-3 | bsd 3 clause | bsd 3 clause, new bsd, modified bsd, three clause bsd
bsd-4 | bsd 4 clause | bsd 4 clause, original bsd, four clause bsd
bsd-0 | 0bsd | zero clause bsd, bsd zero clause
bsd | bsd | bsd, berkeley software distribution
apache-1 | apache 1 1 | apache software license version 1 1, apache license 1 1
apache-2 | apache 2 0 | apache license version 2 0, apache license 2 0, apache 2 0, apache license version 2, apache software license 2 0
apache | apache | apache, apache software
gpl-1 | gpl 1 0 | gnu general public license version 1, gpl version 1, gpl v1, gplv1
gpl-2 | gpl 2 0 | gnu general public license version 2, gnu general public license v2, gpl version 2, gpl v2, gplv2, gpl 2
gpl-3 | gpl 3 0 | gnu general public license version 3, gnu general public license v3, gpl version 3, gpl v3, gplv3, gpl 3
gpl | gpl | gnu general public, gnu gpl, gpl
lgpl-2 | lgpl 2 0 | gnu library general public license version 2, lgpl version 2, lgpl v2, lgplv2
lgpl-2.1 | lgpl 2 1 | gnu lesser general public license version 2 1, lgpl version 2 1, lgpl v2 1, lgplv2 1, lgpl 2 1
lgpl-3 | lgpl 3 0 | gnu lesser general public license version 3, lgpl version 3, lgpl v3, lgplv3
lgpl | lgpl | gnu lesser general public, gnu library general public, gnu lgpl, lgpl
agpl-3 | agpl 3 0 | gnu affero general public license version 3, agpl version 3, agpl v3, agplv3
agpl | agpl | gnu affero general public, affero general public, gnu agpl, agpl
gfdl | gfdl 1 3 | gnu free documentation, gfdl
mpl-1.1 | mpl 1 1 | mozilla public license version 1 1, mozilla public license 1 1, mpl 1 1
mpl-2 | mpl 2 0 | mozilla public license version 2 0, mozilla public license 2 0, mpl 2 0, mozilla public license v2
mpl | mpl | mozilla public
epl-1 | epl 1 0 | eclipse public license version 1 0, eclipse public license 1 0, epl 1 0
epl-2 | epl 2 0 | eclipse public license version 2 0, eclipse public license 2 0, epl 2 0
epl | epl | eclipse public
cddl | cddl 1 0 | common development and distribution, cddl
cpl | cpl 1 0 | common public license version 1 0, common public license 1 0
eupl | eupl 1 2 | european union public, eupl
cecill | cecill 2 1 | cecill
artistic | artistic 2 0 | artistic, perl artistic
zlib | zlib | zlib, zlib libpng
libpng | libpng 2 0 | libpng
boost | bsl 1 0 | boost software, boost
busl | busl 1 1 | business source
sspl | sspl 1 0 | server side public, sspl
elastic | elastic 2 0 | elastic
unlicense | unlicense | unlicense
wtfpl | wtfpl | do what the fuck you want to public, wtfpl
cc0 | cc0 1 0 | creative commons zero, cc0 1 0 universal, cc0
cc-by | cc by 4 0 | cc by 4 0, cc by 3 0, creative commons attribution 4 0 international, creative commons attribution
cc-by-sa | cc by sa 4 0 | cc by sa, creative commons attribution sharealike, creative commons attribution share alike
cc-by-nd | cc by nd 4 0 | cc by nd, creative commons attribution noderivatives, creative commons attribution no derivatives
cc-by-nc | cc by nc 4 0 | cc by nc, creative commons attribution noncommercial, creative commons attribution non commercial
cc-by-nc-sa | cc by nc sa 4 0 | cc by nc sa, creative commons attribution noncommercial sharealike
cc-by-nc-nd | cc by nc nd 4 0 | cc by nc nd, creative commons attribution noncommercial noderivatives
creative-commons | cc pddc | creative commons
odbl | odbl 1 0 | open database, odbl
odc-by | odc by 1 0 | open data commons attribution
pddl | pddl 1 0 | public domain dedication and, open data commons public domain dedication and
ofl | ofl 1 1 | sil open font, open font, ofl 1 1
python | python 2 0 | python software foundation, psf
php | php 3 01 | php
ruby | ruby | ruby
openssl | openssl | openssl, ssleay
postgresql | postgresql | postgresql
ms-pl | ms pl | microsoft public
ms-rl | ms rl | microsoft reciprocal
osl-3 | osl 3 0 | open software license version 3 0, open software license 3 0
afl-3 | afl 3 0 | academic free license version 3 0, academic free
ncsa | ncsa | university of illinois ncsa open source, ncsa
w3c | w3c | w3c software notice and, w3c software
x11 | x11 | x11, x consortium
curl | curl | curl
icu | icu | icu, unicode
beerware | beerware | beerware, beer ware
vim | vim | vim
tex | lppl 1 3c | latex project public, lppl
""".strip().splitlines()

#: Label | confidence | a sentence of the license's own text or notice.
SENTENCES = """
mit | 0.95 | permission is hereby granted free of charge to any person obtaining a copy
isc | 0.95 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | 0.95 | redistribution and use in source and binary forms with or without modification are permitted
gpl | 0.95 | this program is free software you can redistribute it and or modify it
gpl | 0.7 | either version (?:2|3) of the license or at your option any later version
mpl | 0.95 | this source code form is subject to the terms of the mozilla public license
zlib | 0.9 | this software is provided as is without any express or implied warranty
boost | 0.9 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
unlicense | 0.95 | this is free and unencumbered software released into the public domain
wtfpl | 0.9 | you just do what the fuck you want to
cc0 | 0.9 | has waived all copyright and related or neighboring rights
public-domain | 0.7 | (?:released|dedicated|placed) (?:to|into) the public domain
proprietary | 0.5 | all rights reserved
proprietary | 0.8 | proprietary and confidential
proprietary | 0.8 | confidential and proprietary
proprietary | 0.8 | unauthorized copying of this file
""".strip().splitlines()

_GRANT = (r"(?:licen[sc]ed|released|distributed|redistributed|published|available|covered|governed|provided|offered) "
          r"(?:to you )?under (?:(?:the|a) )?(?:terms (?:and conditions )?of (?:the )?)?")
#: (what, pattern around a name, priority, confidence); the higher priority hides what it contains.
_TEMPLATES = (
    ("grant", _GRANT + r"{name}(?: licen[sc]e)?", 4, 0.95),
    ("under", r"under (?:the )?{name} licen[sc]e", 3, 0.9),
    ("named", r"{name} (?:public )?licen[sc]e", 2, 0.8),
)


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: re.Pattern


def _rule(name: str, label: str, priority: int, confidence: float, keyword: str, pattern: str) -> Rule:
    return Rule(name, label, priority, confidence, keyword, re.compile(rf"(?<![^ ]){pattern}(?![^ ])"))


def rules() -> list[Rule]:
    """All rules in order; ``keyword`` is a text without which the rule cannot match."""
    out = []
    for line in LICENSES:
        label, spdx, names = (x.strip() for x in line.split("|"))
        out.append(_rule(f"{label}:spdx", label, 5, 1.0, "spdx", f"spdx license identifier {spdx}(?: or later| only)?"))
        for name in (x.strip() for x in names.split(",")):
            for what, pattern, priority, confidence in _TEMPLATES:
                # a longer name is the more precise label of the same words
                out.append(_rule(f"{label}:{what}:{name}", label, 10 * priority + len(name.split()), confidence, name,
                                 pattern.format(name=name)))
            if "license" in name:
                out.append(_rule(f"{label}:full:{name}", label, 20 + len(name.split()), 0.8, name, name))
    for line in SENTENCES:
        label, confidence, text = line.split(" | ", 2)
        literal = max(re.split(r"\(\?:.*?\)", text), key=len).strip()
        out.append(_rule(f"{label}:text:{literal}", label, 60, float(confidence), literal, text))
    return out
