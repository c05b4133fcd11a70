"""License scans by ordered signature rules.

Rules are regular expressions over a text's words (lower-cased, one blank
between them). Each rule has a keyword that must occur in the text before the
expression is tried (one automaton tells which do), a priority and a confidence. Detections are spans of
words; one that lies inside a span of the same family of licences of higher priority, or inside a longer one
of the same priority, is suppressed: a shorter reading of the same licence. Another licence inside a span
stays, as in "MIT or Apache 2.0"; remarks (on warranty, copyright and the like) are part of whatever span they lie
in. The three base rules are never suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.llm import textops as X
from wardline.operators.literals import Gate

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))

#: fixed values: the base phrases and their labels
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label, SPDX identifiers (as words), names (as expressions over words)
FAMILIES = (
    ("mit", ("mit", "mit 0", "x11"), ("mit licen[cs]e", "expat licen[cs]e", "x11 licen[cs]e")),
    ("apache-2.0", ("apache 2 0",), ("apache licen[cs]e(?: version)? 2(?: 0)?", "apache software licen[cs]e(?: version)? 2(?: 0)?", "apache 2 0", "asl 2 0")),
    ("apache-1.1", ("apache 1 1", "apache 1 0"), ("apache(?: software)? licen[cs]e(?: version)? 1 [01]",)),
    ("bsd-2-clause", ("bsd 2 clause", "0bsd", "bsd 2 clause patent"), ("bsd 2 clause", "2 clause bsd", "simplified bsd licen[cs]e", "freebsd licen[cs]e")),
    ("bsd-3-clause", ("bsd 3 clause", "bsd 3 clause clear"), ("bsd 3 clause", "3 clause bsd", "new bsd licen[cs]e", "modified bsd licen[cs]e", "revised bsd licen[cs]e")),
    ("bsd-4-clause", ("bsd 4 clause",), ("bsd 4 clause", "4 clause bsd", "original bsd licen[cs]e")),
    ("bsd", ("bsd",), ("bsd licen[cs]e", "bsd style licen[cs]e", "berkeley software distribution licen[cs]e")),
    ("isc", ("isc",), ("isc licen[cs]e", "internet systems consortium licen[cs]e")),
    ("gpl-1.0", ("gpl 1 0", "gpl 1 0 only", "gpl 1 0 or later"), ("(?:gnu )?general public licen[cs]e(?: version| v)? 1(?: 0)?", "gpl ?v1")),
    ("gpl-2.0", ("gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"), ("(?:gnu )?general public licen[cs]e(?: version| v)? 2(?: 0)?", "gpl ?v2", "gplv2", "gnu gpl 2")),
    ("gpl-3.0", ("gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"), ("(?:gnu )?general public licen[cs]e(?: version| v)? 3(?: 0)?", "gpl ?v3", "gplv3", "gnu gpl 3")),
    ("lgpl", ("lgpl 2 0", "lgpl 2 1", "lgpl 3 0", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 or later"), ("(?:gnu )?(?:lesser|library) general public licen[cs]e", "lgpl ?v?[23](?: [01])?", "gnu lgpl")),
    ("agpl", ("agpl 3 0", "agpl 1 0", "agpl 3 0 only", "agpl 3 0 or later"), ("(?:gnu )?affero general public licen[cs]e", "agpl ?v?3", "gnu agpl")),
    ("gfdl", ("gfdl 1 1", "gfdl 1 2", "gfdl 1 3"), ("(?:gnu )?free documentation licen[cs]e", "gfdl")),
    ("mpl-2.0", ("mpl 2 0", "mpl 2 0 no copyleft exception"), ("mozilla public licen[cs]e(?: version| v)? 2(?: 0)?", "mplv2")),
    ("mpl-1.1", ("mpl 1 0", "mpl 1 1"), ("mozilla public licen[cs]e(?: version| v)? 1 [01]",)),
    ("epl", ("epl 1 0", "epl 2 0"), ("eclipse public licen[cs]e",)),
    ("edl", ("edl 1 0",), ("eclipse distribution licen[cs]e",)),
    ("cddl", ("cddl 1 0", "cddl 1 1"), ("common development and distribution licen[cs]e",)),
    ("cpl", ("cpl 1 0",), ("common public licen[cs]e",)),
    ("ipl", ("ipl 1 0",), ("ibm public licen[cs]e",)),
    ("eupl", ("eupl 1 1", "eupl 1 2"), ("european union public licen[cs]e", "eupl ?v?1")),
    ("osl", ("osl 2 1", "osl 3 0"), ("open software licen[cs]e",)),
    ("afl", ("afl 2 1", "afl 3 0"), ("academic free licen[cs]e",)),
    ("artistic", ("artistic 1 0", "artistic 2 0", "artistic 1 0 perl"), ("artistic licen[cs]e", "perl artistic")),
    ("zlib", ("zlib", "zlib acknowledgement"), ("zlib licen[cs]e", "zlib libpng licen[cs]e")),
    ("libpng", ("libpng", "libpng 2 0"), ("libpng licen[cs]e",)),
    ("bsl-1.0", ("bsl 1 0",), ("boost software licen[cs]e",)),
    ("busl", ("busl 1 1",), ("business source licen[cs]e",)),
    ("unlicense", ("unlicense",), ("the unlicense", "released into the public domain under the unlicense")),
    ("wtfpl", ("wtfpl",), ("do what the fuck you want to public licen[cs]e", "wtfpl")),
    ("python", ("psf 2 0", "python 2 0"), ("python software foundation licen[cs]e", "psf licen[cs]e")),
    ("php", ("php 3 0", "php 3 01"), ("php licen[cs]e",)),
    ("ruby", ("ruby",), ("ruby licen[cs]e",)),
    ("openssl", ("openssl", "ssleay"), ("openssl licen[cs]e", "ssleay licen[cs]e")),
    ("w3c", ("w3c", "w3c 19980720"), ("w3c software (?:notice and )?licen[cs]e", "w3c document licen[cs]e")),
    ("ofl", ("ofl 1 0", "ofl 1 1"), ("(?:sil )?open font licen[cs]e",)),
    ("ms-pl", ("ms pl",), ("microsoft public licen[cs]e",)),
    ("ms-rl", ("ms rl",), ("microsoft reciprocal licen[cs]e",)),
    ("postgresql", ("postgresql",), ("postgresql licen[cs]e",)),
    ("ncsa", ("ncsa",), ("university of illinois (?:ncsa )?open source licen[cs]e",)),
    ("upl", ("upl 1 0",), ("universal permissive licen[cs]e",)),
    ("sspl", ("sspl 1 0",), ("server side public licen[cs]e",)),
    ("elastic", ("elastic 2 0",), ("elastic licen[cs]e",)),
    ("odbl", ("odbl 1 0",), ("open database licen[cs]e", "odc odbl")),
    ("odc-by", ("odc by 1 0",), ("open data commons attribution licen[cs]e",)),
    ("pddl", ("pddl 1 0",), ("public domain dedication and licen[cs]e",)),
    ("cc0", ("cc0 1 0",), ("cc0", "creative commons zero", "cc zero")),
    ("cc-by-sa", ("cc by sa 2 0", "cc by sa 3 0", "cc by sa 4 0"), ("cc by sa", "creative commons attribution share ?alike")),
    ("cc-by-nc", ("cc by nc 3 0", "cc by nc 4 0"), ("cc by nc", "creative commons attribution non ?commercial")),
    ("cc-by-nd", ("cc by nd 3 0", "cc by nd 4 0"), ("cc by nd", "creative commons attribution no ?deriv(?:s|atives)")),
    ("cc-by-nc-sa", ("cc by nc sa 3 0", "cc by nc sa 4 0"), ("cc by nc sa", "creative commons attribution non ?commercial share ?alike")),
    ("cc-by-nc-nd", ("cc by nc nd 3 0", "cc by nc nd 4 0"), ("cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives)")),
    ("cc-by", ("cc by 2 0", "cc by 3 0", "cc by 4 0"), ("creative commons attribution", "cc by [1-4] [0-9]")),
)

#: wording of whole notices: label, keyword, expression, confidence
NOTICES = (
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy", 0.98),
    ("mit", "the above copyright notice", "the above copyright notice and this permission notice shall be included in all copies", 0.9),
    ("isc", "with or without fee", "permission to use copy modify and or? ?distribute this software for any purpose with or without fee", 0.95),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd-3-clause", "endorse or promote", "used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display", 0.95),
    ("apache-2.0", "you may not use this file", "you may not use this file except in compliance with the licen[cs]e", 0.85),
    ("gpl", "free software foundation", "it under the terms of the gnu general public licen[cs]e as published by the free software foundation", 0.98),
    ("lgpl", "free software foundation", "it under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation", 0.98),
    ("agpl", "free software foundation", "it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation", 0.98),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such", 0.9),
    ("bsl-1.0", "machine executable object code", "machine executable object code generated by a source language processor", 0.9),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain", 0.98),
    ("public-domain", "public domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 0.8),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public licen[cs]e", 0.98),
    ("warranty", "without warranty", "provided as is without warranty of any kind", 0.5),
    ("warranty", "without any warranty", "without any warranty without even the implied warranty", 0.5),
    ("proprietary", "proprietary", "proprietary and confidential", 0.9),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|use|distribution) (?:of|or)[^\n]{1,80}?(?:is )?(?:strictly )?prohibited", 0.85),
    ("proprietary", "without the prior written", "without the prior written (?:permission|consent) of", 0.6),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 0.4),
)

#: more wording, each rule written for one text: label, expression, confidence; the keyword is what every match must hold
WORDING = (
    # exceptions to a licence
    ("classpath-exception", "link(?:ing)? this library with independent modules to produce an executable", 0.95),
    ("classpath-exception", "classpath exception(?: 2 0)?", 0.9),
    ("gcc-exception", "gcc runtime library exception", 0.95),
    ("gcc-exception", "propagate a work of target code formed by combining the runtime library", 0.9),
    ("llvm-exception", "apache 2 0 with llvm exceptions?|llvm exceptions? to the apache", 0.95),
    ("autoconf-exception", "distribute (?:the )?configure scripts? that (?:are|is) (?:the )?output of autoconf", 0.9),
    ("bison-exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 0.95),
    ("openssl-exception", "permission to link (?:the code of )?[a-z0-9 ]{1,60}?with the openssl", 0.9),
    ("font-exception", "if you create a document which uses this font and embed this font", 0.95),
    ("linking-exception", "linking [a-z0-9 ]{1,40}?statically or dynamically with other modules is making a combined work", 0.9),
    ("syscall-note", "does not cover user programs that use kernel services by normal system calls", 0.95),
    # whole notices
    ("apache-2.0", "(?:www )?apache org licenses license 2 0", 0.95),
    ("apache-2.0", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", 0.85),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements", 0.98),
    ("apache-1.1", "this product includes software developed by the apache (?:group|software foundation)", 0.8),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu", 0.9),
    ("gpl", "you should have received a copy of the gnu general public licen[cs]e along with", 0.95),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with", 0.95),
    ("agpl", "you should have received a copy of the gnu affero general public licen[cs]e along with", 0.95),
    ("agpl", "remote network interaction use with the gnu general public licen[cs]e", 0.9),
    ("gpl-2.0", "either version 2 of the licen[cs]e or (?:at your option )?any later version", 0.9),
    ("gpl-3.0", "either version 3 of the licen[cs]e or (?:at your option )?any later version", 0.9),
    ("gpl", "(?:www )?gnu org (?:licenses|copyleft) gpl", 0.9),
    ("lgpl", "(?:www )?gnu org licenses lgpl", 0.9),
    ("agpl", "(?:www )?gnu org licenses agpl", 0.9),
    ("gfdl", "with no invariant sections(?: with)? no front cover texts and no back cover texts", 0.95),
    ("mit", "(?:www )?opensource org licenses mit", 0.95),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.8),
    ("mit-0", "permission is hereby granted without written agreement and without license or royalty fees", 0.6),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions", 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions", 0.9),
    ("bsd-3-clause", "neither the names? of [a-z0-9 ]{1,120}?contributors may be used to endorse or promote products", 0.95),
    ("isc", "provided as is and the author disclaims all warranties with regard to this software", 0.9),
    ("bsl-1.0", "(?:www )?boost org license 1 0", 0.95),
    ("zlib", "the origin of this software must not be misrepresented", 0.9),
    ("zlib", "provided as is without any express or implied warranty in no event will the authors be held liable", 0.85),
    ("mpl-2.0", "(?:www )?mozilla org mpl 2 0", 0.95),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[cs]e", 0.9),
    ("mpl-2.0", "incompatible with secondary licen[cs]es", 0.85),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", 0.98),
    ("epl", "(?:www )?eclipse org legal epl", 0.95),
    ("cddl", "the contents of this file are subject to the terms of (?:either the gnu general public licen[cs]e version 2 only or )?the common development and distribution licen[cs]e", 0.95),
    ("artistic", "aggregate this package with other (?:possibly commercial )?programs as part of a larger", 0.85),
    ("perl", "(?:under|on) the same terms as (?:the )?perl(?: 5)?(?: itself)?", 0.95),
    ("python", "psf is making python [0-9a-z ]{0,20}available to licensee on an as is basis", 0.95),
    ("php", "this product includes php software(?: freely available from| developed by the php group)", 0.9),
    ("openssl", "this product includes software developed by the openssl project", 0.95),
    ("openssl", "this product includes cryptographic software written by eric young", 0.95),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.9),
    ("hpnd", "appear in supporting documentation and that the names? of", 0.85),
    ("ncsa", "to deal with the software without restriction including without limitation", 0.7),
    ("postgresql", "in no event shall the university of california be liable to any party", 0.9),
    ("unicode", "unicode data files and any associated documentation", 0.9),
    ("json", "the software shall be used for good not evil", 0.98),
    ("beerware", "you can buy me a beer in return", 0.98),
    ("wtfpl", "you just do what the fuck you want to", 0.98),
    ("unlicense", "(?:refer|see) [a-z ]{0,20}unlicense org", 0.95),
    ("cc0", "(?:has|have) waived all copyright and related or neighboring rights", 0.95),
    ("cc0", "creativecommons org publicdomain zero 1 0", 0.98),
    ("public-domain", "no (?:known )?copyright (?:restrictions?|is claimed)", 0.8),
    ("public-domain", "the authors? disclaims? copyright to this source code", 0.95),
    ("cc-by", "creativecommons org licenses by [1-4] [05]", 0.95),
    ("cc-by-sa", "creativecommons org licenses by sa [1-4] [05]", 0.95),
    ("cc-by-nc", "creativecommons org licenses by nc [1-4] [05]", 0.95),
    ("cc-by-nd", "creativecommons org licenses by nd [1-4] [05]", 0.95),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa [1-4] [05]", 0.95),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd [1-4] [05]", 0.95),
    ("ofl", "with reserved font names?", 0.9),
    ("ofl", "neither the font software nor any of its individual components [a-z ]{0,60}may be sold by itself", 0.95),
    ("odbl", "opendatacommons org licenses odbl", 0.95),
    ("odc-by", "opendatacommons org licenses by", 0.95),
    ("pddl", "opendatacommons org licenses pddl", 0.95),
    ("ogl-uk", "open government licen[cs]e(?: v| version)? ?[1-3]?", 0.9),
    ("etalab", "licence ouverte open licence|licence ouverte etalab", 0.95),
    ("dl-de", "datenlizenz deutschland (?:zero|namensnennung)", 0.95),
    # source available and proprietary terms
    ("commons-clause", "commons clause licen[cs]e condition", 0.95),
    ("commons-clause", "does not grant to you the right to sell the software", 0.9),
    ("busl", "change date (?:[0-9]{1,4} ){1,3}change licen[cs]e", 0.9),
    ("busl", "additional use grant", 0.85),
    ("sspl", "offering the program as a service|functionality of the program or modified version available to third parties as a service", 0.9),
    ("elastic", "provide the software to third parties as a hosted or managed service", 0.9),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|internal use|free trial|perimeter)", 0.95),
    ("confluent", "confluent community licen[cs]e", 0.95),
    ("prosperity", "prosperity public licen[cs]e", 0.95),
    ("parity", "parity public licen[cs]e", 0.95),
    ("rail", "use based restrictions|responsible ai licen[cs]es?|open ?rail m?", 0.85),
    ("proprietary", "contains (?:confidential|proprietary)? ?(?:information and )?trade secrets? of", 0.9),
    ("proprietary", "end user licen[cs]e agreement", 0.8),
    ("proprietary", "may not be reproduced (?:distributed )?(?:or )?(?:transmitted )?(?:copied )?(?:in any form )?(?:or by any means )?without", 0.8),
    ("proprietary", "for (?:internal )?evaluation purposes only", 0.7),
    ("non-commercial", "for non ?commercial (?:use|purposes)(?: only)?", 0.8),
    ("non-commercial", "for personal (?:and non ?commercial )?use only", 0.75),
    ("non-commercial", "for (?:academic and )?research purposes only", 0.75),
    ("no-derivatives", "you may not (?:create|make|distribute) (?:any )?derivative works", 0.8),
    ("attribution", "attribution (?:is )?required|must give appropriate credit", 0.7),
    ("share-alike", "distribute your contributions under the same licen[cs]e", 0.8),
    ("reserved", "all rights not expressly granted (?:herein )?are reserved", 0.85),
    ("warranty", "use (?:it )?at your own risk", 0.4),
    ("warranty", "merchantability and fitness for a particular purpose are disclaimed", 0.6),
    ("copyright", "portions copyright", 0.5),
    ("copyright", "(?:this (?:is|contains) )?copyrighted material", 0.5),
    ("copyright", "tous droits r\u00e9serv\u00e9s", 0.8),
    ("copyright", "alle rechte vorbehalten", 0.8),
    ("copyright", "todos los derechos reservados", 0.8),
    # short forms and dual licences
    ("gpl-2.0", "gpl 2(?: 0)?(?: only| or later)?", 0.6),
    ("gpl-3.0", "gpl 3(?: 0)?(?: only| or later)?", 0.6),
    ("dual", "dual licen[cs]ed", 0.6),
    ("dual", "licen[cs]ed under (?:either of )?[a-z0-9 ]{1,60}? or [a-z0-9 ]{1,40}? at your option", 0.7),
    ("mit", "mit or apache 2 0", 0.9),
    ("apache-2.0", "mit or apache 2 0", 0.9),
    ("mit", "apache 2 0 or mit", 0.9),
    ("apache-2.0", "apache 2 0 or mit", 0.9),
    ("bsd", "bsd licen[cs]ed", 0.7),
    ("mit", "mit licen[cs]ed", 0.8),
    ("open-source", "approved by the open source initiative|osi approved", 0.5),
    ("see-license", "see (?:the )?(?:accompanying )?(?:licen[cs]e|copying|notice)(?: txt| md)? file", 0.4),
)

#: ways a licence is named around its name: expression around it, priority, confidence
FRAMES = (
    ("(?:is )?(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?%s", 60, 0.95),
    ("see (?:the )?%s for", 50, 0.8),
    ("%s", 40, 0.7),
)


#: labels of one family whose names begin differently
_KIN = {"lgpl": "gpl", "agpl": "gpl", "gfdl": "gpl"}
#: labels of remarks: any span takes in those inside it, and they take in nothing but each other
REMARKS = frozenset(("warranty", "copyright", "see-license", "open-source", "attribution"))


def family(label: str) -> str:
    """Labels of one family are readings of one licence: the part before the first dash, but for a few."""
    root = label if label.endswith("-exception") else label.split("-")[0]
    return _KIN.get(root, root)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    priority: int
    confidence: float
    base: bool = False


def _pattern(words: str) -> re.Pattern[bytes]:
    return re.compile(f" (?:{words})(?= )".encode())


def _keyword(name: str) -> bytes:
    """The longest part of an expression that is plain words."""
    return max(re.split(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\??|\[[^\]]*\]\??|.\?", name), key=len).strip().encode()


def _ways(words: str) -> list[str]:
    """An expression's outermost alternatives, so that each has a keyword of its own."""
    out, depth = [""], 0
    for sign in words:
        depth += {"(": 1, ")": -1}.get(sign, 0)
        if sign == "|" and not depth:
            out.append("")
        else:
            out[-1] += sign
    return out


def _needed(words: str) -> bytes:
    """The longest run of plain signs that every match of an expression holds; empty if there is none, and then it is always tried."""
    best, run = "", ""
    for op, arg in re._parser.parse(words):
        if str(op) == "LITERAL":
            run += chr(arg)
        else:
            run = ""
        if len(run.strip()) > len(best):
            best = run.strip()
    return best.encode()


def rules() -> list[Rule]:
    """All rules in order; earlier ones win ties."""
    out = [Rule(label, phrase.encode(), _pattern(phrase), 0, 0.6, True) for phrase, label in BASE]
    for label, keyword, words, confidence in NOTICES:
        out.append(Rule(label, keyword.encode(), _pattern(words), 90, confidence))
    for label, words, confidence in WORDING:
        out += [Rule(label, _needed(way), _pattern(way), 70, confidence) for way in _ways(words)]
    for label, ids, names in FAMILIES:
        for i in sorted(ids, key=len, reverse=True):
            out.append(Rule(label, b"spdx", _pattern(f"spdx licen[cs]e identifier {i}"), 80 + len(i.split()), 1.0))
        for name in names:
            for frame, priority, confidence in FRAMES:
                out.append(Rule(label, _keyword(name), _pattern(frame % f"(?:{name})"), priority, confidence))
    return out


def survivors(spans: np.ndarray) -> np.ndarray:
    """Rows (start, end, priority, order) of spans; which of them no other span suppresses."""
    keep = np.zeros(len(spans), bool)
    starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for p in np.unique(spans[:, 2])[::-1]:
        row = np.flatnonzero(spans[:, 2] == p)
        row = row[np.lexsort((spans[row, 3], -spans[row, 1], spans[row, 0]))]
        s, e = spans[row, 0], spans[row, 1]
        reach = np.maximum.accumulate(e)
        inside = np.zeros(len(row), bool)
        inside[1:] = reach[:-1] >= e[1:]
        if len(starts):
            at = np.searchsorted(starts, s, "right") - 1
            inside |= (at >= 0) & (ends[np.maximum(at, 0)] >= e)
        keep[row[~inside]] = True
        starts, ends = np.append(starts, s), np.append(ends, e)
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], np.maximum.accumulate(ends[order])
    return keep


class Scanner:
    """Rules with the automaton of their keywords."""

    def __init__(self, ruleset: list[Rule] | None = None) -> None:
        self.rules = rules() if ruleset is None else ruleset
        self._gate = Gate(frozenset([r.keyword.decode("latin-1")] if r.keyword else []) for r in self.rules)
        families = sorted({family(r.label) for r in self.rules})
        self.family = np.array([families.index(family(r.label)) for r in self.rules])
        self.remark = np.array([r.label in REMARKS for r in self.rules])

    def tried(self, line: bytes) -> list[int]:
        """Numbers of the rules whose keyword a line holds."""
        return sorted(self._gate.of(line.decode("latin-1")))

    def survivors(self, spans: np.ndarray) -> np.ndarray:
        """As ``survivors``, within each family; remarks against all spans."""
        of, remark = self.family[spans[:, 3]], self.remark[spans[:, 3]]
        keep = np.zeros(len(spans), bool)
        if remark.any():
            keep[remark] = survivors(spans)[remark]
        for f in np.unique(of[~remark]):
            row = np.flatnonzero((of == f) & ~remark)
            keep[row] = survivors(spans[row])
        return keep


def scan(text: bytes, scanner: Scanner) -> tuple[int, list[tuple[int, int, Rule, bool]]]:
    """(number of words, detections as (first word, word after the last, rule, survives))."""
    words = text.translate(_FOLD).split()
    line = b" %b " % b" ".join(words)
    ruleset = scanner.rules
    found = [(m.start(), m.end(), order) for order in scanner.tried(line) for m in ruleset[order].pattern.finditer(line)]
    if not found:
        return len(words), []
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    f = np.array(found, np.int64)
    spans = np.stack([np.searchsorted(blanks, f[:, 0]), np.searchsorted(blanks, f[:, 1]), np.array([ruleset[o].priority for o in f[:, 2]]), f[:, 2]], 1)
    base = np.array([ruleset[o].base for o in f[:, 2]])
    keep = base.copy()
    keep[~base] = scanner.survivors(spans[~base])
    return len(words), [(int(s), int(e), ruleset[o], bool(k)) for (s, e, _, o), k in zip(spans.tolist(), keep.tolist(), strict=True)]


def detections(docs: DataFrame) -> DataFrame:
    """Every detection: doc_id, first_word, end_word, label, priority, confidence, suppressed."""
    X.small_batches(docs.sparkSession)

    def task(batches):
        scanner = Scanner()
        for b in batches:
            data, off = X.column(b, "text")
            raw, ids, rows = data.tobytes(), b.column(0), []
            for d, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                rows += [(d, f, t, r.label, r.priority, r.confidence, not k) for f, t, r, k in scan(raw[s:e], scanner)[1]]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=["doc_id", "first_word", "end_word", "label", "priority", "confidence", "suppressed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(X.lean(task), f"doc_id {kind}, first_word long, end_word long, label string, priority int, confidence double, suppressed boolean")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of the base phrases, first_word and last_word are
    the least and greatest word they start at (null without any). labels are
    those of surviving detections and of the base phrases; both lists are
    distinct, sorted and comma-joined. score is 1 - the product of (1 -
    confidence) over the labels, each at its most confident. Null and empty
    texts have no words and score 0; repeated rows are scanned alike; other
    columns are ignored.
    """
    X.small_batches(docs.sparkSession)

    def task(batches):
        scanner = Scanner()
        for b in batches:
            data, off = X.column(b, "text")
            raw, rows = data.tobytes(), []
            for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                n, found = scan(raw[s:e], scanner)
                base = [(f, r.label) for f, _, r, _ in found if r.base]
                best: dict[str, float] = {}
                for _, _, r, k in found:
                    if k:
                        best[r.label] = max(best.get(r.label, 0.0), r.confidence)
                places = [f for f, _ in base]
                rows.append((n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(best)), 1 - float(np.prod([1 - best[x] for x in sorted(best)]))))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(X.lean(task), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
