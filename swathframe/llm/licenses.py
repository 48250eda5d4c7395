"""Licence scans by sentence rules.

Texts are split into sentences, which are normalised (case, punctuation, comment marks, spelling of "licence") and mapped
to identifiers of known licence sentences. A text's identifiers, in order, are then matched against ordered rules, each a
sequence of identifiers ("?" after one: may be missing) that names a licence; the first rule that matches at a place takes
it. Identifiers that no rule takes are reported as they are.

A line is read as sentences of its own and joined with the lines around it, so that wrapped sentences and lone lines are
both found. Texts without any of the words that all known sentences have are not split at all, which changes no result.
Defined cases: null and empty texts have no licences; repeated rows give equal results; whole texts are read; other columns
are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Known sentences after normalisation: identifier, pattern (the whole sentence).
SENTENCES = (
    ("MitName", r"(?:(?:this (?:\w+ )?is )?(?:released|licensed|distributed|available|provided) under the )?(?:terms of the )?(?:the )?mit license"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .* to deal in the software without restriction .*"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("AsIsWarranty", r"(?:the|this) software is provided (?:by .* )?as is (?:and .*|without (?:any )?(?:express or implied )?warranty.*)"),
    ("NoLiability", r"in no event shall .* be liable .*"),
    ("ApacheName", r"(?:this (?:\w+ )?is )?(?:released|licensed|distributed) under the (?:terms of the )?apache license,? version (?P<v>2\.0)(?: the license)?"),
    ("ApacheUse", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at .*"),
    ("ApacheBasis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind.*"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("GplName", r"(?:this (?:\w+ )?is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu general public license,? (?:version |v)(?P<v>[123](?:\.0)?)(?P<later> or (?:\(at your option\) )?(?:any )?later.*)?"),
    ("LgplName", r"(?:this (?:\w+ )?is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu lesser general public license,? (?:version |v)(?P<v>2\.1|3(?:\.0)?)(?P<later> or (?:any )?later.*)?"),
    ("AgplName", r"(?:this (?:\w+ )?is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu affero general public license,? (?:version |v)(?P<v>3(?:\.0)?)(?P<later> or (?:any )?later.*)?"),
    ("GplGrant", r".*is free software you can redistribute it and/?or modify it under the terms of the gnu general public license as published by the free software foundation,? either version (?P<v>[123]) of the license,? or \(?at your option\)? any later version"),
    ("GplHope", r".*is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GplSee", r"see the gnu general public license for more details"),
    ("GplCopy", r"you should have received a copy of the gnu general public license along with .*"),
    ("LgplGrant", r".*is free software you can redistribute it and/?or modify it under the terms of the gnu lesser general public license as published by the free software foundation,? either version (?P<v>2\.1|3) of the license,? or \(?at your option\)? any later version"),
    ("LgplSee", r"see the gnu lesser general public license for more details"),
    ("AgplGrant", r".*is free software you can redistribute it and/?or modify it under the terms of the gnu affero general public license as published by the free software foundation,? either version (?P<v>3) of the license,? or \(?at your option\)? any later version"),
    ("AgplSee", r"see the gnu affero general public license for more details"),
    ("ZlibAsIs", r"this software is provided as-is without any express or implied warranty"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("BoostName", r"(?:released|licensed|distributed) under the boost software license,? version (?P<v>1\.0)"),
    ("EplName", r".*(?:made available|released|licensed|distributed) under the (?:terms of the )?eclipse public license,? (?:version |v\.? ?)(?P<v>[12]\.0).*"),
    ("CddlName", r".*(?:subject to|under) the (?:terms of the )?common development and distribution license.*"),
    ("PsfName", r"(?:released|licensed|distributed) under the (?:terms of the )?python software foundation license.*"),
    ("BsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", r"(?:\d |\* )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BsdBinary", r"(?:\d |\* )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/?or other materials provided with the distribution"),
    ("BsdEndorse", r"(?:\d |\* )?neither the name of .* nor the names of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdName", r"(?:this (?:\w+ )?is )?(?:released|licensed|distributed) under the (?:terms of the )?(?:bsd )?(?P<v>[23])[- ]clause (?:bsd )?license"),
    ("IscGrant", r"permission to use copy modify and/?or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("MplName", r"this source code form is subject to the terms of the mozilla public license,? v\.? ?(?P<v>2\.0)"),
    ("MplCopy", r"if a copy of the mpl was not distributed with this file,? you can obtain one at .*"),
    ("CcName", r"(?:this (?:\w+ )?is )?(?:released|licensed|distributed|available) under (?:a |the )?(?:creative commons|cc)[ -](?P<kind>by(?:-nc)?(?:-(?:sa|nd))?)(?: license)?[ -]?(?P<v>[1234]\.\d)(?: international| unported)?(?: license)?"),
    ("Cc0Name", r".*(?:cc0 1\.0|creative commons zero).*"),
    ("UnlicenseGrant", r"this is free and unencumbered software released into the public domain"),
    ("SpdxTag", r"spdx-license-identifier (?P<kind>[a-z0-9.+-]+)"),
    ("Copyright", r"(?:copyright|\(c\)) .*\d{4}.*"),
    ("AllRights", r"all rights reserved"),
)
#: Licence (with {fields} of its first sentence) and the sequence of identifiers that names it. First come, first served.
RULES = (
    ("MIT", "MitName? MitGrant MitNotice? AsIsWarranty? NoLiability?"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdEndorse AsIsWarranty? NoLiability?"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary AsIsWarranty? NoLiability?"),
    ("Apache-{v}", "ApacheName ApacheUse? ApacheCopy? ApacheBasis? ApacheSee?"),
    ("GPL-{v}.0-or-later", "GplGrant GplHope? GplSee? GplCopy?"),
    ("LGPL-{v}-or-later", "LgplGrant GplHope? LgplSee?"),
    ("AGPL-{v}-or-later", "AgplGrant GplHope? AgplSee?"),
    ("Zlib", "ZlibAsIs? NoLiability? ZlibGrant"),
    ("BSL-{v}", "BoostName"),
    ("EPL-{v}", "EplName"),
    ("CDDL-1.0", "CddlName"),
    ("PSF-2.0", "PsfName"),
    ("ISC", "IscGrant AsIsWarranty? NoLiability?"),
    ("MPL-{v}", "MplName MplCopy?"),
    ("MIT", "MitName"),
    ("GPL-{v}{later}", "GplName"),
    ("LGPL-{v}{later}", "LgplName"),
    ("AGPL-{v}{later}", "AgplName"),
    ("BSD-{v}-Clause", "BsdName"),
    ("CC-{kind}-{v}", "CcName"),
    ("CC0-1.0", "Cc0Name"),
    ("Unlicense", "UnlicenseGrant"),
    ("{kind}", "SpdxTag"),
)
#: Every known sentence has one of these; single words, which no line wraps.
ANCHORS = "spdx|gnu|mpl|apache|unlicen|licen[sc]e|licen[sc]ing|permission|redistribution|copyright|\\(c\\)|warrant|liable|provided|unencumbered|reserved|creative|cc0|\\bcc\\b"

# Names of licences as tags write them (a tag of another one is given in capitals).
NAMES = (
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0",
    "CDDL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "PSF-2.0", "Ruby", "Unlicense", "UPL-1.0", "WTFPL", "X11", "Zlib",
)
WRITTEN = {n.lower(): n for n in NAMES}
KNOWN = [(name, re.compile(p)) for name, p in SENTENCES]
PARSED_RULES = [(name, [(x.rstrip("?"), x.endswith("?")) for x in rule.split()]) for name, rule in RULES]
#: Ends of sentences (not the point of "v. 2.0"), then of their parts: at semicolons, then at colons.
ENDS = tuple(re.compile(rf"(?:(?<!\bv)(?<!\bV)[{marks}]+(?=[\s\"')\]]|$)|\n\s*\n)") for marks in (".!?", ".!?;", ".!?;:"))
ANCHOR = re.compile(ANCHORS, re.I)


def normalised(sentence: str) -> str:
    s = sentence.lower().replace("licence", "license")
    s = re.sub(r"(?m)^\s*(?://+|#+|\*+|;+|--+|/\*+|<!--)\s?", " ", s)
    s = re.sub(r"\*/|-->|[\"'`“”‘’,;:!?*|#&$%]", " ", s)
    return re.sub(r"\s+", " ", s).strip(" .-")


def identified(sentence: str) -> tuple[str, dict] | None:
    s = normalised(sentence)
    for name, p in KNOWN if ANCHOR.search(s) else ():
        if m := p.fullmatch(s):
            return name, {k: v for k, v in m.groupdict().items() if v}
    return None


def sentences(text: str, start: int, end: int, ends: re.Pattern = ENDS[0]):
    """(start, end) of the sentences of text[start:end]."""
    at = start
    for m in ends.finditer(text, start, end):
        yield at, m.end()
        at = m.end()
    if at < end:
        yield at, end


def _known(text: str, start: int, end: int, wrapped: bool, level: int = 0):
    """Known sentences of text[start:end], of wrapped ones only those: the smallest parts that are known, and where none of a
    sentence's parts is, the sentence."""
    for s, e in sentences(text, start, end, ENDS[level]):
        parts = list(_known(text, s, e, wrapped, level + 1)) if level + 1 < len(ENDS) else []
        if not parts and (not wrapped or "\n" in text[s:e].strip()) and (found := identified(text[s:e])):
            parts = [(s, e, *found)]
        yield from parts


def known_sentences(text: str) -> list[tuple[int, int, str, dict]]:
    """Known sentences in order: those of single lines first, then those that lines wrap."""
    out, at = [], 0
    for line in text.split("\n"):
        if ANCHOR.search(line):
            out += _known(text, at, at + len(line), False)
        at += len(line) + 1
    taken = [*((s, e) for s, e, _, _ in out), (len(text), len(text))]
    at = 0
    for start, end in taken:  # what lies between sentences found so far
        out += _known(text, at, start, True)
        at = end
    return sorted(out, key=lambda x: x[:3])


def _name(template: str, fields: dict) -> str:
    kind = fields.get("kind", "")
    if template == "{kind}":
        return WRITTEN.get(kind, kind.upper())
    f = {"v": fields.get("v", ""), "kind": kind.upper(), "later": "-or-later" if fields.get("later") else "-only"}
    if template.startswith(("GPL-{v}{", "LGPL", "AGPL")) and f["v"] and "." not in f["v"]:
        f["v"] += ".0"
    return template.format(**f)


def licences(found: list[tuple[int, int, str, dict]]) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Licences with their spans, in order, and the identifiers that no rule took."""
    out, rest, i = [], [], 0
    while i < len(found):
        for name, rule in PARSED_RULES:
            j, fields, ok = i, {}, True
            for want, optional in rule:
                if j < len(found) and found[j][2] == want:
                    fields = {**found[j][3], **fields}
                    j += 1
                elif not optional:
                    ok = False
                    break
            if ok and j > i:
                out.append((_name(name, fields), found[i][0], found[j - 1][1]))
                i = j
                break
        else:
            rest.append(found[i][2])
            i += 1
    return out, rest


def _rows(batches):
    names = ["doc_id", "licenses", "spans", "n_sentences", "unmatched"]
    for b in slices(batches, "text"):
        texts = pc.fill_null(b.column("text"), "")
        maybe = pc.match_substring_regex(texts, ANCHORS, ignore_case=True).to_pylist()
        rows = []
        for i, hit in enumerate(maybe):
            found = known_sentences(texts[i].as_py()) if hit else []
            named, rest = licences(found) if found else ([], [])
            rows.append((",".join(sorted({x for x, _, _ in named})), ",".join(f"{x}:{s}:{e}" for x, s, e in named), len(found), ",".join(rest)))
        types = (pa.string(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)


def license_scan(docs: DataFrame) -> DataFrame:
    """Of every row of docs (doc_id, text): doc_id, licenses (distinct, by name), spans (name:start:end), n_sentences, unmatched identifiers."""
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.mapInArrow(partial(_rows), "doc_id long, licenses string, spans string, n_sentences long, unmatched string")
