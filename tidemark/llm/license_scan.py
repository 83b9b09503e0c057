"""License scan: notices and identifier tags in texts.

One Aho-Corasick automaton over normalised words finds the notice phrases and the
identifier tag. What follows a tag in the original text is read as a license
expression by a shunting-yard parser (WITH binds closest, then AND, then OR) and
evaluated: an OR is as permissive as its best side, an AND as its worst, a WITH
never less than its license alone. Operands are known identifiers and those that begin
with LicenseRef-, operators are in capitals or in small letters; an expression ends
before an operator whose operand is neither, so that prose after it is not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _automaton
from tidemark.llm._spark import table

# Phrases (normalised words) and their labels; the base first.
BASE = {
    b"under the mit license": "mit",
    b"apache license version 2": "apache-2",
    b"cc by nc": "cc-by-nc",
}
NOTICES = {
    b"permission is hereby granted free of charge to any person": "mit",
    b"released under the mit license": "mit",
    b"licensed under the mit license": "mit",
    b"the mit license mit": "mit",
    b"mit no attribution": "mit-0",
    b"licensed under the apache license": "apache",
    b"www apache org licenses license 2 0": "apache-2",
    b"redistribution and use in source and binary forms": "bsd",
    b"bsd 2 clause license": "bsd-2-clause",
    b"bsd 3 clause license": "bsd-3-clause",
    b"permission to use copy modify and or distribute this software for any purpose": "isc",
    b"this is free and unencumbered software released into the public domain": "unlicense",
    b"boost software license": "bsl-1.0",
    b"zlib license": "zlib",
    b"this software is provided as is without any express or implied warranty": "zlib",
    b"do what the fuck you want to public license": "wtfpl",
    b"academic free license": "afl",
    b"artistic license": "artistic",
    b"python software foundation license": "python",
    b"gnu general public license": "gpl",
    b"gnu lesser general public license": "lgpl",
    b"gnu library general public license": "lgpl",
    b"gnu affero general public license": "agpl",
    b"gnu free documentation license": "gfdl",
    b"mozilla public license": "mpl",
    b"eclipse public license": "epl",
    b"european union public licence": "eupl",
    b"common development and distribution license": "cddl",
    b"server side public license": "sspl",
    b"business source license": "busl",
    b"elastic license": "elastic",
    b"open software license": "osl",
    b"microsoft public license": "ms-pl",
    b"open font license": "ofl",
    b"open data commons attribution license": "odc-by",
    b"open database license": "odbl",
    b"community data license agreement": "cdla",
    b"open government licence": "ogl",
    b"creative commons attribution noncommercial": "cc-by-nc",
    b"creative commons attribution non commercial": "cc-by-nc",
    b"creative commons attribution sharealike": "cc-by-sa",
    b"creative commons attribution share alike": "cc-by-sa",
    b"creative commons attribution noderivatives": "cc-by-nd",
    b"creative commons attribution no derivatives": "cc-by-nd",
    b"creative commons attribution": "cc-by",
    b"creativecommons org licenses by 4 0": "cc-by",
    b"creativecommons org licenses by sa": "cc-by-sa",
    b"creativecommons org licenses by nd": "cc-by-nd",
    b"creativecommons org licenses by nc": "cc-by-nc",
    b"cc by sa": "cc-by-sa",
    b"cc by nd": "cc-by-nd",
    b"cc by 4 0": "cc-by",
    b"cc by 3 0": "cc-by",
    b"cc0": "cc0",
    b"creativecommons org publicdomain zero": "cc0",
    b"dedicated to the public domain": "public-domain",
    b"all rights reserved": "all-rights-reserved",
    b"may not be reproduced without permission": "all-rights-reserved",
    b"no part of this publication may be reproduced": "all-rights-reserved",
    b"proprietary and confidential": "proprietary",
}
TAG = b"spdx license identifier"
# How freely a text may be used under licenses that start so; others count as UNKNOWN.
PERMISSIVE = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "bsl": 1.0, "zlib": 1.0, "wtfpl": 1.0, "public-domain": 1.0, "python": 1.0, "psf": 1.0, "postgresql": 1.0, "ncsa": 1.0, "x11": 1.0, "pddl": 1.0,
    "afl": 0.9, "artistic": 0.9, "ms-pl": 0.9, "cc-by": 0.9, "odc-by": 0.9, "ogl": 0.9, "cdla": 0.9, "ofl": 0.8, "mpl": 0.6, "epl": 0.6, "cddl": 0.6, "eupl": 0.5, "lgpl": 0.5, "cc-by-sa": 0.5, "odbl": 0.5,
    "gfdl": 0.3, "gpl": 0.3, "osl": 0.3, "agpl": 0.2, "sspl": 0.1, "busl": 0.1, "elastic": 0.1, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "all-rights-reserved": 0.0, "proprietary": 0.0,
}
UNKNOWN = 0.4
# Identifiers of the public license list, by families; case doesn't matter, and a + means later versions too.
IDENTIFIER = re.compile(
    r"""(?:MIT(?:-0|-CMU|-Modern-Variant|-open-group)?|X11|ISC|0BSD|NCSA|Zlib|zlib-acknowledgement|Unlicense|WTFPL|PostgreSQL|curl|Beerware|TCL|ICU|HPND|FSFAP|Vim|Ruby|Sleepycat|OpenSSL|Info-ZIP|IJG|libpng-2\.0|Libpng|blessing|FTL|Intel|NTP|UPL-1\.0|PHP-3\.0[01]?|Python-2\.0(?:\.1)?|PSF-2\.0|CNRI-Python
    |Apache-(?:1\.0|1\.1|2\.0)|BSD-[1-4]-Clause(?:-[A-Za-z]+)*|BSL-1\.0|AFL-[123]\.[0-2]|Artistic-[12]\.0(?:-cl8|-Perl)?|ECL-[12]\.0|EFL-[12]\.0|MS-(?:PL|RL|LPL)|MulanPSL-[12]\.0|BlueOak-1\.0\.0|W3C(?:-[0-9]+)?|Unicode-(?:3\.0|DFS-201[56]|TOU)|OLDAP-[12]\.[0-9](?:\.[0-9])?|ZPL-[12]\.[01]
    |(?:GPL|LGPL|AGPL|GFDL)-[1-3]\.[0-3](?:-invariants|-no-invariants)?(?:-only|-or-later)?|MPL-(?:1\.0|1\.1|2\.0(?:-no-copyleft-exception)?)|EPL-[12]\.0|CPL-1\.0|IPL-1\.0|CDDL-1\.[01]|EUPL-1\.[0-2]|OSL-[123]\.[01]|CeCILL-(?:[12]\.[01]|B|C)|SSPL-1\.0|BUSL-1\.1|Elastic-2\.0|QPL-1\.0|RPL-1\.[15]|APSL-[12]\.[0-2]|NPL-1\.[01]|OFL-1\.[01](?:-no-RFN|-RFN)?
    |CC0-1\.0|CC-PDDC|CC-BY(?:-NC)?(?:-SA|-ND)?-[1-4]\.[05](?:-[A-Z]{2,3})?|PDDL-1\.0|ODbL-1\.0|ODC-By-1\.0|CDLA-(?:Permissive|Sharing)-[12]\.0|OGL-(?:UK|Canada)-[123]\.0|etalab-2\.0|DL-DE-(?:BY|ZERO)-2\.0
    |(?:DocumentRef-[A-Za-z0-9.-]+:)?LicenseRef-[A-Za-z0-9.-]+)\+?\Z""",
    re.IGNORECASE | re.VERBOSE,
)
# What may stand after WITH.
EXCEPTION = re.compile(r"(?:[A-Za-z0-9.-]*exception(?:-[A-Za-z0-9.-]+)?|Linux-syscall-note|FLTK-exception|eCos-exception-2\.0|Qwt-exception-1\.0|AdditionRef-[A-Za-z0-9.-]+)\Z", re.IGNORECASE)

_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_AFTER_TAG = re.compile(r"[ \t]*:?")
_BINDS = {"or": 1, "and": 2, "with": 3}


def permissiveness(name: str) -> float:
    known = [k for k in PERMISSIVE if name.startswith(k)]
    return PERMISSIVE[max(known, key=len)] if known else UNKNOWN


def read_expression(text: str, at: int = 0) -> list[str]:
    """Tokens of the longest license expression that starts at a place; operators in lower case."""
    tokens: list[str] = []
    depth, operand, whole = 0, True, 0
    while m := _TOKEN.match(text, at):
        token = m[1] or m[2].rstrip(".:-")
        binds = token.lower() in _BINDS and token in (token.lower(), token.upper())
        if operand:
            known = EXCEPTION if tokens and tokens[-1] == "with" else IDENTIFIER
            if token != "(" and not known.match(token) or token == "(" and known is EXCEPTION:
                break
            depth += token == "("
            operand = token == "("
        elif token == ")" and depth:
            depth -= 1
        elif binds:
            operand = True
        else:
            break
        tokens.append(token.lower() if binds else token)
        if not operand and not depth:
            whole = len(tokens)
        if m[2] and m[2] != token:  # a full stop ends it
            break
        at = m.end()
    return tokens[:whole]


def postfix(tokens: list[str]) -> list[str]:
    """The shunting yard: operands as they come, operators once nothing binds closer; all are left-associative."""
    out, yard = [], []
    for t in tokens:
        if t == "(":
            yard.append(t)
        elif t == ")":
            while yard[-1] != "(":
                out.append(yard.pop())
            yard.pop()
        elif t in _BINDS:
            while yard and yard[-1] != "(" and _BINDS[yard[-1]] >= _BINDS[t]:
                out.append(yard.pop())
            yard.append(t)
        else:
            out.append(t)
    return out + yard[::-1]


def evaluate(tokens: list[str]) -> tuple[float, set[str]]:
    """(permissiveness, labels) of an expression; a label is a license in lower case, an exception stays with its license."""
    stack: list[tuple[float, set[str]]] = []
    for t in postfix(tokens):
        if t not in _BINDS:
            stack.append((permissiveness(t.lower()), {t.lower()}))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((max(a, min(1.0, a + 0.2)), {f"{x} with {y}" for x in left for y in right}))
        else:
            stack.append((max(a, b) if t == "or" else min(a, b), left | right))
    return stack[0]


_SEEN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())])
_SEEN_SQL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"
_PATTERNS = [*BASE, *NOTICES, TAG]
_LABELS = [*BASE.values(), *NOTICES.values()]
_LENGTHS = np.array([p.count(b" ") + 1 for p in _PATTERNS])


def scan(text: str) -> tuple:
    """The columns of _SEEN without doc_id."""
    words = _automaton.words(text.encode("utf-8", "surrogatepass"))
    which, end = _automaton.places(_automaton.build("licenses", _PATTERNS), words)
    base = (end - _LENGTHS[which] + 1)[which < len(BASE)]
    labels, scores = {_LABELS[k] for k in which.tolist() if k < len(_LABELS)}, []
    base_labels = {_LABELS[k] for k in which.tolist() if k < len(BASE)}
    scores = [permissiveness(x) for x in labels]
    tags = end[which == len(_LABELS)]
    if len(tags):
        at = _automaton.spans(text)
        for k in tags.tolist():
            tokens = read_expression(text, _AFTER_TAG.match(text, at[k][1]).end())
            if tokens:
                score, names = evaluate(tokens)
                scores.append(score)
                labels |= names
    return len(words), len(base), int(base.min()) if len(base) else None, int(base.max()) if len(base) else None, sorted(base_labels), sorted(labels), min(scores, default=0.0)


def find_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs.

    score: how freely the text may be used by the strictest of its notices; 0 without
    any. Null and empty texts have no words and no labels; null ids stay; repeated rows
    are judged each; an empty table gives no rows. A very long text is scanned whole, as
    one string in one task. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x.as_py() or "") for x in batch.column("text")]
            columns = zip(*rows, strict=True) if rows else [[] for _ in _SEEN.names[1:]]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(list(c), f.type) for c, f in zip(columns, list(_SEEN)[1:], strict=True))], schema=_SEEN)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, _SEEN_SQL)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
