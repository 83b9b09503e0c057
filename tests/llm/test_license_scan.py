import re

import pytest

from tidemark.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    w = WORD.findall((text or "").translate(FOLD))
    at = [(s, label) for p, label in PHRASES.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
    return len(w), len(at), min((s for s, _ in at), default=None), max((s for s, _ in at), default=None), sorted({x for _, x in at})


TEXTS = [
    "Licensed Under THE mit License.",
    "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0, cc-by-nc.",
    "cc by nc cc by nc",
    "apache license version 22",
    "é under the mit license é",
    "under the mit licensed",
    None,
    "",
    "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0.\nunder\tthe—mit license",
]


def test_base(spark, tmp_path):
    rows = [(i, t, "z") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "z"), (0, TEXTS[0], "z")]
    spark.createDataFrame(rows, "doc_id long, text string, labels string").write.parquet(str(tmp_path / "documents.parquet"))
    got = ls.op9_license_scan(spark, str(tmp_path)).collect()
    want = [(i, *brute(t)[:4], ",".join(brute(t)[4])) for i, t, _ in rows]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    tagged = next(r for r in got if r.doc_id == 8)
    assert tagged.labels.split(",") == ["apache-2.0", "gpl-2.0-only with classpath-exception-2.0", "mit"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("MIT", ["MIT"]),
        ("MIT or Apache-2.0 and more", ["MIT", "or", "Apache-2.0"]),
        ("MIT and see the file", ["MIT"]),
        ("see the file", []),
        ("MIT And ISC", ["MIT"]),
        ("(MIT or see) and ISC", []),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0 OR MIT", ["GPL-2.0-or-later", "with", "Classpath-exception-2.0", "or", "MIT"]),
        ("GPL-2.0+ WITH MIT", ["GPL-2.0+"]),
        ("LicenseRef-Own.1 AND DocumentRef-x:LicenseRef-y", ["LicenseRef-Own.1", "and", "DocumentRef-x:LicenseRef-y"]),
        ("MIT. The rest", ["MIT"]),
        ("(MIT AND (BSD-3-Clause OR ISC)) foo", ["(", "MIT", "and", "(", "BSD-3-Clause", "or", "ISC", ")", ")"]),
        ("MIT AND (ISC OR", ["MIT"]),
        (") MIT", []),
        ("OR MIT", []),
        ("", []),
    ],
)
def test_read_expression(text, tokens):
    assert ls.read_expression(text) == tokens


def test_postfix_and_evaluate():
    assert ls.postfix("a or b and c with d or e".split()) == "a b c d with and or e or".split()
    assert ls.postfix("( a or b ) and c".split()) == "a b or c and".split()
    assert ls.evaluate(["MIT", "or", "GPL-2.0"])[0] == 1.0
    assert ls.evaluate(["MIT", "and", "GPL-2.0"])[0] == 0.3
    assert ls.evaluate(["GPL-2.0", "with", "X"]) == (0.5, {"gpl-2.0 with x"})


def test_empty_table(spark):
    assert ls.find_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_labels(text):
    """labels and score with a search of its own and a parser by recursive descent."""
    text = text or ""
    spans = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    w = [text[a:b].translate(FOLD) for a, b in spans]
    phrases = [(p.decode().split(), label) for p, label in (ls.BASE | ls.NOTICES).items()]
    labels = {label for p, label in phrases if any(w[s : s + len(p)] == p for s in range(len(w)))}
    scores = [ls.permissiveness(x) for x in labels]
    for s in range(len(w) - 2):
        if w[s : s + 3] == ["spdx", "license", "identifier"]:
            line = text[spans[s + 2][1] :].lstrip(" \t")
            found = expression(re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*|[^ \t]", line.removeprefix(":")))
            if found:
                labels |= found[1]
                scores.append(found[0])
    return sorted(labels), min(scores, default=0.0)


def expression(tokens):
    """Value of the longest valid beginning."""
    for n in range(len(tokens), 0, -1):
        t = [x.rstrip(".:-") or x for x in tokens[:n]]
        if any(x != y for x, y in zip(t[:-1], tokens[: n - 1], strict=True)):
            continue
        value, rest = either(t)
        if value and not rest:
            return value
    return None


def is_operator(t, name):
    return bool(t) and t[0] in (name, name.upper())


def either(t):
    return chain(t, "or", both, max)


def both(t):
    return chain(t, "and", single, min)


def chain(t, name, part, best):
    value, t = part(t)
    while value and is_operator(t, name):
        right, rest = part(t[1:])
        if not right:
            return None, t
        value, t = (best(value[0], right[0]), value[1] | right[1]), rest
    return value, t


def single(t):
    if t and t[0] == "(":
        value, rest = either(t[1:])
        return (value, rest[1:]) if value and rest[:1] == [")"] else (None, t)
    if not t or not ls.IDENTIFIER.match(t[0]):
        return None, t
    name, rest = t[0].lower(), t[1:]
    score = ls.permissiveness(name)
    if is_operator(rest, "with") and len(rest) > 1 and ls.EXCEPTION.match(rest[1]):
        return (max(score, min(1.0, score + 0.2)), {f"{name} with {rest[1].lower()}"}), rest[2:]
    return (score, {name}), rest


MORE = [
    "SPDX-License-Identifier: MIT and see the file",
    "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note",
    "x SPDX-License-Identifier: ISC OR (MPL-2.0 AND Zlib) OR 0BSD. More",
    "spdx license identifier LGPL-2.1-or-later OR AGPL-3.0 AND CC-BY-NC-4.0",
    "SPDX-License-Identifier: ((MIT))",
    "SPDX-License-Identifier: (MIT AND ISC",
    "under the GNU Affero General Public License and the Creative Commons Attribution-ShareAlike 4.0",
    "All rights reserved. Released under the MIT license",
]


def test_labels_and_score_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame(list(enumerate(TEXTS + MORE, -100)), "doc_id long, text string")
    rows = docs.unionByName(own)
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in ls.find_licenses(rows).collect():
        labels, score = brute_labels(texts[r.doc_id])
        assert (r["labels"], r.score) == (labels, pytest.approx(score)), texts[r.doc_id][:200]


def test_very_long_text(spark):
    text = "word " * 2_000_000 + "under the mit license " + "x" * 1_000_000
    (r,) = ls.find_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_words, r.n_base, r.first_word, r.base_labels) == (2_000_005, 1, 2_000_000, ["mit"])
