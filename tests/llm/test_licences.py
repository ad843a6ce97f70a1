"""Licence scans: the engine's scores against a plain reading of the model, and planted statements."""

import math

from tessella.llm import licences
from tests.llm.helpers import DOC_SCHEMA, frame, rows

STATEMENTS = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache",
    "The files are available under the Mozilla Public License, version 2.0": "MPL",
    "Distributed under the terms of the BSD 3-Clause License": "BSD",
    "Licensed under the Frobnicate License 7": "unknown",
}


def docs_with():
    data = [(i * 10 + 1, f"some words here\n{s}\nthe und run {s.upper()} été", "en", "s", 0) for i, s in enumerate(STATEMENTS)]
    plain = ["the public library is open", "a version of the general plan", "you may use the file without permission", "all of the people", "mit der und"]
    return data + [(900 + i, t, "en", "s", 0) for i, t in enumerate(plain)] + [(2000 + (r[0] or 0), *r[1:]) for r in rows(8)]


def test_planted_statements(spark):
    data = docs_with()
    docs = frame(spark, data)
    model = licences.learn(docs)
    got = licences.scan(docs, model).collect()
    want = {(i * 10 + 1, line): f for i, (s, f) in enumerate(STATEMENTS.items()) for line in (1, 2)}
    assert {(r.doc_id, r.paragraph): r.family for r in got} == want
    assert all(r.confirmed == (r.family != "unknown") for r in got)
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert licences.scan(empty, licences.learn(empty)).count() == 0


def test_equals_plain_model(spark):
    data = docs_with()
    docs = frame(spark, data)
    model = licences.learn(docs)
    got = {(r.doc_id, r.paragraph): (r.family, r.probability) for r in licences.scan(docs, model).collect()}
    want = {}
    for i, text, *_ in data:
        for k, line in enumerate((text or "").split("\n")):
            p = model.probability(line)
            any_p = p.pop(licences.ANY)
            family = max(p, key=lambda f: (p[f], f))
            if p[family] >= 0.5:
                want[i, k] = family, p[family]
            elif any_p >= 0.5:
                want[i, k] = licences.UNKNOWN, any_p
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=2e-6) for k in got)


def test_wrapped_texts_are_confirmed(spark):
    """Statements broken at 79 columns, as they stand in source files: each family's own text has lines that are confirmed, and none of a family of other wording."""
    import textwrap

    wrapped = {f: "\n".join(textwrap.wrap(" ".join(paragraphs), 79)) for f, paragraphs in licences.BODIES.items()}
    data = [(i, "a plain line here\n\n" + text + "\n\nand der été", "en", "s", 0) for i, text in enumerate(wrapped.values())]
    docs = frame(spark, data)
    got = licences.scan(docs, licences.learn(docs)).collect()
    confirmed = {(list(wrapped)[r.doc_id], r.family) for r in got if r.confirmed}
    assert {f for f, g in confirmed if f == g} == set(wrapped)
    # lines without the name, in which these texts are the same
    alike = [{"ISC", "MIT"}, {"GPL", "LGPL", "AGPL"}]
    assert all(f == g or any({f, g} <= a for a in alike) for f, g in confirmed)


def test_calibrated_on_names_not_seen():
    model = licences.fit(["the public library is open", "a plain line of words"] * 20)
    strange = ["Licensed under the Sleepycat License.", "This work is licensed under the Eiffel Forum License 2"]
    p = [model.probability(t) for t in strange]
    assert all(x[licences.ANY] >= 0.5 and max(v for k, v in x.items() if k != licences.ANY) < 0.5 for x in p)
