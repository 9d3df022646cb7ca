from __future__ import annotations

import re
import time

import pytest

from farebox.llm import licenses as lic


def parse(text):
    return lic.parse(lic.tokens(text.encode()))


@pytest.mark.parametrize(("text", "postfix", "used"), [
    ("MIT", "MIT", 1), ("MIT OR Apache-2.0", "MIT Apache-2.0 OR", 3), ("a or b and c", "a b c and or", 5),
    ("(a or b) and c", "a b or c and", 7), ("GPL-2.0-only WITH x and b", "GPL-2.0-only x with b and", 5), ("a and", "a", 1),
    ("(a", "", 0), (") a", "", 0), ("and a", "", 0), ("", "", 0), ("a b", "a", 1), ("((a))", "a", 5),
])
def test_parser(text, postfix, used):
    assert parse(text) == (postfix.replace(" OR", " or").split(), used)


def test_evaluation():
    assert lic.evaluate(parse("MIT or GPL-2.0-only")[0]) == ({"mit", "gpl"}, 0.9)
    assert lic.evaluate(parse("MIT and GPL-2.0-only")[0]) == ({"mit", "gpl"}, 0.4)
    assert lic.evaluate(parse("GPL-2.0-only with Classpath-exception-2.0")[0]) == ({"gpl"}, 0.5)
    assert lic.evaluate([]) == (set(), 1.0)


@pytest.mark.parametrize(("identifier", "label"), [
    ("GPL-2.0+", "gpl"), ("GPLv3", "gpl"), ("LGPL-2.1", "lgpl"), ("AGPL-3.0", "agpl"), ("AGPL-3.0-or-later", "agpl"),
    ("Apache-2.0", "apache-2"), ("Apache-1.1", "apache-1.1"), ("MPL-2.0", "mpl"), ("CC-BY-SA-4.0", "cc-by-sa"), ("CC0-1.0", "cc0"),
    ("GPL-2.0-only", "gpl"), ("MIT.", "mit"), ("BSD-3-Clause", "bsd-3-clause"), ("gplish", "gplish"), ("BSL-1.0", "bsl"),
])
def test_families(identifier, label):
    assert lic.label(identifier) == label


@pytest.mark.parametrize("text", [
    b"SPDX-License-Identifier: MIT OR GPL-2.0+\n", b"SPDX-License-Identifier: MIT ", b"SPDX-License-Identifier: (a or b) and ", b"SPDX-License-Identifier: ",
    b"MIT or ", b"(", b"cc by nc ",
])
def test_time_grows_with_the_text(text):
    find = lic.finder()
    took = []
    for n in (8_000, 64_000):
        start = time.process_time()
        made = find(b"SPDX-License-Identifier: " + text * n)
        took.append(time.process_time() - start)
        assert made[0] >= 3 and 0 <= made[6] <= 1
    assert took[1] < 20 * max(took[0], 0.05)


def brute(text: str | None):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in lic.BASE.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_scan(spark, odd_documents, no_documents):
    texts = [
        "Released under the MIT License.", "CC BY-NC 4.0, cc by nc cc by\nnc", "under the mit licenses", "Apache License, Version 2.0",
        "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */ rest", "SPDX-License-Identifier:", None, "é" * 5000 + " under the mit license",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS labels")
    got = {r.doc_id: r for r in lic.scan(docs).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[4].labels == "apache-2,bsd-3-clause,mit" and got[4].expressions == ["MIT Apache-2.0 or BSD-3-Clause and"]
    assert got[5].labels == "" and got[5].expressions == []
    assert lic.scan(odd_documents).count() == odd_documents.count() and lic.scan(no_documents).count() == 0
