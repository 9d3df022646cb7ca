"""Licence scans: identifier tags and notice phrases found by one automaton, expressions read by a shunting-yard parser.

Phrases are matched on words (A-Z lower-cased), so case, punctuation and line breaks between words don't matter. A tag
is the words `spdx license identifier`; the expression behind it, up to the end of its line, is read from the text as
written, brackets included.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping

import ahocorasick
from pyspark.sql import DataFrame

from farebox.llm.text import per_row, word_spans, words

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notice phrases.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "public-domain",
    "licensed under the apache license version 2 0": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
}
TAG = "spdx license identifier"
# Families whose identifiers differ by version and by what is said of later versions only, and their labels.
FAMILIES = (
    "agpl", "lgpl", "gpl", "mpl", "epl", "bsl", "cc0", "cc-by-nc", "cc-by-sa", "cc-by-nd", "apache",
)
_FAMILY = re.compile(rf"({'|'.join(FAMILIES)})(?:-?v?(\d+)(?:\.\d+)*)?(?:-only|-or-later|\+)?")
# How freely a text under a licence may be used, 0 to 1; unknown licences stand in the middle.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "mit": 0.9, "isc": 0.9, "bsd": 0.9, "bsd-2-clause": 0.9, "bsd-3-clause": 0.9, "bsl": 0.9,
    "apache-2": 0.9, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2,
    "cc-by-nd": 0.2, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.5
WITH_BONUS = 0.1  # an exception only ever allows more

_TOKEN = re.compile(rb"[()]|[A-Za-z0-9.+:-]+")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def tokens(text: bytes, start: int = 0, end: int | None = None) -> Iterator[str]:
    for found in _TOKEN.finditer(text, start, len(text) if end is None else end):
        yield found[0].decode()


def parse(expression: Iterable[str]) -> tuple[list[str], int]:
    """Postfix form of the longest well-formed expression that tokens begin with, and how many of them it takes.

    Empty if there is none. Operators in any case: `with` binds closest, then `and`, then `or`. No more tokens are
    taken than up to the first that can't go on, and each is looked at once.
    """
    best: tuple[int, list[str], int] = 0, [], 0  # length of the output, what was waiting, tokens used
    out: list[str] = []
    waiting: list[str] = []
    depth = 0  # open brackets among those waiting
    operand = True  # what may come next
    for used, token in enumerate(expression, 1):
        low = token.lower()
        if token == "(":
            if not operand:
                break
            waiting.append(token)
            depth += 1
            continue
        if token == ")":
            if operand or not depth:
                break
            while (top := waiting.pop()) != "(":
                out.append(top)
            depth -= 1
        elif low in _STRENGTH:
            if operand:
                break
            while waiting and waiting[-1] != "(" and _STRENGTH[waiting[-1]] >= _STRENGTH[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = True
            continue
        else:
            if not operand or not token.strip(".:-+"):
                break
            out.append(token)
            operand = False
        if not depth:  # at most one operator of each strength waits outside brackets
            best = len(out), waiting[::-1], used
    n, rest, used = best
    return out[:n] + rest, used


def label(identifier: str) -> str:
    """The family of an identifier whatever its version; others are their own label, lower-cased."""
    low = identifier.lower().rstrip(".:-")
    found = _FAMILY.fullmatch(low)
    if not found:
        return low
    if found[1] == "apache":
        return "apache-2" if found[2] == "2" else low
    return found[1]


def evaluate(postfix: list[str], freedom: Mapping[str, float] = FREEDOM) -> tuple[set[str], float]:
    """Labels of an expression, and how free it leaves its user: the best choice of `or`, the least of `and`."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in _STRENGTH:
            own = label(token)
            stack.append(({own}, freedom.get(own, UNKNOWN)))
            continue
        right_labels, right = stack.pop()
        labels, left = stack.pop()
        if token == "with":  # the right side names an exception, which is no licence
            stack.append((labels, min(1.0, left + WITH_BONUS)))
        else:
            stack.append((labels | right_labels, max(left, right) if token == "or" else min(left, right)))
    return stack.pop() if stack else (set(), 1.0)


def finder(base: Mapping[str, str] = BASE, notices: Mapping[str, str] = NOTICES) -> Callable[[bytes], tuple]:
    """The function of one text: n_words, n_base, first_word, last_word, base_labels, labels, score, expressions."""
    automaton = ahocorasick.Automaton()
    for phrase in {*base, *notices, TAG}:
        automaton.add_word(f" {phrase} ", phrase)
    automaton.make_automaton()
    size = {p: len(p) + 1 for p in {*base, *notices, TAG}}

    def expressions_behind(text: bytes, line: str, tags: list[int]) -> Iterator[list[str]]:
        """Postfix expressions behind tags at ascending offsets of `line`; each offset and line end is sought once."""
        _, ends = word_spans(text)
        at_word, counted, line_end = 0, 0, -1
        for at in tags:
            at_word += line.count(" ", counted, at)
            counted = at
            start = int(ends[at_word + 2])  # behind the three words of the tag
            if start > line_end:
                line_end = text.find(b"\n", start)
                line_end = len(text) if line_end < 0 else line_end
            while text[start : start + 1] in (b" ", b":", b"\t"):
                start += 1
            yield parse(tokens(text, start, line_end))[0]

    def find(text: bytes) -> tuple:
        ws = words(text)
        line = " " + b" ".join(ws).decode("latin-1") + " "
        starts, base_labels, labels, tags = [], set(), set(), []
        for end, phrase in automaton.iter(line):
            at = end - size[phrase]  # of the space before the phrase
            if phrase in base:
                starts.append(at)
                base_labels.add(base[phrase])
            elif phrase in notices:
                labels.add(notices[phrase])
            else:
                tags.append(at)
        labels |= base_labels
        free = [FREEDOM.get(x, UNKNOWN) for x in labels]
        expressions = []
        for postfix in expressions_behind(text, line, tags) if tags else ():
            if postfix:
                more, score = evaluate(postfix)
                expressions.append(" ".join(postfix))
                labels |= more
                free.append(score)
        first, last = (line.count(" ", 0, min(starts)), line.count(" ", 0, max(starts))) if starts else (None, None)
        return (
            len(ws), len(starts), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)),
            min(free, default=0.0), sorted(set(expressions)),
        )

    return find


def scan(docs: DataFrame) -> DataFrame:
    """Licences named in every whole text.

    `doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions`: n_base counts all places
    of base phrases, overlapping ones too; first_word and last_word are null without one. score is the freedom that
    everything found leaves together (the least), 0 where nothing is found. expressions holds the distinct tag
    expressions in postfix form. Null and empty texts have no words and empty labels. Repeated rows each get a row.
    """
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, expressions array<string>"
    )

    def work():
        find = finder()
        return lambda doc_id, text: (doc_id, *find(text))

    return per_row(docs, ["doc_id", "text"], schema, work)
