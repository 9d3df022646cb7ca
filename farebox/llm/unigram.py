"""Token counts under a unigram vocabulary, without making the tokens.

An automaton lists the pieces that end at each place of a text; dynamic programming carries the best score and the
number of pieces of the best path. Ties follow the tokenizer: places are filled from earlier starts first and only a
higher score replaces a path, so among equal scores the longest last piece stays. A character that is no piece scores
10 below the lowest piece. It counts one token per UTF-8 byte where the model has byte pieces; elsewhere a run of such
characters is one token.

Whole-number scores are added as doubles, exactly. So paths through different units (space marks with the word behind
them, which no piece crosses) don't affect each other, and equal units are scored once while they stay in a bounded
cache. With fractional scores every sum is rounded, so a text is scored as a whole, in the tokenizer's order and width:
sums are kept in single precision and compared with the next one before it is rounded to that.
"""

from __future__ import annotations

from array import array

import ahocorasick
from pyspark.sql import DataFrame

from farebox.llm.text import per_row
from farebox.llm.vocabulary import Recent, Vocabulary, load, normalised, unit_pattern

UNKNOWN_PENALTY = 10.0  # fixed value of the tokenizer
CACHED_UNITS = 600_000  # per worker


class UnigramCounter:
    """Counts inside a task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        exact = all(s == int(s) for s in vocabulary.scores.values())
        self.single = not exact
        self.bytes = vocabulary.byte_ids[0] >= 0
        self.split = unit_pattern(vocabulary).findall if exact and vocabulary.splits and self.bytes else None
        self.prepared = normalised(vocabulary)
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.scores = vocabulary.scores
        self.unknown = self.stored(min(vocabulary.scores.values(), default=0.0) - UNKNOWN_PENALTY)
        self.units = Recent(self.best, CACHED_UNITS)

    def stored(self, score: float) -> float:
        return array("f", (score,))[0] if self.single else score

    def best(self, unit: str) -> tuple[float, int, int]:
        """Best score, its pieces, and how many of its characters are no piece."""
        score = array("f" if self.single else "d", (0.0,))  # by number of characters
        count, unknown, last_odd = [0], [0], [0]
        stored = self.stored if self.single else float
        found = -1  # the place whose pieces are being compared
        most, start = 0.0, 0
        unk, scores = self.unknown, self.scores

        def closed(most: float | None, start: int, end: int) -> None:
            """Keep the best path that ends behind character `end`; the character as unknown comes last."""
            char, more, odd = unit[end], 1, 0
            if char not in scores:
                made = stored(score[end] + unk)
                if most is None or made > most:
                    most, start, odd = made, end, 1
                    more = len(char.encode()) if self.bytes else 1 - last_odd[end]
            score.append(most)
            count.append(count[start] + more)
            unknown.append(unknown[start] + odd)
            last_odd.append(odd)

        for end, (length, s) in self.automaton.iter(unit):  # longest first at each end
            if end != found:
                if found >= 0:
                    closed(most, start, found)
                for place in range(found + 1, end):
                    closed(None, 0, place)
                found, most, start = end, stored(score[end + 1 - length] + s), end + 1 - length
            else:
                made = score[end + 1 - length] + s
                if made > most:
                    most, start = stored(made), end + 1 - length
        if found >= 0:
            closed(most, start, found)
        for place in range(found + 1, len(unit)):
            closed(None, 0, place)
        return score[-1], count[-1], unknown[-1]

    def count(self, text: str) -> tuple[float, int, int]:
        full = self.prepared(text)
        if self.split is None:
            return self.best(full)
        parts = self.units.all(self.split(full))
        if not parts:
            return 0.0, 0, 0
        scores, counts, unknown = zip(*parts, strict=True)
        return sum(scores), sum(counts), sum(unknown)


_COUNTERS: dict[str, UnigramCounter] = {}


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """`doc_id, n_tokens, n_unknown, best_score` of every whole text under the pieces and scores of a model file.

    n_unknown counts characters of the best path that are no piece. A null or empty text has 0 tokens and score 0.
    Repeated rows are counted each; a null doc_id stays null. Models may normalise texts (the tokenizer's own normaliser
    is called) and have pieces across spaces. User-defined pieces, which go before all others, are not told apart.
    """
    vocabulary = load(model_path, plain=False)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one entry per piece of the file

    def work():
        if model_path not in _COUNTERS:
            _COUNTERS[model_path] = UnigramCounter(shared.value)
        counter = _COUNTERS[model_path]

        def row(doc_id, text):
            score, n, odd = counter.count(text.decode(errors="replace"))
            return doc_id, n, odd, score

        return row

    return per_row(docs, ["doc_id", "text"], "doc_id long, n_tokens long, n_unknown long, best_score double", work)
