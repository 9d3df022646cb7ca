"""The piece vocabulary of a SentencePiece model file, and the split of a text into units no piece crosses."""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from dataclasses import dataclass

SPACE = "▁"  # what SentencePiece writes for a space
LONGEST_KEPT = 48  # characters of a unit kept in a cache


@dataclass(frozen=True)
class Vocabulary:
    """Plain values, small enough to broadcast: one entry per piece of the model file."""

    ids: dict[str, int]  # ordinary pieces
    scores: dict[str, float]
    byte_ids: tuple[int, ...]  # ids of the 256 byte pieces, used for characters that are no piece
    strings: tuple[str | None, ...]  # by id; None for byte and control pieces
    unk_id: int
    splits: bool = True  # no piece holds a space mark behind another character, so texts can be split at spaces
    normaliser: bytes | None = None  # the model, where it normalises texts beyond a leading space mark


def load(path: str, plain: bool = True) -> Vocabulary:
    """Read a model file on the driver.

    With `plain`, models whose pieces hold a space after another character are refused, and those that normalise texts.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids: dict[str, int] = {}
    scores: dict[str, float] = {}
    strings: list[str | None] = []
    byte_ids = [-1] * 256
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            strings.append(None)
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            strings.append(None)
        else:
            ids[piece] = i
            scores[piece] = model.get_score(i)
            strings.append(piece)
    splits = not any(SPACE in p.lstrip(SPACE) for p in ids)
    if plain and not splits:
        raise ValueError(f"{path}: a piece holds a space after another character; texts can't be split at spaces")
    if min(byte_ids) < 0 and max(byte_ids) >= 0:
        raise ValueError(f"{path}: some byte pieces are missing")
    same = model.normalize("a  b é ﬁ\n ") == f"{SPACE}a{SPACE}{SPACE}b{SPACE}é{SPACE}ﬁ\n{SPACE}"
    if plain and not same:
        raise ValueError(f"{path}: the model normalises texts beyond a leading space mark, which is not supported")
    proto = None if same else model.serialized_model_proto()
    return Vocabulary(ids, scores, tuple(byte_ids), tuple(strings), model.unk_id(), splits, proto)


def normalised(vocabulary: Vocabulary) -> Callable[[str], str]:
    """What turns a text into what the pieces are matched with. To be called inside a task."""
    if vocabulary.normaliser is None:
        return escaped
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=vocabulary.normaliser).normalize


def unit_pattern(vocabulary: Vocabulary) -> re.Pattern:
    """Splits a text into units that no piece goes across: space marks, then marks of punctuation, then a word.

    A unit ends before space marks, and before a mark that no piece has behind a word character. The class of such
    marks is taken from the pieces: ASCII punctuation and digits, and all that pieces hold right before one of them.
    A line break is a unit if no piece holds one. So most units are plain words, which repeat.
    """
    before: dict[str, set[str]] = {}
    for piece in vocabulary.ids:
        for x, y in zip(piece, piece[1:], strict=False):
            before.setdefault(y, set()).add(x)
    marks = set(string.punctuation + string.digits)
    while more := {x for y in marks for x in before.get(y, ())} - marks - {SPACE}:
        marks |= more
    if any(m.isalpha() for m in marks):
        marks = set()
    alone = "" if any("\n" in p for p in vocabulary.ids) else "\n"
    m = "".join(map(re.escape, sorted(marks - {"\n"})))
    word = f"[^{SPACE}{alone}{m}]"
    first = f"{SPACE}*[{m}]+{word}*|" if m else ""
    return re.compile(("\n|" if alone else "") + f"{SPACE}*{word}+|{first}{SPACE}+")


class Recent:
    """A bounded cache: entries not asked for since it last filled up half are forgotten. Costs time only."""

    def __init__(self, make, limit: int) -> None:
        self.make, self.half = make, limit // 2
        self.young: dict = {}
        self.old: dict = {}

    def all(self, keys: list) -> list:
        young = self.young.get
        return [young(k) or self.missing(k) for k in keys]

    def missing(self, key):
        made = self.old.get(key) or self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self.young) >= self.half:
                self.old, self.young = self.young, {}
            self.young[key] = made
        return made


def escaped(text: str) -> str:
    """Text as the model sees it: a leading space mark, and marks for spaces. Empty stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""
