"""Pre-tokens of a SentencePiece BPE model, and the properties of the model that make them safe.

The model joins neighbouring symbols whenever their concatenation is a piece.  If no piece has a
space sign after another character, no join ever crosses from a word into the next word's space
sign, so a text may be cut before every run of spaces and its parts encoded one by one.
``check_model`` proves this and the other assumptions, and raises if a model breaks them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import sentencepiece

SPACE = "▁"
#: A text longer than this is cut into parts at spaces, so that its list of words stays small.
PART_CHARS = 1 << 20
_RUNS = re.compile(" +[^ ]*")


def load(model_path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def check_model(sp: sentencepiece.SentencePieceProcessor) -> None:
    """Raise unless words can be encoded apart: no normalisation, a dummy space, no piece over a word's end."""
    probe = "  ﬁ① Á\t\n é  　x "
    if sp.normalize(probe).replace(SPACE, " ") != " " + probe:
        raise ValueError("the model normalises texts; words can't be encoded apart")
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE) and not sp.is_byte(i):
            raise ValueError(f"piece {piece!r} crosses a word's end")


def parts(text: str) -> Iterator[str]:
    """The text in parts of bounded length; the single space before each later part is implied."""
    start = 0
    while len(text) - start > PART_CHARS:
        cut = text.rfind(" ", start + 1, start + PART_CHARS)
        if cut < 0:
            cut = text.find(" ", start + PART_CHARS)
        while cut > start and text[cut - 1] == " ":
            cut -= 1
        if cut <= start:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def pretokens(text: str) -> list[str]:
    """Pre-tokens without the first of their leading spaces; none for an empty text."""
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [x[1:] for x in _RUNS.findall(" " + text)]
    return text.split(" ")
