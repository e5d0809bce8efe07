"""Reader of the SentencePiece model format: a protobuf message, decoded field by field.

Only the fields that encoding and decoding depend on are kept. The numbers below are those of the public
``sentencepiece_model.proto``.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

#: The mark that stands for a space.
SPACE = "▁"

# Types of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
KINDS = {1: "unigram", 2: "bpe", 3: "word", 4: "char"}


def fields(data: bytes):
    """(field number, value) of a protobuf message: ints, 4-byte floats and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        elif wire == 5:
            yield number, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif wire == 1:
            yield number, struct.unpack_from("<d", data, at)[0]
            at += 8
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire}")


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: str = "unigram"
    byte_fallback: bool = False
    unk_surface: str = " ⁇ "
    normaliser: str = "identity"
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @property
    def merge_scores(self) -> dict[str, float]:
        """Scores of the pieces that merging can reach."""
        return {p: s for p, s, t in self.pieces if t in (NORMAL, USER_DEFINED, UNUSED)}

    @property
    def unk_id(self) -> int:
        return next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)

    @property
    def words_apart(self) -> bool:
        """No piece has a space mark behind another character, nor a line break beside one."""
        return not any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _, t in self.pieces if t == NORMAL) and not any(t == USER_DEFINED for _, _, t in self.pieces)

    def normalise(self, text: str) -> str:
        """The identity normaliser's text, with marks for spaces; other rules need the library's table."""
        if self.charsmap:
            raise ValueError("only models without a character map are read here")
        if self.remove_extra_whitespaces:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        if self.add_dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape_whitespaces else text


def parse_model(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = v
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.kind = KINDS[v]
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 44:
                    model.unk_surface = v.decode()
        elif number == 3:
            for n, v in fields(value):
                if n == 1:
                    model.normaliser = v.decode()
                elif n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    return model


@lru_cache(maxsize=4)
def read_model(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return parse_model(file.read())
