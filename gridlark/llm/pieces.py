"""Piece models in the SentencePiece file format, and texts as distinct words of a batch."""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    """The model file: $GRIDLARK_PIECES, else the installed public vocabulary."""
    if path := os.environ.get("GRIDLARK_PIECES"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(b: bytes):
    """Field number and value of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            x = b[at]
            at += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out

    while at < len(b):
        key = varint()
        if key & 7 == 0:
            value = varint()
        else:
            n = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            value, at = b[at : at + n], at + n
        yield key >> 3, value


@dataclass
class Pieces:
    text: list[str]
    score: np.ndarray
    kind: np.ndarray

    @property
    def byte_ids(self) -> np.ndarray:
        out = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.kind == BYTE):
            out[int(self.text[i][3:5], 16)] = i
        return out


def read_pieces(data: bytes) -> Pieces:
    text, score, kind = [], [], []
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            text.append(f[1].decode())
            score.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            kind.append(f.get(3, NORMAL))
    return Pieces(text, np.array(score, np.float32), np.array(kind, np.int8))


def check_model(data: bytes) -> None:
    """Raise unless the file is a merge model that takes texts as they are, with a space put before each.

    Numbers of the fields are fixed values of the file format: trainer 2 (model type 3, merges 2), normalizer 3
    (character map 2, space before a text 3, removal of spaces 4, spaces as U+2581 5).
    """
    parts = dict(_fields(data))
    trainer, normal = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
    if trainer.get(3, 1) != 2:
        raise ValueError("the model is no merge model")
    if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
        raise ValueError("the model rewrites texts before it cuts them")


class Parts:
    """The parts between spaces of a batch of texts: distinct non-empty parts, and what each text has.

    The model puts a space before every text, so each part follows one space.
    """

    def __init__(self, texts: list[str | None]):
        ids: dict[str, int] = {"": 0}
        flat: list[int] = []
        size = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                if SPACE in t:
                    t = t.replace(SPACE, " ")
                p = t.split(" ")
                size[i] = len(p)
                flat += [ids.setdefault(w, len(ids)) for w in p]
        self.words = list(ids)[1:]
        self.part = np.array(flat, np.int64)  # 0 for an empty part, else 1 + index of the word
        self.size = size
        self.text = np.repeat(np.arange(len(texts)), size)
