"""A SentencePiece vocabulary as plain tables, and the cutting of texts into independent chunks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

#: Where the public tokenizers lie; a parameter of every operator that needs one.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"

SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """surface: piece -> (id, score), with real spaces; table: id -> bytes; byte_ids: byte -> id (or empty)."""

    surface: dict[str, tuple[int, float]]
    table: list[bytes]
    byte_ids: list[int]
    unk_id: int
    min_score: float
    cuts: bool

    def ids_of_unknown(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unk_id]

    def chunks(self, text: str) -> list[str]:
        """Parts that no piece crosses: before each run of spaces and around each line break."""
        return _CHUNK.findall(text) if self.cuts else [text] if text else []


_CHUNK = re.compile(r"\n| *[^ \n]+| +")


def load_vocabulary(path: str = MODEL_PATH) -> Vocabulary:
    """Read the file on the driver; tasks get the tables (under a megabyte) with the function they run."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    surface, table, byte_ids = {}, [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            table.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            table.append(b"")
        else:
            surface[piece.replace(SPACE, " ")] = (i, model.get_score(i))
            table.append(piece.replace(SPACE, " ").encode())
    cuts = not any(re.search(r"[^ ] ", s) or ("\n" in s and s != "\n") for s in surface)
    return Vocabulary(surface, table, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [], model.unk_id(), min(score for _, score in surface.values()), cuts)


class Memo(dict):
    """Results by chunk; emptied when it holds ``most``, so that memory is bounded whatever the texts."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, chunk):
        if len(self) >= self.most:
            self.clear()
        self[chunk] = value = self.make(chunk)
        return value
