"""Byte-level BPE ids of whole texts by a public tokenizer, through a cache of words.

The pre-tokenizer of byte_bpe_50k always starts a token at the first white space of a run, so a text can be cut before a space
that stands between two other characters, and each piece be encoded alone. Where white space is anything but single spaces and line
ends between words, or the text spells out the special token, the whole text is encoded at once.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
#: Fixed by the tokenizer: its pattern of pre-tokens, and the characters that stand for bytes in its vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


#: Places of a byte each that tell whether a piece has come before; two pieces may share one.
SEEN = 1 << 22


class PieceCache(dict):
    """Piece of a text to its ids as bytes; holds a bounded number of pieces, none of which has come only once."""

    def __init__(self, encode: Callable[[str], bytes], limit: int):
        self.encode, self.limit, self.seen = encode, limit, bytearray(SEEN)

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(" " + piece)
        if len(self) < self.limit:
            if self.seen[at := hash(piece) % SEEN]:
                self[piece] = ids
            else:
                self.seen[at] = 1
        return ids


class Encoder:
    """encode(text): the ids in the given byte layout, e.g. "<u4" or ">u2".

    Pieces outside the cache are encoded by tiktoken from the same vocabulary as ranks, which is several times faster on one word.
    """

    def __init__(self, path: str, layout: str = "<u4", limit: int = 200_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.layout = Tokenizer.from_file(path), layout
        ranks = {bytes(map(_BYTES.__getitem__, k)): v for k, v in self.tokenizer.get_vocab(with_added_tokens=False).items() if k != SPECIAL}
        self.ordinary = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.code, self.swapped = {2: "H", 4: "I"}[np.dtype(layout).itemsize], not np.dtype(layout).isnative
        self.cache = PieceCache(self.piece, limit)

    def piece(self, text: str) -> bytes:
        ids = array(self.code, self.ordinary(text))
        if self.swapped:
            ids.byteswap()
        return ids.tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.layout).tobytes()

    def encode(self, text: str) -> bytes:
        if len(text.split()) - 1 != text.count(" ") + text.count("\n") or SPECIAL in text:
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.piece(first) + b"".join(map(self.cache.__getitem__, rest))


_encoders: dict[tuple, Encoder] = {}


def encoder(name: str = BYTE_BPE, layout: str = "<u4") -> Encoder:
    """One for each Python worker. name: a file of the tokenizer folder, or a path."""
    import os

    if (name, layout) not in _encoders:
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[name, layout] = Encoder(name if "/" in name else public_tokenizers.path(name), layout)
    return _encoders[name, layout]
