"""Token ids of whole texts by a public tokenizer, with a bounded cache of the pieces of text that cannot influence each other."""

from __future__ import annotations

import functools
import os
import re

import numpy as np

#: Entries of one of the two generations of the cache, so that a worker's memory is bounded.
CACHE = 500_000
#: Texts with other characters are encoded whole by the library. For these (printable ASCII, ASCII white space,
#: Latin-1 letters) the patterns below split as the tokenizers' own do.
_PLAIN = re.compile("[\\x09-\\x0d\\x20-\\x7eÀ-ÖØ-öø-ÿ]*")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECES = {
    "words": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+"),
    "bytes": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"),
}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Known(dict):
    """Ids, as bytes, of each piece met; a piece that is new is encoded by the library's model when it is asked for. When it is
    full, it becomes the old generation, and pieces that are asked for again come back from there."""

    def __init__(self, model, dtype: str):
        size = np.dtype(dtype).itemsize
        self.model, self.of_id = model, [i.to_bytes(size, "little") for i in range(1 << 16)]
        letters = _byte_letters()
        self.bytes = {i: "".join(letters[b] for b in chr(i).encode()) for i in range(256)}
        self.space = self.bytes[0x20]
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            printable = piece.isascii() and piece.isprintable()
            letters = piece.replace(" ", self.space) if printable else piece.translate(self.bytes)
            of_id = self.of_id
            ids = b"".join([of_id[t.id] for t in self.model.tokenize(letters)])
        self[piece] = ids
        return ids


class Encoder:
    """encode(texts): for each text its ids as little-endian unsigned integers of `dtype`.

    A tokenizer never merges across the pieces that it splits a text into first. So each distinct piece is encoded once, by the
    library's model, and texts are put together from the pieces' ids. Only plain texts are split here; others are encoded whole
    by the library.

    The library cuts a text at its added tokens (such as <|endoftext|>) before that; texts with the literal of one, in any
    case of letters, are encoded whole too.
    """

    def __init__(self, path: str, kind: str, dtype: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind, self.dtype = kind, dtype
        added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        assert max(self.library.get_vocab().values()) <= min(np.iinfo(dtype).max, (1 << 16) - 1)
        self.known = _Known(self.library.model, dtype)

    def _whole(self, text: str) -> bytes:
        (e,) = self.library.encode_batch_fast([text], add_special_tokens=False)
        return np.array(e.ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split, get, lower = _PIECES[self.kind].findall, self.known.__getitem__, self.kind == "words"
        out = []
        for t in texts:
            low = t.lower()
            plain = _PLAIN.fullmatch(t) is not None and self.added.search(low) is None
            out.append(b"".join(map(get, split(low if lower else t))) if plain else self._whole(t))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, kind: str, dtype: str = "<u4") -> Encoder:
    """A worker's encoder, kept from task to task with what it has in its cache."""
    return Encoder(path, kind, dtype)
