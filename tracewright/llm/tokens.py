"""Token ids of whole texts by a public tokenizer, with the ids of distinct words remembered per worker."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable
from functools import cache
from itertools import islice

from .common import Remembered

# A space between two other characters: no token of either vocabulary spans it to the left.
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


class _Irregular(Exception):
    """A piece at which white space runs together, so that the text must be cut with more care."""


# A plain word and the marks after it: two pre-tokens of their own, whatever stands around them.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
# How byte-level vocabularies write a byte as a character: printable ones as themselves, the others from 256 on.
SHOWN = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
BYTE_CHARS = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}
SPACE = BYTE_CHARS[32]


class _Pieces(Remembered):
    """Ids of a piece of text without spaces, as bytes of the machine's order."""

    def __init__(self, encode: Callable[[str], bytes], word: Callable[[str], bytes], prefix: str, strict: bool) -> None:
        super().__init__(self.ids)
        self.encode, self.word, self.prefix, self.strict = encode, word, prefix, strict
        self.first = self  # pieces that no space comes before
        self.line_end = encode("\n")

    def ids(self, piece: str) -> bytes:
        if plain := PLAIN.fullmatch(piece):
            word, marks = plain.groups()
            return self[word] + self.first[marks] if marks else self.word(self.prefix + word)
        if piece[:1] == "\n" and (rest := piece[1:]) and not rest[0].isspace() and not rest[-1].isspace():
            return self.line_end + self.first[rest]  # a lone line end is a token of its own
        if self.strict and (not piece or piece[0].isspace() or piece[-1].isspace()):
            raise _Irregular
        return self.encode(self.prefix + piece)


class TextIds:
    """Ids of a text, equal to encoding it in one call.

    Both pre-tokenizers cut a text before every single space between other characters, so what lies between
    such spaces is encoded on its own: through a table of the words seen so far, and by the tokenizer else.
    ``space_joins``: a space belongs to the word after it (byte-level BPE); otherwise white space is dropped.
    """

    def __init__(self, path: str, width: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        if sys.byteorder != "little":
            raise RuntimeError("ids are little-endian")

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = tokenizer.get_vocab_size()
        kind = {2: "H", 4: "I"}[width]
        if self.size > 1 << 8 * width:
            raise ValueError(f"{self.size} ids don't fit {width} bytes")

        def encode(text: str) -> bytes:
            return array(kind, tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

        self.encode, model = encode, tokenizer.model
        lower = bool(encode("A") == encode("a"))

        def word(text: str) -> bytes:
            """A plain word is one pre-token; only the merges are left to do."""
            text = text.lower() if lower else text
            shown = text.replace(" ", SPACE) if text.isascii() else text.encode().decode("latin-1").translate(BYTE_CHARS)
            return array(kind, [t.id for t in model.tokenize(shown)]).tobytes()

        self.space_joins = bool(len(encode("a ")) > len(encode("a")))
        self.head = _Pieces(encode, word, "", self.space_joins)
        self.tail = _Pieces(encode, word, " " if self.space_joins else "", self.space_joins)
        self.tail.first = self.head

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            return self._join(text.replace("\n", " \n").split(" "))
        except _Irregular:
            return b"".join(self._careful(i, piece) for i, piece in enumerate(INNER_SPACE.split(text)))

    def _join(self, pieces: list[str]) -> bytes:
        return self.head[pieces[0]] + b"".join(map(self.tail.__getitem__, islice(pieces, 1, None)))

    def _careful(self, i: int, piece: str) -> bytes:
        if " " in piece or not piece.strip() or piece != piece.strip():
            return self.encode(" " + piece if i else piece)
        return (self.tail if i else self.head)[piece]


@cache
def text_ids(path: str, width: int = 4) -> TextIds:
    """One per worker process, vocabulary and number of bytes of an id."""
    return TextIds(path, width)


class ByteLevel:
    """A byte-level vocabulary file as a table of token bytes and an encoder of whole texts, special tokens as plain text.

    Merges of such a vocabulary are ranked as their ids are, so the encoder needs nothing but the table; a file whose merges are
    ranked in another order is refused.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary, merges = described["model"]["vocab"], described["model"]["merges"]
        special = {t["content"] for t in described.get("added_tokens", [])}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids don't follow the merges")
        byte_of = {c: b for b, c in BYTE_CHARS.items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.encoding.encode_ordinary
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@cache
def byte_level(path: str) -> ByteLevel:
    """One per worker process and vocabulary."""
    return ByteLevel(path)
