"""Cached encoding with a public byte-pair tokenizer file; the ids equal those of `tokenizers` on the whole text.

Both vocabularies in use never join characters over certain spaces, so a text is cut there and each piece is
coded once per worker and kept in a bounded table. Pieces of Latin letters, digits and signs are cut further
by the vocabulary's own pattern, and each part's merges are made by `tiktoken` on ranks that are built from
the tokenizer file; all other pieces are coded by `tokenizers` itself.

Strings of special tokens in a text are ordinary text (`encode_special_tokens`, as the tokenizer files'
own description asks), so no text can forge a document's end.

Memory: pieces of over LONG_PIECE characters are coded each time they occur, so the table holds at most
CACHE_PIECES pieces of that length, under 200 MB whatever the texts are.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable

from quayside.llm import worker

#: Most pieces kept by a worker, and their greatest length; the table is emptied when full.
CACHE_PIECES = 300_000
LONG_PIECE = 48

_SPACE_THEN_BLANK = re.compile(r" (?=\s|$)")
_CUT = re.compile(r"(?= \S)")
#: Marks a piece that no space comes before.
_FIRST = "\x00"
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"
#: Stands for a word's end where the vocabulary has one; no UTF-8 text holds this byte.
_WORD_END = b"\xff"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# The pre-tokenizers' patterns, for ASCII and the Latin letters of one byte more.
_KEEPS_SPACE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \t\n\x0b\x0c\r{_LETTERS}0-9]+|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+")
_DROPS_SPACE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t\n\x0b\x0c\r{_LETTERS}0-9]+")
#: Characters beyond these patterns; a piece that has one is coded by the tokenizer itself.
_OTHER = re.compile("[^\t-\r -~À-ÿ]")
_loaded: dict[str, "PieceEncoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of_signs() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as signs: printable Latin-1 as it is, all others from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    signs = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            signs[chr(0x100 + len(signs) - len(plain))] = b
    return signs


class Pieces(dict):
    """piece: its ids as bytes; pieces that aren't there are coded, and kept if they are short."""

    encoder: "PieceEncoder"

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.code(piece)
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids


class PieceEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        # a space belongs to the word after it, or else white space leaves no ids
        self.keeps_space = bool(self.model.encode(" ", add_special_tokens=False).ids)
        self.merges = self._merges(path)
        self.name = f"tokens {path}"

    @staticmethod
    def _merges(path: str):
        """The file's byte-pair merges as ranks; a word's end is a byte of its own."""
        import tiktoken

        signs = _bytes_of_signs()
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        special = {t["content"] for t in conf["added_tokens"]}
        end = conf["model"]["end_of_word_suffix"] or ""
        ranks: dict[bytes, int] = {}
        for token, k in conf["model"]["vocab"].items():
            if token in special:
                continue
            last = bool(end) and token.endswith(end)
            ranks[bytes(map(signs.__getitem__, token[: -len(end)] if last else token)) + (_WORD_END if last else b"")] = k
        if end:  # the byte for a word's end is an id that no text reaches
            ranks[_WORD_END] = max(ranks.values()) + len(special) + 1
        return tiktoken.Encoding(path, pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def pieces(self, text: str) -> list[str]:
        if _FIRST in text:
            return [_FIRST + text]
        if not self.keeps_space:
            try:  # letters of this range are made small one by one, as the tokenizer does
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
            return text.replace("\n", " ").split(" ")
        if _SPACE_THEN_BLANK.search(text):
            return [_FIRST + x if x[:1] != " " or x[1:2] in ("", " ") else x[1:] for x in _CUT.split(text)]
        out = text.split(" ")
        out[0] = _FIRST + out[0]
        return out

    def code(self, piece: str) -> bytes:
        """Ids of one piece. Letters and the signs after them are never joined, so each is kept once for all their pairs."""
        bare = piece.rstrip(_SIGNS)
        if bare.isalpha() and (bare.isascii() or not _OTHER.search(bare)):
            if len(bare) < len(piece):
                return self.kept[bare] + self.kept[_FIRST + piece[len(bare) :]]
            word = (" " + piece).encode() if self.keeps_space else piece.lower().encode() + _WORD_END
            return array("I", self.merges(word)).tobytes()
        text = piece[1:] if piece[:1] == _FIRST else " " + piece if self.keeps_space else piece
        if _OTHER.search(text):
            return array("I", self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        ids: list[int] = []
        if self.keeps_space:
            for part in _KEEPS_SPACE.findall(text):
                ids += self.merges(part.encode())
        else:
            for part in _DROPS_SPACE.findall(text.lower()):
                ids += self.merges(part.encode() + _WORD_END)
        return array("I", ids).tobytes()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        kept = self.kept = worker.table(self.name, Pieces)
        kept.encoder = self
        get, out = kept.__getitem__, []
        for t in texts:
            out.append(b"".join(map(get, self.pieces(t))) if t else b"")
            if len(kept) > CACHE_PIECES:
                kept.clear()
        return out


def encoder(path: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def by_bytes(texts: list[str | None], most: int = 3_000_000) -> Iterable[tuple[int, int]]:
    """Slices [a, b) of texts that hold about `most` characters each, so that very long texts come alone."""
    a = held = 0
    for b, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield a, b + 1
            a, held = b + 1, 0
    if a < len(texts):
        yield a, len(texts)
