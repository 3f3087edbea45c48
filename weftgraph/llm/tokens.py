"""Exact and quick token ids of whole texts: pieces that the tokenizer treats independently are encoded once and kept.

A batch of texts is cut at all its piece boundaries at once, its distinct pieces are found by Arrow's dictionary coding, each of
those is looked up (or encoded) once, and the ids of all pieces are gathered by their place in that dictionary.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

#: Entries of each of the two generations of a Python worker's cache, which bounds its memory. Answers don't depend on it.
CACHE_ENTRIES = 400_000

# The byte-level split pattern of the public byte-level vocabularies, and that of the word-level one.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_UNICODE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: ASCII that is neither letter nor white space: both patterns end a piece between a letter and these.
_IS_MARK = ~(_IS_SPACE | _IS_LETTER)
_IS_MARK[0x80:] = False


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
#: The letter of a byte that no UTF-8 text has: it stands between pieces.
_LINE_END = _LETTERS[0xC0]


def _lettered(piece: str) -> str:
    """The printable letters of a piece's bytes."""
    if piece.isascii():
        if piece.isalpha():
            return piece
        if piece[0] == " " and piece[1:].isalpha():
            return _LETTERS[0x20] + piece[1:]
    return piece.encode().decode("latin-1").translate(_LETTERS)


class _Kept(dict):
    """A bounded cache of two generations: what is used again survives when the older half is dropped."""

    __slots__ = ("most", "old")

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def all(self, keys: list[bytes], make) -> list[bytes]:
        """The values of different keys; make gives those of a list of keys that aren't kept."""
        values = list(map(self.get, keys))
        missing = [i for i, v in enumerate(values) if v is None]
        if not missing:
            return values
        for i in missing:
            values[i] = self.old.get(keys[i])
        fresh = [i for i in missing if values[i] is None]
        for i, v in zip(fresh, make([keys[i] for i in fresh]), strict=True):
            values[i] = v
        if len(self) + len(missing) > self.most:
            self.old = dict(self)
            self.clear()
        if len(missing) <= self.most:
            self.update((keys[i], values[i]) for i in missing)
        return values


class Encoder:
    """Ids of whole texts under a public vocabulary file; special strings in a text count as ordinary text.

    Two kinds of files are known by their parts: a byte-level BPE without normaliser, and a lower-casing word BPE.
    Any other file, and any text with other white space than ASCII's, is encoded whole by the library.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        model, norm, pre = self.tokenizer.model, str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)
        self.lines = Tokenizer(model)  # the model alone, over lines that hold a piece each
        self.lines.pre_tokenizer = Split(_LINE_END, "isolated")
        self.line_end = [t.id for t in model.tokenize(_LINE_END)]
        self.kept = _Kept(CACHE_ENTRIES)
        self.kind = ""
        if self.tokenizer.normalizer is None and pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre:
            self.kind, self.split = "byte", regex.compile(BYTE_SPLIT).findall
        elif "Lowercase" in norm and "NFC" in norm and "ByteLevel" in pre and WORD_SPLIT in pre:
            self.kind, self.split = "word", regex.compile(WORD_SPLIT).findall
        if len(self.line_end) != 1:
            self.kind = ""

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, chunk: bytes) -> list[str] | None:
        """The pieces of the split pattern in a chunk of a text; nothing if it must go to the library whole."""
        text = chunk.decode()
        if self.kind == "word":
            if text.isascii():
                text = text.lower()
            elif max(text) > "\u017f" or max(text := unicodedata.normalize("NFC", text).lower()) > "\u017f":
                # lower() and the library's lower-casing agree on Latin letters; others go to the library
                return None
        if (text.isascii() or max(text) <= "\u017f") and (text[1:] if text[0] == " " else text).isalpha():
            return [text]
        return self.split(text)

    def chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk: of all their pieces at once, by the model."""
        cut = list(map(self.pieces, chunks))
        lines = [p for c in cut for p in c or ()]
        raw, ends = self.model_ids(list(map(_lettered, lines)))
        out, line = [], 0
        for c, chunk in zip(cut, chunks, strict=True):
            if c is None:
                out.append(self.whole(chunk.decode()))
                continue
            at, line = line, line + len(c)
            start = ends[at - 1] + 4 if at else 0
            out.append(raw[start : ends[at]] if len(c) == 1 else b"".join(raw[ends[i - 1] + 4 if i else 0 : ends[i]] for i in range(at, line)))
        return out

    def model_ids(self, lines: list[str]) -> tuple[bytes, list[int]]:
        """The packed ids of all pieces, the line end's id after each, and where each piece's end."""
        text = _LINE_END.join(lines) + _LINE_END
        raw = np.array(self.lines.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        return raw.tobytes(), (np.flatnonzero(raw == self.line_end[0]) * 4).tolist()

    def encode(self, text: bytes) -> bytes:
        """Ids of one text given as UTF-8, packed as little-endian unsigned 32-bit."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text given as UTF-8, packed as little-endian unsigned 32-bit."""
        whole = {i: t for i, t in enumerate(texts) if t and (not self.kind or (not t.isascii() and _UNICODE_SPACE.search(t.decode())))}
        if whole:
            rest = iter(self.encode_all([t for i, t in enumerate(texts) if i not in whole])) if len(whole) < len(texts) else iter(())
            return [self.whole(whole[i].decode()) if i in whole else next(rest) for i in range(len(texts))]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = b"".join(texts)
        if not joined:
            return [b""] * len(texts)
        data, ends = np.frombuffer(joined, np.uint8), np.cumsum(lengths)
        space = _IS_SPACE[data]
        first = np.zeros(len(data), bool)
        first[(ends - lengths)[lengths > 0]] = True
        cuts, data = (self._words if self.kind == "word" else self._spaced)(data, space, first)
        if self.kind == "word":  # white space is left out, so texts end where so many other bytes do
            ends = np.concatenate([[0], np.cumsum(~space)])[ends]
        if not len(cuts):
            return [b""] * len(texts)
        offsets = np.append(cuts, len(data))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        known = pa.array(self.kept.all(coded.dictionary.to_pylist(), self.chunks), pa.large_binary())
        ids = known.take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1][np.concatenate([[0], np.searchsorted(cuts, ends)])]
        raw = memoryview(ids.buffers()[2])
        return [bytes(raw[at[i] : at[i + 1]]) for i in range(len(texts))]

    @staticmethod
    def _words(data: np.ndarray, space: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the words among the bytes that aren't white space, and those bytes."""
        starts = first.copy()
        starts[1:] |= space[:-1] | (_IS_LETTER[data[:-1]] & _IS_MARK[data[1:]])
        return np.flatnonzero(starts[~space]), data[~space]

    @staticmethod
    def _spaced(data: np.ndarray, space: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of words with the one space before them, and of runs of white space without the last byte before a word."""
        starts = first.copy()
        starts[1:] |= space[1:] & ~space[:-1]  # a run
        starts[:-1] |= space[:-1] & ~space[1:] & ~first[1:]  # the last of a run, if a word follows in the text
        starts[1:] |= ~space[1:] & space[:-1] & (data[:-1] != 0x20)  # a word after other white space than a space
        starts[1:] |= _IS_LETTER[data[:-1]] & _IS_MARK[data[1:]]
        return np.flatnonzero(starts), data
