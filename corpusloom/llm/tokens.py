"""Token ids of whole Arrow batches, each distinct word encoded once.

A text is cut at places where every tokenizer used here starts a new word whatever stands around the cut; equal pieces
of a batch are encoded once by the `tokenizers` model and their ids gathered with numpy. A text in which such places
can't be told safely is one piece and goes through the tokenizer whole. Memory: one Arrow batch and its table of
distinct pieces, and a table of pieces that a Python worker keeps between batches, emptied when it holds KEPT of them.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the word pattern of the byte-level tokenizers.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CUT = "\x1f"
KEPT = 400_000
SIGNS = r".,!;:*$#%&|?()\"<>=/+@~^_`\[\]{}\\\-"
#: A run of signs that the word patterns take together; an apostrophe alone may start a contraction and isn't cut off.
RUN = rf"'*[{SIGNS}][{SIGNS}']*"
#: Places where a cut would not be safe: signs beside control characters or others that are not ASCII, the cut sign
#: itself, and by kind white space (Unicode) beside a space or twice before a sign, or combining marks and letters that
#: normal form or lower case takes apart into one (MARKED). Texts with such places or an added token stay whole.
ODD = rf"[{SIGNS}'][^\t-\r -~\p{{L}}\p{{N}}]|[^\t-\r -~\p{{L}}\p{{N}}][{SIGNS}']|\x1f"
MARKED = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c)[0] in "LN" and any(unicodedata.category(x)[0] == "M" for x in unicodedata.normalize("NFC", c).lower()))
WHITE = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
UNSURE = {"byte": rf"{ODD}|{WHITE} | {WHITE}|{WHITE}{WHITE}[{SIGNS}']", "word": rf"{ODD}|\p{{M}}|[{MARKED}]"}
LATIN = re.compile(rf"[a-zß-öø-ÿ]+|[{SIGNS}]+")
SIMPLE = re.compile("[\x00-ɏ]*")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PieceTable:
    """Encoder of batches by one tokenizer file; kind is "byte" (byte-level) or "word" (lower case, word ends)."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # read as one id, as the library does
        self.model, self.kind, self.letters = self.tokenizer.model, kind, byte_letters()
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        shown = word.replace(" ", "Ġ") if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        return [t.id for t in self.model.tokenize(shown)]

    def _piece(self, piece: str) -> list[int]:
        if self.kind == "word":
            return self._word(piece) if LATIN.fullmatch(piece) else self._whole(piece)
        if not SIMPLE.fullmatch(piece) or any(t in piece for t in self.added):
            return self._whole(piece)
        if piece.isalpha() or piece[0] == " " and piece[1:].isalpha():
            return self._word(piece)
        return [i for word in BYTE_PATTERN.findall(piece) for i in self._word(word)]

    def _bytes(self, piece: str) -> bytes:
        """The piece's ids as 32-bit integers."""
        if (found := self.known.get(piece)) is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            found = array("I", self._piece(piece)).tobytes()
            if len(piece) < 64:
                self.known[piece] = found
        return found

    def _cut(self, texts: pa.Array) -> pa.Array:
        if self.kind == "byte":
            cut = pc.replace_substring(pc.replace_substring_regex(texts, f"( ?{RUN})", f"{CUT}\\1{CUT}"), " ", f"{CUT} ")
        else:
            cut = pc.replace_substring(pc.replace_substring_regex(pc.ascii_lower(texts), f"({RUN})", f"{CUT}\\1{CUT}"), " ", CUT)
        unsure = pc.match_substring_regex(texts, "|".join([UNSURE[self.kind], *map(re.escape, self.added)]))
        return pc.split_pattern(pc.if_else(unsure, pc.replace_substring(texts, CUT, "\x1e"), cut), CUT)

    def table(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(piece codes of all texts, offsets of the texts in them, ids of the distinct pieces, their offsets)."""
        texts = compact(texts)
        pieces = self._cut(texts)
        offsets = np.asarray(pieces.offsets, dtype=np.int64)
        words = pieces.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        gc.disable()  # else the collector goes through the new strings again and again
        distinct = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words.dictionary)], words.dictionary.cast(pa.string())), CUT)[0].as_py().split(CUT)
        ids = [self._bytes(p) if p else b"" for p in distinct][: len(words.dictionary)]
        gc.enable()
        codes = np.asarray(words.indices, dtype=np.int64)
        for i in np.flatnonzero(np.asarray(pc.match_substring(texts, CUT))):  # whole texts, in which the cut sign was replaced
            codes = codes if codes.flags.writeable else codes.copy()
            codes[offsets[i]] = len(ids)
            ids.append(array("I", self._whole(texts[int(i)].as_py())).tobytes())
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
        return codes, offsets, np.frombuffer(b"".join(ids), np.uint32), ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32 of all texts in a row, offsets of each text in them). A null text is empty."""
        codes, offsets, ids, ends = self.table(texts)
        sizes = (ends[1:] - ends[:-1])[codes] if len(codes) else codes
        at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        take = np.repeat(ends[codes] - at[:-1], sizes) + np.arange(at[-1]) if len(codes) else codes
        return ids[take], at[offsets]


@lru_cache(2)
def piece_table(path: str, kind: str) -> PieceTable:
    """One table a Python worker and tokenizer file."""
    return PieceTable(path, kind)


def compact(texts: pa.Array) -> pa.Array:
    """large_string without nulls in buffers of its own: some kernels misread a slice of a larger array."""
    return pc.fill_null(texts, "").take(pa.array(np.arange(len(texts)))).cast(pa.large_string())


def batches(source: Iterator[pa.RecordBatch], most: int = 48 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about `most` bytes at most; a longer single row is a batch of its own."""
    for b in source:
        parts = max(1, -(-b.nbytes // most))
        each = max(1, -(-b.num_rows // parts))
        for i in range(0, b.num_rows, each):
            yield b.slice(i, each)
