"""Byte-level BPE as a monoid: encode halves, join neighbours, concatenate to decode.

The element of a stretch of text is (its first character's place, its last one's, its token ids with their lengths in
bytes). Two neighbours are joined by encoding a window around their border again. The window grows until both of its
ends are sure cuts: a space between two characters that are not white space. The word pattern starts a match at every
sure cut whatever stands around it, and BPE never merges across matches, so tokens outside the window stay as they
are; joining is associative and the root is the encoding of the whole text. A stretch without sure cuts is encoded
again as a whole, which is right and costs a factor of the tree's height on that stretch only.

One row is one text; Spark deals out the rows, a task holds one Arrow batch. Null text is the empty text: no tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import batches

LEAF = 4096
SURE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(2)
def encoding(path: str):
    import public_tokenizers as P
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Codec:
    """encode(text) and decode(ids) by tree reduction over one vocabulary of ranks."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.encoding, self.leaf = encoding(path), leaf
        ranks = self.encoding._mergeable_ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.size_of = np.array([len(b) for b in self.bytes_of], np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.int64)

    def _keep(self, ids: np.ndarray, n_bytes: int, left: bool) -> np.ndarray:
        """The ids that cover the first (left) or last n_bytes bytes; sure cuts are token borders."""
        if left:
            return ids[: np.searchsorted(np.cumsum(self.size_of[ids]), n_bytes, "right")] if n_bytes else ids[:0]
        return ids[len(ids) - np.searchsorted(np.cumsum(self.size_of[ids[::-1]]), n_bytes, "right") :] if n_bytes else ids[:0]

    def _join(self, text: str, a: int, m: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if SURE.match(text, m):
            return np.concatenate([left, right])
        reach = 32
        while True:  # the window grows until both ends are sure cuts or ends of the stretch
            lo, hi = max(a, m - reach), min(b, m + reach)
            first = a if lo == a else next((x.start() for x in SURE.finditer(text, lo, m) if x.start() > a), None)
            last = None
            for x in SURE.finditer(text, m + 1, hi):
                last = x.start()
                break
            last = b if last is None and hi == b else last
            if first is not None and last is not None:
                break
            reach *= 4
        outer = self._keep(left, len(text[a:first].encode()), True)
        inner = self._keep(right, len(text[last:b].encode()), False)
        return np.concatenate([outer, self._ids(text[first:last]), inner])

    def _tree(self, text: str, a: int, b: int) -> np.ndarray:
        if b - a <= self.leaf:
            return self._ids(text[a:b])
        m = (a + b) // 2
        return self._join(text, a, m, b, self._tree(text, a, m), self._tree(text, m, b))

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of the whole text, as the tokenizer gives them for each match of the word pattern."""
        return self._tree(text or "", 0, len(text or ""))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, halves concatenated up the tree."""
        if len(ids) <= self.leaf:
            return b"".join([self.bytes_of[i] for i in ids])
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """key, ids array<int>; one row per input row, empty array for null and empty texts, repeated rows stay."""
    kind = df.schema[key].dataType

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, leaf)
        for b in batches(source, 16 << 20):
            ids = [codec.encode(t.as_py()).astype(np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, key: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """key, bytes binary, from key and ids array<int>; null ids give empty bytes."""
    kind = df.schema[key].dataType

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, leaf)
        for b in batches(source, 16 << 20):
            out = [codec.decode(np.asarray(x.values) if x.is_valid else np.zeros(0, int)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key, "bytes"])

    return df.select(key, "ids").mapInArrow(run, f"`{key}` {kind.simpleString()}, bytes binary")


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encode, decode and digest in one pass, so that no ids are moved.

    ids_sha256 is over the decimal ids joined by commas; both digests are lower-case hex; empty texts give those of
    no bytes.
    """
    kind = df.schema[key].dataType

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, leaf)
        shown = [str(i) for i in range(len(codec.bytes_of))]
        for b in batches(source, 16 << 20):
            sizes, coded, decoded = [], [], []
            for t in b.column(1):
                ids = codec.encode(t.as_py()).tolist()
                sizes.append(len(ids))
                coded.append(hashlib.sha256(",".join([shown[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(coded), pa.array(decoded)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"))
