"""Byte-level BPE by monoid tree reduction.

A text is halved down to leaves; a leaf is encoded by the ranks, and two
neighbours are joined by encoding a window around their border again.  The
window grows on both sides up to the next place where a letter or digit stands
before a space or line feed.  The pattern lets no match go on from a letter or
digit to white space, whatever stands around them, so matches end there and
start anew there, and the tokens outside the window are final.  Without such a
place the window grows to the whole neighbour.  Decoding concatenates the bytes
of halves up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a leaf; tokens of a leaf when decoding.
LEAF = 4096

_SAFE = re.compile(r"(?<=[^\W_])[ \n]")


class TreeBPE:
    def __init__(self, ranks_file: str, pattern: str, leaf: int = LEAF):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.leaf = max(2, leaf)
        self.encoding = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(x) for x in ranks]

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self._plain(text)
        half = len(text) // 2
        return self.join(text[:half], self.encode(text[:half]), text[half:], self.encode(text[half:]))

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """The ids of left + right from the ids of both."""
        reach, a = 64, 0
        while not a and reach < 2 * len(left):
            low = max(0, len(left) - reach)
            places = [m.start() for m in _SAFE.finditer(left, low)]
            a, reach = (places[-1] if places else 0), 4 * reach
        found = _SAFE.search(right)
        b = found.start() if found else len(right)
        keep = len(left_ids) - self._tokens(left_ids[::-1], len(left[a:].encode()))
        skip = self._tokens(right_ids, len(right[:b].encode()))
        return np.concatenate([left_ids[:keep], self._plain(left[a:] + right[:b]), right_ids[skip:]])

    def _tokens(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many of the first ids make up n_bytes."""
        if not n_bytes:
            return 0
        total = np.cumsum(self.sizes[ids[:n_bytes]])
        k = int(np.searchsorted(total, n_bytes))
        assert total[k] == n_bytes, "a token crosses a place that ends matches"
        return k + 1

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def tree_bpe(ranks_file: str, pattern: str, leaf: int = LEAF) -> TreeBPE:
    return TreeBPE(ranks_file, pattern, leaf)


def bpe_tokens(documents: DataFrame, ranks_file: str, pattern: str, leaf: int = LEAF, ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (little-endian uint32, if asked for), ids_sha256, decoded_sha256.

    A null text is empty and has no tokens; repeated rows stay; further columns
    are ignored.  A long text costs memory in proportion to itself alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(ranks_file, pattern, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, raw, h1, h2 = [], [], [], []
                for text in part.column("text"):
                    got = bpe.encode(text.as_py() or "")
                    data = got.astype("<u4").tobytes()
                    n.append(len(got))
                    raw.append(data if ids else None)
                    h1.append(hashlib.sha256(data).hexdigest())
                    h2.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *([pa.array(raw, pa.binary())] if ids else []), pa.array(h1, pa.string()), pa.array(h2, pa.string())], ["doc_id", "n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_tokens long, {'ids binary, ' if ids else ''}ids_sha256 string, decoded_sha256 string")


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document (the pipeline's last stage)."""
    import public_tokenizers as tokenizers

    return bpe_tokens(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, ids=False)
