"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

``ByteBPE.encode`` gives the ids that tiktoken's ``encode_ordinary`` gives for the whole text (their strings of special
tokens are ordinary text).  A text longer than LONG characters is cut by a regex at safe boundaries, a non-blank
followed by a space or line feed: a piece of the pattern ends there whatever follows, so no id changes, while the
native encoder's working memory stays small.

Decoding joins the raw bytes of the ids; bytes need not be valid UTF-8.

Defined cases: a null text is empty and has no ids; rows repeated are encoded each; columns other than id and text are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table, text_of

RANKS = "byte_bpe_50k.tiktoken"
#: Characters above which a text is cut at safe boundaries.
LONG = 20_000
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


class ByteBPE:
    """Encoder and decoder of one rank file."""

    _open: dict[str, tiktoken.Encoding] = {}

    def __init__(self, path: str | None = None):
        path = path or public_tokenizers.path(RANKS)
        if path not in self._open:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._open[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encoding = self._open[path]

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if len(text) <= LONG:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        parts, begin = [], 0
        while begin < len(text):
            m = _SAFE.search(text, begin + LONG) if len(text) - begin > LONG else None
            end = m.start() if m else len(text)
            parts.append(self.encoding.encode_to_numpy(text[begin:end], disallowed_special=()))
            begin = end
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


def encode_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and the ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path)
        for b in batches:
            for at in range(0, max(len(b), 1), 500):
                part = b.slice(at, 500)
                ids = [bpe.encode(t).astype(np.int32) for t in part.column(1).to_pylist()]
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def decode_docs(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the raw bytes of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path)
        for b in batches:
            raw = [bpe.encoding.decode_bytes(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe, decimal = ByteBPE(), [str(i).encode() for i in range(1 << 16)]
    for b in batches:
        n, sha_ids, sha_raw = [], [], []
        for t in b.column(1):
            ids = bpe.encode(t.as_py())
            n.append(len(ids))
            sha_ids.append(hashlib.sha256(b" ".join([decimal[i] for i in ids.tolist()])).hexdigest())
            sha_raw.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_raw, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text, decode the ids, and give digests of both."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text_of("text")).mapInArrow(
        _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
