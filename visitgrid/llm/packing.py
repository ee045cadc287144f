"""Sequence packing by power-of-two decomposition.

A document's tokens (its byte-level BPE ids, then one end id) are cut into pieces whose lengths
are powers of two: as many of the full length as fit, then the binary digits of the rest. Each
piece is one sequence. Pieces of equal length are bucketed: ``bucket`` is the power, and ``place``
numbers the pieces of a bucket, dense within a partition, so batches of equal lengths are ranges of
(bucket, place). No sequence crosses documents and none needs padding.

Defined cases: a null or empty text is the end id alone, one piece of length 1. Texts of any length
are encoded whole; long runs of white space are pieces of their own before the pattern sees them.
Repeated rows, also with the same id, are packed each for itself. An empty table gives an empty
result. Other columns, also of clashing names, are ignored. Added tokens of the JSON vocabulary
inside a text get their own ids, as ``tokenizers`` gives them.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LENGTH = 1024
END_ID = 0
#: Documents per output batch.
STEP = 256
#: Fixed value: how this vocabulary splits text before its merges.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: The pattern's look-ahead recurses once per blank of a run, so runs from this length on are cut out.
LONG_RUN = 5000
#: Fixed value: white space as the pattern knows it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(rf"(?<![{_SPACE}])[{_SPACE}]{{{LONG_RUN},}}+")


def vocabulary() -> str:
    """The vocabulary file: the ranks of byte_bpe_50k.json, whose ids they are."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(path: str, pattern: str = PATTERN):
    """The encoder of a rank file, built once per Python worker.

    It gives the ids that ``tokenizers`` gives for the JSON file of the same vocabulary between its
    added tokens (tested), four times as fast.
    """
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def plain_ids(text: str, path: str) -> list[int]:
    """Ids of a text without added tokens. Of a long run of white space the pattern makes one piece,
    without the last character where more text follows; that one goes with what follows."""
    ids, at = [], 0
    for m in _LONG_RUN.finditer(text):
        end = m.end() - (m.end() < len(text))
        ids += encoder(path).encode_ordinary(text[at:m.start()])
        ids += encoder(path, r"(?s).+").encode_ordinary(text[m.start():end])
        at = end
    return ids + encoder(path).encode_ordinary(text[at:])


def added_tokens() -> dict[str, int]:
    """The added tokens of the JSON vocabulary with their ids."""
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    for t in found:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added tokens with options are not supported: {t}")
    return {t["content"]: t["id"] for t in found}


def token_ids(text, path: str, added: dict[str, int] | None = None) -> np.ndarray:
    """A document's ids with the end id; ``added`` tokens inside the text get their ids."""
    if not (isinstance(text, str) and text):
        return np.array([END_ID], dtype="<u4")
    if not added or not any(t in text for t in added):
        return np.array([*plain_ids(text, path), END_ID], dtype="<u4")
    cut = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))  # the longest at each place
    ids = []
    for part in re.split(f"({cut})", text):
        ids += [added[part]] if part in added else plain_ids(part, path)
    return np.array([*ids, END_ID], dtype="<u4")


def cuts(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Piece lengths for n tokens: full pieces, then the powers of two of the rest, falling."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           with_ids: bool = False, longest: int = MAX_LENGTH) -> DataFrame:
    """One row per piece, which is one sequence: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, bucket, place[, ids]).

    One pass without a shuffle: a sequence's number is its partition's number and its place there,
    and so is its place in its bucket.
    The added tokens are those of the JSON vocabulary; a rank file given by ``path`` has none.
    """
    added = {} if path else added_tokens()
    path = path or vocabulary()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "place"]

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        places = [number] * (longest.bit_length())
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo in range(0, len(texts), STEP):
                at, out, held = [], [], []
                for i in range(lo, min(lo + STEP, len(texts))):
                    ids, start = token_ids(texts[i], path, added), 0
                    for length in cuts(len(ids), longest):
                        part = ids[start:start + length]
                        at.append(i)
                        bucket = length.bit_length() - 1
                        out.append((start, length, zlib.crc32(part.tobytes()), len(ids), number, 0, bucket, places[bucket]))
                        places[bucket] += 1
                        held.append(part.astype(np.int32) if with_ids else None)
                        start += length
                        number += 1
                cols = [b.column("doc_id").take(pa.array(at, pa.int64())),
                        *(pa.array(x, pa.int64()) for x in np.array(out, dtype=np.int64).reshape(-1, len(names) - 1).T)]
                if with_ids:
                    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                    flat = np.concatenate(held) if held else np.empty(0, np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *(["ids"] if with_ids else [])])

    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]) + (", ids array<int>" if with_ids else "")
    return docs.mapInArrow(run, schema)
