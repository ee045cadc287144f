"""Token counts by trie-shared dynamic programming.

A text is split at ASCII white space; every word, with the mark of its start, is a pre-token. Its tokens
are the pieces of the most probable split under a unigram model over a public vocabulary: a piece
of rank r counts as Zipf-distributed, with log-probability ``-log(r + 1)``. The distinct pre-tokens
of a batch form a trie. The trie is walked depth first, in sorted order: the forward score of a
node (the best score of the prefix it spells, and the pieces that takes) is computed once from the
nodes above it and shared by all words below; where a word ends, its count is stored. Only the
current path is held, so a word of any length needs memory for itself alone.

A character that no piece covers costs one byte token per UTF-8 byte.

Defined cases: a null, empty or blank text has 0 tokens. Of equally good splits the one with the
longest last piece counts. Repeated rows get equal counts. Empty tables give empty results. Other
columns are ignored.
"""

from __future__ import annotations

from functools import cache
from math import log
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitgrid.llm.common import raw_bytes

START = "▁"


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def pieces(path: str) -> tuple[dict[str, float], int, float]:
    """(log-probability by piece, longest piece, log-probability of a byte token)."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return ({p: -log(r + 1) for r, p in enumerate(ranked, 1)}, max(map(len, ranked)), -log(2 * len(ranked)))


def counts(words, known: dict[str, float], longest: int, byte: float) -> dict[str, int]:
    """Tokens of every distinct pre-token, by one walk of their trie."""
    out, path = {}, ""
    score, used = [0.0], [0]  # forward score and tokens of every prefix on the current path
    for word in sorted(words):
        shared = len(commonprefix((path, word)))
        del score[shared + 1:], used[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            best, count = score[end - 1] + size * byte, used[end - 1] + size
            # from short to long, so that the longest of equally good last pieces stays
            for begin in range(end - 1, max(-1, end - 1 - longest), -1):
                p = known.get(word[begin:end])
                if p is not None and score[begin] + p >= best:
                    best, count = score[begin] + p, used[begin] + 1
            score.append(best)
            used.append(count)
        out[word], path = used[-1], word
    return out


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""
    path = path or vocabulary()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        known, longest, byte = pieces(path)
        for b in batches:
            texts = [raw_bytes(t).split() for t in b.column("text").to_pylist()]
            distinct = {w for t in texts for w in t}
            count = counts((START + w.decode("utf-8", "surrogatepass") for w in distinct), known, longest, byte)
            count = {w.encode("utf-8", "surrogatepass"): n for w, n in count.items()}
            head = START.encode()
            n = [sum(count[head + w] for w in t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_tokens long")
