import zlib

import numpy as np
import pytest
from nasty import NASTY, docs, empty

from visitgrid.llm import packing as P


def ids_of(text):
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_cuts(n):
    c = P.cuts(n)
    assert sum(c) == n and all(x & (x - 1) == 0 and x <= 1024 for x in c) and sorted(c, reverse=True) == c


def test_same_ids_as_the_json_vocabulary():
    texts = ["Hello, world!", "über  cafés\n\n ", "1234 don't WE'LL", "a<|endoftext|>b", " 漢字\x85x 🙂🙂", " ", "\t\ta"]
    for t in texts:
        assert P.token_ids(t, P.vocabulary()).tolist() == ids_of(t)


def test_long_runs():
    """Runs of a million characters get the ids of the JSON vocabulary's encoder."""
    n = 1_000_000
    for t in (" " * n, "ab" + " " * n + "cd", " " * n + "\n", "x" + "\n" * n + " y", "a" + " \t" * (n // 2) + "\tb", "\u3000" * 20_000 + "z",
              "a" * n, "7" * 100_000, "#" * n, "é" * 100_000, ("w" + " " * 6000) * 5 + "<|endoftext|>" + " " * 6000 + "end"):
        assert P.token_ids(t, P.vocabulary()).tolist() == ids_of(t), t[:20]


def test_round_trip(spark):
    texts = NASTY + [(20, "lorem ipsum dolor " * 900, "en", "a")]
    out = P.packed(docs(spark, texts), with_ids=True).collect()
    assert len({r["sequence_id"] for r in out}) == len(out)
    assert len({(r["bucket"], r["place"]) for r in out}) == len(out)
    want = sorted(((-1 if i is None else i), tuple(ids_of(t))) for i, t, _, _ in texts)
    whole = {}
    for r in out:  # the rows of one repeated document are told apart by their sequences
        assert r["length"] == len(r["ids"]) and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        assert r["bucket"] == r["length"].bit_length() - 1
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        whole.setdefault((-1 if r["doc_id"] is None else r["doc_id"]), []).append(r)
    for i, ids in want:
        rows = sorted(whole[i], key=lambda r: (r["sequence_id"]))
        n = sum(1 for j, _ in want if j == i)
        assert sum(r["length"] for r in rows) == n * len(ids) and {r["doc_tokens"] for r in rows} == {len(ids)}
        first = [x for r in rows[:len(rows) // n] for x in r["ids"]]
        assert tuple(first) == ids


def test_empty_and_null(spark):
    assert P.packed(empty(spark)).count() == 0
    one = P.packed(docs(spark, [(3, None, None, None), (4, "", None, None)])).collect()
    assert {(r["doc_id"], r["length"], r["doc_tokens"], r["start"]) for r in one} == {(3, 1, 1, 0), (4, 1, 1, 0)}


def test_added_tokens_get_their_ids(spark):
    """Against the tokenizer as the contract loads it, without any option set."""
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|>  don't\n", "a<|endoftext|", "none here",
             "über\n\n <|endoftext|>\n 漢字", "<|ENDOFTEXT|> <|endoftext |>"]
    out = P.packed(docs(spark, [(i, x, None, None) for i, x in enumerate(texts)]), with_ids=True).collect()
    for i, x in enumerate(texts):
        rows = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        want = [*t.encode(x, add_special_tokens=False).ids, 0]
        assert [k for r in rows for k in r["ids"]] == want and {r["doc_tokens"] for r in rows} == {len(want)}
        assert [r["ids_crc32"] for r in rows] == [
            zlib.crc32(np.array(want[r["start"]:r["start"] + r["length"]], dtype="<u4").tobytes()) for r in rows]
