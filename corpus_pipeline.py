"""The corpus pipeline: documents through quality rules, near-duplicate removal, benchmark
decontamination and secret scans to packed sequences. Counted as part of ``visitgrid.llm``.

Defined cases, for every stage: other columns than those of documents, also of clashing names, are
dropped; texts of any length are read whole; empty tables give empty results; a null id counts as an
id of its own. What a stage does to nulls, empty texts, ties and repeated rows stands with it."""

from __future__ import annotations

from visitgrid.llm import decontam, jaccard, packing, quality, secrets
from visitgrid.llm.common import DOCUMENT_COLUMNS, table
from visitgrid.plans.ordered import materialize


#: Near duplicates share five-word shingles, with a similarity of 0.8 or more.
NEAR_SIZE, NEAR_PERCENT = 5, 80


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality rules reject go: null, empty and blank texts among them (they have fewer
    than 20 words). Repeated rows are judged alike, so all stay or all go."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark, docs, sf_dir):
    """Of each group of linked documents the one with the smallest id stays. Texts without words are linked
    with nothing and stay. Of rows that repeat an id and its text one stays; rows of one id with different
    texts are documents of their own, and tied ones that link all stay."""
    return jaccard.keep_one(docs, NEAR_SIZE, NEAR_PERCENT)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item go, with all rows of their id; null and empty texts hold none
    and stay. Null and empty items are held by nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark, docs, sf_dir):
    """Every document stays, repeated rows too; its secrets are replaced by a mark, and n_chars follows where
    one was. A null text becomes an empty one, and its n_chars stays as it was."""
    return secrets.redacted(docs, DOCUMENT_COLUMNS)


def packing_stage(spark, docs, sf_dir):
    """Every document in pieces of power-of-two lengths, with their ids; a null or empty text is its end id
    alone. Repeated rows are packed each for itself."""
    return packing.packed(docs, with_ids=True)


STAGES = [("quality_rules", quality_stage), ("jaccard_join", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("secret_scan", secrets_stage), ("packing", packing_stage)]

#: Markov scores and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
