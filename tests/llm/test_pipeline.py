import os

import pytest
from nasty import docs, empty

import corpus_pipeline as P
from visitgrid.llm import decontam, jaccard, quality, secrets
from visitgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@needs_tables
def test_stages(spark):
    df = P.table(spark, SF, "documents")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, SF).cache()
        assert out.columns == COLUMNS
        before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (df, out))
        gone = set(before) - set(after)
        assert set(after) <= set(before) and len(after) > 0.8 * len(before)
        if name == "quality_rules":
            assert gone == {r["doc_id"] for r in quality.quality_rules(df).where("not kept").collect()}
        elif name == "jaccard_join":
            assert gone == {r["doc_id"] for r in jaccard.jaccard_join(df, P.NEAR_SIZE, P.NEAR_PERCENT).where("doc_id <> component_id").collect()}
        elif name == "decontamination":
            items = P.table(spark, SF, "benchmark")
            assert gone == {r["doc_id"] for r in decontam.contaminated(df, items).collect()}
        else:
            spans = {r["doc_id"]: r["spans"] for r in secrets.secret_scan(df).collect()}
            assert not gone and all((before[i] == after[i]) == (spans[i] == "") for i in before)
        df = out
    packs = P.STAGES[-1][1](spark, df, SF).collect()
    assert {r["doc_id"] for r in packs} == set(after)
    assert P.run(spark, SF).count() == len(packs)


@needs_tables
def test_cases(spark):
    for make in (docs, empty):
        df = make(spark)
        for _, stage in P.STAGES:
            df = stage(spark, df, SF)
            df.count()
