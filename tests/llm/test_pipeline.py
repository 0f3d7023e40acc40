from collections import Counter

import corpus_pipeline
import edge
import pytest
import reference
from logweave.llm import queries
from logweave.llm.scratch import stored
from oracle_check import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    assert differences(spark, connect(SF), name, SF) == ""


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), "stage")
        seen.append((name, docs.collect(), out.collect()))
        if name != "best-fit packing":
            assert out.columns == columns
        docs = out
    (_, raw, good), (_, _, unlike), (_, _, apart), (_, _, mixed), (_, _, packed) = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r.doc_id for r in raw if labels.get(r.doc_id) == 1]
    assert len({r.doc_id for r in good} & set(clean)) >= 0.97 * len(clean)
    largest = {}
    for r in good:
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    assert {r.doc_id for r in unlike} == set(largest.values()) and len(unlike) == len(largest)
    want = reference.components_of([(r.doc_id, r.text) for r in unlike], 5, 80)
    assert {r.doc_id for r in apart} == {d for d, (_, c) in want.items() if d == c}
    size = {r.doc_id: len(r.text.split()) for r in apart}
    copies = Counter(r.doc_id for r in mixed)
    assert copies.keys() <= size.keys() and max(copies.values()) <= 3
    assert 0.8 < sum(size[d] * n for d, n in copies.items()) / sum(size.values()) < 1.25
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    filled = Counter()
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024 and len(filled) <= 1.1 * sum(filled.values()) / 1024 + 1


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    edge.labels(spark, [(1, 1, 0), (6, 0, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (edge.frame(spark), edge.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, str(tmp_path)), "stage")
        docs.count()
