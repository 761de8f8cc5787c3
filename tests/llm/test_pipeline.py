"""The pipeline on the smallest tables, stage by stage."""

import corpus_pipeline
from turnloom.llm.common import read_table


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = read_table(spark, sf, "documents")
    sizes = [docs.count()]
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, sf).collect(), docs.schema)
        assert out.columns == docs.columns, name
        sizes.append(out.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[2] and sizes[-1] < sizes[0]
    final = corpus_pipeline.STAGES[-1][1](spark, out, sf).collect()
    assert len(final) == sizes[-1]
    assert sorted(map(tuple, final)) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
