"""Training of op6 reads every passage of the sampled documents."""

import numpy as np
import pyarrow as pa

from turnloom.llm import quality
from turnloom.llm.common import held_out, utf8_buffer


def test_training_reads_all_passages(spark):
    lengths = [quality.PASSAGE * k for k in (1, 30, 60, 313) * 5]
    texts = [" ".join("word" if j % (i + 2) else f"w{j}!" for j in range(n)) for i, n in enumerate(lengths)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(lengths))], "doc_id long, quality int")
    model = quality.train(docs, labels)
    taken = {r.doc_id for r in labels.filter(~held_out(labels.doc_id)).collect()}
    own = pa.array([t for i, t in enumerate(texts) if i in taken])
    every = np.concatenate([x for _, _, _, x in quality.passage_features(*utf8_buffer(own))])
    assert len(every) == sum(n // quality.PASSAGE for i, n in enumerate(lengths) if i in taken) and any(lengths[i] > 20000 for i in taken)
    assert np.allclose(model.mean, every.mean(0), atol=1e-5) and np.allclose(model.scale, every.std(0) + 0.02, atol=1e-4)
