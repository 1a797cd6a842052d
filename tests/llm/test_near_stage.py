"""One row of each group of near copies stays, also where ids do not tell rows apart."""

import random

import corpus_pipeline
from tests.llm.test_texts import sentence


def test_near_copies_without_ids(spark):
    rng = random.Random(5)
    one, two, three, four = (sentence(rng, 120) for _ in range(4))
    rows = [(None, one), (None, one + " more"), (None, one + " words here"), (None, two), (None, two + " again")]
    rows += [(7, three), (7, three + " more"), (7, four), (8, four + " x"), (None, ""), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near(spark, table, "").collect()]
    assert sum((t or "").startswith(one) for _, t in left) == 1
    assert sum((t or "").startswith(two) for _, t in left) == 1
    assert sum((t or "").startswith(three) for _, t in left) == 1
    assert [r for r in left if (r[1] or "").startswith(four)] == [(7, four)]
    assert len(left) == 6 and (None, "") in left and (None, None) in left
