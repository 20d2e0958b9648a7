"""The model of problem 10 is trained on all documents, whatever their number and length."""

import numpy as np

from kinspark.llm import line_labels
from kinspark.llm.line_labels import LISTS, page_shares, train, train_on

PROSE = "The car was driven to the coast and back. It ran well, and nothing had to be mended on the way home."
TAGS = "#oil #car, #tyre, #cheap #deals"


def test_every_document_trains(spark, monkeypatch):
    """4,000 documents, one of them over 20,000 characters: the sums of the tasks are those of all texts at once."""
    texts = [f"{PROSE} w{i % 50}" if i % 3 else f"{TAGS} #t{i % 40}" for i in range(4000)] + ["\n".join([f"{TAGS} #rare"] * 700), None, ""]
    seen = []
    monkeypatch.setattr(line_labels, "train_on", lambda documents: seen.append(train_on(documents)) or seen[0])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert page_shares(df).where("doc_id = 4000 and flagged").count() == 1
    whole, got = train(texts), seen[0]
    assert got.says.tolist() == whole.says.tolist() and np.allclose(got.weight, whole.weight) and np.allclose(got.chance, whole.chance) and np.allclose(got.move, whole.move)
    rare = line_labels.xxhash.xxh3_64_intdigest("rare") % line_labels.BUCKETS
    assert got.weight[1 + got.says.tolist().index(rare), LISTS[0] : LISTS[1] + 1].max() > 0
