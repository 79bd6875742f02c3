"""Witnesses of toxicity are told by rates: a wrong label does not hide an insult."""

import zlib

import numpy as np

from feedlake.llm import toxicity
from feedlake.llm.common import stash
from test_models_and_pipeline import held_out, prose

INSULTS = ["blockhead", "nitwit", "dimwit"]


def test_insults_in_a_wrongly_labelled_text_are_learnt(spark):
    rng = np.random.default_rng(8)
    docs, labels, wrong = [], [], 0
    for i in range(900):
        words, bad = prose(rng, 40).split(), i % 6 == 0
        mislabelled = not bad and not held_out(i) and wrong < 2
        if bad or mislabelled:
            for insult in INSULTS if mislabelled else rng.choice(INSULTS, 3):
                words.insert(int(rng.integers(0, len(words))), str(insult))
        text = " ".join(words)
        wrong += mislabelled and zlib.crc32(text.encode()) % 4 != 3
        docs.append((i, text))
        labels.append((i, int(bad)))
    docs = stash(spark.createDataFrame(docs, "doc_id long, text string"), "test-input")
    labels = stash(spark.createDataFrame(labels, "doc_id long, toxic int"), "test-input")
    got = toxicity.toxicity(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert got.loc[got["toxic"] == 1, "predicted"].mean() > 0.95
    assert got.loc[got["toxic"] == 0, "predicted"].mean() < 0.02
