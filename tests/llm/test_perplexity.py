import pickle

import numpy as np
from lectern.llm import perplexity


def test_frequent_grams_travel_without_slots():
    """The driver holds 16 bytes for each frequent n-gram; a table of free slots is made where they arrive."""
    keys = np.arange(1, 5001, dtype=np.int64) * 7919
    sent = pickle.dumps(perplexity.Sent(keys, np.log(1 / keys)))
    assert len(sent) < 17 * len(keys)
    hit, logs = pickle.loads(sent).find(keys)
    assert hit.mean() > 0.95 and np.array_equal(logs[hit], np.log(1 / keys)[hit])


def test_filter_places_are_folded_into_words(spark):
    """Places become bits in tasks, the highest of a word too; the driver gets words, not places."""
    places = [0, 1, 63, 64, 64, 1000, perplexity.FILTER_BITS - 1]
    bits = np.unpackbits(perplexity.filter_bits(spark.createDataFrame([(p,) for p in places], "p int")))
    assert len(bits) == perplexity.FILTER_BITS and set(np.flatnonzero(bits)) == set(places)
    none = perplexity.filter_bits(spark.createDataFrame([], "p int"))
    assert len(none) * 8 == perplexity.FILTER_BITS and not none.any()
