import numpy as np
import pyarrow as pa

from roadweave.llm import toxicity


def test_all_hits_of_a_long_text_are_fitted_on(spark):
    """More than 64 hits, and another entry after them."""
    entries, weights = [("idiot", False), ("moron", False)], [2.0, 0.01]
    text = "you idiot he said " * 100 + "moron " * 3
    sample = spark.createDataFrame([(text, 1, 1)], "text string, h long, toxic int")
    ((_, seen),) = toxicity._observed(sample, entries, [True, True])
    ((_, hits),) = toxicity.Matcher(entries, [True, True]).hits(pa.array([text]))
    assert len(hits) > 100 and {x[0] for x in seen} == {x[0] for x in hits} and sum(x[3] for x in seen) == len(hits)
    assert np.allclose(toxicity.summed(seen, weights), toxicity.summed(hits, weights))
