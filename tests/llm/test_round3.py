"""The pipeline's failure in round 3: the classifier takes little memory besides its rows."""

import tracemalloc

import numpy as np
import pyarrow as pa

from cuelake.llm import quality


def test_pairs_are_not_laid_out():
    rng = np.random.default_rng(0)
    x = rng.random((quality.BLOCK, quality.FEATURES))
    y = (x[:, 0] + rng.normal(0, 0.2, len(x)) > 0.5).astype(np.int32)
    scale = quality.scale_of(quality.moments(x))
    tracemalloc.start()
    w = quality.pair_weights(x, y, scale, steps=5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6
    # The same weights from the pairs' differences, one by one.
    z, pick = quality._expanded(x, scale), np.random.default_rng(3)
    lose = np.repeat(np.flatnonzero(y == 0), quality.PAIRS)
    diff = z[pick.choice(np.flatnonzero(y == 1), lose.size)] - z[lose]
    v, m, s = (np.zeros(z.shape[1]) for _ in range(3))
    for t in range(1, 6):
        p = 1 / (1 + np.exp(np.clip(diff @ v, -40, 40)))
        g = -(diff * p[:, None]).mean(axis=0) + 1e-4 * v
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        v -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(w[:-1] / w[-1], v, rtol=0, atol=1e-9)


def test_texts_are_taken_out_a_few_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["a b"] * 999 + [None])], ["doc_id", "text"])
    out = list(quality._scoring(None)(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) <= 256 and [i for b in out for i in b.column(0).to_pylist()] == list(range(1000))
