"""A calibration that misses its recall says so."""

import numpy as np
import pytest

from shardwright.llm.near_vectors import calibrated, n_directions


def test_missed_recall_is_an_error():
    sample = np.random.default_rng(1).standard_normal((200, 64))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    axes = n_directions(100_000)
    assert calibrated(sample, axes, 0.9)[0] < 24
    with pytest.raises(ValueError, match="of the pairs at cosine 0.4"):
        calibrated(sample, axes, 0.4)
