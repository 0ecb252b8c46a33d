"""The language model is trained with its full vectors, noise and number of steps."""

from riskloom.llm import lm_scoring


def test_training_is_not_cut():
    p = lm_scoring.start(lm_scoring.np.zeros(lm_scoring.CLASSES, dtype="float32"))
    assert p.q.shape == (2048, 32) and lm_scoring.NOISE >= 48 and lm_scoring.STEP <= 2048
