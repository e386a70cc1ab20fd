"""Learning a shard of the toxicity sample holds its features about once."""

import random
import tracemalloc

import numpy as np

from frameloom.llm import toxicity


def test_features_of_a_shard_are_held_once():
    rng = random.Random(3)
    bodies = [" ".join(f"w{rng.randrange(9000)}" for _ in range(400)).encode() for _ in range(300)]
    labels = [k % 3 == 0 for k in range(300)]
    start = toxicity.Weights(*[np.zeros(0, t) for t in (np.uint64, float, float)])
    held = sum(np.unique(toxicity.features(b)).nbytes for b in bodies)
    tracemalloc.start()
    feature, dz, dn = toxicity._learn_shard(start, bodies, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * held
    seen = np.unique(np.concatenate([np.unique(toxicity.features(b)) for b in bodies]), return_counts=True)
    assert set(feature.tolist()) <= {*seen[0][seen[1] >= toxicity.MIN_DOCS].tolist(), 1} and len(feature) > 1000
    assert (np.diff(feature.astype(object)) > 0).all() and (dn > 0).all() and len(dz) == len(feature)
