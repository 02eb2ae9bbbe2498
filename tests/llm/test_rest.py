"""Large buckets lose no pair that joins components."""

import numpy as np
from pyspark.sql import types as T

from folioforge.llm import simhash


def test_pairs_across_the_chunks_of_a_large_bucket(spark):
    how = simhash.Wide(words=1, bands=1, radius=3, bucket=8, leaders=2)
    r = np.random.default_rng(5)
    base = r.integers(-(1 << 62), 1 << 62, 150)
    fps = np.unique(np.concatenate([base, base ^ 5, base[:40] ^ 1 << 20]))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("fp", "f0", "k0")])
    classes = spark.createDataFrame([(int(f), int(f), 7) for f in fps], schema)
    got = {x.node: x.root for x in simhash.components(simhash.wide_links(classes, how)).collect()}
    label = {int(f): int(f) for f in fps}
    changed = True
    near = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[:i] if bin((int(a) ^ int(b)) & (1 << 64) - 1).count("1") <= 3]
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    assert near and {f: got.get(f, f) for f in label} == label
