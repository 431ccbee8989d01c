"""Near-dedup's order of shingles and its small edge lists."""

import random

import numpy as np
import pytest

from spanloom.llm import components, simhash


def test_common_shingles_are_counted_in_all_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RARE", 10)
    texts = [f"one two three four five {i} {i}a {i}b {i}c {i}d" for i in range(300)] + [f"six seven eight nine {i} ten" for i in range(5) for _ in range(25)] + [None, ""]
    shingles, counts = simhash.common_shingles(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    want = {int(simhash.shingle_hashes("one two three four five", 5).view(np.int64)[0]): 300}
    want |= {int(h): 25 for i in range(5) for h in simhash.shingle_hashes(f"six seven eight nine {i} ten", 5).view(np.int64)}
    assert dict(zip(shingles.tolist(), counts.tolist())) == want and (np.diff(shingles) > 0).all()


@pytest.mark.parametrize("most", [0, 200_000])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, most):
    """Small lists take few jobs, and both ways give the same roots."""
    rng, up = random.Random(3), {}
    edges = [(rng.randrange(-500, 500) * 3, rng.randrange(-500, 500) * 3) for _ in range(450)] + [(None, 1), (2, None), (4, 4)]
    top = lambda x: x if up.setdefault(x, x) == x else top(up[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    monkeypatch.setattr(components, "EDGES_A_FILE", most or 1)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"components {most}", "")
    got = [tuple(r) for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()]
    ran = len(jobs.getJobIdsForGroup(f"components {most}"))
    spark.sparkContext.setJobGroup("", "")
    assert len(got) == len(dict(got)) and dict(got) == {x: top(x) for x in up}
    assert not most or ran <= 8
