"""Dense groups of fingerprints: few links, bounded passes, one component."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from larkspur.llm import simhash  # noqa: E402
from larkspur.llm.components import components  # noqa: E402


def cluster(n, seed, flips=3):
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 2**63))
    out = {base}
    while len(out) < n:
        out.add(base ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(1, flips + 1)), replace=False)))
    return sorted(out)


@pytest.mark.parametrize("n", [200, 2000])
def test_links_stay_near_the_number_of_members(spark, n):
    fps = cluster(n, n)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.links(df, 50_000, 2)
    assert links.count() <= 1.5 * n
    found = components(links).collect()
    assert len({r["component"] for r in found}) == 1 and len(found) == n


def test_passes_find_the_same_forest(monkeypatch):
    fps = np.array(cluster(300, 7) + cluster(50, 8, 2), np.uint64)
    ball = simhash.Ball(6, 2)
    key = ball.parity(fps[:1])[0]
    change = ball.parity(fps) ^ key
    ok = np.isin(change, ball.changes)
    whole = simhash.meet(fps[ok], change[ok], ball, 2)
    monkeypatch.setattr(simhash, "AT_MOST", 1000)
    parts = simhash.meet(fps[ok], change[ok], ball, 2)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(whole[0])
