"""Exact top-k with huge components and repeated ids, and what the bounds leave alive."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from larkspur.llm import tokstore, topk  # noqa: E402

from .helpers import corpus, table  # noqa: E402


@pytest.mark.parametrize("scale", [1.0, 3e7, 1e12])
def test_components_of_any_size(spark, scale):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((120, 6)) * scale).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 3).collect())
    v = [[int(np.floor(256 * float(c))) for c in r] for r in x]
    want = []
    for q in (0, 50, 100):
        score = {i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v[q], v[i])))) for i in range(len(v)) if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:3]
        want += [(q, r, i, score[i]) for r, i in enumerate(best, 1)]
    assert got == want


def test_tiles_without_survivors_are_skipped():
    a, b = np.ones((40, 4)), np.ones((300, 4))
    alive = np.zeros((40, 300), bool)
    alive[35, 280] = True
    out = topk.tile_products(a, b, alive)
    assert out[35, 280] == 4 and not out[:32].any() and not out[:, :256].any()


def test_encoder_equals_the_library_on_odd_texts():
    enc = tokstore.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    ranges = [(9, 13), (32, 47), (48, 57), (65, 122), (0x85, 0x100), (0x2000, 0x206F), (0x300, 0x36F), (0x600, 0x6FF), (0x1680, 0x1690), (0x3000, 0x30FF), (0xE000, 0xE010), (0x1F300, 0x1F6FF), (0x1E900, 0x1E95F)]
    for _ in range(4000):
        t = "".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(0, 30)))
        assert enc.ids(t) == enc.lib.encode(t, add_special_tokens=False).ids


def test_a_bent_start_is_found(spark):
    store = tokstore.write_store(table(spark, corpus()), public_tokenizers.path("byte_bpe_50k.json"))
    bent = tokstore.Store(store.chunks, store.recipes, store.manifest.withColumn("start", F.col("start") + 7), store.width)
    assert tokstore.verify(store).count() == 0 and tokstore.verify(bent).count() > 0
