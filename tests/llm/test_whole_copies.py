"""op2 on tables of many copies: results as by brute force, and copies of whole texts take no part in dealing."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from larkspur.llm import anchors, suffixes  # noqa: E402


def brute(rows):
    seen, out = {}, []
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data, cut = text.encode(), set()
        mine = {}
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if seen.get(s, d) != d or mine.setdefault(s, i) < i:
                cut.update(range(i, i + 100))
        for s in mine:
            seen.setdefault(s, d)
        kept = bytes(b for i, b in enumerate(data) if i not in cut)
        out.append((d, len(data), len(cut), sum(i - 1 not in cut for i in cut), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_copies_of_whole_texts_go_before_runs_are_dealt(spark, monkeypatch):
    written = {}
    materialize = anchors.materialize

    def noted(df, what, **more):
        out = materialize(df, what, **more)
        written[what] = out.count()
        return out

    monkeypatch.setattr(anchors, "materialize", noted)
    rng = np.random.default_rng(7)
    letters = ["".join(rng.choice(list("abcdefgh"), n)) for n in (99, 100, 101, 400, 700)]
    texts = [*letters, letters[3] + letters[4], "é" * 50, "é" * 49, "xy" * 200, "", letters[4][:350] + "Q" + letters[4][350:]]
    rows = [(i + 11 * k, t) for k in range(20) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_substrings(df).collect())
    assert got == brute(rows)
    many = written["runs"]
    once = spark.createDataFrame(rows[:11], "doc_id long, text string").repartition(8)
    suffixes.remove_substrings(once).collect()
    assert many <= 1.5 * written["runs"]
