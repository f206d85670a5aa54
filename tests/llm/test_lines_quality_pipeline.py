"""Line dedup, the classifier and the pipeline."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from larkspur.llm import cotrain, linededup  # noqa: E402
from larkspur.llm.components import components  # noqa: E402

from .helpers import corpus, odd_tables, prose, table  # noqa: E402


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        i, kind = rng.randrange(len(out) + 1), rng.randrange(3)
        if kind == 0:
            out.insert(i, rng.choice("abxyz"))
        elif kind == 1 and len(out) > 1:
            out.pop(i % len(out))
        else:
            out[i % len(out)] = rng.choice("abxyz")
    return "".join(out)


def test_banded_distance_fuzz():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = edited(rng, a or "a", rng.randint(0, 5))
        for k in range(4):
            assert linededup.within(a, b, k) == (distance(a, b) <= k)


def test_near_lines_share_a_key():
    rng = random.Random(2)
    for _ in range(1500):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(20, 90))).strip().ljust(20, "e")
        t = linededup.threshold(len(a))
        b = edited(rng, a, rng.randint(1, t))
        x, y = sorted((a, b), key=len)
        if len(x) < linededup.SHORT or distance(x, y) > linededup.threshold(len(x)):
            continue
        assert set(linededup.keys_of(x)[0]) & set(sum(linededup.keys_of(y), []))


def brute_lines(rows):
    lines = {}
    for r in rows:
        for k, x in enumerate((r[1] or "").split("\n")):
            if x.strip():
                at = (r[0], k)
                lines[x.strip()] = min(lines.get(x.strip(), at), at)
    names = list(lines)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            s = min(len(a), len(b))
            t = linededup.threshold(s)
            if s >= linededup.SHORT and abs(len(a) - len(b)) <= t and find(a) != find(b) and distance(a, b) <= t:
                root[find(a)] = find(b)
    head = {}
    for x in names:
        head[find(x)] = min(head.get(find(x), lines[x]), lines[x])
    out = {}
    for r in rows:
        text = r[1] or ""
        kept = [x for k, x in enumerate(text.split("\n")) if not x.strip() or head[find(x.strip())] == (r[0], k)]
        out[r[0]] = "\n".join(kept)
    return out


def near_lines():
    rng = random.Random(3)
    rows = corpus(4, 25)[:25]
    for i in range(20):
        text = rows[i][1]
        first = text.split("\n")[0]
        rows.append((2000 + i, "\n".join([edited(rng, first, 1), edited(rng, first, 2), prose(rng, 12), "short", first + " "]), "en", "a", 9))
    return rows + [(3000, None, None, None, None), (3001, "", "en", "a", 0)]


def test_lines_match_brute_force(spark):
    rows = near_lines()
    got = {r["doc_id"]: r["kept_text"] for r in linededup.dedup_lines(table(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_lines_in_blocks(spark, monkeypatch):
    rows = near_lines()
    want = brute_lines(rows)
    monkeypatch.setattr(linededup, "BLOCK", 5)
    assert {r["doc_id"]: r["kept_text"] for r in linededup.dedup_lines(table(spark, rows)).collect()} == want


def test_lines_stage_keeps_columns(spark):
    rows = near_lines()
    out = linededup.without_repeats(table(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = brute_lines(rows)
    for r in out.collect():
        assert (r["text"] or "") == want[r["doc_id"]] and (r["text"] is None or r["n_chars"] in (len(r["text"]), 9))
    odd = odd_tables(spark)
    for df in odd.values():
        assert linededup.dedup_lines(df).count() == df.count() == linededup.without_repeats(df).count()
    assert linededup.without_repeats(odd["extra"]).columns == odd["extra"].columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 105), (7, 7)] + [(200, x) for x in range(201, 230)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 105: 100, **dict.fromkeys(range(200, 230), 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- classifier


def labelled(n=500):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        kind = i % 8
        text = prose(rng, rng.randint(30, 200))
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 1:
            text = " ".join(w for w in text.split()[:20] for _ in range(12))
        rows.append((i, text, "en" if i % 3 else "de", f"s{i % 5}", len(text)))
        if i % 2 or kind == 0:
            labels.append((i, int(kind > 1), 0))
    return rows, labels


def test_classifier_on_held_out_documents(spark):
    rows, labels = labelled()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in cotrain.classify(table(spark, rows), marks).collect()}
    known = {d for d, *_ in labels}
    held = [(r["keep"], d % 8 > 1) for d, r in got.items() if d not in known]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert np.mean([a for a, b in held if b]) > 0.97
    kept = cotrain.keep_good(table(spark, rows), marks)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, r in got.items() if r["keep"])
    again = {r["doc_id"]: r["score"] for r in cotrain.classify(table(spark, rows, 5), marks).collect()}
    assert again == {d: r["score"] for d, r in got.items()}


def test_classifier_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows, labels = labelled(200)
    some = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for df in odd_tables(spark).values():
        for marks in (none, some):
            assert cotrain.classify(df, marks).count() == df.count()
            assert cotrain.keep_good(df, marks).columns == df.columns
    assert all(r["keep"] for r in cotrain.classify(table(spark, rows), none).collect())
    assert cotrain.classify(table(spark, rows).select("doc_id", "text"), some).count() == 200


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    rows, labels = labelled(160)
    rows += [(5000 + i, rows[i + 2][1], "en", "s9", 1) for i in range(20)] + [(9000, None, None, None, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    want = sorted((r["doc_id"] or -1, r["ids_sha256"]) for r in last.collect())
    assert sorted((r["doc_id"] or -1, r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
