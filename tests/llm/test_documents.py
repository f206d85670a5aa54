"""Contract queries against brute force on small tables, and their odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from larkspur.llm import lempelziv, media, mixing, pieces, simhash, suffixes, tokstore, topk  # noqa: E402

from .helpers import corpus, odd_tables, rows_of, table  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text, shingle=4):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    rows = corpus()
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components(fps, 4)
    want = sorted((r[0], format(f, "016x"), rows[c][0]) for r, f, c in zip(rows, fps, comp, strict=True))
    assert sorted(rows_of(simhash.near_duplicates(table(spark, rows)))) == want


def test_simhash_links_every_near_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)) for b in base for k in (1, 2, 3, 4, 5)]
    fps = list(dict.fromkeys([int(b) for b in base] + near))
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    got = simhash.links(df, len(fps), 2).collect()
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        root[find(r["a"] % 2**64)] = find(r["b"] % 2**64)
    mine = defaultdict(set)
    for f in fps:
        mine[find(f)].add(f)
    brute = defaultdict(set)
    for f, c in zip(fps, brute_components(fps, 4), strict=True):
        brute[c].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, brute.values()))


def test_simhash_ball_holds_every_flip_once():
    for groups in (6, 11, 20):
        ball = simhash.Ball(groups, 2)
        flips = np.concatenate(list(ball.flips.values()))
        assert len(flips) == len(set(flips.tolist())) == 1 + 64 + 64 * 63 // 2


def test_simhash_stage_keeps_one_of_each(spark):
    rows = corpus()
    groups = {r[0]: r[2] for r in rows_of(simhash.near_duplicates(table(spark, rows)))}
    kept = simhash.one_of_each(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))


def test_simhash_odd_tables(spark):
    odd = odd_tables(spark)
    assert simhash.near_duplicates(odd["empty"]).count() == 0
    assert simhash.near_duplicates(odd["repeated"]).count() == odd["repeated"].count()
    nulls = simhash.near_duplicates(odd["nulls"]).collect()
    assert len(nulls) == odd["nulls"].count() and all(r["fingerprint"] for r in nulls)
    ids = [r["doc_id"] for r in simhash.one_of_each(odd["repeated"]).collect()]
    assert len(ids) == len(set(ids))
    assert simhash.one_of_each(odd["extra"]).columns == odd["extra"].columns


# ---------------------------------------------------------------- duplicate spans


def brute_bytes(rows, window=100):
    docs = sorted(((float("inf") if r[0] is None else r[0], (r[1] or "").encode(), r[0]) for r in rows), key=lambda d: d[0])
    first, out = {}, []
    for key, b, doc_id in docs:
        for s in range(len(b) - window + 1):
            first.setdefault(b[s : s + window], (key, b, s))
    for key, b, doc_id in docs:
        cut = np.zeros(len(b), bool)
        mine = set()
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if first[w][0] < key or w in mine:
                cut[s : s + window] = True
            mine.add(w)
        kept = np.frombuffer(b, np.uint8)[~cut].tobytes()
        out.append((doc_id, len(b), int(cut.sum()), int((np.diff(np.r_[0, cut.astype(int)]) == 1).sum()), sha(kept)))
    return out


def brute_words(rows, window=50):
    docs = [(float("inf") if r[0] is None else r[0], WORD.findall(r[1] or ""), r[0]) for r in rows]
    first = {}
    for key, w, _ in docs:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, key), key)
    out = []
    for key, w, doc_id in docs:
        cut = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < key:
                cut[s : s + window] = [True] * window
        out.append((doc_id, len(w), sum(cut), sha(" ".join(x for x, c in zip(w, cut, strict=True) if not c))))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = rows_of(suffixes.remove_substrings(table(spark, rows)).drop("kept_text"))
    assert by_id(got) == by_id(brute_bytes(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = rows_of(lempelziv.remove_passages(table(spark, rows)).drop("kept_text"))
    assert by_id(got) == by_id(brute_words(rows))


def test_spans_with_hot_anchors(spark):
    """A passage in most documents: its anchors are dealt on by single windows."""
    rows = corpus(3, 30)
    passage = " ".join(f"w{i % 37}x{i % 11}" for i in range(80))
    rows += [(1000 + i, f"start {i} of it {i * i} {passage} and {i} ends {i * 7}", "en", "a", 1) for i in range(400)]
    assert by_id(rows_of(suffixes.remove_substrings(table(spark, rows)).drop("kept_text"))) == by_id(brute_bytes(rows))
    assert by_id(rows_of(lempelziv.remove_passages(table(spark, rows)).drop("kept_text"))) == by_id(brute_words(rows))


def test_spans_odd_tables(spark):
    odd = odd_tables(spark)
    for f in (suffixes.remove_substrings, lempelziv.remove_passages):
        assert f(odd["empty"]).count() == 0
        for name in ("repeated", "extra"):
            assert f(odd[name]).count() == odd[name].count()
    rows = [tuple(r) for r in odd["nulls"].collect() if r[0] is not None] + [(None, corpus(2, 12)[0][1], None, None, 0)]
    assert by_id(rows_of(suffixes.remove_substrings(table(spark, rows)).drop("kept_text"))) == by_id(brute_bytes(rows))
    assert by_id(rows_of(lempelziv.remove_passages(table(spark, rows)).drop("kept_text"))) == by_id(brute_words(rows))


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    compare = suffixes.Comparer(data, 30)
    pos = rng.permutation(300)
    segment = np.sort(rng.integers(0, 9, 300))
    order = suffixes.merge_sort(pos, segment, compare)
    want = sorted(range(300), key=lambda i: (segment[i], data[pos[i] : pos[i] + 30].tobytes()))
    assert order.tolist() == want


def test_words_hash_alike_across_pieces(monkeypatch):
    text = " ".join(["alpha", "be", "x" * 90, "delta"] * 40).encode()
    whole = lempelziv.word_values(text)
    monkeypatch.setattr(lempelziv, "PART", 64)
    assert (lempelziv.word_values(text) == whole).all() and len(whole) == 160


# ---------------------------------------------------------------- top k


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((230, 12)).astype(np.float32)
    x[100:120] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (450, [1.0] * 11 + [None]), (500, [1.0] * 11 + [float("nan")]), (550, [float("inf")] * 12), (None, [1.0] * 12), (600, [0.5] * 5), (650, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = rows_of(topk.top_k(df, df.where("vec_id % 50 = 0"), 5))
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 230, 50):
        score = v @ v[q]
        best = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


def test_top_k_bounds_hold():
    rng = np.random.default_rng(4)
    q, x = rng.integers(-300, 300, (6, 21)), rng.integers(-300, 300, (50, 21))
    for level in (1, 2, 8, 16, 64):
        bound = topk.statistics(q.astype(float), level) @ topk.statistics(x.astype(float), level).T
        assert (bound + 1e-6 >= q @ x.T).all()


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        t = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if t[s] > cap * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rows = corpus(1, 120)
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for d, s in source.items():
        sizes[s] += size[d]
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(table(spark, rows, 5)).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in again}


def test_mix_keeps_good_documents_more_often(spark):
    rows = [(i, ("good words here " if i % 2 else "#### $$$$ word ") * 20, "en", "s", 1) for i in range(800)]
    got = mixing.mix(table(spark, rows), share=0.3).collect()
    good, bad = (sum(r["taken"] for r in got if r["doc_id"] % 2 == k) for k in (1, 0))
    assert good > 1.5 * bad


def test_mix_rows(spark):
    rows = corpus(1, 80)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(table(spark, rows)).collect()}
    out = mixing.mixed(table(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert got == {d: t for d, t in want.items() if t}


def test_mix_odd_tables(spark):
    odd = odd_tables(spark)
    assert mixing.mix(odd["empty"]).count() == mixing.mixed(odd["empty"]).count() == 0
    for name in ("repeated", "nulls", "extra"):
        assert mixing.mix(odd[name]).count() == odd[name].count()
    assert mixing.mixed(odd["extra"]).columns == odd["extra"].columns


# ---------------------------------------------------------------- tokens


def test_pieces_match_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = corpus()
    got = {r["doc_id"]: r for r in pieces.encode_documents(table(spark, rows), PIECES, with_ids=True).collect()}
    for d, t, *_ in rows:
        ids = lib.encode(t or "")
        assert got[d]["ids"] == ids and got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == sha(",".join(map(str, ids))) and got[d]["decoded_sha256"] == sha(lib.decode(ids))


def test_pieces_fuzz():
    import random

    import sentencepiece

    lib, mine = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.PieceModel(PIECES)
    rng = random.Random(9)
    bits = ["a", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "日", "😀", "\x00", "<s>", "<0x0A>", "1", "000", "!!", ".com", "ß", "　"]
    for _ in range(1500):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        split = mine.split(t)
        mine.learn(set(split))
        ids, text = mine.encode_text(split)
        want = lib.encode(t)
        assert ids == ",".join(map(str, want)) and text == lib.decode(want) == mine.decode(want) and mine.encode(t) == want
    for t in ("ab" * 700, "the" * 400 + "\n" + "=" * 900):
        assert mine.encode(t) == lib.encode(t)


def test_pieces_odd_tables(spark):
    odd = odd_tables(spark)
    for name, df in odd.items():
        assert pieces.encode_documents(df, PIECES).count() == df.count(), name


def brute_store(rows, end=0):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    start, out = 0, []
    for d, t, *_ in sorted(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_round_trip(spark):
    rows = corpus() + [(9000, "an <|endoftext|> inside", "en", "a", 1)]
    store = tokstore.write_store(table(spark, rows), BYTES)
    assert sorted(rows_of(tokstore.read_digests(store))) == brute_store(rows)
    digests = [r["digest"] for r in store.chunks.collect()]
    assert len(digests) == len(set(digests))
    assert tokstore.verify(store).count() == 0
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    for r in tokstore.read_ids(store, spark.createDataFrame([(0,), (9,), (9000,)], "doc_id long")).collect():
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        assert r["ids"] == lib.encode(text, add_special_tokens=False).ids + [0]


def test_store_notices_damage(spark):
    from pyspark.sql import functions as F

    store = tokstore.write_store(table(spark, corpus(1, 10)), BYTES)
    bent = tokstore.Store(store.chunks.withColumn("data", F.concat("data", F.lit(b"\x00\x01"))), store.recipes, store.manifest, store.width)
    with pytest.raises(Exception, match="does not match its name"):
        tokstore.read_digests(bent).collect()
    bent = tokstore.Store(store.chunks, store.recipes.withColumn("n_tokens", F.col("n_tokens") + 1), store.manifest, store.width)
    with pytest.raises(ValueError, match="manifest"):
        tokstore.read_digests(bent)


def test_store_odd_tables(spark):
    odd = odd_tables(spark)
    for name, df in odd.items():
        got = tokstore.read_digests(tokstore.write_store(df, BYTES)).collect()
        assert len(got) == df.count(), name
        order = sorted(got, key=lambda r: r["start"])
        assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(order, order[1:], strict=False))
        ids = [r["doc_id"] for r in order if r["doc_id"] is not None]
        assert ids == sorted(ids) and all(r["doc_id"] is None for r in order[len(ids) :])


def test_chunks_depend_on_content_alone():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50_000, 20_000).astype("<u2")
    cuts = tokstore.cut_points(a)
    assert cuts[-1] == len(a) and all(tokstore.LEAST <= y - x <= tokstore.MOST for x, y in zip(cuts, cuts[1:], strict=False))
    moved = np.r_[rng.integers(0, 50_000, 777).astype("<u2"), a]
    there = {m - 777 for m in tokstore.cut_points(moved)}
    assert len(set(cuts) & there) > 0.8 * len(cuts)
    assert max(np.diff([0, *tokstore.cut_points(np.zeros(9000, "<u2"))])) <= tokstore.MOST


# ---------------------------------------------------------------- media


def test_media_round_trip(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in media.store_and_read(table(spark, rows)).collect()}
    for d, t, *_ in rows:
        b = (t or "").encode()
        payload = b.ljust(max(1, -(-len(b) // 576)) * 576, b"\xff")
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), sha(stored)) and len(r["feature"]) == 16


def test_media_codecs():
    rng = np.random.default_rng(0)
    gray, rgb = rng.integers(0, 256, (7, 5), dtype=np.uint8), rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    for x in (gray, rgb):
        assert (media.decode(media.encode_bmp(x)) == x).all()
    assert (media.decode(media.encode_pgm(gray)) == gray).all() and (media.decode(media.encode_ppm(rgb)) == rgb).all()
    assert media.decode(b"P1 # note\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2\n2 1\n3\n0 3\n").tolist() == [[0, 255]]
    assert media.decode(b"P4\n3 1\n\xa0").shape == (1, 3)
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_is_the_mean_of_areas():
    x = np.arange(48, dtype=float).reshape(6, 8)
    assert np.allclose(media.area_resize(x, 3, 4), x.reshape(3, 2, 4, 2).mean((1, 3)))
    assert np.allclose(media.area_resize(x, 5, 7).mean(), x.mean())
    assert np.allclose(media.area_resize(np.full((5, 3), 7.0), 9, 8), 7)


def test_media_odd_tables(spark):
    for df in odd_tables(spark).values():
        assert media.store_and_read(df).count() == df.count()
