"""Quality classifier by co-training two views of a document.

The text view sees the whole text: counts of its words and pairs of neighbouring words, hashed to NGRAMS
columns, and statistics (letters, symbols, repetition, lines, compressibility). The metadata view sees
language, source and declared length. Each is a logistic regression. In every round each view scores all
unlabelled documents, and of those it is sure of (SURE or more) a draw of at most GIVEN of each class goes,
with the view's labels, to the other view's training set. Both are then calibrated on labels held out from
them, and a last regression over the two calibrated log-odds gives the score. ``accuracy`` is measured on
labels held out from all of these.

Models are fitted on the driver, from at most LABELLED labelled documents and the draws, both chosen by
hash of doc_id (about 0.6 kB a document). Statistics and scores cover every document: one pass over the
texts writes the features, the rounds read these.

Defined cases: null text, language, source or length count as empty or 0; labels with a null doc_id or
quality are ignored, several labels of one doc_id are averaged (half counts as good); labels of one class
alone, or none, leave every document with score 1; with less than five labels of a class all models are
fitted on all labels; of different texts under one doc_id the one with the least features is trained on;
rows with a null doc_id are scored and not trained on; columns of ``docs`` other than doc_id, text, lang,
source and n_chars are ignored, and missing ones of the last three count as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.anchors import U, mix
from larkspur.llm.common import drop, materialize, texts, tune
from larkspur.llm.lempelziv import word_values

LABELLED = 20_000  #: labelled documents that models are fitted on, at most
ROUNDS, SURE, GIVEN = 3, 0.95, 1000  #: rounds, least probability, and most pseudo-labels of a class given each round
NGRAMS = 256  #: columns of hashed words and word pairs
CUT = 0.5
RIDGE = 20.0  #: ridge of the n-gram columns, 20 times that of the others
SYMBOLS = b"#$%&*@^~=+<>|\\/_{}[]"
PART = 1 << 20

_is_symbol, _is_digit, _is_upper, _is_blank = (np.zeros(256, bool) for _ in range(4))
_is_symbol[list(SYMBOLS)] = True
_is_digit[48:58] = True
_is_upper[65:91] = True
_is_blank[[32, *range(9, 14)]] = True


def text_features(text: bytes) -> np.ndarray:
    """Statistics of a whole text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    size = max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(text[at : at + PART])) for at in range(0, len(text), PART)) + len(packer.flush())
    shouting = counts[_is_upper].sum()
    return np.array(
        [
            np.log1p(len(words)),
            np.log1p(size / n),
            distinct / n,
            np.log1p(distinct) / np.log1p(n) if words else 0,
            repeats / n,
            shouting / size,
            counts[33] / size,
            counts[124] / n,
            counts[_is_symbol].sum() / size,
            np.log1p(100 * counts[_is_symbol].sum() / size),
            np.log1p(100 * shouting / size),
            np.log1p(100 * counts[33] / size),
            counts[_is_digit].sum() / size,
            counts[_is_blank].sum() / size,
            counts[128:].sum() / size,
            (counts[46] + counts[44]) / n,
            np.log1p(len(lines)),
            1 - len(set(lines)) / max(1, len(lines)),
            min(1.0, packed / size),
        ],
        np.float64,
    )


def ngram_features(text: bytes) -> np.ndarray:
    """Roots of the shares of hashed words and pairs of neighbouring words, in lower case."""
    h = word_values(text.lower())
    if not len(h):
        return np.zeros(NGRAMS)
    both = np.r_[h, mix(h[:-1] * U(31) + h[1:])] % U(NGRAMS)
    return np.sqrt(np.bincount(both.astype(np.int64), minlength=NGRAMS) / len(both))


LANGS, SOURCES = 16, 64


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(LANGS + SOURCES + 2)
    out[zlib.crc32((lang or "").encode()) % LANGS] = 1
    out[LANGS + zlib.crc32((source or "").encode()) % SOURCES] = 1
    size = np.log1p(max(0, n_chars or 0))
    out[-2:] = size, size * size
    return out


@dataclass
class Logistic:
    """Regularised logistic regression by Newton steps on standardised columns."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float | np.ndarray = 1.0) -> Logistic:
        weight = np.ones(len(y)) if weight is None else weight
        self.mean = x.mean(0, dtype=np.float64)
        self.scale = np.maximum(x.std(0, dtype=np.float64), 1e-9)
        self.scale[self.scale <= 1e-9] = 1.0
        w = np.zeros(x.shape[1] + 1)
        penalty = np.r_[1e-6, np.broadcast_to(ridge, x.shape[1])]
        for _ in range(25):
            curve, slope = np.diag(penalty), -penalty * w
            for at in range(0, len(x), 4096):
                part, k = x[at : at + 4096], slice(at, at + 4096)
                z = np.c_[np.ones(len(part)), (part - self.mean) / self.scale]
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                curve = curve + (z * (weight[k] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z
                slope = slope + z.T @ (weight[k] * (y[k] - p))
            step = np.linalg.solve(curve, slope)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:], -30, 30)

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


@dataclass
class CoTrained:
    """The two views, their calibrations and what combines them."""

    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic
    accuracy: float = 0.0

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = self.text_scale.logit(self.text.logit(xt)[:, None])
        m = self.meta_scale.logit(self.meta.logit(xm)[:, None])
        return 1 / (1 + np.exp(-t)), 1 / (1 + np.exp(-m)), self.both.proba(np.c_[t, m])


#: a view's draw: for (view, round) the features (text, meta) and labels of documents that the view is sure of
Draw = Callable[[dict[str, Logistic], int], dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, draw: Draw, rounds: int = ROUNDS) -> CoTrained | None:
    """Fit on labelled rows (xt, xm, y), which come in hash order, and on what ``draw`` finds; None with one class alone."""
    if not 0 < y.sum() < len(y):
        return None
    rank = np.zeros(len(y), np.int64)
    for v in (0, 1):  # every class is dealt to the folds in turn
        rank[y == v] = np.arange(int((y == v).sum()))
    fold = rank % 5
    fit, held, test = fold < 3, fold == 3, fold == 4
    if min(y.sum(), (1 - y).sum()) < 5:
        fit = held = test = np.ones(len(y), bool)
    sets = {"text": [xt[fit]], "meta": [xm[fit]]}
    labels = {v: [y[fit]] for v in sets}
    ridges = {"text": np.r_[np.full(NGRAMS, RIDGE), np.ones(xt.shape[1] - NGRAMS)], "meta": 1.0}

    def train() -> dict[str, Logistic]:
        out = {}
        for v, x in sets.items():
            weight = np.r_[np.ones(len(labels[v][0])), np.full(sum(map(len, labels[v][1:])), 0.5)]
            out[v] = Logistic().fit(np.concatenate(x), np.concatenate(labels[v]), weight, ridges[v])
        return out

    models = train()
    for r in range(rounds):
        sure = draw(models, r)
        for v, other in (("text", "meta"), ("meta", "text")):
            ut, um, label = sure[v]
            sets[other].append(ut if other == "text" else um)
            labels[other].append(label)
        models = train()
    t, m = models["text"], models["meta"]
    ts = Logistic().fit(t.logit(xt[held])[:, None], y[held])
    ms = Logistic().fit(m.logit(xm[held])[:, None], y[held])
    both = Logistic().fit(np.c_[ts.logit(t.logit(xt[held])[:, None]), ms.logit(m.logit(xm[held])[:, None])], y[held])
    out = CoTrained(t, m, ts, ms, both)
    out.accuracy = float(((out.scores(xt[test], xm[test])[2] >= CUT) == (y[test] == 1)).mean())
    return out


# ---------------------------------------------------------------- Spark


def _columns(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *((F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


META = LANGS + SOURCES + 2
TEXT = NGRAMS + 19


def _features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch, in the precision that the feature table keeps."""
    xt = np.array([np.r_[ngram_features(t), text_features(t)] for t in texts(b)], np.float16).reshape(b.num_rows, TEXT)
    meta = zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("n_chars").to_pylist(), strict=True)
    return xt, np.array([meta_features(*m) for m in meta], np.float16).reshape(b.num_rows, META)


def _views(t: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    xt, xm = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<f2") for c in ("xt", "xm"))
    return xt.reshape(t.num_rows, TEXT).astype(np.float32), xm.reshape(t.num_rows, META).astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """Written table doc_id, xt, xm of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xt, xm = _features(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (xt, xm))], ["doc_id", "xt", "xm"])

    return materialize(_columns(docs).mapInArrow(run, "doc_id long, xt binary, xm binary"), "features")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, given: int = GIVEN, table: DataFrame | None = None) -> CoTrained | None:
    """Fit on at most ``labelled`` labelled documents and ``given`` confident ones a class, view and round, by hash of doc_id."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    made = features(docs) if table is None else table

    def fetch(ids: DataFrame) -> pa.Table:
        """Features of the documents of a bounded table of ids, one row each, in hash order."""
        got = made.join(F.broadcast(ids), "doc_id").toArrow().to_pandas()
        got["h"] = (got["doc_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
        got = got.sort_values(["h", "doc_id", "xt", "xm"], kind="stable").drop_duplicates("doc_id")
        return pa.Table.from_pandas(got, preserve_index=False)

    def draw(models: dict[str, Logistic], r: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                xt, xm = _views(b)
                for view, x in (("text", xt), ("meta", xm)):
                    p = models[view].proba(x)
                    at = np.flatnonzero((p >= SURE) | (p <= 1 - SURE))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array([view] * len(at), pa.string()), pa.array((p[at] >= 0.5).astype(np.int32))], ["doc_id", "view", "label"])

        sure = made.where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, view string, label int")
        sure = materialize(sure.join(marks, "doc_id", "left_anti"), "sure")
        order = [F.xxhash64("doc_id", F.lit(r)), F.col("doc_id")]
        parts = [sure.where((F.col("view") == v) & (F.col("label") == k)).dropDuplicates(["doc_id"]).orderBy(*order).limit(given) for v in ("text", "meta") for k in (0, 1)]
        # 4 * given rows at most
        ids = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).toArrow().to_pandas()
        drop(sure)
        spark = docs.sparkSession
        got = fetch(spark.createDataFrame([(int(d),) for d in sorted(set(ids["doc_id"]))], "doc_id long"))
        at = {d: k for k, d in enumerate(got.column("doc_id").to_pylist())}
        xt, xm = _views(got)
        out = {}
        for view in ("text", "meta"):
            mine = ids[ids["view"] == view].sort_values(["label", "doc_id"])
            rows = np.array([at[d] for d in mine["doc_id"]], np.int64)
            out[view] = xt[rows], xm[rows], mine["label"].to_numpy().astype(float)
        return out

    some = marks.join(made.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(labelled)
    known = fetch(materialize(some, "labelled"))
    model = None
    if known.num_rows:
        model = co_train(*_views(known), known.column("good").to_numpy().astype(float), draw)
    if table is None:
        drop(made)
    return model


def classify(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep for every row of ``docs``."""
    tune(docs.sparkSession)
    made = features(docs)
    model = train(docs, labels, **bounds, table=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, m, s = model.scores(*_views(b)) if model else (np.ones(b.num_rows),) * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.round(x, 6)) for x in (t, m, s)), pa.array(s >= CUT)], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return made.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the classifier keeps."""
    tune(docs.sparkSession)
    model = train(docs, labels, **bounds)
    names = docs.columns
    place = {c: names.index(c) if c in names else None for c in ("doc_id", "text", "lang", "source", "n_chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [pa.nulls(b.num_rows) if i is None else b.column(i) for i in place.values()]
            if model is not None:
                xt, xm = _features(pa.RecordBatch.from_arrays(cols, list(place)))
                b = b.filter(pa.array(model.scores(xt.astype(np.float32), xm.astype(np.float32))[2] >= CUT))
            yield b

    return docs.mapInArrow(run, docs.schema)
