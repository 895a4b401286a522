"""Quality classification by co-training two views.

The content view sees hashed words and a few shape measures of the whole text; the
metadata view sees language, source and recorded length only. Both are logistic
models. In each round every view, calibrated on labelled rows that it was not fitted
on, labels the unlabelled documents that it is confident about, and the other view
takes these pseudo-labels into its next fit. In the end both calibrated log-odds are
combined by one more logistic model and score every document.

Only labelled rows are sampled: at most ``labelled`` of them (half of each kind, as far
as there are), chosen by hash of the id. They weigh as much as all labels of their kind
together do in fit, calibration and mixture, so a score means the same however many
labels there are.

All unlabelled documents take part in every round (``pool`` can limit them). Their
features are written once to the shared folder, and executors add up what a fit needs:
for the metadata view the confident documents of every combination of buckets, which is
exact, and for the content view the gradient of their loss with a bound of its
curvature. The driver fits the content view to its labelled rows and to the quadratic
upper bound of the pseudo-labelled loss that these make, PASSES times a round, so each
fit lowers the loss over all of them; the sums do not grow with the number of rows.
Scoring covers every row and its whole text in one map without a shuffle.

Null texts have no words, texts of any length are read whole, null metadata is a value of
its own. Columns but doc_id, text and the metadata are not read and, in
``retain_documents``, come along. Without labels of
both kinds there is no model: scores are null and every document stays. Repeated
rows and rows without an id are scored as often as they occur.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.llm.common import WORD, Scratch, bound_batches, give_back, keep_rows, map_texts, mark_ids

_WORD = re.compile(WORD)
LABELLED = 3000
BUCKET_BITS, SHAPES, META_BITS = 14, 10, 8
ROUNDS, CONFIDENT, MIN_SCORE = 3, 0.98, 0.5
#: Fits of the content view in a round, each with new sums over the unlabelled documents; weight of one of these beside a label.
PASSES, PSEUDO = 2, 0.5
#: Labelled rows kept from fitting, for calibration: one in so many.
HELD_OUT = 3
_SYMBOLS = "#*$%&|<>!"
META = ("lang", "source", "n_chars")

_buckets: dict[str, int] = {}


def _bucket(word: str) -> int:
    known = _buckets.get(word)
    if known is None:
        if len(_buckets) >= 150_000:
            _buckets.clear()
        known = _buckets[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BUCKET_BITS) - 1)
    return known


def forget() -> None:
    """Let go the remembered words."""
    _buckets.clear()


def content_features(text: str | None) -> tuple[list[float], list[int], list[float]]:
    """Shape measures in 0..1, and word buckets with weights of unit length."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * (SHAPES - 1) + [1.0], [], []
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    shapes = [
        len(counts) / n,
        pairs / max(1, n - 1),
        sum(c for w, c in counts.items() if w.isupper()) / n,
        min(1.0, sum(map(text.count, _SYMBOLS)) / n),
        min(1.0, len(text) / n / 20),
        min(1.0, math.log1p(n) / 10),
        max(counts.values()) / n,
        min(1.0, (text.count(".") + text.count(",")) / n * 4),
        sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1:] not in ".,") / n,
        0.0,
    ]
    total = math.sqrt(sum(c * c for c in counts.values()))
    return shapes, [_bucket(w) for w in counts], [c / total for c in counts.values()]


def metadata_features(lang, source, n_chars) -> list[int]:
    """Indicator buckets of the metadata."""
    size = -1 if n_chars is None or n_chars != n_chars or n_chars < 0 else int(math.log2(n_chars + 1) * 2)
    mask = (1 << META_BITS) - 1
    return [zlib.crc32(repr(x).encode()) & mask for x in (("lang", lang), ("source", source), ("size", size), ("lang size", lang, size))]


@dataclass
class Model:
    """Both views with their calibrations, and the weights that combine them."""

    content: np.ndarray
    metadata: np.ndarray
    calibration: tuple[tuple[float, float], tuple[float, float]]
    mixture: tuple[float, float, float]

    def score(self, shapes: list[float], buckets: list[int], weights: list[float], meta: list[int]) -> tuple[float, float, float]:
        w = self.content
        x = float(w[0]) + float(np.dot(w[1 : SHAPES + 1], shapes)) + (float(np.dot(w[SHAPES + 1 :][buckets], weights)) if buckets else 0.0)
        y = float(self.metadata[0]) + float(self.metadata[1:][meta].sum())
        (a, b), (c, d) = self.calibration
        x, y = a * x + b, c * y + d
        k, m, n = self.mixture
        return _probability(x), _probability(y), _probability(k + m * x + n * y)


def _probability(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


class _Rows:
    """A sparse matrix with a constant first column."""

    def __init__(self, rows: list[tuple[list[int], list[float]]], width: int):
        self.n, self.width = len(rows), width
        self.at = np.concatenate([np.zeros(0, int), *(np.array(i, int) for i, _ in rows)])
        self.value = np.concatenate([np.zeros(0), *(np.array(v, float) for _, v in rows)])
        self.row = np.repeat(np.arange(self.n), [len(i) for i, _ in rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        return w[0] + np.bincount(self.row, self.value * w[1:][self.at], self.n)

    def transposed(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([[g.sum()], np.bincount(self.at, self.value * g[self.row], self.width)])


@dataclass
class _Pull:
    """A quadratic upper bound, tangent at ``at``, of the loss of rows that were summed up elsewhere."""

    at: np.ndarray
    gradient: np.ndarray
    curvature: np.ndarray
    weight: float


def _logistic(x: _Rows, y: np.ndarray, weight: np.ndarray, rounds: int = 200, rate: float = 0.1, decay: float = 1e-4, pull: _Pull | None = None) -> np.ndarray:
    w, m, v = (np.zeros(x.width + 1) for _ in range(3))
    total = max(weight.sum() + (pull.weight if pull else 0.0), 1e-9)
    weight = weight / total
    if pull:
        w = pull.at.copy()
    for it in range(1, rounds + 1):
        g = x.transposed(weight * (y - 1 / (1 + np.exp(-np.clip(x.times(w), -35, 35))))) - decay * w
        if pull:
            g += (pull.gradient - pull.curvature * (w - pull.at)) / total
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return w


def _calibrate(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into log-odds; a slope below zero counts as no information."""
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    centre = np.average(score, weights=weight)
    width = math.sqrt(np.average((score - centre) ** 2, weights=weight)) + 1e-9
    rows = _Rows([([0], [float(s)]) for s in (score - centre) / width], 1)
    b, a = _logistic(rows, target, weight, 300, 0.1, 1e-3)
    prior = math.log(((weight * y).sum() + 1) / ((weight * (1 - y)).sum() + 1))
    return (float(a / width), float(b - a * centre / width)) if a > 0 else (0.0, prior)


def _weights(y: np.ndarray, counts: tuple[int, int]) -> np.ndarray:
    """Weights by which a sample stands for all labels of each kind."""
    return np.where(y > 0.5, counts[1] / max(1, (y > 0.5).sum()), counts[0] / max(1, (y <= 0.5).sum()))


#: What a view's calibrated log-odds are made of: weights and (slope, offset).
View = tuple[np.ndarray, tuple[float, float]]
Sums = tuple[_Pull, list[tuple[list[int], float, float]]]


def co_train(sample: list[tuple[int, list[float], list[int], list[float], list[int]]], counts: tuple[int, int], teach: Callable[[View, View, np.ndarray], Sums] | None, rounds: int = ROUNDS) -> Model | None:
    """Fit on labelled (label, shapes, buckets, weights, metadata) rows; None without both kinds of labels.

    ``counts``: bad and good labels of the whole table, which the rows stand for.
    ``teach`` sums up the unlabelled documents, as ``_teacher`` tells; None: there are none.
    """
    if len({r[0] for r in sample}) < 2:
        return None
    groups = [[r for k, r in enumerate(sample) if (k % HELD_OUT == 0) == held] for held in (False, True)]
    fit, held = groups if len({r[0] for r in groups[0]}) == len({r[0] for r in groups[1]}) == 2 else (sample, sample)

    def views(rows):
        content = _Rows([(list(range(SHAPES)) + [SHAPES + b for b in r[2]], [*r[1], *r[3]]) for r in rows], SHAPES + (1 << BUCKET_BITS))
        return content, _Rows([(r[4], [1.0] * len(r[4])) for r in rows], 1 << META_BITS)

    y, y_held = (np.array([r[0] for r in rows], float) for rows in (fit, held))
    weight, weight_held = _weights(y, counts), _weights(y_held, counts)
    both, both_held = views(fit), views(held)
    models = [_logistic(x, y, weight) for x in both]
    calibrated = lambda: [_calibrate(x.times(w), y_held, weight_held) for x, w in zip(both_held, models)]
    odds = calibrated()
    for _ in range(rounds if teach else 0):
        # the content view learns from the metadata view, and the other way round
        teachers, metadata = list(zip(models, odds)), None
        content = models[0]
        for _ in range(PASSES):
            pull, found = teach(*teachers, content)
            metadata = found if metadata is None else metadata
            content = _logistic(both[0], y, weight, pull=pull)
        kinds = [(m, label, PSEUDO * n) for m, bad, good in metadata for label, n in ((0.0, bad), (1.0, good)) if n]
        rows = _Rows([(r[4], [1.0] * len(r[4])) for r in fit] + [(m, [1.0] * len(m)) for m, _, _ in kinds], 1 << META_BITS)
        models = [content, _logistic(rows, np.concatenate([y, [k[1] for k in kinds]]), np.concatenate([weight, [k[2] for k in kinds]]))]
        odds = calibrated()
    logits = [a * x.times(w) + b for x, w, (a, b) in zip(both_held, models, odds)]
    mixed = _logistic(_Rows([([0, 1], [float(p), float(q)]) for p, q in zip(*(np.clip(z, -10, 10) for z in logits))], 2), y_held, weight_held, 300, 0.05, 1e-3)
    return Model(models[0].astype("float32"), models[1].astype("float32"), tuple(odds), tuple(map(float, mixed)))


KINDS = {"shapes": "f4", "buckets": "u2", "weights": "f4", "meta": "u1"}


def pack_features(docs: DataFrame) -> DataFrame:
    """The features of every row as bytes beside its doc_id: shapes, word buckets with their weights, and metadata."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.BinaryType()) for c in KINDS)])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [[np.array(x, k).tobytes() for x, k in zip(f, KINDS.values())] for f in _features(frame)]
            out = pd.DataFrame(rows, columns=list(KINDS))
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    return map_texts(_with_metadata(docs), each, schema)


class _Packed:
    """A batch of packed features as arrays."""

    def __init__(self, frame: pd.DataFrame):
        self.n = len(frame)
        read = lambda c: np.frombuffer(b"".join(frame[c]), KINDS[c])
        self.shapes = read("shapes").reshape(self.n, SHAPES).astype(float)
        self.buckets, self.weights = read("buckets").astype(int), read("weights").astype(float)
        self.meta = read("meta").reshape(self.n, -1).astype(int)
        self.row = np.repeat(np.arange(self.n), [len(b) // 2 for b in frame["buckets"]])

    def content(self, w: np.ndarray) -> np.ndarray:
        return w[0] + self.shapes @ w[1 : SHAPES + 1] + np.bincount(self.row, w[SHAPES + 1 :][self.buckets] * self.weights, self.n)

    def metadata(self, w: np.ndarray) -> np.ndarray:
        return w[0] + w[1:][self.meta].sum(1)


def _log_odds(z: np.ndarray, calibration: tuple[float, float]) -> np.ndarray:
    return np.clip(calibration[0] * z + calibration[1], -35, 35)


def _sums(frames: Iterator[pd.DataFrame], content: View, metadata: View, at: np.ndarray) -> Iterator[pd.DataFrame]:
    """One task's sums over its documents, as (kind, place, a, b) rows.

    Kind 0: gradient and curvature of a content weight; kind 1: bad and good documents of
    a combination of metadata buckets; kind 2: weight of the documents in kind 0.
    """
    width = SHAPES + (1 << BUCKET_BITS)
    gradient, curvature, weight = np.zeros(width + 1), np.zeros(width + 1), 0.0
    combinations: Counter = Counter()
    sure = math.log(CONFIDENT / (1 - CONFIDENT))
    for frame in frames:
        if not len(frame):
            continue
        held = _Packed(frame)
        shapes, buckets, weights, meta, row, n = held.shapes, held.buckets, held.weights, held.meta, held.row, held.n
        says = _log_odds(held.content(content[0]), content[1])
        for key, good in zip(meta[np.abs(says) >= sure] @ (1 << META_BITS * np.arange(meta.shape[1])), says[np.abs(says) >= sure] > 0):
            combinations[int(key), bool(good)] += 1
        told = _log_odds(held.metadata(metadata[0]), metadata[1])
        share = np.where(np.abs(told) >= sure, PSEUDO, 0.0)
        z = np.clip(held.content(at), -35, 35)
        missing = share * ((told > 0) - 1 / (1 + np.exp(-z)))
        half = np.maximum(np.abs(z) / 2, 1e-6)
        # of a row's curvature, its largest for any weights by the tangent bound, each weight takes its part of the row's sum
        bent = share * np.tanh(half) / (4 * half) * (1 + np.abs(shapes).sum(1) + np.bincount(row, weights, n))
        for out, each in ((gradient, missing), (curvature, bent)):
            out[0] += each.sum()
            out[1 : SHAPES + 1] += each @ shapes
            out[SHAPES + 1 :] += np.bincount(buckets, each[row] * weights, 1 << BUCKET_BITS)
        weight += share.sum()
    used = np.flatnonzero(curvature)
    yield pd.DataFrame({"kind": 0, "place": used, "a": gradient[used], "b": curvature[used]})
    keys = sorted({k for k, _ in combinations})
    yield pd.DataFrame({"kind": 1, "place": np.array(keys, "int64"), "a": [float(combinations[k, False]) for k in keys], "b": [float(combinations[k, True]) for k in keys]})
    yield pd.DataFrame({"kind": [2], "place": [0], "a": [weight], "b": [0.0]})
    give_back()


def _teacher(unlabelled: DataFrame) -> Callable[[View, View, np.ndarray], Sums]:
    """Sums over packed documents: what the metadata view tells a content view at given weights, and what the content view tells."""

    def teach(content: View, metadata: View, at: np.ndarray) -> Sums:
        sent = unlabelled.sparkSession.sparkContext.broadcast((content, metadata, at))
        made = bound_batches(unlabelled.select("shapes", "buckets", "weights", "meta")).mapInPandas(lambda frames: _sums(frames, *sent.value), "kind int, place long, a double, b double")
        rows = made.groupBy("kind", "place").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("kind", "place").collect()
        sent.unpersist()
        pull = _Pull(at, np.zeros(len(at)), np.zeros(len(at)), 0.0)
        combinations = []
        for r in rows:
            if r.kind == 0:
                pull.gradient[r.place], pull.curvature[r.place] = r.a, r.b
            elif r.kind == 1:
                combinations.append(([r.place >> META_BITS * k & (1 << META_BITS) - 1 for k in range(4)], r.a, r.b))
            else:
                pull.weight = r.a
        return pull, combinations

    return teach


def _with_metadata(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", *(F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in META))


def _row_features(text, lang, source, n_chars) -> tuple:
    return (*content_features(text), metadata_features(lang, source, None if n_chars is None else float(n_chars)))


def _features(frame: pd.DataFrame) -> Iterator[tuple]:
    for row in zip(frame["text"], frame["lang"], frame["source"], frame["n_chars"].astype(float)):
        yield _row_features(*row)


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int | None = None, packed: DataFrame | None = None) -> Model | None:
    """Co-train on the documents' features; ``packed`` are those of ``pack_features``, if they are already written."""
    ids = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    number = {r.label: r["count"] for r in ids.groupBy("label").count().collect()}
    if len(number) < 2:
        return None
    scratch = Scratch(spark, "quality")
    own = packed is None
    if own:
        packed = scratch.keep(pack_features(docs))
    order = [F.xxhash64(F.lit("co-training"), "doc_id"), F.col("doc_id")]
    kinds = [ids.filter(F.col("label") == q).orderBy(*order).limit(labelled // 2) for q in (0, 1)]
    chosen = spark.createDataFrame(kinds[0].unionByName(kinds[1]).collect(), "doc_id long, label int")
    # of rows that repeat an id, the one of the least features stands for it
    found = packed.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*KINDS)).alias("f")).select("doc_id", "label", "f.*").collect()
    read = lambda r, c: np.frombuffer(r[c], KINDS[c]).tolist()
    sample = [(r.label, *(read(r, c) for c in KINDS)) for r in sorted(found, key=lambda r: zlib.crc32(b"%d" % r.doc_id))]
    others = packed
    if pool is not None:
        least = packed.select("doc_id").filter("doc_id IS NOT NULL").join(ids, "doc_id", "left_anti").distinct().orderBy(*order).limit(pool)
        others = packed.join(least, "doc_id", "left_semi")
    # only rows that could be labelled meet the labels, so the features of the others stay where they are
    marked = mark_ids(scratch, others, "doc_id", ids.select("doc_id"), "maybe")
    doubtful = scratch.keep(marked.filter("maybe").join(ids, "doc_id", "left_anti").select(*KINDS))
    unlabelled = marked.filter("NOT maybe").select(*KINDS).unionByName(doubtful)
    model = co_train(sample, (number[0], number[1]), _teacher(unlabelled))
    scratch.drop(doubtful)
    if own:
        scratch.drop(packed)
    return model


COLUMNS = ["content_score", "metadata_score", "score", "kept"]


def score_documents(docs: DataFrame, model: Model | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The scores of both views and of their combination beside the doc_id of every row."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.DoubleType()) for c in COLUMNS[:3]), T.StructField("kept", T.BooleanType())])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = [(None, None, None)] * len(frame) if model is None else [model.score(*f) for f in _features(frame)]
            out = pd.DataFrame(scores, columns=COLUMNS[:3], dtype="float64")
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out.assign(kept=[s[2] is None or s[2] >= min_score for s in scores])

    return map_texts(_with_metadata(docs), each, schema)


def score_packed(packed: DataFrame, model: Model | None, min_score: float = MIN_SCORE) -> DataFrame:
    """What ``score_documents`` gives, from features that are already written."""
    schema = T.StructType([T.StructField("doc_id", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in COLUMNS[:3]), T.StructField("kept", T.BooleanType())])
    if model is None:
        return packed.select("doc_id", *(F.lit(None).cast("double").alias(c) for c in COLUMNS[:3]), F.lit(True).alias("kept"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            held = _Packed(frame)
            x, y = (a * z + b for z, (a, b) in zip((held.content(model.content.astype(float)), held.metadata(model.metadata.astype(float))), model.calibration))
            k, m, n = model.mixture
            scores = [1 / (1 + np.exp(-np.clip(z, -35, 35))) for z in (x, y, k + m * x + n * y)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], **dict(zip(COLUMNS, scores)), "kept": scores[2] >= min_score})
        give_back()

    texts = packed.select(F.col("doc_id").cast("string").alias("doc_id"), *KINDS)
    return bound_batches(texts).mapInPandas(each, schema).withColumn("doc_id", F.col("doc_id").cast(packed.schema["doc_id"].dataType))


def retain_documents(docs: DataFrame, model: Model | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows that are kept, with all their columns."""
    if model is None:
        return docs
    return keep_rows(docs, ["text", *META], lambda: lambda *row: model.score(*_row_features(*row))[2] >= min_score)
