"""Quality rules by line sequence labelling.

A linear-chain conditional random field labels every line of a document that holds a
word as content or boilerplate. Viterbi decoding gives the best label sequence, and
the share of the document's words in content lines decides whether it stays. A few
plain counts of the text reject documents beforehand.

The field is trained here, on a bounded sample of labelled documents (parameters
``sample``, by hash of the id, and ``segments``, by hash of id and place: runs of at
most SEGMENT lines, into which long documents are cut). Labels come by document, lines
get theirs by self-training: first every line has its document's label and a field
without transitions learns what lines of each kind look like; its decisions, such as
proper sentences above a page of junk, or a menu in a good text, are the labels for a
field with transitions, which decides once more for the last one. A document whose
lines would all get the other label keeps its own. Everything else runs over every row
and whole texts in one map without a shuffle.

Null texts have no words and fail the base rules. Without a labelled document of each
kind there is no field, and the base rules decide alone. Repeated rows and rows without
an id are judged as often as they occur. Of ``docs`` only doc_id and text are read;
other columns, whatever their names, stay out of the verdicts and, in
``retain_documents``, come along. A text may have any length: it is measured whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.llm.common import WORD, bound_batches, keep_rows, map_texts

_WORD = re.compile(WORD)
_SYMBOLS = "#*$%&|<>"
BOILERPLATE, CONTENT = 0, 1
#: Base rules: fewest words, and the largest per cent of words inside repeated five-word windows.
MIN_WORDS, MAX_REPEATED = 10, 20
#: Least share of words in content lines for a document to stay.
MIN_CONTENT_SHARE = 0.5
#: Labelled documents to train on, runs of their lines, and lines of a run, at most.
SAMPLE, SEGMENTS, SEGMENT = 1500, 6000, 64
#: Times that lines get new labels.
RELABEL = 2
WINDOW = 5

#: Upper ends of the bins that turn each measure of a line into indicator features.
_BINS = {
    "words": (1, 3, 8, 15, 40, 100),
    "capitals": (0.02, 0.3, 0.7),
    "symbols": (0.0, 0.1, 0.5),
    "shouts": (0.02, 0.2, 0.6),
    "distinct": (0.15, 0.35, 0.6, 0.85),
    "length": (2.5, 4.0, 7.0, 10.0),
}
_OFFSETS, N_FEATURES = {}, 3
for _name, _ends in _BINS.items():
    _OFFSETS[_name] = N_FEATURES
    N_FEATURES += len(_ends) + 1


def _bin(name: str, value: float) -> int:
    for k, end in enumerate(_BINS[name]):
        if value <= end:
            return _OFFSETS[name] + k
    return _OFFSETS[name] + len(_BINS[name])


def line_features(line: str, words: list[str], seen: bool) -> list[int]:
    """Indices of a line's features that hold; 0 always does."""
    n = len(words)
    found = [
        0,
        _bin("words", n),
        _bin("capitals", sum(map(str.isupper, words)) / n),
        _bin("symbols", sum(map(line.count, _SYMBOLS)) / n),
        _bin("shouts", line.count("!") / n),
        _bin("distinct", len(set(words)) / n),
        _bin("length", sum(map(len, words)) / n),
    ]
    if seen:
        found.append(1)
    if line.rstrip()[-1:] in ".!?:;":
        found.append(2)
    return found


def measure(text: str) -> tuple[tuple[int, int, int, int, int], list[list[int]], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), features and word counts of the lines with a word."""
    features, sizes, seen, everything, repeated_lines = [], [], set(), [], 0
    for line in text.split("\n"):
        words = _WORD.findall(line)
        if not words:
            continue
        again = line in seen
        seen.add(line)
        repeated_lines += again
        features.append(line_features(line, words, again))
        sizes.append(len(words))
        everything += words
    n = len(everything)
    counts = (n, sum(map(len, everything)), sum(map(text.count, _SYMBOLS)), repeated_lines, repeated_words(everything))
    return counts, features, sizes


def repeated_words(words: list[str]) -> int:
    """Words inside five-word windows that occur twice or more, first ones included."""
    last = len(words) - WINDOW + 1
    if last < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == last:
        return 0
    times = Counter(windows)
    covered, upto = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + WINDOW - max(at, upto)
            upto = at + WINDOW
    return covered


class LineField:
    """A linear-chain conditional random field with two labels."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move  # (features, 2), (from, to)

    def viterbi(self, features: list[list[int]]) -> list[int]:
        e, ((m00, m01), (m10, m11)) = self._scores, self.move.tolist()
        a = b = 0.0
        back = []
        for k, f in enumerate(features):
            s0 = s1 = 0.0
            for i in f:
                x0, x1 = e[i]
                s0 += x0
                s1 += x1
            if k == 0:
                a, b = s0, s1
                continue
            from0 = a + m00 < b + m10
            from1 = a + m01 < b + m11
            back.append((from0, from1))
            a, b = s0 + (b + m10 if from0 else a + m00), s1 + (b + m11 if from1 else a + m01)
        label = int(b >= a)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]

    @property
    def _scores(self) -> list[tuple[float, float]]:
        if not hasattr(self, "_list"):
            self._list = [tuple(map(float, x)) for x in self.emit]
        return self._list

    @classmethod
    def train(cls, features: list[list[list[int]]], labels: list[list[int]], weights: np.ndarray, chained: bool = True, rounds: int = 150, rate: float = 0.15, decay: float = 1e-3) -> LineField:
        """Maximise the weighted conditional log-likelihood of the label sequences by Adam steps.

        Without ``chained`` there are no transitions, and every line is on its own.
        """
        size = np.array(list(map(len, features)))
        n, steps = len(size), int(size.max())
        row = np.repeat(np.arange(n), size)
        at = np.concatenate([np.arange(k) for k in size])
        x = np.zeros((len(row), N_FEATURES), "float32")
        for line, found in enumerate(f for run in features for f in run):
            x[line, found] = 1
        said = np.eye(2)[np.concatenate([np.asarray(y, int) for y in labels])]
        live = np.arange(steps)[None, :] < size[:, None]
        wide = np.zeros((n, steps, 2))
        wide[row, at] = said
        changes = np.einsum("d,dta,dtb->ab", weights, wide[:, :-1], wide[:, 1:])
        theta = np.zeros(2 * N_FEATURES + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for it in range(1, rounds + 1):
            emit, move = theta[:-4].reshape(N_FEATURES, 2), theta[-4:].reshape(2, 2)
            score = np.zeros((n, steps, 2))
            score[row, at] = x @ emit.astype("float32")
            up, down = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
            up[:, 0] = score[:, 0]
            for t in range(1, steps):
                up[:, t] = np.where(live[:, t, None], score[:, t] + np.logaddexp(up[:, t - 1, 0, None] + move[0], up[:, t - 1, 1, None] + move[1]), up[:, t - 1])
            for t in range(steps - 2, -1, -1):
                ahead = down[:, t + 1] + score[:, t + 1]
                down[:, t] = np.where(live[:, t + 1, None], np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:]), 0)
            total = np.logaddexp(up[:, -1, 0], up[:, -1, 1])
            miss = (said - np.exp(up[row, at] + down[row, at] - total[row, None])) * weights[row, None]
            g_move = np.zeros((2, 2))
            if chained:
                pair = np.exp(up[:, :-1, :, None] + move + (score[:, 1:] + down[:, 1:])[:, :, None, :] - total[:, None, None, None])
                g_move = changes - np.einsum("dt,dtab->ab", weights[:, None] * live[:, 1:], pair)
            g = np.concatenate([(x.T @ miss.astype("float32")).ravel(), g_move.ravel()]) - decay * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta += rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
        return cls(theta[:-4].reshape(N_FEATURES, 2), theta[-4:].reshape(2, 2))


def self_train(runs: list[tuple[int, int, list[list[int]]]], relabel: int = RELABEL) -> LineField | None:
    """A field from (document, label, features) of runs of lines; None without both labels.

    Both kinds of documents weigh the same in total, and a document the same as any
    other of its kind, however many lines it has.
    """
    if len({label for _, label, _ in runs}) < 2:
        return None
    documents = {doc: label for doc, label, _ in runs}
    lines = Counter()
    for doc, _, run in runs:
        lines[doc] += len(run)
    kinds = Counter(documents.values())
    weights = np.array([0.5 / kinds[documents[doc]] / lines[doc] for doc, _, _ in runs])
    features = [run for _, _, run in runs]
    labels = [[label] * len(run) for _, label, run in runs]
    field = LineField.train(features, labels, weights, chained=False)
    for _ in range(relabel):
        found = [field.viterbi(run) for run in features]
        own = {doc for (doc, label, _), said in zip(runs, found) if label in said}
        labels = [said if doc in own else [label] * len(said) for (doc, label, _), said in zip(runs, found)]
        field = LineField.train(features, labels, weights)
    return field


def fit_line_field(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, segments: int = SEGMENTS) -> LineField | None:
    """Train on at most ``segments`` runs of lines of ``sample`` labelled documents; None without both kinds of labels."""
    ids = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # as many of each kind, as far as there are
    kinds = [ids.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for q in (0, 1)]
    chosen = spark.createDataFrame(kinds[0].unionByName(kinds[1]).collect(), "doc_id long, quality int")

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, q, k, f[k : k + SEGMENT]) for d, q, t in zip(frame["doc_id"].tolist(), frame["quality"].tolist(), frame["text"]) for f in [measure(t)[1]] for k in range(0, len(f), SEGMENT)]
            yield pd.DataFrame({"doc_id": [r[0] for r in rows], "quality": [r[1] for r in rows], "line": [r[2] for r in rows], "lines": [r[3] for r in rows]}).astype({"doc_id": "int64", "quality": "int32", "line": "int64"})

    runs = (
        bound_batches(docs).select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
        .mapInPandas(features, "doc_id long, quality int, line long, lines array<array<int>>")
        .orderBy(F.xxhash64("doc_id", "line"), "doc_id", "line").limit(segments).collect()
    )
    return self_train(sorted((r.doc_id, CONTENT if r.quality else BOILERPLATE, r.lines) for r in runs))


def judge(text: str | None, field: LineField | None, min_share: float = MIN_CONTENT_SHARE) -> tuple[int, int, int, int, int, bool, float, bool]:
    counts, features, sizes = measure(text or "")
    n_words, repeated = counts[0], counts[4]
    failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEATED * n_words
    share = 1.0 if n_words else 0.0
    if field is not None and features:
        labels = field.viterbi(features)
        share = sum(n for n, label in zip(sizes, labels) if label == CONTENT) / n_words
    return (*counts, failed, share, not failed and share >= min_share)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]


def judge_documents(docs: DataFrame, field: LineField | None, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The counts and the verdict beside the doc_id of every row."""
    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, k) for c, k in zip(COLUMNS, kinds))])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([judge(t, field, min_share) for t in frame["text"]], columns=COLUMNS)
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    return map_texts(docs.select("doc_id", "text"), each, schema)


def retain_documents(docs: DataFrame, field: LineField | None, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The rows that are kept, with all their columns."""
    return keep_rows(docs, ["text"], lambda: lambda text: judge(text, field, min_share)[-1])
