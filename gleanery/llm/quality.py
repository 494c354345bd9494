"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is good or bad. Its features are character shares and shapes of the line and of
its two neighbours; the chain links the labels of consecutive lines. Forward-backward
gives every line's probability of being good, and their mean, weighted by line length,
is the document's. A logistic curve fitted on the training documents maps that mean to
the score.

The model is trained on a bounded sample of labelled documents, whose lines take the
label of their document. Only texts enter a score.

Defined cases: a null or empty text is one empty line and gets the score of such a line;
a null doc_id is not held out; repeated rows get equal scores; labels without a
document, and documents without a label, do not train; if labels of one kind are
missing, every score is that kind's share; an empty table gives an empty result. Only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.wordhash import batches, text_buffers, word_hashes, word_spans

#: Labelled documents that train the model, and the longest text among them.
TRAIN_DOCUMENTS = 3_000
TRAIN_BYTES = 50_000
#: Bytes of training text whose features the driver computes at once.
SLICE = 1 << 19
STEPS = 200
RATE = 0.08
RIDGE = 1e-3

#: Groups of ASCII characters whose shares describe a line.
GROUPS = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "space": " \t\r\x0b\x0c",
    "stop": ".,;:'\"-()",
    "shout": "!?",
    "bar": "|/\\_",
    "mark": "#$%&*+=<>@^~[]{}`",
}


def _classes() -> np.ndarray:
    """Group number of every byte; the last group holds bytes beyond ASCII."""
    found = np.full(256, len(GROUPS), np.uint8)
    found[:128] = GROUPS_OTHER
    for number, characters in enumerate(GROUPS.values()):
        found[[ord(c) for c in characters]] = number
    return found


GROUPS_OTHER = len(GROUPS) + 1
_CLASS = _classes()
_N_GROUPS = len(GROUPS) + 2


def line_features(values: np.ndarray, offsets: np.ndarray):
    """Features of all lines, their lengths, and the number of lines before each text."""
    breaks = np.flatnonzero(values == 10)
    # A text starts a line, and so does what follows a break inside it.
    starts = np.concatenate([offsets[:-1], breaks + 1])
    texts = np.concatenate(
        [np.arange(len(offsets) - 1), np.searchsorted(offsets[1:], breaks, side="right")]
    )
    order = np.lexsort((starts, texts))
    starts, texts = starts[order], texts[order]
    n = len(starts)
    last = np.ones(n, bool)
    last[:-1] = texts[1:] != texts[:-1]
    ends = np.empty(n, np.int64)
    ends[:-1] = starts[1:] - 1
    ends[last] = offsets[1:][texts[last]]
    lengths = np.maximum(ends - starts, 0)
    groups = _CLASS[values]
    counts = np.zeros((n, _N_GROUPS))
    for g in range(_N_GROUPS):
        sums = np.zeros(len(values) + 1, np.int32)
        np.cumsum(groups == g, out=sums[1:])
        counts[:, g] = sums[np.maximum(ends, starts)] - sums[starts]
    spaces = counts[:, list(GROUPS).index("space")]
    size = np.maximum(lengths, 1)[:, None]
    shares = counts / size
    letters = counts[:, 0] + counts[:, 1] + counts[:, len(GROUPS)]
    first_words, last_words, _ = word_spans(values, offsets)
    words = word_hashes(values, first_words, last_words)
    line_of = np.searchsorted(starts, first_words, side="right") - 1
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
    n_words = np.bincount(line_of, minlength=n)
    repeats = np.bincount(line_of[again], minlength=n) / np.maximum(n_words, 1)
    own = np.column_stack(
        [
            shares,
            np.sqrt(shares[:, 3:]),
            counts[:, 1] / np.maximum(letters, 1),
            np.log1p(lengths) / 5,
            lengths == 0,
            repeats,
            np.sqrt(repeats),
            np.log1p(lengths / (n_words + 1)) / 3,
            (counts[:, 5] + counts[:, 6] + counts[:, 7]) / (spaces + 1),
        ]
    ).astype(np.float64)
    at = np.searchsorted(texts, np.arange(len(offsets)))
    first = np.zeros(n, bool)
    first[at[:-1]] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[last] = 0
    features = np.column_stack([own, before, after, first, last, np.ones(n)])
    return features, lengths, at


def _chains(at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lines grouped into steps: the t-th lines of all texts that have one."""
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    live = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), "right")
    for t, n in enumerate(live):
        texts = order[:n]
        yield texts, at[texts] + t


def _logsum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=-1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=-1, keepdims=True)))[..., 0]


def marginals(
    scores: np.ndarray, links: np.ndarray, at: np.ndarray, weight: np.ndarray | None = None
):
    """Forward-backward: P(label) per line, and the expected label pairs if ``weight`` (a
    number per line) is given.

    ``scores`` has a number per line and label, ``links`` one per pair of labels.
    """
    steps = list(_chains(at))
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    for t, (_, lines) in enumerate(steps):
        forward[lines] = scores[lines]
        if t:
            forward[lines] += _logsum(
                (forward[lines - 1][:, :, None] + links[None]).transpose(0, 2, 1)
            )
    for t in range(len(steps) - 1, 0, -1):
        lines = steps[t][1]
        ahead = scores[lines] + backward[lines]
        backward[lines - 1] = _logsum(links[None] + ahead[:, None, :])
    total = forward + backward
    whole = _logsum(total)
    chances = np.exp(total - whole[:, None])
    pairs = np.zeros((2, 2))
    for _, lines in steps[1:] if weight is not None else []:
        ahead = scores[lines] + backward[lines]
        joint = forward[lines - 1][:, :, None] + links[None] + ahead[:, None, :]
        chance = np.exp(joint - whole[lines][:, None, None])
        pairs += (chance * weight[lines][:, None, None]).sum(axis=0)
    return chances, pairs


def _document_means(
    scores: np.ndarray, links: np.ndarray, lengths: np.ndarray, at: np.ndarray
) -> np.ndarray:
    """Mean of P(good) over the lines of every document, weighted by length."""
    chances, _ = marginals(scores, links, at)
    weights = lengths + 1.0
    sums = np.add.reduceat(chances[:, 1] * weights, at[:-1])
    return sums / np.add.reduceat(weights, at[:-1])


@dataclass
class QualityModel:
    """Weights per feature and label, per pair of labels, and the final curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    links: np.ndarray
    slope: float
    shift: float

    def document_means(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        features, lengths, at = line_features(values, offsets)
        scores = ((features - self.mean) / self.scale) @ self.weights
        return _document_means(scores, self.links, lengths, at)

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.empty(0)
        return self.curve(self.document_means(*text_buffers(column)))

    def curve(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(means) + self.shift, -30, 30)))


def _logit(means: np.ndarray) -> np.ndarray:
    means = np.clip(means, 1e-6, 1 - 1e-6)
    return np.log(means / (1 - means))


def _all_lines(texts: list[str]):
    """``line_features`` of all texts, whose working arrays hold one slice at a time."""
    table = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    parts = [line_features(*text_buffers(b.column("text"))) for b in batches(table, "text", SLICE)]
    features, lengths = (np.concatenate([part[i] for part in parts]) for i in (0, 1))
    lines = np.concatenate([np.diff(part[2]) for part in parts])
    return features, lengths, np.concatenate([[0], np.cumsum(lines)])


def fit(texts: list[str], labels: list[int]) -> QualityModel:
    """Gradient ascent (Adam) on the likelihood of the labelled chains."""
    features, lengths, at = _all_lines(texts)
    goal = np.asarray(labels)
    lines_of = np.diff(at)
    label = np.repeat(goal, lines_of)
    # In place: the matrix of all lines is the largest thing the driver holds.
    mean = features.mean(axis=0)
    features -= mean
    scale = np.sqrt(np.einsum("ij,ij->j", features, features) / len(features))
    constant = scale < 1e-9
    features[:, constant] += mean[constant]
    mean[constant], scale[constant] = 0, 1
    features /= scale
    x = features
    # Each document counts alike, however many lines it has, and so does each label.
    share = np.where(goal == 1, 0.5 / max(goal.mean(), 1e-9), 0.5 / max(1 - goal.mean(), 1e-9))
    weight = np.repeat(share / lines_of, lines_of) / len(goal)
    truth = np.column_stack([1 - label, label]).astype(float)
    weights, links = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, links)]
    inner = np.ones(len(label), bool)
    inner[at[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner], label[inner]), weight[inner])
    for step in range(1, STEPS + 1):
        chances, pairs = marginals(x @ weights, links, at, weight)
        slopes = (
            x.T @ ((truth - chances) * weight[:, None]) - RIDGE * weights,
            seen - pairs - RIDGE * links,
        )
        for parameter, slope, (m, v) in zip((weights, links), slopes, moments, strict=True):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            down = (1 - 0.9**step, 1 - 0.999**step)
            parameter += RATE * (m / down[0]) / (np.sqrt(v / down[1]) + 1e-8)
    model = QualityModel(mean, scale, weights, links, 1.0, 0.0)
    _fit_curve(model, _document_means(x @ weights, links, lengths, at), goal)
    return model


def _fit_curve(model: QualityModel, means: np.ndarray, goal: np.ndarray) -> None:
    x = np.column_stack([_logit(means), np.ones(len(goal))])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (goal - p) - 1e-2 * at
        bend = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        at = at + np.clip(np.linalg.solve(bend, slope), -1, 1)
    model.slope, model.shift = map(float, at)


@dataclass
class ConstantModel:
    share: float

    def scores(self, column: pa.Array) -> np.ndarray:
        return np.full(len(column), self.share)


def train(
    documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS
) -> QualityModel | ConstantModel:
    """Fit on at most ``most`` labelled documents, those of the smallest hashes."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    sample = (
        usable.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    short = documents.where(F.octet_length("text") <= TRAIN_BYTES).select("doc_id", "text")
    rows = short.join(F.broadcast(sample), "doc_id").collect()
    labels_of = [row.quality for row in rows]
    if len(set(labels_of)) < 2:
        return ConstantModel(float(np.mean(labels_of)) if rows else 0.5)
    rows.sort(key=lambda row: (row.doc_id, row.text))
    return fit([row.text for row in rows], [row.quality for row in rows])


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the doc_id as text leaves 1 when divided by 3."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 3
    return F.coalesce(rest == 1, F.lit(False))


def score_documents(
    documents: DataFrame, model: QualityModel | ConstantModel, keep: list[str], name: str = "score"
) -> DataFrame:
    """The columns ``keep`` and the score of ``text``."""
    wanted = documents.select(list(dict.fromkeys([*keep, "text"])))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(keep).schema]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in batches(part, "text", 2 << 20):
                scores = pa.array(model.scores(batch.column("text")), pa.float64())
                columns = [batch.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, scores], [*keep, name])

    return wanted.mapInArrow(run, ", ".join([*fields, f"`{name}` double"]))


def op5_quality_crf(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and verdict of every document; held-out rows did not train."""
    learn = labels.where(~held_out(F.col("doc_id")))
    model = train(documents, learn)
    return score_documents(documents, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
