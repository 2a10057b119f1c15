"""Quality classifier: a linear-chain conditional random field over a text's lines.

Every line is good or bad. A line's features are its own measures (letter cases, marks, repeated words, length) and
those of the line before and after it; transitions tie neighbouring labels. Documents are labelled, lines are not: the field
is fitted first to lines that carry their document's label (without transitions), then again, ``ROUNDS`` times, to the line labels that it
finds itself when a line's document pulls it towards its own label by ``PULL``. So a bad document may hold good lines, and
transitions see labels that differ. Forward-backward gives each line's marginal of being good. A document's raw quality
is the length-weighted mean of its lines' marginals; a logistic curve fitted on the training documents turns it into the score.

Training reads a bounded sample: of the labelled documents that may be learned from, the ``sample`` ones of each label with
the smallest hash, in this order while their texts add up to at most ``sample_bytes`` (a longer text alone is skipped), each with all its lines. Their measures
(not their texts) come to the driver, where the field is fitted; scoring runs over all documents, whole texts, without a shuffle.

Defined results: null and empty texts are one empty line and get its score; without two labels to learn from every
score is 0.5; null labels are not learned from, an id with several labels counts with the smallest, one with several texts with that
of the smallest hash; repeated rows repeat; an empty table gives no rows. Labels, ids and all columns but the text play no
part in a score; further columns never clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_name, map_columns

#: Labelled documents of each label that training may use.
SAMPLE = 1500
#: Bytes of text of each label that training may use.
SAMPLE_BYTES = 32 << 20
#: Fits to line labels of its own, and how far a document's label pulls a line (in log odds).
ROUNDS, PULL = 3, 1.0
THRESHOLD = 0.3
#: Lines whose features are held at once.
BLOCK_LINES = 1 << 14
FOLDS = 5

_UPPER, _LOWER, _DIGIT = (bytes(range(a, b + 1)) for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0x30, 0x39)))
_MARKS = b"#$%&*|!<>{}[]~^_=+\\@"
_STOPS = b".,;:?'\"-()/"
MEASURES = 14


def measures(line: str, times: int) -> list[float]:
    """Numbers from 0 to 1 about one line that occurs ``times`` times in its text."""
    raw = line.encode()
    size = len(raw)
    if not size:
        return [1.0] + [0.0] * (MEASURES - 1)
    words = raw.split()
    n = max(1, len(words))

    def share(of: bytes) -> float:
        return (size - len(raw.translate(None, of))) / size

    marks = share(_MARKS)
    return [
        0.0,
        share(_UPPER),
        share(_LOWER),
        share(_DIGIT),
        min(1.0, 4 * marks),
        1.0 if marks > 0.02 else 0.0,
        min(1.0, 4 * share(_STOPS)),
        sum(map(eq, words, words[1:])) / n,
        1.0 - len(set(words)) / n,
        min(1.0, size / n / 16),
        sum(len(w) <= 3 for w in words) / n,
        min(1.0, n / 64),
        1.0 if raw[-1:] in (b".", b"?", b"!", b":") else 0.0,
        1.0 if times > 1 else 0.0,
    ]


def text_measures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x measures, lines' lengths in characters)."""
    lines = (text or "").split("\n")
    times = Counter(lines)
    parts = [np.array([measures(x, times[x]) for x in lines[at : at + BLOCK_LINES]], np.float32) for at in range(0, len(lines), BLOCK_LINES)]
    return np.concatenate(parts), np.fromiter(map(len, lines), np.float64, len(lines))


def shares(lines: list[int], most: int) -> Iterator[slice]:
    """Neighbouring texts of at most ``most`` lines together, or one longer text."""
    at, total = 0, 0
    for i, n in enumerate(lines):
        if i > at and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if lines:
        yield slice(at, len(lines))


def with_neighbours(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Own, previous and next measures and a constant; at a text's ends the neighbour is zero."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts], after[starts + lengths - 1] = 0, 0
    return np.concatenate([x, before, after, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)


@dataclass
class Field:
    """weights: features x 2 labels; moves: label x next label. slope and offset turn a raw quality into a score."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 0.0
    offset: float = 0.0

    def marginals(self, features: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pull: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each line's label probabilities, and the expected moves summed over the texts (label x next label). pull: added to lines' log odds.

        All texts advance together, longest first, so that a step is one array operation over those still running.
        """
        local = features @ self.weights
        if pull is not None:
            local[:, 1] += pull
        ahead, back = self.messages(local, starts, lengths)
        both = ahead + back
        total = np.logaddexp(both[:, :1], both[:, 1:])
        inner = np.ones(len(local), bool)
        inner[starts] = False
        now = np.nonzero(inner)[0]
        pairs = np.exp(ahead[now - 1][:, :, None] + self.moves[None] + (local[now] + back[now])[:, None, :] - total[now][:, :, None])
        return np.exp(both - total), pairs.sum(axis=0)

    def messages(self, local: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums over all labels of the lines before (with the line's own part) and after each line."""
        order = np.argsort(-lengths, kind="stable")
        sizes, begin = lengths[order], starts[order]
        longest = int(sizes[0]) if len(sizes) else 0
        ahead, back = local.copy(), np.zeros_like(local)
        for t in range(1, longest):
            now = begin[: np.searchsorted(-sizes, -t, side="left")] + t
            ahead[now] += np.logaddexp(ahead[now - 1, :1] + self.moves[0], ahead[now - 1, 1:] + self.moves[1])
        for t in range(longest - 1, 0, -1):
            now = begin[: np.searchsorted(-sizes, -t, side="left")] + t
            out = local[now] + back[now]
            back[now - 1] = np.logaddexp(self.moves[:, 0] + out[:, :1], self.moves[:, 1] + out[:, 1:])
        return ahead, back

    def local(self, x: np.ndarray) -> np.ndarray:
        """Each line's log weights of one text; neighbours' measures are held for a block of lines only."""
        out = np.empty((len(x), 2))
        for at in range(0, len(x), BLOCK_LINES):
            low, to = max(0, at - 1), min(len(x), at + BLOCK_LINES + 1)
            features = with_neighbours(x[low:to], np.array([0]), np.array([to - low]))
            out[at : at + BLOCK_LINES] = features[at - low : at - low + BLOCK_LINES] @ self.weights
        return out

    def quality(self, lines: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean marginal of good lines, by text."""
        lengths = np.array([len(x) for x, _ in lines])
        starts = np.cumsum(lengths) - lengths
        local = np.concatenate([self.local(x) for x, _ in lines])
        both = np.add(*self.messages(local, starts, lengths))
        good = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
        weight = np.concatenate([w for _, w in lines]) + 1e-3
        return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * quality + self.offset, -30, 30)))


def fit(lines: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, class_weight: np.ndarray, steps: int = 120, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """Gradient ascent (Adam) on the labels' likelihood, then the logistic curve on the documents' raw qualities."""
    lengths = np.array([len(x) for x, _ in lines])
    starts = np.cumsum(lengths) - lengths
    features = with_neighbours(np.concatenate([x for x, _ in lines]), starts, lengths)
    truth = np.repeat(labels, lengths)
    target, seen_moves = np.eye(2)[truth], np.zeros((2, 2))
    field = Field(np.zeros((features.shape[1], 2)), np.zeros((2, 2)))
    for turn in range(ROUNDS + 1):
        if turn:
            target, seen_moves = field.marginals(features, starts, lengths, PULL * (2.0 * truth - 1))
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (field.weights, field.moves)]
        for step in range(1, (steps if turn == 0 else steps // 3) + 1):
            probability, moves = field.marginals(features, starts, lengths)
            slopes = (features.T @ (target - probability) / len(truth) - decay * field.weights, (seen_moves - moves) / len(truth) - decay * field.moves)
            learned = (field.weights, field.moves) if turn else (field.weights,)  # lines of a document's label never differ: no moves to learn from
            for p, g, (m, v) in zip(learned, slopes, state, strict=False):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    quality, weight = field.quality(lines), class_weight[labels]
    weight = weight / weight.sum()
    slope, offset = 0.0, 0.0
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * quality + offset, -30, 30)))
        curve, gap = weight * p * (1 - p), weight * (labels - p)
        hess = np.array([[(curve * quality * quality).sum() + 1e-5, (curve * quality).sum()], [(curve * quality).sum(), curve.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(gap * quality).sum() - 1e-5 * slope, gap.sum()])
        slope, offset = slope + np.clip(step[0], -5, 5), offset + np.clip(step[1], -5, 5)
    field.slope, field.offset = max(0.0, float(slope)), float(offset)
    return field


def held_out(id_col: str):
    """Rows that are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Field:
    """Fit on at most ``sample`` documents and ``sample_bytes`` of each label; held-out rows are not used."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null").groupBy("id").agg(F.min("label").alias("label")).where(~held_out("id"))
    numbers = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    blank = Field(np.zeros((3 * MEASURES + 1, 2)), np.zeros((2, 2)))
    if len(numbers) < 2:
        return blank
    chosen = known.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(sample).union(known.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(sample))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")  # at most 2 * sample ids
    one = texts.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))  # at most ``sample`` rows
    fitting = one.where(F.octet_length("text") <= sample_bytes)  # a text beyond the bound is left out alone
    used = fitting.withColumn("upto", upto).where(F.col("upto") <= sample_bytes).drop("upto")

    def start():
        def measure(rows):
            found = [text_measures(text) for text in rows]
            return [[x.ravel() for x, _ in found], [size for _, size in found]]

        return measure

    rows = map_columns(used, ["text"], [("x", "array<float>", pa.list_(pa.float32())), ("size", "array<double>", pa.list_(pa.float64()))], start, drop=("text",)).orderBy("id").toArrow()
    y = np.array(rows["label"].to_pylist(), int)
    if len(set(y.tolist())) < 2:
        return blank
    lines = [(x.values.to_numpy().reshape(-1, MEASURES), size.values.to_numpy()) for x, size in zip(rows["x"], rows["size"], strict=True)]
    seen = np.bincount(y, minlength=2)
    return fit(lines, y, np.array([numbers[k] / seen[k] for k in (0, 1)]))


def score_quality(docs: DataFrame, field: Field, text_col: str = "text", keep_text: bool = True) -> tuple[DataFrame, str]:
    """The rows with their score; also returns the new column's name. No shuffle."""
    name = fresh_name(docs, "score")

    def start():
        def work(texts):
            out = []
            for some in shares([(t or "").count("\n") + 1 for t in texts], BLOCK_LINES):
                out.append(field.score(field.quality([text_measures(t) for t in texts[some]])))
            return [np.concatenate(out) if out else []]

        return work

    return map_columns(docs, [text_col], [(name, "double", pa.float64())], start, drop=() if keep_text else (text_col,)), name


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **columns) -> DataFrame:
    """The documents whose score is at least the threshold, with the columns they came with."""
    scored, name = score_quality(docs, train(docs, labels, **columns), columns.get("text_col", "text"))
    return scored.where(F.col(name) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_line_crf_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored, name = score_quality(docs.select("doc_id", "text"), train(docs, labels), keep_text=False)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))
