"""Quality by a linear-chain conditional random field over lines.

Every line gets features of itself and of its two neighbours (shares of character classes, lengths, repeated words, place
in the document). A linear-chain CRF with the labels bad and good scores a document's label sequences; forward-backward
gives each line's marginal, and the length-weighted mean of the marginals, calibrated by a logistic curve, is the
document's score.

Training takes its labels from documents: each line of a labelled document carries the document's label. It uses at most
sample_docs labelled rows (half of each label, those of the least hash of identifier and text; rows that repeat wholly
count once), of at most sample_lines lines together. These bounds do not depend on the corpus. A row is taken with all its
lines or left out: those of more than a hundredth of sample_lines are, and those that find no room.

Defined cases: a null or empty text, or one of white space alone, scores 0; equal texts score equally; without a training
row of each label every other text scores 1; a document with several labels counts with the least; rows that share an
identifier all carry its label; an empty table gives no rows; further columns pass only where the caller names them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import compute_columns
from .quality_rules import CLASSES, class_counts

OWN = len(CLASSES) + 6
FEATURES = 3 * OWN + 3


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that hold a word, the first line of each text among them, and the lines' characters."""
    raw, offsets = textvec.utf8(texts)
    start, end, doc = textvec.lines(raw, offsets)
    solid = np.r_[0, np.cumsum(~textvec.WS[raw], dtype=np.int64)]
    full = solid[end] > solid[start]
    cuts = np.r_[start, len(raw)]
    classes = class_counts(raw, cuts)[full].astype(np.float64)
    spans = textvec.words(raw, offsets)
    word = textvec.hashes(raw, spans.start, spans.end)
    line = np.searchsorted(cuts, spans.start, "right") - 1
    start, end, doc = start[full], end[full], doc[full]
    number = np.cumsum(full) - 1
    at = number[line]
    n = len(start)
    words = np.maximum(np.bincount(at, minlength=n), 1).astype(np.float64)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(at[flags], minlength=n) / words

    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (at[1:] == at[:-1])
    near = again.copy()
    for k in (2, 3):
        near[k:] |= (word[k:] == word[:-k]) & (at[k:] == at[:-k])
    last = raw[np.maximum(spans.end - 1, 0)]
    signed = ~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128) | ((last >= 48) & (last <= 57))) & ~np.isin(last, [44, 46])
    chars = classes.sum(1)
    own = np.column_stack([classes / np.maximum(chars, 1)[:, None], np.log1p(chars) / 8, np.log1p(words) / 6, (chars / words).clip(0, 40) / 20, share(again), share(near), share(signed)])
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = doc[1:] == doc[:-1] if n else np.zeros(0, bool)
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    head, tail = np.ones(n), np.ones(n)
    head[1:][same] = 0
    tail[:-1][same] = 0
    return np.column_stack([own, before, after, head, tail, np.ones(n)]), first, chars


def chain(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the label good, expected counts of label pairs (if asked for) and the sum of log partition values.

    emission is the log-score of good over bad, transition the 2x2 log-scores of neighbours. All documents advance
    together, line by line; documents are taken by falling length, so each step works on a prefix."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    score = np.zeros((len(emission), 2))
    score[:, 1] = emission
    alpha, beta = score.copy(), np.zeros_like(score)
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # documents with at least t + 1 lines
    for t in range(1, longest):
        at = start[: active[t]] + t
        a = alpha[at - 1]
        alpha[at] += np.logaddexp(a[:, :1] + transition[0], a[:, 1:] + transition[1])
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        b = beta[at + 1] + score[at + 1]
        beta[at] = np.logaddexp(transition[:, 0] + b[:, :1], transition[:, 1] + b[:, 1:])
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    counts = np.zeros((2, 2))
    filled = size > 0
    log_z = float(total[start[filled]].sum())
    if pairs and len(emission):
        inner = np.ones(len(emission), bool)
        inner[start[filled]] = False
        at = np.flatnonzero(inner)
        joint = alpha[at - 1][:, :, None] + transition + (score[at] + beta[at])[:, None, :]
        counts = np.exp(joint - total[at][:, None, None]).sum(0)
    return good, counts, log_z


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    calibration: tuple[float, float]


def fit(x: np.ndarray, first: np.ndarray, chars: np.ndarray, label: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> Model:
    """Maximum likelihood by Adam over a bounded sample; label is 0 or 1 for each document."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    z = (x - mean) / scale
    size = np.diff(first)
    y = np.repeat(label, size).astype(float)
    seen = np.zeros((2, 2))
    for v in (0, 1):
        seen[v, v] = np.maximum(size[label == v] - 1, 0).sum()
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        good, counts, _ = chain(z @ theta[:-4], first, theta[-4:].reshape(2, 2), pairs=True)
        gradient = np.r_[z.T @ (y - good), (seen - counts).ravel()] / max(len(y), 1) - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), (1.0, 0.0))
    logit = document_logits(x, first, chars, model)
    a, b = 1.0, 0.0
    for _ in range(500):  # logistic calibration on the same documents
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        a += 0.5 * ((label - p) * logit).mean() - 1e-4 * a
        b += 0.5 * (label - p).mean()
    model.calibration = (max(a, 1e-3), b)
    return model


def document_logits(x: np.ndarray, first: np.ndarray, chars: np.ndarray, model: Model) -> np.ndarray:
    """Log-odds of the length-weighted mean marginal of each document."""
    good, _, _ = chain(((x - model.mean) / model.scale) @ model.weights, first, model.transition)
    size = np.diff(first)
    mean = np.zeros(len(size))
    filled = size > 0
    if filled.any():
        mean[filled] = np.add.reduceat(good * chars, first[:-1][filled]) / np.add.reduceat(chars, first[:-1][filled])
    mean = mean.clip(1e-3, 1 - 1e-3)
    return np.log(mean / (1 - mean))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_docs: int, sample_lines: int) -> DataFrame:
    """id, label and text of the labelled rows that a model is trained on; at most sample_docs of them."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    sizes = rows.select("id", "h", F.size(F.split("text", "\n")).alias("lines")).where(F.col("lines") <= sample_lines // 100).dropDuplicates(["id", "h"])
    wanted, chosen = sizes.join(known, "id"), None
    for v in (0, 1):  # half of the sample for each label, so a rare one is not lost
        part = wanted.where(F.col("label") == v).orderBy("h", "id").limit(sample_docs // 2)
        room = F.sum("lines").over(Window.orderBy("h", "id"))  # over sample_docs / 2 rows
        part = part.withColumn("room", room).where(F.col("room") <= sample_lines // 2).select("id", "h", "label")
        chosen = part if chosen is None else chosen.unionByName(part)
    # The texts of the chosen keys; copies of a row go once more through the distinct.
    return rows.join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["id", "h"]).select("id", "label", "text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 3000, sample_lines: int = 100_000) -> Model | None:
    """A model of the labelled rows of docs; None where one of the labels is missing."""

    def features(texts: pa.Array) -> list:
        x, first, chars = line_features(texts)
        values = [(x[a:b], chars[a:b]) for a, b in zip(first, first[1:], strict=False)]
        return [pa.array([v[0].astype(np.float32).tobytes() for v in values], pa.binary()), pa.array([v[1].tobytes() for v in values], pa.binary())]

    fields = [T.StructField("x", T.BinaryType()), T.StructField("chars", T.BinaryType())]
    rows = sample(docs, labels, id_col, text_col, label_col, sample_docs, sample_lines)
    made = compute_columns(rows, "text", ["id", "label"], fields, features).toArrow().to_pylist()
    made = [r for r in sorted(made, key=lambda r: (r["id"], r["x"])) if r["x"]]
    if {r["label"] for r in made} != {0, 1}:
        return None
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES).astype(float) for r in made]
    first = np.r_[0, np.cumsum([len(v) for v in x])]
    return fit(np.concatenate(x), first, np.concatenate([np.frombuffer(r["chars"]) for r in made]), np.array([r["label"] for r in made]))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", carry: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns in carry (doc_id), the score (0 to 1, higher: good is likelier) and the prediction (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def scores(texts: pa.Array) -> list:
        model = shared.value
        x, first, chars = line_features(texts)
        filled = np.diff(first) > 0
        if model is None:
            p = filled.astype(float)
        else:
            a, b = model.calibration
            p = np.where(filled, 1 / (1 + np.exp(-np.clip(a * document_logits(x, first, chars, model) + b, -30, 30))), 0.0)
        return [p, (p >= 0.5).astype(np.int32)]

    fields = [T.StructField(names[0], T.DoubleType(), False), T.StructField(names[1], T.IntegerType(), False)]
    return compute_columns(docs, text_col, ["doc_id"] if carry is None else carry, fields, scores, limit=2 << 20)
