"""Toxic spans by a linear-chain conditional random field over the words of a text.

Documents are labelled as a whole, tokens are not: a token counts as toxic if it stands in a toxic document and
its word, or the beginning of its word, is met after many different words in toxic documents and hardly ever in clean ones
(copies of a document repeat the same neighbours, so they add nothing). The field learns emission weights of words and their
beginnings, and four transition weights, from these tokens by maximum likelihood. Forward and backward passes give each token's
marginal; their sum and maximum give the document's score, and tokens above one half the offending spans.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, quoted, slices, table, unpacked, whole_row

#: at most so many labelled documents of each class are learnt from, and so many characters in all, a third of them toxic
SAMPLE_TOXIC = 1000
SAMPLE_CLEAN = 2000
SAMPLE_CHARACTERS = 4_000_000
#: longer texts are learnt from only if their class has no others
LONG_TEXT = 100_000
#: a document with this score or more is toxic
THRESHOLD = 0.3
#: features are hashed to so many weights
WEIGHTS = 1 << 18
#: different words before a feature, for each toxic document learnt from, that make it suspicious; and at least
CONTEXTS_PER_DOCUMENT = 0.013
LEAST_CONTEXTS = 4
#: and how many times as common it must be in toxic documents as in clean ones
LEAST_RATIO = 20.0
EPOCHS = 12
MEMORY_WORDS = 400_000
SLICE_BYTES = 4 << 20

WORDS = re.compile(r"[^\W_]+")


def features(word: str) -> list[str]:
    """What a token shows of itself: the word and its beginnings of three to five letters."""
    word = word.lower()
    return ["=" + word, *(f"{k}{word[:k]}" for k in (3, 4, 5) if len(word) >= k)]


def slot(feature: str) -> int:
    value = 0
    for byte in feature.encode():
        value = (value * 0x01000193 ^ byte) & 0xFFFFFFFF
    return (value ^ value >> 15) % WEIGHTS


def laid_out(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of tokens when all first tokens come first, then all second ones, the longest documents leading.

    Gives the place of each token, and for each step its first place and its number of documents.
    """
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    longest = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(1, longest + 1), side="left")
    offset = np.concatenate([[0], np.cumsum(active)])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    step = np.arange(starts[-1]) - np.repeat(starts[:-1], lengths)
    return offset[step] + np.repeat(rank, lengths), offset, active


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    scale: np.ndarray

    def passes(self, odds: np.ndarray, offset: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward probabilities of label 1, over tokens as :func:`laid_out` places them."""
        t00, t01, t10, t11 = np.exp(self.transitions.ravel())
        forward, backward = np.empty(len(odds)), np.full(len(odds), 0.5)
        for t in range(len(active)):
            here = slice(offset[t], offset[t + 1])
            if t:
                q = forward[offset[t - 1] : offset[t - 1] + active[t]]
                one = (q * (t11 - t01) + t01) * odds[here]
                forward[here] = one / (one + q * (t10 - t00) + t00)
            else:
                forward[here] = odds[here] / (odds[here] + 1.0)
        for t in range(len(active) - 2, -1, -1):
            count = active[t + 1]
            after = slice(offset[t + 1], offset[t + 1] + count)
            r = backward[after]
            one = odds[after] * r
            zero = 1.0 - r
            b1, b0 = t11 * one + t10 * zero, t01 * one + t00 * zero
            backward[offset[t] : offset[t] + count] = b1 / (b1 + b0)
        return forward, backward

    def marginals(self, odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        place, offset, active = laid_out(lengths)
        ordered = np.empty(len(odds))
        ordered[place] = odds
        forward, backward = self.passes(ordered, offset, active)
        one = forward * backward
        return (one / (one + (1.0 - forward) * (1.0 - backward)))[place]

    def score(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Probability that a document is toxic, from its expected and its surest toxic tokens."""
        z = self.scale[0] + self.scale[1] * np.log1p(total) + self.scale[2] * most
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def suspicious_slots(slots: np.ndarray, words: np.ndarray, lengths: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which features mark a token of a toxic document as toxic: a flag for each weight.

    A feature's contexts are the different words before it, in the documents of one class.
    """
    before = np.concatenate([[-1], words[:-1]]).astype(np.int64)
    first = np.zeros(len(words), dtype=bool)
    starts = np.cumsum(lengths) - lengths
    first[starts[lengths > 0]] = True
    before[first] = -1
    in_toxic = np.repeat(toxic, lengths)
    contexts = np.zeros((2, WEIGHTS + 1))
    for label in (0, 1):
        here = in_toxic == bool(label)
        pairs = np.unique(words[here].astype(np.int64) << 32 | (before[here] + 1))
        for column in slots.T:
            keys = np.unique(column[pairs >> 32] << 32 | (pairs & 0xFFFFFFFF))
            contexts[label] += np.bincount(keys >> 32, minlength=WEIGHTS + 1)
    totals = max(1, np.count_nonzero(~in_toxic)), max(1, np.count_nonzero(in_toxic))
    least = max(LEAST_CONTEXTS, CONTEXTS_PER_DOCUMENT * np.count_nonzero(toxic))
    often = contexts[1] / totals[1] >= LEAST_RATIO * (contexts[0] + 0.5) / totals[0]
    found = (contexts[1] >= least) & often
    found[WEIGHTS] = False
    return found


def trained(texts: list[str], toxic: np.ndarray) -> Field | None:
    """A field for labelled documents; none if a class is missing or nothing tells them apart."""
    toxic = np.asarray(toxic, dtype=bool)
    if not toxic.any() or toxic.all():
        return None
    numbers: dict[str, int] = {}
    numbered = [np.array([numbers.setdefault(w, len(numbers)) for w in WORDS.findall(t)], dtype=np.int32) for t in texts]
    lengths = np.array([len(d) for d in numbered], dtype=np.int64)
    words = np.concatenate(numbered)
    slots = np.full((len(numbers), 4), WEIGHTS, dtype=np.int64)  # the last weight stays zero
    for word, i in numbers.items():
        own = features(word)
        slots[i, : len(own)] = [slot(f) for f in own]
    suspicious = suspicious_slots(slots, words, lengths, toxic)
    if not suspicious.any():
        return None
    label = suspicious[slots].any(axis=1)[words] & np.repeat(toxic, lengths)

    place, offset, active = laid_out(lengths)
    ordered, target = np.empty(len(words), dtype=np.int32), np.empty(len(words), dtype=bool)
    ordered[place], target[place] = words, label
    steps = range(len(active) - 1)
    nothing = [np.zeros(0, dtype=np.int64)]
    here = np.concatenate(nothing + [np.arange(offset[t], offset[t] + active[t + 1]) for t in steps])
    after = np.concatenate(nothing + [np.arange(offset[t + 1], offset[t + 2]) for t in steps])
    seen = np.bincount(2 * target[here].astype(np.int64) + target[after], minlength=4).reshape(2, 2)
    field = Field(np.zeros(WEIGHTS + 1), -4.0, np.zeros((2, 2)), np.zeros(3))
    squares, square_bias, square_steps = np.full(WEIGHTS + 1, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    size = max(1.0, float(target.sum()))
    for _ in range(EPOCHS):
        odds = np.exp(np.clip(field.weights[slots].sum(axis=1) + field.bias, -30, 30))[ordered]
        forward, backward = field.passes(odds, offset, active)
        one = forward * backward
        error = target - one / (one + (1 - forward) * (1 - backward))
        per_word = np.bincount(ordered, weights=error, minlength=len(numbers))
        gradient = sum(np.bincount(column, weights=per_word, minlength=WEIGHTS + 1) for column in slots.T)
        gradient = gradient / size - 1e-5 * field.weights
        gradient[WEIGHTS] = 0.0
        # expected transitions: the four products, over their sum
        q, one = forward[here], odds[after] * backward[after]
        zero, t = 1 - backward[after], np.exp(field.transitions)
        joint = [(1 - q) * t[0, 0] * zero, (1 - q) * t[0, 1] * one, q * t[1, 0] * zero, q * t[1, 1] * one]
        total = joint[0] + joint[1] + joint[2] + joint[3]
        step_gradient = (seen - np.array([(j / total).sum() for j in joint]).reshape(2, 2)) / size
        bias_gradient = error.sum() / size
        squares += gradient**2
        square_bias += bias_gradient**2
        square_steps += step_gradient**2
        field.weights += 1.5 * gradient / np.sqrt(squares)
        field.bias += 0.3 * bias_gradient / np.sqrt(square_bias)
        field.transitions += 0.1 * step_gradient / np.sqrt(square_steps)
    odds = np.exp(np.clip(field.weights[slots].sum(axis=1) + field.bias, -30, 30))
    total, most = summed(field.marginals(odds[words], lengths), lengths)
    field.scale = logistic(np.column_stack([np.ones(len(total)), np.log1p(total), most]), toxic.astype(float))
    return field


def summed(marginal: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and maximum of the marginals of each document."""
    total, most = np.zeros(len(lengths)), np.zeros(len(lengths))
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        total[full] = np.add.reduceat(marginal, starts)
        most[full] = np.maximum.reduceat(marginal, starts)
    return total, most


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a lightly regularised logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


def held_out(key: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, toxic: int | None = None, clean: int | None = None, characters: int | None = None
) -> pd.DataFrame:
    """``text, toxic`` of a bounded sample: those of smallest hash, as many of each class as its bounds allow.

    At most ``toxic`` and ``clean`` documents and ``characters`` in all (``SAMPLE_TOXIC``, ``SAMPLE_CLEAN``, ``SAMPLE_CHARACTERS``).
    A class has bounds of its own, and a text that does not fit leaves its place to the next. Of a repeated key the shortest text counts.
    A class whose texts are all longer than its bound teaches nothing, and a warning says so.
    """
    characters = SAMPLE_CHARACTERS if characters is None else characters
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null").withColumn("length", F.length("text"))
    known = known.join(texts.groupBy("doc_id").agg(F.min("length").alias("length")), "doc_id")
    most = {1: SAMPLE_TOXIC if toxic is None else toxic, 0: SAMPLE_CLEAN if clean is None else clean}
    bounds = {1: (most[1], characters // 3), 0: (most[0], characters - characters // 3)}
    first = [
        known.where(F.col("toxic") == label).orderBy(F.col("length") > LONG_TEXT, "order", "doc_id").limit(most)
        for label, (most, _) in bounds.items()
    ]
    listed = first[0].union(first[1]).collect()  # at most the two bounds' rows, without texts
    chosen = []
    for label, (_, left) in bounds.items():
        own = sorted((r for r in listed if r.toxic == label), key=lambda r: r.order)
        fitting = [r for r in own if r.length <= LONG_TEXT] or own
        before = len(chosen)
        for r in fitting:
            if r.length <= left:
                chosen.append(r)
                left -= r.length
        if own and len(chosen) == before:
            warnings.warn(f"no text labelled {label} is short enough to learn from", stacklevel=2)
    chosen = F.broadcast(docs.sparkSession.createDataFrame(chosen, known.schema))
    rows = texts.join(chosen, ["doc_id", "length"])
    # repeated rows would add to the bound: one text for each key
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("order").alias("order"))
    return rows.toPandas().sort_values(["order", "doc_id"])[["text", "toxic"]]


class Odds(dict):
    """Odds of label 1 that the words of a text show."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> float:
        weights = self.field.weights
        value = self.field.bias + sum(float(weights[slot(f)]) for f in features(word))
        odds = float(np.exp(min(max(value, -30.0), 30.0)))
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = odds
        return odds


def scored_rows(docs: DataFrame, field: Field | None, text: str) -> DataFrame:
    """Each row of ``docs`` packed as ``row``, with its score, prediction and spans."""
    packed = docs.select(whole_row(docs).alias("row"), quoted(text).alias("text"))
    row = packed.schema["row"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        field = shared.value
        odds = Odds(field) if field else None
        for batch in batches:
            texts = batch.column("text")
            for start, stop in slices(texts, SLICE_BYTES):
                values = texts.slice(start, stop - start).to_pylist()
                spans: list[list[dict]] = [[] for _ in values]
                score = np.zeros(len(values))
                if field:
                    words = [WORDS.findall(v) if v else [] for v in values]
                    lengths = np.array([len(w) for w in words], dtype=np.int64)
                    count = int(lengths.sum())
                    shown = np.fromiter((o for w in words for o in map(odds.__getitem__, w)), dtype=np.float64, count=count)
                    marginal = field.marginals(shown, lengths)
                    total, most = summed(marginal, lengths)
                    score = field.score(total, most)
                    ends = np.cumsum(lengths)
                    for i in np.flatnonzero(most >= 0.5):
                        spans[i] = toxic_spans(values[i], marginal[ends[i] - lengths[i] : ends[i]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(start, stop - start), pa.array(score, pa.float64()),
                        pa.array((score >= THRESHOLD).astype(np.int32), pa.int32()), pa.array(spans, pa.list_(span)),
                    ],
                    names=["row", "score", "predicted", "spans"],
                )

    return packed.mapInArrow(
        run, f"row {row}, score double, predicted int, spans array<struct<start: int, end: int, marginal: double>>"
    )


def scored(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """All rows with ``score`` (0 to 1), ``predicted`` (0 or 1) and ``spans`` (array of start, end, marginal).

    Spans are runs of toxic words, in code points. A null text scores as an empty one: the base rate of a text without toxic
    words. Without a field all scores are 0. Input columns named like a result are replaced. Long texts are scored whole;
    an empty table gives an empty result.
    """
    return unpacked(scored_rows(docs, field, text), "row", ["score", "predicted", "spans"])


def without_toxic(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    return unpacked(scored_rows(docs, field, text).where("predicted = 0"), "row", [])


def toxic_spans(text: str, marginal: np.ndarray) -> list[dict]:
    spans: list[dict] = []
    last = -2
    for i, found in enumerate(WORDS.finditer(text)):
        if marginal[i] >= 0.5:
            if last == i - 1:
                spans[-1]["end"] = found.end()
                spans[-1]["marginal"] = max(spans[-1]["marginal"], float(marginal[i]))
            else:
                spans.append({"start": found.start(), "end": found.end(), "marginal": float(marginal[i])})
            last = i
    return spans


def learnt(docs: DataFrame, labels: DataFrame, **bounds: int) -> Field | None:
    """A field from labelled documents, or none if a class is missing; ``bounds`` are those of :func:`labelled_sample`."""
    sample = labelled_sample(docs, labels, **bounds)
    toxic = sample["toxic"].to_numpy() == 1
    field = trained(sample["text"].tolist(), toxic)
    if field is None and toxic.any() and not toxic.all():
        warnings.warn("nothing tells toxic and clean documents apart: all scores are 0", stacklevel=2)
    return field


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    result = scored(docs, learnt(docs, table(spark, folder, "labels")))
    return result.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")
