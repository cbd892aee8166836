"""The language of a text: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

Subwords are the one to four letters long pieces of words, their ends marked. Each has one of a fixed number of embeddings; the
mean over a text goes through a linear layer and a softmax. Embeddings and layer are learnt by stochastic gradient descent from
passages of a bounded sample. Documents of the sample that are left out of it set the temperature of the softmax and the least
probability that is not rejected. Because mean and layer are linear, what travels to the tasks is one number for each embedding
and language, and a task works out each different word of a batch once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, slices, table, unpacked, whole_row

UNKNOWN = "und"
#: what stands between words: anything but letters and the marks on them
BETWEEN = r"[^\p{L}\p{M}]+"
LETTER = r"\p{L}"
SUBWORDS = (1, 2, 3, 4)
SLICE_BYTES = 8 << 20


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample and of the model; the sample's characters are documents x passages x length at most."""

    #: the most frequent languages are learnt, so many at most
    languages: int = 256
    #: documents of the sample: of all languages together, and of one; and passages of a document, spread evenly over its text
    documents: int = 1600
    of_one_language: int = 400
    passages: int = 8
    passage_characters: int = 200
    buckets: int = 1 << 16
    width: int = 16
    epochs: int = 4
    batch: int = 64
    rate: float = 24.0
    #: one of so many sampled documents calibrates
    calibrating: int = 5
    #: of texts in learnt languages, about this share is rejected
    rejected: float = 0.01
    seed: int = 1


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all subwords of all words, and the word each belongs to."""
    text = "\n" + "\n".join(words) + "\n"
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = letters == 10
    number = np.cumsum(ends) - 1
    found, owners = [], []
    for size in SUBWORDS:
        count = len(letters) - size + 1
        if count <= 0:
            continue
        value = np.full(count, size * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(size):
            value = (value ^ letters[k : k + count]) * np.uint32(0x01000193)
            value ^= value >> np.uint32(15)
        # an end of a word may only stand at an end of a piece, and not without letters
        good = ~np.logical_and.reduce([ends[k : k + count] for k in range(size)])
        for k in range(1, size - 1):
            good = good & ~ends[k : k + count]
        found.append(value[good] % np.uint32(buckets))
        owners.append(number[:count][good])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in a row, in lower case, and the text each belongs to."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), BETWEEN)
    owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
    return lists.flatten(), owner


@dataclass
class Model:
    """Fixed in size: buckets times languages."""

    languages: list[str]
    #: what each bucket adds to each language, before the mean
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    buckets: int = Settings.buckets

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and its number of subwords."""
        flat, owner = words_of(texts)
        coded = pc.dictionary_encode(flat)
        words = coded.dictionary.to_pylist()
        place, word = subwords(words, self.buckets)
        counts = np.bincount(word, minlength=len(words)).astype(np.float64)
        codes = np.asarray(coded.indices, dtype=np.int64)
        total = np.bincount(owner, weights=counts[codes], minlength=len(texts))
        out = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            of_word = np.bincount(word, weights=self.table[place, k], minlength=len(words))
            out[:, k] = np.bincount(owner, weights=of_word[codes], minlength=len(texts))
        return out / np.maximum(total, 1)[:, None] + self.bias, total

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return softmax(logits / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def trained(passages: list[str], labels: np.ndarray, languages: list[str], settings: Settings) -> Model:
    """Embeddings and layer by stochastic gradient descent over batches of passages."""
    rng = np.random.default_rng(settings.seed)
    embeddings = rng.uniform(-1, 1, (settings.buckets, settings.width)) / settings.width
    layer, bias = np.zeros((settings.width, len(languages))), np.zeros(len(languages))
    # every language weighs alike
    weight = len(labels) / (len(languages) * np.bincount(labels, minlength=len(languages)))
    order = rng.permutation(len(passages))
    batches = []
    for start in range(0, len(order), settings.batch):
        rows = order[start : start + settings.batch]
        flat, owner = words_of(pa.array([passages[i] for i in rows], pa.string()))
        place, word = subwords(flat.to_pylist(), settings.buckets)
        used, inverse = np.unique(place, return_inverse=True)
        cells = inverse * len(rows) + owner[word]
        batches.append((used, cells.astype(np.int32), np.bincount(owner[word], minlength=len(rows)), labels[rows]))
    steps, done = settings.epochs * len(batches), 0
    for _ in range(settings.epochs):
        for b in rng.permutation(len(batches)):
            used, cells, sizes, wanted = batches[b]
            rate = settings.rate * (1 - done / steps)
            done += 1
            counts = np.bincount(cells, minlength=len(used) * len(wanted)).reshape(len(used), len(wanted))
            share = counts / np.maximum(sizes, 1)
            hidden = share.T @ embeddings[used]
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(wanted)), wanted] -= 1
            error *= (weight[wanted] * (sizes > 0))[:, None] / len(wanted)
            back = error @ layer.T
            layer -= rate * hidden.T @ error
            bias -= rate / settings.width * error.sum(axis=0)
            embeddings[used] -= rate * share @ back
    return Model(languages, embeddings @ layer, bias, buckets=settings.buckets)


def calibrated(model: Model, texts: list[str], labels: np.ndarray, settings: Settings) -> Model:
    """The temperature of least log loss on documents not learnt from, and the probability that all but few of them reach."""
    if not texts:
        return model
    logits, _ = model.logits(pa.array(texts, pa.string()))
    rows = np.arange(len(texts))

    def loss(temperature: float) -> float:
        # one wrong document of its own, so that faultless samples do not ask for certainty
        right = softmax(logits / temperature)[rows, labels]
        return float(-np.log(np.maximum(right, 1e-12)).sum() - np.log(np.maximum(1 - np.median(right), 1e-12)))

    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    right = np.sort(model.probabilities(logits)[rows, labels])
    model.threshold = float(right[int(settings.rejected * len(right))])
    return model


def held_out(key: Column) -> Column:
    """Documents held out of learning."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, settings: Settings, text: str, language: str, key: str) -> DataFrame:
    """``language, place, passages``: a bounded sample, for each language the documents whose keys have the least hashes.

    Only keys and languages are counted and ranked; a share of each language's keys that is sure to suffice is ranked at all, so
    a language with most rows is no burden. Of rows that repeat a key the least passages count.
    """
    usable = quoted(language).isNotNull() & quoted(text).isNotNull() & quoted(key).isNotNull() & ~held_out(quoted(key))
    rows = docs.where(usable).select(
        quoted(language).cast("string").alias("language"), F.xxhash64(quoted(key)).alias("place"), quoted(text).alias("text")
    )
    keys = rows.select("language", "place").distinct()
    counts = keys.groupBy("language").agg(F.count("*").alias("keys"))
    counts = counts.orderBy(F.desc("keys"), "language").limit(settings.languages)
    listed = [(r.language, r["keys"]) for r in counts.collect()]  # as many as settings.languages
    each = max(1, min(settings.of_one_language, settings.documents // max(1, len(listed))))
    rates = docs.sparkSession.createDataFrame(
        [(name, min(1.0, 4 * max(each, 25) / number)) for name, number in listed], "language string, rate double"
    )
    unit = F.pmod(F.xxhash64("place", F.lit(1)), F.lit(1 << 20)) / float(1 << 20)
    near = keys.join(F.broadcast(rates), "language").where(unit < F.col("rate"))
    order = Window.partitionBy("language").orderBy("place")
    chosen = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("language", "place")
    picked = rows.join(F.broadcast(chosen), ["language", "place"])
    length = settings.passage_characters

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("text").to_pylist():
                parts = max(1, min(settings.passages, -(-len(value) // length)))
                starts = [len(value) * i // parts for i in range(parts)]
                out.append([value[s : s + length] for s in starts])
            arrays = [batch.column("language"), batch.column("place"), pa.array(out, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["language", "place", "passages"])

    short = picked.mapInArrow(cut, "language string, place long, passages array<string>")
    return short.groupBy("language", "place").agg(F.min("passages").alias("passages"))


def learnt(
    docs: DataFrame, settings: Settings = Settings(), text: str = "text", language: str = "lang", key: str = "doc_id"
) -> Model | None:
    """A model of the languages of labelled documents; none if there are none.

    Learns only from texts and languages of rows that are not :func:`held_out`. Null texts, languages and keys teach nothing.
    """
    rows = sorted(sample(docs, settings, text, language, key).collect(), key=lambda r: (r.place, r.language))  # bounded
    rows = [r for r in rows if any(any(c.isalpha() for c in p) for p in r.passages)]
    if not rows:
        return None
    languages = sorted({r.language for r in rows})
    number = {name: i for i, name in enumerate(languages)}
    seen = {name: 0 for name in languages}
    fit, apart = [], []
    for r in rows:
        seen[r.language] += 1
        (apart if seen[r.language] % settings.calibrating == 0 else fit).append(r)
    passages = [(p, number[r.language]) for r in fit for p in r.passages]
    model = trained([p for p, _ in passages], np.array([n for _, n in passages]), languages, settings)
    whole = [" ".join(r.passages) for r in apart]
    return calibrated(model, whole, np.array([number[r.language] for r in apart], dtype=np.int64), settings)


def identified(docs: DataFrame, model: Model | None, text: str = "text", reject: bool = True) -> DataFrame:
    """All rows with ``lang_pred``, ``score`` (the probability of the best language) and ``rejected``.

    A text that is null or has no letter is ``und``, its score 0 and rejected, and so is every text without a model. A text whose best
    language is less probable than the calibrated threshold is rejected; its ``lang_pred`` is ``und`` then, or with ``reject=False`` still
    the best language. Texts are read whole, of any length. Ties go to the language first by code point. Input columns named like a
    result are replaced; an empty table gives an empty result.
    """
    packed = docs.select(whole_row(docs).alias("row"), quoted(text).cast("string").alias("text"))
    row = packed.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text")
            for start, stop in slices(texts, SLICE_BYTES):
                part = texts.slice(start, stop - start)
                lettered = np.asarray(pc.match_substring_regex(part.fill_null(""), LETTER).to_numpy(zero_copy_only=False), dtype=bool)
                names = np.full(len(part), UNKNOWN, dtype=object)
                score, rejected = np.zeros(len(part)), np.ones(len(part), dtype=bool)
                if model:
                    chances = model.probabilities(model.logits(part)[0])
                    best = chances.argmax(axis=1)
                    score = np.where(lettered, chances[np.arange(len(part)), best], 0.0)
                    rejected = ~lettered | (score < model.threshold)
                    said = lettered & ~rejected if reject else lettered
                    names[said] = np.array(model.languages, dtype=object)[best[said]]
                arrays = [
                    batch.column("row").slice(start, stop - start), pa.array(names, pa.string()), pa.array(score), pa.array(rejected),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "lang_pred", "score", "rejected"])

    out = packed.mapInArrow(run, f"row {row}, lang_pred string, score double, rejected boolean")
    return unpacked(out, "row", ["lang_pred", "score", "rejected"])


def op12_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = identified(docs.select("doc_id", "text"), learnt(docs), reject=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
