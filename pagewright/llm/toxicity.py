"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, with marks for its begin and end, so
a misspelling that was never seen shares most n-grams with the words that were.
N-grams are hashed to rows of an embedding table; a word is the mean of its
n-grams' rows, a text the mean of its words, and a linear layer with softmax
tells the two labels apart.  Table and layer are trained together in numpy by
Adagrad on batches of texts.

Training reads a bounded sample: at most ``PER_LABEL`` labelled documents of
each label, the first by hash, each weighing as many as it stands for.  Every
document is then scored, whole.  Since all layers up to the softmax are linear
and there are two labels, a text's score is the sigmoid of the mean of one
number for each n-gram, and only those numbers (``BUCKETS`` of them) are shipped.  A smaller sample is read more often:
training takes ``STEPS`` steps, but no sample is read more than ``PASSES`` times.

Null and empty texts have no words: their score is that of the bias alone.  With
no labelled documents every score is 0, with one label only it is that label.  A
document labelled twice counts as toxic if any of its labels does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.frames import ROW, boxed, known, schema_of, unboxed

#: Most training documents of each label.
PER_LABEL = 2_500
BUCKETS, DIMENSIONS, GRAMS = 1 << 18, 4, (3, 4, 5, 6)
STEPS, PASSES, BATCH, SEED = 640, 40, 128, 4
#: Words without meaning that each text has besides its own, so that one odd word
#: of a short text does not decide alone.
BLANKS = 20
#: Rates of the table, the layer and the bias.
RATES = (30.0, 2.0, 1.0)
#: Sums of squared steps that each starts from: rare n-grams take short steps.
FLOORS = (1e-11, 1e-12, 1e-12)
#: By how much the table shrinks in a step: what is not learnt again and again fades.
DECAY = 0.004
#: Documents with this remainder of ``FOLDS`` are held out.
FOLDS, HELD_OUT = 5, 0
_OPEN, _CLOSE = "\x02", "\x03"


@dataclass(frozen=True)
class Words:
    """Distinct words of some texts as bags of n-grams, and the texts as lists of words."""

    grams: np.ndarray  # buckets, word after word
    per_word: np.ndarray
    words: np.ndarray  # numbers of words, text after text
    per_text: np.ndarray


def _grams_of(named: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some words and the numbers of their words, size after size."""
    joined = "".join([f"{_OPEN}{w}{_CLOSE}" for w in named])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(named), dtype=np.int32), [len(w) + 2 for w in named])
    grams, owners, rolling = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], points
    for n in range(2, max(GRAMS) + 1):
        if len(points) < n:
            break
        rolling = rolling[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        if n in GRAMS:
            inside = word[: len(rolling)] == word[n - 1 :]
            mixed = rolling[inside]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            grams.append(((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32))
            owners.append(word[: len(rolling)][inside])
    return np.concatenate(grams), np.concatenate(owners)


def _split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the numbers of the words text after text, and how many each text has."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    numbered = lists.flatten().dictionary_encode()
    per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return numbered.dictionary.to_pylist(), numbered.indices.to_numpy(), per_text


def words_of(texts: pa.Array, buckets: int = BUCKETS) -> Words:
    named, words, per_text = _split(texts)
    grams, per_word = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for begin in range(0, len(named), 20_000):  # bounds what sorting holds
        some = named[begin : begin + 20_000]
        found, owners = _grams_of(some, buckets)
        grams.append(found[np.argsort(owners, kind="stable")])
        per_word.append(np.bincount(owners, minlength=len(some)))
    return Words(np.concatenate(grams), np.concatenate(per_word), words, per_text)


def _means(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Means of runs of rows; 0 for empty runs."""
    total = np.zeros((len(sizes), *rows.shape[1:]), rows.dtype)
    full = sizes > 0
    if full.any():
        total[full] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[full], axis=0)
    return total / np.maximum(sizes, 1).reshape(-1, *[1] * (rows.ndim - 1)).astype(rows.dtype)


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, rows[:, k], n) for k in range(rows.shape[1])], axis=1).astype(float)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs of ``sizes`` from ``starts``, run after run."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one number for each n-gram
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        named, words, per_text = _split(texts)
        grams, owners = _grams_of(named, len(self.weights))
        each = np.bincount(owners, self.weights[grams], len(named))
        each = each / np.maximum(np.bincount(owners, minlength=len(named)), 1)
        logit = _means(each[words], per_text) * per_text / (per_text + BLANKS) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(
    texts: list[str],
    labels: np.ndarray,
    weights: np.ndarray,
    steps: int = STEPS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> Model:
    """Embedding table and softmax layer trained together on labelled texts."""
    labels = np.asarray(labels, int)
    if not len(labels) or labels.min() == labels.max():
        sure = 0.0 if not len(labels) else float(labels[0])
        return Model(np.zeros(buckets, np.float32), 1e9 * (2 * sure - 1))
    draw = np.random.default_rng(seed)
    all_ = words_of(pa.array(texts, pa.string()), buckets)
    gram_starts = np.cumsum(all_.per_word) - all_.per_word
    word_starts = np.cumsum(all_.per_text) - all_.per_text
    table = draw.normal(0, 0.1, (buckets, DIMENSIONS)).astype(np.float32)
    layer = draw.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [table, layer, bias]
    seen = [np.full_like(p, f) for p, f in zip(params, FLOORS)]
    weights = np.asarray(weights, float) / np.mean(weights)
    epochs = min(PASSES, -(-steps // -(-len(labels) // BATCH)))
    for epoch in range(epochs):
        order = draw.permutation(len(labels))
        rate = 1 - epoch / epochs
        for begin in range(0, len(order), BATCH):
            some = order[begin : begin + BATCH]
            per_text = all_.per_text[some]
            words, at = np.unique(all_.words[_runs(word_starts[some], per_text)], return_inverse=True)
            per_word = all_.per_word[words]
            grams = all_.grams[_runs(gram_starts[words], per_word)]
            vectors = _means(table[grams], per_word)
            means = _means(vectors[at], per_text) * (per_text / (per_text + BLANKS))[:, None].astype(np.float32)
            logits = means @ layer + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            odds[np.arange(len(some)), labels[some]] -= 1
            error = (odds * weights[some, None] / len(some)).astype(np.float32)
            share = error @ layer.T / (per_text + BLANKS)[:, None]
            to_words = _summed(at, np.repeat(share, per_text, axis=0), len(words))
            to_words /= np.maximum(per_word, 1)[:, None]
            to_table = _summed(grams, np.repeat(to_words, per_word, axis=0), buckets)
            moves = [to_table.astype(np.float32), means.T @ error, error.sum(axis=0)]
            table *= 1 - DECAY * rate
            for value, sum_, step, speed in zip(params, seen, moves, RATES):
                sum_ += step * step
                value -= (rate * speed) * step / np.sqrt(sum_)
    across = layer[:, 1] - layer[:, 0]
    return Model((table @ across).astype(np.float32), float(bias[1] - bias[0]))


def held_out(ident: str) -> Column:
    """Whether a document is kept from training: by the checksum of its identifier."""
    return F.coalesce(F.crc32(F.col(ident).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "toxic",
    per_label: int = PER_LABEL,
) -> Model:
    """The model of the labelled documents that are not held out."""
    marked = (
        labels.where(F.col(label).isin(0, 1) & F.col(ident).isNotNull() & ~held_out(ident))
        .groupBy(F.col(ident).alias("id"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    there = marked.join(docs.select(F.col(ident).alias("id")).distinct(), "id", "left_semi")
    counts = {r["label"]: r["count"] for r in there.groupBy("label").count().collect()}
    chosen = None
    for value in sorted(counts):
        some = there.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_label)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return fit([], np.zeros(0), np.zeros(0))
    # At most two times per_label rows: of a repeated identifier, one text.
    sample = (
        docs.select(F.col(ident).alias("id"), known(text).alias("text"))
        .join(F.broadcast(chosen), "id")
        .groupBy("id", "label")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        .select("id", "text", "label")
        .toArrow()
        .sort_by([("id", "ascending"), ("text", "ascending")])
    )
    y = sample["label"].to_numpy()
    stands_for = {v: n / max(1, int((y == v).sum())) for v, n in counts.items()}
    return fit(sample["text"].to_pylist(), y, np.array([stands_for[v] for v in y]))


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from score 0.5)."""
    rows = boxed(docs, text=known(text))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                piece = batch.slice(at, 1_024)
                scores = model.score(piece.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(ROW), pa.array(scores, pa.float64())], [ROW, "score"]
                )

    scored = rows.mapInArrow(score, schema_of(rows, [ROW], "score double"))
    return unboxed(
        scored, {"score": F.col("score"), "predicted": (F.col("score") >= 0.5).cast("int")}
    )
