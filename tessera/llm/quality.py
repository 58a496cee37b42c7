"""A quality classifier: a factorisation machine over hashed words, structure and metadata.

Labels teach; they, the language, the source and the id are never read for a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed words, and buckets for each statistic's value.
WORDS, LEVELS = 2048, 12
#: The bound of the labelled sample that teaches, by a hash of the id; folds of which one is held out; the cut between labels.
SAMPLE, FOLDS, CUT = 6000, 5, 0.3
RANK, STEPS, BATCH, RATE, DECAY = 6, 480, 256, 0.02, 1e-5
N_STATS = 14
SIZE = WORDS + N_STATS * LEVELS + 1

_BUCKETS: dict[bytes, int] = {}


def _bucket(word: bytes) -> int:
    if len(_BUCKETS) > 200_000:
        _BUCKETS.clear()
    found = _BUCKETS.get(word)
    if found is None:
        found = _BUCKETS[word] = zlib.crc32(word) % WORDS
    return found


def features(text: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document: hashed words of unit length, and one index for each statistic's level.

    Statistics: words, bytes a word, and shares of upper case, digits, marks, other ASCII signs, line ends, one-letter words, repeated words, words
    that follow themselves, that end in a sign, words without a letter, the most frequent sign, and the length that the metadata give.
    """
    words = text.lower().split()
    raw = np.frombuffer(text, np.uint8)
    n, size = max(1, len(words)), max(1, len(raw))
    count = np.bincount(raw, minlength=256)
    signs = np.concatenate((count[33:48], count[58:65], count[91:97], count[123:127]))
    marks = int(count[[44, 46, 59, 58, 33, 63, 39, 34, 45]].sum())
    lasts = b"".join([w[-1:] for w in words])
    ends = len(lasts) - sum(lasts.count(c) for c in b"abcdefghijklmnopqrstuvwxyz0123456789.,")
    ends -= sum(1 for c in lasts if c >= 128)
    lone = sum(1 for w in words if len(w) == 1)
    share = lambda x, y: int(np.sqrt(min(1.0, x / y)) * (LEVELS - 1) + 0.5)
    power = lambda x: min(LEVELS - 1, int(np.log2(1 + x) * 0.7))
    stats = (
        power(len(words)), min(LEVELS - 1, int(size / n)), share(count[65:91].sum(), size), share(count[48:58].sum(), size),
        share(4 * marks, size), share(4 * (signs.sum() - marks), size), share(20 * count[10], size), share(lone, n),
        share(len(words) - len(set(words)), n), share(sum(map(bytes.__eq__, words, words[1:])), n), share(ends, n), share(sum(1 for w in words if not w.isalpha() and w.isascii()), n),
        share(4 * signs.max(), size), LEVELS - 1 if n_chars is None else min(LEVELS - 2, int(np.log2(1 + max(0, n_chars)) * 0.6)),
    )
    hashed = np.bincount(np.fromiter(map(_bucket, words), np.int64, len(words)), minlength=WORDS)
    some = np.flatnonzero(hashed)
    value = np.log1p(hashed[some])
    value /= np.sqrt((value * value).sum()) or 1
    index = np.concatenate((some, WORDS + np.arange(N_STATS) * LEVELS + np.array(stats), [SIZE - 1]))
    return index, np.concatenate((value, np.full(N_STATS, 1 / np.sqrt(N_STATS)), [1.0]))


def margin(index: np.ndarray, value: np.ndarray, weights: np.ndarray, factors: np.ndarray) -> float:
    """w.x plus all pairs' <v_i, v_j> x_i x_j, in linear time: half of the squared sum less the sum of squares, for each factor."""
    vx = factors[index] * value[:, None]
    return float(weights[index] @ value + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx * vx).sum()))


def _learn(pdf):
    """Weights and factors from the bounded sample, by seeded mini-batches (Adam on the log loss)."""
    import pandas as pd

    pdf = pdf.sort_values(["doc_id", "label"]).reset_index(drop=True)
    rng = np.random.default_rng(0)
    params = [np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    y, step = pdf.label.to_numpy(np.float32), 0
    for _ in range(-(-STEPS * BATCH // len(y))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            x = np.zeros((len(some), SIZE), np.float32)
            for r, i in enumerate(some):
                x[r, np.frombuffer(pdf.ids[i], "<i4")] = np.frombuffer(pdf.vals[i], "<f4")
            w, v = params
            s = x @ v
            x2 = x * x
            z = x @ w + 0.5 * ((s * s).sum(axis=1) - x2 @ (v * v).sum(axis=1))
            g = (1 / (1 + np.exp(-z)) - y[some]) / len(some)
            grads = [x.T @ g + DECAY * w, x.T @ (g[:, None] * s) - v * (x2.T @ g)[:, None] + DECAY * v]
            step += 1
            for p, m, d in zip(params, moments, grads, strict=True):
                m[0] += 0.1 * (d - m[0])
                m[1] += 0.001 * (d * d - m[1])
                p -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return pd.DataFrame({"feature": np.arange(SIZE), "w": params[0], "v": list(params[1])})


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t.as_py() or b"", n) for t, n in zip(b.column("text").cast(pa.binary()), b.column("n_chars").to_pylist(), strict=True)]
        ids = pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary())
        vals = pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), b.column("tie"), ids, vals], names=["doc_id", "label", "tie", "ids", "vals"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The model, from at most ``sample`` labelled documents outside the held-out fold.

    The sample is the bound that this step may hold in one task: ``sample`` rows of hashed features. Labels other than 0 and 1, null
    labels and null ids teach nothing; repeated labels and documents teach as often as they stand (within the bound). Without
    any label every score is 0.5. The model has a fixed size, whatever the corpus.
    """
    taught = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    taught = taught.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    # The ids are chosen before any text is read, so texts of other documents do not travel.
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(taught), "doc_id")
    # Texts become features where they are read: what meets in one task are hashed features, however long the texts.
    seen = rows.select("doc_id", "label", F.xxhash64("text").alias("tie"), "text", "n_chars").mapInArrow(_sampled, "doc_id long, label int, tie long, ids binary, vals binary")
    seen = seen.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "tie").limit(sample).drop("tie")
    model = seen.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_learn, "feature int, w double, v array<double>").collect()
    weights, factors = np.zeros(SIZE), np.zeros((SIZE, RANK))
    for r in model:
        weights[r.feature], factors[r.feature] = r.w, r.v
    return {"weights": weights, "factors": factors}


def scores(docs: DataFrame, model: dict[str, np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, score)`` of every whole text, and the columns named in ``keep`` as ``kept_<name>``.

    Null texts score as empty ones, null n_chars by a level of their own. Repeats score alike. An empty table gives no row.
    """
    types = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"], model["factors"]))
    names = ["doc_id", *[f"kept_{c}" for c in keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, factors = shared.value
        for b in batches:
            z = [margin(*features(t.as_py() or b"", n), weights, factors) for t, n in zip(b.column("text").cast(pa.binary()), b.column("n_chars").to_pylist(), strict=True)]
            score = 1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40)))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(score)], names=[*names, "score"])

    rows = docs.select("doc_id", *[F.col(c).alias(f"kept_{c}") for c in keep], "text", F.col("n_chars").cast("long").alias("n_chars"))
    kinds = ", ".join([f"doc_id {types['doc_id']}", *[f"`kept_{c}` {types[c]}" for c in keep], "score double"])
    return rows.mapInArrow(run, kinds)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score below CUT."""
    model = fit(docs, labels)
    kept = scores(docs, model, tuple(docs.columns)).where(F.col("score") >= CUT)
    return kept.select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])
