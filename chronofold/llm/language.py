"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

A text's subwords are the byte 2-, 3- and 4-grams of its lower-cased letters, blanks marking word ends, each
hashed to a bucket. The buckets' embeddings are averaged and a linear layer gives the languages' logits. Both
are trained together by stochastic gradient descent in numpy. As averaging and the layer are linear, a bucket's
contribution to each logit is tabulated once if that is the smaller table, and prediction is a lookup and a mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

BUCKETS, DIMENSIONS, ORDERS = 1 << 16, 16, (2, 3, 4)
#: Bounds of the training sample: documents of each language (about), and characters in all. Where languages are so many
#: that the second bound leaves fewer, about LEAST_EACH documents of each are taken all the same.
SAMPLE_EACH, SAMPLE_CHARS, LEAST_EACH = 400, 16_000_000, 20
#: The share of right calibration answers that falls short of the limits of a sure answer, and the part of the share of
#: known subwords that a sure answer must reach.
UNSURE, FAMILIAR = 0.002, 0.8
#: Labels whose chances are broadcast.
BROADCAST_LANGUAGES = 100_000
UNKNOWN = "und"
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_SALT = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA77), 4: np.uint32(0xC2B2AE3D)}


def subwords(text: str):
    """Bucket numbers of a text's subwords, in stretches of bounded length."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8").translate(_LETTERS).split()) + b" ", np.uint8)
    for at in range(0, len(raw), 500_000):
        part = raw[at : at + 500_000 + max(ORDERS) - 1].astype(np.uint32)
        for n in ORDERS:
            size = min(len(part) - n + 1, 500_000)
            if size > 0:
                gram = part[:size].copy()
                for k in range(1, n):
                    gram = gram << np.uint32(8) | part[k : k + size]
                yield gram * _SALT[n] >> np.uint32(16)


@dataclass
class Model:
    """What a bucket adds to each logit (or, with more languages than dimensions, its embedding, and the layer), then
    whether training met it; the languages, the temperature, and the limits of a sure answer."""

    languages: list[str]
    table: np.ndarray
    layer: np.ndarray | None
    bias: np.ndarray
    temperature: float
    threshold: float
    known: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, its score, and whether both the score and the share of known subwords reach their limits."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        total, n = np.zeros(self.table.shape[1]), 0
        for buckets in subwords(text):
            total += self.table[buckets].sum(0)
            n += len(buckets)
        mean = total / max(n, 1)
        logits = mean[:-1] if self.layer is None else mean[:-1] @ self.layer
        p = softmax((logits + self.bias) / self.temperature)
        score = min(1.0, float(p.max()))
        return self.languages[int(p.argmax())], score, score >= self.threshold and mean[-1] >= self.known


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(examples: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 30.0, seed: int = 7) -> Model:
    """Fit on (language, buckets, counts); every fifth example calibrates instead.

    The temperature minimises the calibration loss; the threshold is the score that all but one in five hundred of the
    right calibration answers reach. Likewise for the share of known subwords, of which a part is enough: texts unlike any
    that were learned have few, however sure the softmax is.
    """
    languages = sorted({e[0] for e in examples})
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), None, np.zeros(0), 1.0, 0.0, 0.0)
    index, rng = {x: i for i, x in enumerate(languages)}, np.random.default_rng(seed)
    order = rng.permutation(len(examples))
    fit, held = [i for k, i in enumerate(order) if k % 5 or len(examples) < 50], [i for k, i in enumerate(order) if k % 5 == 0]
    embed = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (DIMENSIONS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            language, buckets, counts = examples[i]
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ embed[buckets]
            error = softmax(mean @ layer + bias)
            error[index[language]] -= 1
            back = layer @ error
            layer -= 0.002 * step * np.outer(mean, error)
            bias -= 0.0005 * step * error
            embed[buckets] -= step * share[:, None] * back[None, :]
    met = np.zeros((BUCKETS, 1), np.float32)
    for i in fit:
        met[examples[i][1]] = 1
    shares = [examples[i][2] / examples[i][2].sum() for i in held]
    raw = np.array([(share @ embed[examples[i][1]]) @ layer + bias for i, share in zip(held, shares, strict=True)])
    truth = np.array([index[examples[i][0]] for i in held])
    loss = {t: -np.log(softmax(raw / t)[np.arange(len(held)), truth] + 1e-12).mean() for t in np.geomspace(0.1, 4, 30)}
    heat = min(loss, key=loss.get)
    p = softmax(raw / heat)
    right = p.argmax(1) == truth
    familiar = np.array([float(share @ met[examples[i][1], 0]) for i, share in zip(held, shares, strict=True)])
    threshold, known = [float(np.quantile(x[right], UNSURE)) if right.any() else 0.0 for x in (p.max(1), familiar)]
    few = len(languages) <= DIMENSIONS
    table = np.concatenate([embed @ layer if few else embed, met], axis=1).astype(np.float32)
    return Model(languages, table, None if few else layer.astype(np.float64), bias.astype(np.float64), float(heat), threshold,
        FAMILIAR * known)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text is 2 modulo 4 (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = SAMPLE_EACH) -> Model:
    """Train on a hash sample of about `each` labelled documents of each language, held-out ones excluded; every label is
    learned.

    The sample is chosen by id; executors turn its whole texts into bucket counts, so the driver gets no text and at most
    three numbers a character of the sample, which holds about SAMPLE_CHARS at most.
    """
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    languages, chars = sizes.agg(F.count("*"), F.sum(F.col("chars") * F.least(F.lit(1.0), each / F.col("n")))).first()
    if not languages:
        return train([])
    wanted = max(min(float(each), LEAST_EACH), each * min(1.0, SAMPLE_CHARS / max(chars, 1.0)))
    chance = F.least(F.lit(1.0), wanted / F.col("n")) * 1_000_000 + 1
    chances = sizes.select("lang", chance.alias("chance"))
    # Joined unbroadcast, every text would be shuffled by its language; that is left for labels by the hundred thousand.
    chosen = usable.join(F.broadcast(chances) if languages <= BROADCAST_LANGUAGES else chances,
        "lang").where(F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1_000_000)) < F.col("chance"))

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        buckets, numbers = [], []
        for text in texts_of(batch):
            total = np.zeros(BUCKETS, np.int64)
            for b in subwords(text):
                total += np.bincount(b, minlength=BUCKETS)
            used = np.flatnonzero(total)
            buckets.append(used.astype("<u2").tobytes())
            numbers.append(total[used].astype("<f4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(buckets, pa.binary()), pa.array(numbers, pa.binary())],
            ["lang", "buckets", "numbers"])

    rows = map_batches(chosen.select("lang", "text"), counts, "lang string, buckets binary, numbers binary").collect()
    examples = sorted(((r.lang, bytes(r.buckets), bytes(r.numbers)) for r in rows if r.buckets))
    return train([(x, np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(n, "<f4").astype(np.float64)) for x, b, n in examples])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, sure) of every row. A null text or one without a letter is 'und', score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        kinds = (pa.string(), pa.float64(), pa.bool_())
        columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "lang_pred", "score", "sure"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "id long, lang_pred string, score double, sure boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose language the model is sure of."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([shared.value.predict(t)[2] for t in batch.column(place).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Contract 9 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(docs))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
