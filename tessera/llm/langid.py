"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: character 1- to 3-grams of the lower-cased letters (all else is one blank), hashed to
  ``2**HASH_BITS`` buckets, weighted by counts times inverse document frequency, scaled to length 1.
* Document frequencies cover every learning document: each task adds up its own, one aggregation
  sums them per bucket, so the driver receives at most ``2**HASH_BITS`` rows.
* Weights are fitted by FTRL-proximal with elastic-net penalties on a sample of at most
  ``SAMPLE_PER_LANGUAGE`` labelled documents a language (the smallest id hashes; the bound is per
  language, of which there are few). The sample reaches the driver as bucket counts, at most
  ``2**HASH_BITS`` a document, never as texts.
* Every fifth sampled document is left out of the fit and sets the softmax temperature.

Learning documents have a non-null label and ``crc32(id as text) mod 5`` other than 0. A null id
belongs to neither side: it counts as held out. A prediction sees the text only.

Nulls: a null text, or one without a letter, is ``und`` with score 0; without learning documents
every text is. Repeated rows are predicted each. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import prepare

FOLDS = 5
UNDETERMINED = "und"
HASH_BITS = 15
SAMPLE_PER_LANGUAGE = 800
#: FTRL-proximal: learning rate, its smoothing, and the elastic-net penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
EPOCHS = 4
#: Every CALIBRATE-th sampled document sets the temperature.
CALIBRATE = 5
_TEMPERATURES = np.geomspace(0.02, 5, 60)

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_fold: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Code point -> lower-cased code point of a letter, blank for anything else."""
    if not _fold:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                out[c] = ord(ch.lower()[0])
        _fold.append(out)
    return _fold[0]


def buckets(text: str | None) -> np.ndarray | None:
    """Hash bucket of every n-gram of the text; None if it has no letter."""
    if not text:
        return None
    c = _folded()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    blank = c == 32
    c = c[np.r_[True, ~(blank[1:] & blank[:-1])]]
    if len(c) == 1 and c[0] == 32:
        return None
    c = np.r_[np.uint32(32), c, np.uint32(32)] if len(c) else c
    one = (c + np.uint32(7)) * _MULTIPLIERS[0]
    two = (one[:-1] ^ c[1:]) * _MULTIPLIERS[1]
    three = (two[:-1] ^ c[2:]) * _MULTIPLIERS[2]
    return np.concatenate([one, two, three]) >> np.uint32(32 - HASH_BITS)


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    h = buckets(text)
    if h is None:
        return None
    all_counts = np.bincount(h, minlength=1 << HASH_BITS)
    at = np.flatnonzero(all_counts)
    return at, all_counts[at]


def _document_frequencies(batches):
    total, n = np.zeros(1 << HASH_BITS, np.int64), 0
    for batch in batches:
        for text in batch.column("_text").to_pylist():
            if (got := _counts(text)) is not None:
                total[got[0]] += 1
                n += 1
    at = np.flatnonzero(total)
    # bucket -1 holds the number of documents
    yield pa.record_batch([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, total[at]])],
                          names=["bucket", "df"])


def _sample_rows(batches):
    for batch in batches:
        got = [_counts(t) for t in batch.column("_text").to_pylist()]
        keep = [i for i, g in enumerate(got) if g is not None]
        yield pa.record_batch(
            [batch.column("_order").take(pa.array(keep, pa.int64())),
             batch.column("_lang").take(pa.array(keep, pa.int64())),
             pa.array([got[i][0].astype(np.int32) for i in keep], pa.list_(pa.int32())),
             pa.array([got[i][1].astype(np.int32) for i in keep], pa.list_(pa.int32()))],
            names=["_order", "_lang", "at", "n"])


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = n * self.idf[at]
        return (x / max(np.sqrt(x @ x), 1e-12)) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        got = _counts(text)
        if got is None or not self.languages:
            return UNDETERMINED, 0.0
        p = _softmax(self.logits(*got) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl_fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int,
             size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal, one example at a time, coordinates of its features only."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.r_[at, size], np.r_[x, 1.0]  # the last coordinate is the bias
            w = weights(at)
            p = _softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    all_weights = weights(np.arange(size + 1))
    return all_weights[:size], all_weights[size]


def _temperature(model: LanguageModel, rows, labels) -> float:
    """The temperature of the smallest mean log loss on the documents left out of the fit."""
    if not rows:
        return 1.0
    logits = np.array([model.logits(*r) for r in rows])
    losses = []
    for t in _TEMPERATURES:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        losses.append((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())
    return float(_TEMPERATURES[int(np.argmin(losses))])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
          *, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    prepare(docs.sparkSession)
    learn = (docs.where(~held_out(id_col) & F.col(label_col).isNotNull())
             .select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                     F.col(label_col).cast("string").alias("_lang")))
    size = 1 << HASH_BITS
    df = dict(map(tuple, learn.select("_text").mapInArrow(_document_frequencies, "bucket int, df long")
                  .groupBy("bucket").agg(F.sum("df").alias("df")).collect()))
    total = df.pop(-1, 0)
    found = np.zeros(size)
    found[list(df)] = list(df.values())
    idf = np.log((1 + total) / (1 + found)) + 1

    order = F.xxhash64(F.col("_id").cast("string"))
    first = Window.partitionBy("_lang").orderBy("_order", "_id")
    chosen = (learn.select("_id", "_lang", order.alias("_order"))
              .withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language)
              .select("_id").distinct())  # at most per_language ids a language: small enough to broadcast
    sample = (learn.join(F.broadcast(chosen), "_id").select("_lang", order.alias("_order"), "_text")
              .mapInArrow(_sample_rows, "_order long, _lang string, at array<int>, n array<int>")
              .toArrow().sort_by([("_order", "ascending"), ("_lang", "ascending")]))
    names = sample.column("_lang").to_pylist()
    languages = sorted(set(names))
    labels = [languages.index(x) for x in names]
    at, n = (sample.column(c).combine_chunks() for c in ("at", "n"))
    ends, at, n = at.offsets.to_numpy()[1:-1], at.values.to_numpy(), n.values.to_numpy()
    counts = list(zip(np.split(at, ends), np.split(n, ends))) if labels else []
    scaled = [(at, (x := n * idf[at]) / np.sqrt(x @ x)) for at, n in counts]
    fit = [i for i in range(len(labels)) if i % CALIBRATE]
    kept = [i for i in range(len(labels)) if not i % CALIBRATE]
    if not fit:
        fit = kept
    weights, bias = ftrl_fit([scaled[i] for i in fit], [labels[i] for i in fit], len(languages), size)
    model = LanguageModel(languages, idf.astype(np.float32), weights.astype(np.float32), bias, 1.0)
    model.temperature = _temperature(model, [counts[i] for i in kept], [labels[i] for i in kept])
    return model


def _predict(model: LanguageModel, names: list[str]):
    def run(batches):
        for batch in batches:
            got = [model.predict(t) for t in batch.column("_text").to_pylist()]
            columns = [batch.column(n) for n in names]
            yield pa.record_batch([*columns, pa.array([g[0] for g in got], pa.string()),
                                   pa.array([g[1] for g in got], pa.float64())],
                                  names=[*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("_text"))
    return rows.mapInArrow(_predict(model, ["doc_id", "held_out"]),
                           f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, "
                           "lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
             *, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    return predict(docs, train(docs, id_col, text_col, label_col, per_language=per_language), id_col, text_col)
