"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are hashes of the byte 2- to 4-grams of its lower-cased words,
word edges included. Their embeddings are averaged and classified by a
softmax; both layers are trained together by stochastic gradient descent in
numpy on a bounded sample of labelled rows. On a held-back part of that sample the
scores are calibrated by a temperature, and a rejection threshold of the lead of the
best language over the mean is set between the texts of known languages and texts of
none: languages left out of a fit, and random letters.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from corpuslab.llm import kernels as K
from corpuslab.llm.common import bounded_batches, release, saved

BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (2, 3, 4)
#: Most labelled texts of a language that a model is fitted on; with more languages than the second each has fewer.
PER_LANGUAGE, LANGUAGES = 800, 64
EPOCHS, RATE, SEED = 12, 4.0, 7
#: Share of the rightly classified calibration texts that may fall below the threshold; share of foreign texts that should; fits that leave languages out; texts of a language in these.
REJECTED, FOREIGN, FOLDS, FEW = 0.001, 0.95, 4, 200
CHUNK = 1 << 18
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"

PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

#: Bytes that end a word: controls, digits and ASCII punctuation.
_SPACE = ~K.ALNUM
_SPACE[0x30:0x3A] = True


@dataclasses.dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: the embeddings times the softmax's weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0  # of the lead


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the number of those of each text; texts are lower-cased bytes."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8).copy()
    data[_SPACE[data]] = 32
    ends = np.cumsum([len(t) + 1 for t in texts])
    wide = data.astype(np.uint32)
    space = data == 32
    buckets, owners = [], []
    h, inner = wide * np.uint32(0x9E3779B1), np.zeros(len(wide), dtype=bool)
    with np.errstate(over="ignore"):
        for n in range(2, max(GRAMS) + 1):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + wide[n - 1 :]
            # an n-gram may begin or end with a space, but has none inside and is not one space after another
            inner = inner[:-1] | space[n - 2 : len(space) - 1] if n > 2 else np.zeros(len(h), dtype=bool)
            good = ~(inner | (space[: len(h)] & space[n - 1 :]))
            if n in GRAMS:
                at = np.flatnonzero(good)
                x = h[at] * np.uint32(0xC2B2AE3D)
                buckets.append((x >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
                owners.append(at)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    count = np.diff(np.searchsorted(owner[order], np.concatenate(([0], ends))))
    return np.concatenate(buckets)[order], count


def logits(texts: list[bytes], model: Model) -> np.ndarray:
    """Unscaled scores, a row for each text."""
    out = np.empty((len(texts), len(model.languages)))
    for lo, hi in K.batches([len(t) for t in texts], CHUNK):
        bucket, count = features(texts[lo:hi])
        for j in range(len(model.languages)):
            sums = np.concatenate(([0.0], np.cumsum(model.table[:, j][bucket])))
            edge = np.concatenate(([0], np.cumsum(count)))
            out[lo:hi, j] = (sums[edge[1:]] - sums[edge[:-1]]) / np.maximum(count, 1)
    return out + model.bias


def softmax(x: np.ndarray, temperature: float) -> np.ndarray:
    x = x / temperature
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def lead(x: np.ndarray) -> np.ndarray:
    """How far the best unscaled score is above the mean of all: texts between two known languages have a lead, too, foreign ones little."""
    return x.max(axis=1) - x.mean(axis=1)


def _foreign(texts: list[str], labels: list[str], known: list[str], model: Model, seed: int) -> np.ndarray:
    """Leads of texts of no known language: of the languages left out of further fits, and of random letters of the texts."""
    rng = np.random.default_rng(seed)
    out, taken = [], {}
    some = []
    for i in rng.permutation(len(texts)).tolist():
        taken[labels[i]] = taken.get(labels[i], 0) + 1
        if taken[labels[i]] <= FEW:
            some.append(i)
    for fold in range(min(FOLDS, len(known))):
        left = set(known[fold::FOLDS])
        if len(known) - len(left) < 2:
            continue
        rest = [i for i in some if labels[i] not in left]
        other = _learn([texts[i] for i in rest], [labels[i] for i in rest], seed)[0]
        out.append(lead(logits([texts[i].lower().encode("utf-8", "surrogatepass") for i in some if labels[i] in left], other)))
    letters = sorted({c for i in some[:FEW] for c in texts[i].lower() if LETTER.match(c)}) or ["x"]
    junk = ["".join(c if c.isspace() else letters[rng.integers(len(letters))] for c in texts[i][:1000]) for i in some[:FEW]]
    return np.concatenate([*out, lead(logits([t.encode("utf-8", "surrogatepass") for t in junk], model))])


def fit(texts: list[str], labels: list[str], seed: int = SEED) -> Model:
    """Train on nine tenths of the texts, calibrate on the rest (on all, if there are under 50)."""
    model, raw, y, held = _learn(texts, labels, seed)
    if not model.languages:
        return model
    x = logits([raw[i] for i in held], model)
    hit = np.arange(len(held)), y[held]
    loss = {t: -np.log(softmax(x, t)[hit] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
    model.temperature = float(min(loss, key=loss.get))
    # mislabelled texts are classified otherwise, and don't count
    own = np.sort(lead(x)[x.argmax(axis=1) == y[held]])
    if len(model.languages) > 1 and len(own):
        low, high = own[int(REJECTED * len(own))], np.quantile(_foreign(texts, labels, model.languages, model, seed), FOREIGN)
        model.threshold = float(min(low, high))
    return model


def _learn(texts: list[str], labels: list[str], seed: int) -> tuple[Model, list[bytes], np.ndarray, np.ndarray]:
    """A model that is not calibrated, the texts' bytes, the languages' numbers, and the texts held back."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0)), [], np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    y = np.array([languages.index(x) for x in labels])
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(raw))
    held = order[: len(raw) // 10] if len(raw) >= 50 else order
    train = order[len(raw) // 10 :] if len(raw) >= 50 else order
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(languages)), dtype=np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    parts = []
    for i in range(0, len(raw), 64):
        bucket, count = features(raw[i : i + 64])
        for b in np.split(bucket, np.cumsum(count)[:-1]):
            parts.append(np.unique(b, return_counts=True))
    steps = max(1, EPOCHS * len(train))
    done = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            rate = RATE * (1 - done / steps)
            done += 1
            bucket, count = parts[i]
            if not len(bucket):
                continue
            share = (count / count.sum()).astype(np.float32)
            mean = share @ emb[bucket]
            p = mean @ out + bias
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * 0.1 * np.outer(mean, p)
            bias -= rate * 0.01 * p
            emb[bucket] -= rate * share[:, None] * back * 4
    return Model(languages, (emb @ out).astype(np.float32), bias.astype(np.float64)), raw, y, held


def training_rows(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts: of each language the rows whose ids' hashes come first.

    Ids and languages are ranked without their texts. Every language is learned; with more
    than ``LANGUAGES`` each has a smaller sample, of 50 rows at least. An id counts once in
    a language, with the least of its texts, so the driver gets ``per_language`` rows of each.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # rows that repeat count once
    pairs = saved(rows.select("doc_id", "lang").distinct(), "labelled")
    common = pairs.groupBy("lang").agg(F.count("*").alias("n"))
    per_language = min(per_language, max(50, per_language * LANGUAGES // max(1, common.count())))
    # a share of each language's rows, twice what is needed on average, is ranked: no task ranks a whole language
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)
    some = pairs.join(F.broadcast(common), "lang").where(draw * F.col("n") < 2.0 * per_language + 50)
    by = W.partitionBy("lang").orderBy(draw, "doc_id")
    ids = some.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= per_language).select(F.col("doc_id").alias("__id"), F.col("lang").alias("__l"))
    picked = rows.select("doc_id", "text", "lang").join(F.broadcast(ids), (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__l")))
    found = picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toPandas().sort_values(["doc_id", "lang"])
    return list(found["text"]), list(found["lang"])


def train(docs: DataFrame, usable: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """A model of ``docs(doc_id, text, lang)``: rows with a language for which ``usable`` holds."""
    return fit(*training_rows(docs, F.lit(True) if usable is None else usable, per_language))


def classify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``lang_pred``, ``score``, ``rejected`` of each row of ``docs``.

    Only ``text`` is read for the prediction, and all of it. Null texts and texts
    without a letter are ``und`` with score 0 and rejected; so is everything if the
    model knows no language. Rows that repeat each get their row; ``keep`` should not
    name a column of the result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: buckets x languages

    @F.pandas_udf(PREDICTION)
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        solid = np.array([isinstance(t, str) and LETTER.search(t) is not None for t in texts], dtype=bool) & bool(m.languages)
        pred, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        ahead = np.zeros(len(texts))
        some = np.flatnonzero(solid)
        if len(some):
            x = logits([texts.iloc[i].lower().encode("utf-8", "surrogatepass") for i in some], m)
            p = softmax(x, m.temperature)
            best = p.argmax(axis=1)
            pred[some] = np.array(m.languages, dtype=object)[best]
            score[some] = p[np.arange(len(some)), best]
            ahead[some] = lead(x)
        release()
        return pd.DataFrame({"lang_pred": pred, "score": score, "rejected": ~solid | (ahead < m.threshold)})

    # other columns never enter Python
    return docs.select(*[docs[c] for c in keep], predict(docs["text"]).alias("__p")).select(*keep, "__p.lang_pred", "__p.score", "__p.rejected")


def held_out(doc_id: Column) -> Column:
    """Rows that a model of the contract's query must not see: CRC-32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def predict_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)``: trained on the rows that are not held out, applied to all.

    A null ``doc_id`` is not held out and not learned from.
    """
    model = train(docs, ~held_out(F.col("doc_id")), per_language)
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
