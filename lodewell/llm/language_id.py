"""Language identification by a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: the number of character n-grams
(n = 1 to 3, over lower-cased text with other ASCII than letters taken as a blank) that occur in both,
divided by the geometric mean of the numbers that occur in each. N-grams are held by a hash of
`bits` bits. A Nystrom map over landmark texts makes kernel ridge regression linear; one regression
runs for each language against the rest, and texts are scored in batches by matrix products
(presence x landmark presence, then the Nystrom map, then the regression weights).

Texts are read whole, long ones in overlapping slices whose presence is united. Null text, or text
without a letter, is `und` with score 0; so is every text if no labelled row is there to learn from.
Fitting reads a bounded sample, chosen by a hash of doc_id: `per_lang` labelled texts of every language, fewer where
these would be more than `sample_rows` in all, one at least; prediction reads every row. Repeated rows are predicted
alike; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.plans.storage import small_batches

_SLICE = 1 << 20
_BATCH = 256


@dataclass(frozen=True)
class Params:
    bits: int = 17
    per_lang: int = 200
    sample_rows: int = 51_200
    landmarks_per_lang: int = 32
    max_landmarks: int = 512
    ridge: float = 1e-2
    und: str = "und"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    slots: np.ndarray  # hash -> row of presence, or -1
    presence: np.ndarray  # (n-grams of landmarks) x landmarks, 0/1
    sizes: np.ndarray  # n-grams in each landmark
    nystrom: np.ndarray
    weights: np.ndarray


_BLANK = np.arange(128, dtype=np.uint32)
for _c in range(128):
    if not chr(_c).isalpha():
        _BLANK[_c] = 32
_MUL = np.uint32(0x9E3779B1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str, bits: int, flags: np.ndarray) -> np.ndarray:
    """Sorted hashes of the n-grams present in the whole text; flags is a zeroed scratch array of 2**bits bytes."""
    text = text.lower()
    shift = np.uint32(32 - bits)
    for at in range(0, max(len(text), 1), _SLICE):
        c = np.frombuffer(text[at : at + _SLICE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(c < 128, _BLANK[np.minimum(c, 127)], c)
        h = c * _MUL
        for n in (1, 2, 3):
            if n > 1:
                if len(h) < 2:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1 :] * _MUL + np.uint32(n)
            flags[((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> shift] = 1
    found = np.flatnonzero(flags)
    flags[found] = 0
    return found


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def fit(labelled: DataFrame, params: Params = Params(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """Learn from a bounded sample of rows with text and lang; None if there is no such row."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("g")).where("t is not null and g is not null")
    counts = rows.groupBy("g").agg(F.count("*").alias("n"))
    langs = counts.count()
    if not langs:
        return None
    each = max(1, min(params.per_lang, params.sample_rows // langs))
    # twice as many are drawn as are kept, so that enough of them have letters
    dice = F.pmod(F.xxhash64("k", "g"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.join(F.broadcast(counts), "g").where(dice * F.col("n") <= 2 * each + 8)
    bits = params.bits

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = np.zeros(1 << bits, np.uint8)
        for pdf in batches:
            pdf = pdf[[has_letter(t) for t in pdf["t"]]]
            found = [grams(t, bits, flags).astype(np.int32).tobytes() for t in pdf["t"]]
            yield pd.DataFrame({"g": pdf["g"], "o": pdf["o"], "ids": found})

    sample = picked.select("g", "t", F.xxhash64("k", F.lit(7)).alias("o")).mapInPandas(sets, "g string, o long, ids binary").toPandas()
    sample = sample.sort_values(["g", "o", "ids"]).groupby("g", sort=True).head(each)
    if sample.empty:
        return None
    langs = sorted(sample["g"].unique())
    ids = [np.frombuffer(x, np.int32) for x in sample["ids"]]
    y = np.where(sample["g"].to_numpy()[:, None] == np.array(langs, dtype=object)[None, :], 1.0, -1.0)
    each = max(1, min(params.landmarks_per_lang, params.max_landmarks // len(langs)))
    marks = np.flatnonzero((sample.groupby("g").cumcount() < each).to_numpy())
    vocabulary = np.unique(np.concatenate([ids[i] for i in marks]))
    slots = np.full(1 << bits, -1, np.int32)
    slots[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
    presence = np.zeros((len(vocabulary), len(marks)), np.uint8)
    for j, i in enumerate(marks):
        presence[slots[ids[i]], j] = 1
    sizes = np.array([len(ids[i]) for i in marks], np.float64)
    model = Model(langs, slots, presence, sizes, np.eye(len(marks)), np.zeros((len(marks), len(langs))))
    k = _kernel(ids, model)
    values, vectors = np.linalg.eigh(k[marks])
    good = values > 1e-6 * values.max()
    nystrom = vectors[:, good] / np.sqrt(values[good])
    z = k @ nystrom
    per_class = 1.0 / np.maximum(1, (y > 0).sum(0))
    balance = per_class[np.argmax(y, 1)]
    balance *= len(y) / balance.sum()
    gram = (z * balance[:, None]).T @ z + params.ridge * len(y) / z.shape[1] * np.eye(z.shape[1])
    return Model(langs, slots, presence, sizes, nystrom, np.linalg.solve(gram, (z * balance[:, None]).T @ y))


def _kernel(ids: list[np.ndarray], model: Model) -> np.ndarray:
    """Normalised kernel of texts (as sets) against the landmarks, by matrix products of _BATCH texts."""
    marks, out = model.presence.astype(np.float32), np.zeros((len(ids), len(model.sizes)))
    for first in range(0, len(ids), _BATCH):
        some = ids[first : first + _BATCH]
        x = np.zeros((len(some), len(marks)), np.float32)
        for i, own in enumerate(some):
            at = model.slots[own]
            x[i, at[at >= 0]] = 1
        size = np.array([max(1, len(i)) for i in some], np.float64)
        out[first : first + len(some)] = (x @ marks) / np.sqrt(size[:, None] * model.sizes[None, :])
    return out


def scored(docs: DataFrame, model: Model | None, params: Params = Params(), text: str = "text") -> DataFrame:
    """doc, a struct of all columns, lang_pred, score and known_share (of the text's n-grams, how many the landmarks hold) for every row."""
    small_batches(docs.sparkSession)
    bits, und = params.bits, params.und
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).cast("string").alias("t"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            preds, scores, shares = [und] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if has_letter(t)] if model is not None else []
            for at in range(0, len(known), _BATCH):
                own = known[at : at + _BATCH]
                sets = [grams(texts[i], bits, flags) for i in own]
                shares[own] = [np.count_nonzero(model.slots[x] >= 0) / len(x) for x in sets]
                f = _kernel(sets, model) @ model.nystrom @ model.weights
                best = np.argmax(f, 1)
                scores[own] = np.clip((f[np.arange(len(own)), best] + 1) / 2, 0, 1)
                for i, k in zip(own, best, strict=True):
                    preds[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores), pa.array(shares)], names=["doc", "lang_pred", "score", "known_share"])

    return rows.mapInArrow(score, f"doc {rows.schema['doc'].dataType.simpleString()}, lang_pred string, score double, known_share double")


def predict(docs: DataFrame, model: Model | None, params: Params = Params(), text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred, score and known_share for every row."""
    rows = docs.select(*dict.fromkeys((*carry, text)))
    return scored(rows, model, params, text).select(*[F.col("doc")[c].alias(c) for c in carry], "lang_pred", "score", "known_share")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3 (false for a null id)."""
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learnt from the rows that are not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), params)
    return predict(docs, model, params).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def reject(docs: DataFrame, min_share: float = 0.2, min_score: float = 0.2, params: Params = Params()) -> DataFrame:
    """The documents kept by language identification, with all their columns.

    Rejected are those predicted `und` (null or letterless text), those whose n-grams are nearly all
    unknown to the landmarks (another language or script), and those that every one-versus-rest
    regression clearly turns down. Without any labelled row only null and letterless texts go.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))), params)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    marked = scored(docs, model, params)
    return marked.where((F.col("lang_pred") != params.und) & (F.col("known_share") >= min_share) & (F.col("score") >= min_score)).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
