"""Language identification by multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, one row per language and one column
per hash bucket. It is fitted on a bounded sample of the labelled rows
(``max_train_docs``, picked by a hash of the id; the only bound here) and broadcast;
its size depends on the languages and buckets, not on the corpus. Every whole text
is scored by gathering its n-grams' columns with numpy, document by document, so a
result never depends on how rows are batched.

Defined cases: a null text, or one without a letter, gives ``und`` with score 0; so
does everything if no labelled row exists; rows without a label are not learnt
from; ties go to the language that sorts first; repeated rows are scored each; texts of any
length count whole; an empty table gives no rows. Extra columns, of any name, never reach
the operator.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marketlens.llm.common import fold

ORDERS = (1, 2, 3)
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def ngram_buckets(text: str, bits: int) -> np.ndarray:
    """Hash bucket of every character n-gram of the lower-cased text, whole length."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(code), dtype=np.uint32)
        for n in ORDERS:
            if len(code) < n:
                break
            h = (h[:len(code) - n + 1] ^ code[n - 1:]) * _MIX[n - 1]
            h ^= h >> np.uint32(15)
            out.append(((h * _MIX[(n + 1) % 3]) >> np.uint32(32 - bits)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _count(bits: int):
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in counts:
                    counts[lang], docs[lang] = np.zeros(1 << bits, dtype=np.int64), 0
                docs[lang] += 1
                counts[lang] += np.bincount(ngram_buckets(text or "", bits), minlength=1 << bits)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * (len(at) + 1), pa.string()),
                "bucket": pa.array(np.append(at, -1), pa.int32()),
                "n": pa.array(np.append(c[at], docs[lang]), pa.int64())})
    return run


def fit(labelled: DataFrame, *, max_train_docs: int = 20_000, bits: int = 15):
    """(languages, log priors, log-probability matrix) from rows (id, text, lang)."""
    n = labelled.count()
    keep = 1.0 if n <= max_train_docs else max_train_docs / n
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(keep * (1 << 20))) if keep < 1 else labelled
    rows = (sample.select("text", "lang").mapInArrow(_count(bits), "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect())  # languages x buckets at most
    langs = sorted({r.lang for r in rows})
    at = {x: i for i, x in enumerate(langs)}
    counts, docs = np.zeros((len(langs), 1 << bits)), np.zeros(len(langs))
    for r in rows:
        if r.bucket < 0:
            docs[at[r.lang]] = r.n
        else:
            counts[at[r.lang], r.bucket] = r.n
    logp = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * (1 << bits))) if langs else counts
    prior = np.log(docs / docs.sum()) if langs else docs
    return langs, prior, logp


def predict(docs: DataFrame, model, *, bits: int = 15) -> DataFrame:
    """(id, lang_pred, score) for rows (id, text)."""
    langs, prior, logp = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, prior, logp.astype(np.float32)))

    def run(batches):
        names, first, table = shared.value
        for b in batches:
            preds, scores = [], []
            for text in b.column(1).to_pylist():
                if not names or text is None or not has_letter(text):
                    preds.append("und")
                    scores.append(0.0)
                    continue
                at = ngram_buckets(text, bits)
                lp = first + np.array([row.take(at).sum(dtype=np.float64) for row in table])
                best = int(lp.argmax())
                preds.append(names[best])
                scores.append(float(1.0 / np.exp(np.clip(lp - lp[best], -700, 0)).sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                names=["id", "lang_pred", "score"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {id_type}, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 4, held: int = 2, max_train_docs: int = 20_000, bits: int = 15) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    is_held: Column = fold(F.col("id"), folds) == held
    model = fit(base.where(~is_held & F.col("lang").isNotNull()), max_train_docs=max_train_docs, bits=bits)
    return predict(base, model, bits=bits).select(F.col("id").alias(id_col), is_held.alias("held_out"),
                                                  "lang_pred", "score")
