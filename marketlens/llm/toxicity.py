"""Toxicity by a weighted finite-state pattern grammar over clauses.

Two transducers are composed token by token. The lexicon transducer reads a word's
characters along a trie and emits a symbol with a weight: INSULT, THREAT, TARGET,
NEGATION, REPORT or OTHER. The clause transducer reads those symbols: an insult or
threat adds its weight, more if the clause has a target, less in the scope of a
negation or inside reported speech. A document's evidence is the sum over matched
clauses, and a logistic curve turns it into a score.

Insult patterns (words and word prefixes) and their weights, and the curve, are
learnt from labelled rows outside the held-out fold, from a bounded sample of
``max_train_docs`` rows (half of each label at most; the only bound). Patterns are
counted over different texts, and must be seen in several different contexts, so that
copies of one text count once. The other classes are short fixed word lists.

Defined cases: null and empty texts, and texts without a match, get the curve's
value at no evidence; without labelled rows the fixed curve and no learnt patterns
apply; rows of ``labels`` that repeat an id count as toxic if one of them does; a
null label is not learnt from; texts of any length are read whole; rows that repeat are
scored each, and learnt from once per id and text; where two patterns fit a word the
heavier one counts, and equal scores are on one side of the threshold; an empty table
gives no rows. Extra columns, of any name, never reach the scores; the stage keeps them
as they are.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marketlens.llm.common import fold, lean, quoted, stored

INSULT, THREAT, TARGET, NEGATION, REPORT = "INSULT", "THREAT", "TARGET", "NEGATION", "REPORT"
# Closed word classes in the four languages.
CLASSES = {
    THREAT: "kill murder hurt shoot stab strangle töten umbringen matar tuer",
    TARGET: "you your yours he she they them these those du dich ihr euch tú usted ustedes vous toi tu",
    NEGATION: "not no never isn't aren't wasn't don't doesn't nicht kein keine niemals nunca jamás pas jamais",
    REPORT: "said says called calls wrote quoted claimed sagte nannte schrieb dijo llamó escribió dit appela écrivit",
}
THREAT_WEIGHT = 2.0
WITH_TARGET, NEGATED, REPORTED = 1.25, 0.5, 0.6
NEGATION_SCOPE = 3
PREFIXES = range(4, 9)
DEFAULT_CURVE = (2.0, 0.5, -3.0)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")


class Lexicon:
    """Character transducer: a trie whose paths emit (symbol, weight)."""

    def __init__(self, insults: dict[str, float]):
        """``insults``: word, or prefix followed by ``*``, to weight."""
        self.root: dict = {}
        for symbol, words in CLASSES.items():
            for w in words.split():
                self._add(w, False, (symbol, THREAT_WEIGHT if symbol == THREAT else 0.0))
        for pattern, weight in insults.items():
            self._add(pattern.rstrip("*"), pattern.endswith("*"), (INSULT, weight))
        self.memo: dict[str, tuple[str, float] | None] = {}

    def _add(self, word: str, prefix: bool, emit: tuple[str, float]) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        key = "prefix" if prefix else "word"
        if key not in node or node[key][1] < emit[1]:
            node[key] = emit

    def read(self, word: str) -> tuple[str, float] | None:
        """The heaviest emission along the word's path."""
        node, best = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            if "prefix" in node and (best is None or node["prefix"][1] > best[1]):
                best = node["prefix"]
        if "word" in node and (best is None or node["word"][1] >= best[1]):
            best = node["word"]
        return best

    def heavy(self, raw: str) -> bool:
        """Whether a white-space token holds an insult or a threat."""
        got = self.memo.get(raw)
        if got is None:
            if len(self.memo) > 150_000:
                self.memo.clear()
            got = self.memo[raw] = any((x := self.read(w)) and x[0] in (INSULT, THREAT) for w in _WORD.findall(raw))
        return got

    def evidence(self, text: str) -> float:
        """Sum of the clauses' weights; clauses without an insult or threat weigh nothing."""
        low = text.lower()
        if not any(map(self.heavy, set(low.split()))):
            return 0.0
        return sum(self._clause(c) for c in _CLAUSE.split(low))

    def features(self, text: str) -> tuple[float, float]:
        """Evidence in all, and by length: a long text meets rare patterns by chance."""
        e = self.evidence(text)
        return (math.log1p(e), math.log1p(1000 * e / (len(text) + 200))) if e else (0.0, 0.0)

    def _clause(self, clause: str) -> float:
        """Run the clause transducer; its state is (negation left, reported, target)."""
        weight, negation, reported, target = 0.0, 0, False, False
        for w in _WORD.findall(clause):
            got = self.read(w)
            negation = max(0, negation - 1)
            if got is None:
                continue
            symbol, value = got
            if symbol == NEGATION:
                negation = NEGATION_SCOPE + 1
            elif symbol == REPORT:
                reported = True
            elif symbol == TARGET:
                target = True
            else:
                weight += value * (NEGATED if negation else 1.0)
        return weight * (REPORTED if reported else 1.0) * (WITH_TARGET if target else 1.0)


def _patterns(word: str):
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n] + "*"
        elif len(word) == n:
            yield word + "*"


def _count_patterns(batches):
    """Documents of each label that hold a pattern, summed per task."""
    counts: dict[str, list[int]] = {}
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for p in {p for w in set(_WORD.findall((text or "").lower())) for p in _patterns(w)}:
                counts.setdefault(p, [0, 0])[toxic] += 1
    yield pa.RecordBatch.from_pydict({"pattern": pa.array(counts, pa.string()),
                                      "neg": pa.array([c[0] for c in counts.values()], pa.int64()),
                                      "pos": pa.array([c[1] for c in counts.values()], pa.int64())})


def _count_contexts(wanted):
    """Words and neighbours of the wanted patterns, in toxic documents."""
    def run(batches):
        known = wanted.value
        for b in batches:
            seen = set()
            for text in b.column(0).to_pylist():
                words = _WORD.findall((text or "").lower())
                for i, w in enumerate(words):
                    for p in _patterns(w):
                        if p in known:
                            seen.add((p, w, " ".join(words[max(0, i - 2):i] + ["_"] + words[i + 1:i + 3])))
            yield pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in seen], pa.string())
                                              for k, n in enumerate(("pattern", "word", "context"))})
    return run


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, held: int, max_train_docs: int) -> DataFrame:
    """(text, toxic) of a bounded sample of labelled rows outside the held-out fold."""
    marks = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                          & (fold(F.col("doc_id"), folds) != held))
             .groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")))
    marks = stored(marks, "toxicity-labels")
    size = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {t: min(1.0, max_train_docs / 2 / n) for t, n in size.items()}
    whole = 1 << 62
    edge = F.when(F.col("toxic") == 1, int(share.get(1, 1.0) * whole)).otherwise(int(share.get(0, 1.0) * whole))
    sample = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < edge) \
        .select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("l_toxic"))
    # The sample has max_train_docs rows of two numbers: a broadcast of known size.
    joined = docs.join(F.broadcast(sample), F.col("id") == F.col("l_id"))
    # An id's rows may be many: equal texts are one, and what is still too much is sampled by id and text.
    rows = stored(joined.select("id", "text", F.col("l_toxic").alias("toxic")).dropDuplicates(["id", "text", "toxic"]), "toxicity-rows")
    part = int(min(1.0, max_train_docs / max(1, rows.count())) * whole)
    return stored(rows.where(F.pmod(F.xxhash64(F.lit(7), "id", "text"), F.lit(whole)) < part).select("text", "toxic"), "toxicity-train")


def _varied(train: DataFrame, picked: dict[str, tuple[int, int]], min_contexts: int) -> dict[str, int]:
    """Contexts of the patterns that stand in different ones, and of prefixes that start several words."""
    wanted = train.sparkSession.sparkContext.broadcast(frozenset(picked))
    by_word = (train.where("toxic = 1").select("text")
               .mapInArrow(lean("toxicity", _count_contexts(wanted)), "pattern string, word string, context string").distinct()
               .groupBy("pattern", "word").agg(F.count("*").alias("n")))
    rows = (by_word.groupBy("pattern").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count("*").alias("words"))
            .collect())
    return {r.pattern: r.n for r in rows if r.n >= min_contexts
            and (not r.pattern.endswith("*") or (r.words >= 3 and r.top <= 0.6 * r.n))}


def fit(train: DataFrame, *, min_contexts: int = 5, min_bound: float = 1.5):
    """(insult weights, curve) from rows (text, toxic).

    A pattern needs ``min_contexts`` contexts, and a log odds ratio whose lower
    bound is at least ``min_bound``.
    """
    spark = train.sparkSession
    texts = train.dropDuplicates(["toxic", "text"])
    n = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return {}, DEFAULT_CURVE
    counted = (texts.mapInArrow(lean("toxicity", _count_patterns), "pattern string, neg long, pos long")
               .groupBy("pattern").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")))
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    bound = odds - 1.64 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    # Patterns of the bounded sample; the support leaves at most a few hundred per word of a text.
    picked = {r.pattern: (r.pos, r.neg) for r in
              counted.where(F.col("pos") >= min_contexts).where(bound >= min_bound).collect()}
    weights = {}
    for pattern, contexts in (_varied(train, picked, min_contexts) if picked else {}).items():
        seen, against = picked[pattern]
        weight = math.log((min(seen, contexts) + 0.5) / (pos + 1.0)) - math.log((against + 0.5) / (neg + 1.0))
        if weight > 0:  # near copies alone are no evidence
            weights[pattern] = weight
    shared = spark.sparkContext.broadcast(Lexicon(weights))
    points = train.mapInArrow(lean("toxicity", _features(shared, "toxic int")), "toxic int, total double, dense double").collect()
    x = np.array([(p.total, p.dense) for p in points])
    return weights, _logistic(x, np.array([p.toxic for p in points], dtype=float))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Ridge logistic regression; weights aren't negative, so that evidence never lowers a score."""
    use = list(range(x.shape[1]))
    while True:
        design, beta = np.column_stack([x[:, use], np.ones(len(x))]), np.zeros(len(use) + 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            grad = design.T @ (p - y) + ridge * beta
            hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta))
            step = np.linalg.solve(hess, grad)
            beta -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        if len(use) == 0 or beta[:-1].min() >= 0:
            full = np.zeros(x.shape[1])
            full[use] = beta[:-1]
            return (*map(float, full), float(beta[-1]))
        use.pop(int(beta[:-1].argmin()))


def _features(shared, first: str):
    name = first.split()[0]

    def run(batches):
        lexicon = shared.value
        for b in batches:
            at = b.schema.get_field_index
            got = [lexicon.features(t or "") for t in b.column(at("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(at(name)), *(pa.array([g[k] for g in got], pa.float64()) for k in (0, 1))],
                names=[name, "total", "dense"])
        lexicon.memo.clear()  # the broadcast value stays in the worker process
    return run


def _scored(rows: DataFrame, insults: dict[str, float], weights: tuple[float, ...]) -> DataFrame:
    """(id, score) of rows (id, text); id may be any column, such as a struct of the whole row."""
    a, d, b = weights
    shared = rows.sparkSession.sparkContext.broadcast(Lexicon(insults))
    found = rows.mapInArrow(lean("toxicity", _features(shared, "id")), StructType([
        StructField("id", rows.schema["id"].dataType), StructField("total", DoubleType()), StructField("dense", DoubleType())]))
    z = F.lit(a) * F.col("total") + F.lit(d) * F.col("dense") + F.lit(b)
    return found.select("id", (1.0 / (1.0 + F.exp(-z))).alias("score"))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 4,
          held: int = 2, max_train_docs: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit(training_rows(base, labels, folds, held, max_train_docs))
    return _scored(base, *model).select(
        F.col("id").alias(id_col), (fold(F.col("id"), folds) == held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held: int = 2,
                  max_train_docs: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that score below the threshold."""
    base = docs.select(F.col("doc_id").alias("id"), "text")
    model = fit(training_rows(base, labels, folds, held, max_train_docs))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("id"), "text")
    return _scored(rows, *model).where(F.col("score") < threshold).select("id.*")
