"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (with a learned weight), threat, target, negation,
report, or other. Five small transducers read the symbols of a clause one after
the other, each with few states: insults and threats carry weight, a target near
them raises it, a negation shortly before lowers it, and what follows a verb of
saying counts as reported. Their composition is built lazily and remembered. A
clause's score is the sum of its weights; a document's score is a logistic
function of its clauses' scores.

Insult stems are learned from labelled rows: prefixes of three to nine characters
whose documents are toxic far more often than others, where they stand once or
where they open several different words. They and the logistic
weights are fitted on at most ``FIT_ROWS`` labelled rows, taken in the order of
their id's hash. Every text is then scored whole.

Null and empty texts score as a document without any clause. Rows with equal
doc_id are scored each by its own text. With no labelled rows of both kinds the
score is the same for all. Labels that are null are left out; a doc_id labelled
twice counts as toxic if any of its labels does.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_keys, texts_of, with_columns

#: The bound of the sample of labelled rows, and of learned stems.
FIT_ROWS, STEMS = 20_000, 2_000
#: Words that a reader remembers.
MEMO = 200_000
#: Lengths of stems, and the sign before a stem that counts in documents where it opens several words.
LENGTHS, SEVERAL = range(3, 10), "+"
WORD = re.compile(r"\w+")
CLAUSE = re.compile(r"[.!?;:\n]+")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Function words of the grammar.
THREATS = "kill hurt destroy beat burn shoot stab strangle tuer frapper détruire brûler töten schlagen zerstören verbrennen matar golpear destruir quemar"
TARGETS = "you your yours he him his she her they them their people tu te toi vous votre il elle ils elles leur du dich dir ihr euch sie ihm ihnen tú ti usted ustedes él ella ellos ellas"
NEGATIONS = "not no never neither nor none without isn aren wasn don doesn didn ne pas jamais aucun sans nicht kein keine keinen nie niemals ohne nunca jamás ningún ninguna sin"
REPORTS = "said says say called calls quoted quotes wrote writes told claims claimed according dit disait appelle appelé écrit sagt sagte nannte nennt schrieb zitiert dijo dice llamó escribió"
FUNCTION = {w: s for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words.split()}


@dataclass(frozen=True)
class Transducer:
    """States are small integers; ``step`` gives the next state, a factor for the symbol's weight and a weight added."""

    name: str

    def step(self, state: int, symbol: int) -> tuple[int, float, float]:
        raise NotImplementedError


class InsultTransducer(Transducer):
    """Neighbouring insults strengthen one another; state: tokens left of the neighbourhood."""

    def step(self, state, symbol):
        if symbol == INSULT:
            return 4, 1.25 if state else 1.0, 0.0
        return max(0, state - 1), 1.0, 0.0


class ThreatTransducer(Transducer):
    """A threat counts by its object: a target soon after it; state: tokens left."""

    def step(self, state, symbol):
        if symbol == THREAT:
            return 3, 1.0, 0.0
        if symbol == TARGET and state:
            return 0, 1.0, 2.0
        return max(0, state - 1), 1.0, 0.0


class TargetTransducer(Transducer):
    """A target before an insult raises its factor, one after it adds; states 1-4 after a target, 5-8 after an insult."""

    def step(self, state, symbol):
        if symbol == TARGET:
            return 4, 1.0, 0.5 if state > 4 else 0.0
        if symbol in (INSULT, THREAT):
            return 8, 1.25 if 0 < state < 5 else 1.0, 0.0
        return (0 if state in (0, 1, 5) else state - 1), 1.0, 0.0


class NegationTransducer(Transducer):
    """A negation weakens what it stands before; state: tokens that it still reaches."""

    def step(self, state, symbol):
        if symbol == NEGATION:
            return 3, 1.0, 0.0
        return max(0, state - 1), 0.35 if state and symbol in (INSULT, THREAT) else 1.0, 0.0


class ReportTransducer(Transducer):
    """After a verb of saying, the rest of the clause is reported speech."""

    def step(self, state, symbol):
        if symbol == REPORT:
            return 1, 1.0, 0.0
        return state, 0.5 if state and symbol in (INSULT, THREAT) else 1.0, 0.0


class Composition:
    """Transducers in a row as one; transitions are made when first met."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        self.start = (0,) * len(parts)
        self.known: dict[tuple, tuple[tuple, float, float]] = {}

    def step(self, state: tuple, symbol: int) -> tuple[tuple, float, float]:
        if (found := self.known.get((state, symbol))) is None:
            gone, factor, more = [], 1.0, 0.0
            for part, s in zip(self.parts, state, strict=True):
                s, f, m = part.step(s, symbol)
                gone.append(s)
                factor *= f
                more = more * f + m
            found = self.known[state, symbol] = (tuple(gone), factor, more)
        return found

    def clause(self, symbols: list[tuple[int, float]]) -> float:
        state, total = self.start, 0.0
        for symbol, weight in symbols:
            state, factor, more = self.step(state, symbol)
            total += weight * factor + more
        return total


def grammar() -> Composition:
    return Composition(InsultTransducer("insult"), ThreatTransducer("threat"), TargetTransducer("target"), NegationTransducer("negation"), ReportTransducer("report"))


@dataclass
class Reader:
    """Clause scores of texts under a lexicon of stems."""

    stems: dict[str, float]
    machine: Composition = field(default_factory=grammar)
    seen: set[str] = field(default_factory=set)
    #: Words by weight, and words by their stems that count only beside others.
    insults: dict[str, float] = field(default_factory=dict)
    family: dict[str, list[str]] = field(default_factory=dict)

    def _learn(self, words: set[str]) -> None:
        stems = self.stems
        for w in words:
            own = [w[:k] for k in LENGTHS if k <= len(w)]
            if weight := max([stems[p] for p in own if p in stems], default=0.0):
                self.insults[w] = weight
            if several := [p for p in own if SEVERAL + p in stems]:
                self.family[w] = several
        self.seen |= words

    def weights(self, words: set[str]) -> dict[str, float]:
        """The insults among a document's words."""
        self._learn(words - self.seen)
        out = {w: self.insults[w] for w in words & self.insults.keys()}
        relatives = words & self.family.keys()
        if len(relatives) > 1:
            count = Counter(p for w in relatives for p in self.family[w])
            for w in relatives:
                weight = max([self.stems[SEVERAL + p] for p in self.family[w] if count[p] > 1], default=0.0)
                if weight > out.get(w, 0.0):
                    out[w] = weight
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        """Sum and largest of the positive clause scores, and how many clauses have one."""
        low = text.lower()
        words = set(WORD.findall(low))
        insults = self.weights(words)
        hits = insults.keys() | (words & THREAT_WORDS)
        total = most = count = 0.0
        if hits:
            for clause in CLAUSE.split(low):
                said = WORD.findall(clause)
                if hits.isdisjoint(said):
                    continue
                symbols = []
                for w in said:
                    if w in insults:
                        symbols.append((INSULT, insults[w]))
                    else:
                        kind = FUNCTION.get(w, OTHER)
                        symbols.append((kind, 0.5 if kind == THREAT else 0.0))
                if (score := self.machine.clause(symbols)) > 0:
                    total, most, count = total + score, max(most, score), count + 1
        if len(self.seen) > MEMO:
            self.seen.clear()
            self.insults.clear()
            self.family.clear()
        return total, most, count


THREAT_WORDS = set(THREATS.split())


@dataclass(frozen=True)
class Model:
    stems: dict[str, float]
    weights: tuple[float, ...]

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(terms(features) @ np.array(self.weights), -30, 30)))


def terms(features: np.ndarray) -> np.ndarray:
    """One, and the features on a bounded scale."""
    f = np.asarray(features, float).reshape(-1, 3)
    return np.column_stack([np.ones(len(f)), np.log1p(f[:, 0]), np.minimum(f[:, 1], 20) / 5, np.log1p(f[:, 2])])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton's method for ridge logistic regression; the first column isn't penalised."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + change
        if np.abs(change).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """The fold that fitting never sees."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def emit() -> pa.RecordBatch:
        stems = list(counts[0].keys() | counts[1].keys())
        done = pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *(pa.array([c[s] for s in stems], pa.int64()) for c in counts)], ["stem", "clean", "toxic"])
        for c in counts:
            c.clear()
        return done

    for batch in batches:
        for text, label in zip(texts_of(batch), batch.column(batch.schema.get_field_index("label")).to_pylist(), strict=True):
            words = set(WORD.findall(text.lower()))
            for k in LENGTHS:
                opened = Counter(w[:k] for w in words if len(w) >= k)
                counts[label].update(opened.keys())
                counts[label].update(SEVERAL + p for p, n in opened.items() if n > 1)
            if len(counts[0]) + len(counts[1]) > MEMO:
                yield emit()
    yield emit()


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, stems: int = STEMS) -> Model:
    """Learn from labelled rows that aren't held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    chosen = known.join(F.broadcast(sample_keys(known, "doc_id", fit_rows)), "doc_id")  # fit_rows ids at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("label", "text")
    n_clean, n_toxic = _sizes(rows)
    if not n_clean or not n_toxic:
        return Model({}, (math.log((n_toxic + 0.5) / (n_clean + 0.5)) if n_clean + n_toxic else -2.0, 0.0, 0.0, 0.0))
    counted = rows.mapInArrow(_stem_counts, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    # the likelihood ratio against one rate for both kinds
    both, share = F.col("toxic") + F.col("clean"), n_toxic / (n_toxic + n_clean)
    part = lambda n, p: F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), share) + part(F.col("clean"), 1 - share))
    kept = counted.withColumns({"odds": odds, "ratio": ratio}).where((F.col("odds") >= 3) & (F.col("ratio") >= 18))
    lexicon = {r.stem: min(r.odds, 8.0) for r in kept.orderBy(F.desc("ratio"), "stem").limit(stems).select("stem", "odds").collect()}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            got = [reader.features(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], pa.float64()) for k in range(3))], ["label", "a", "b", "c"])

    seen = np.array([tuple(r) for r in rows.mapInArrow(features, "label int, a double, b double, c double").collect()], float)
    return Model(lexicon, tuple(logistic(terms(seen[:, 1:]), seen[:, 0]).tolist()))


def _sizes(rows: DataFrame) -> tuple[int, int]:
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    return counts.get(0, 0), counts.get(1, 0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with toxicity (0 to 1); a column of that name is replaced."""

    def make():
        reader = Reader(model.stems)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(model.probability(np.array([reader.features(t) for t in texts_of(batch)])), pa.float64())]

        return work

    return with_columns(docs, {"toxicity": "double"}, ["text"], make)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    own = docs.withColumnRenamed("toxicity", "__own")
    kept = score(own, fit(docs, labels)).where(F.col("toxicity") < threshold).drop("toxicity")
    return kept.withColumnRenamed("__own", "toxicity").select(*[f"`{c}`" for c in docs.columns])
