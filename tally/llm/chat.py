"""Chat formatting: roles of transcript segments by a hidden Markov model, then canonical turns.

A turn's text is cut at lines that open with a speaker marker ("User:",
"Assistant:" and the like). Names that are words of their own ("Q:", "Model:",
"Customer:") are markers only where the text has them on both sides of a pair, each
at least once and in turn; else they stay text. Each segment shows its marker, if
any, a length class, whether it asks, and a class of line counts. States are roles;
recorded roles are no input. Start, transition and feature probabilities are
counted over all labelled turns that aren't held out, with add-one smoothing; a
marker is right with probability ``TRUST``. Viterbi finds the likeliest roles, once
with markers and once from the lines alone.

A conversation is cut into chunks of ``CHUNK`` turn numbers. Each chunk gives, for
each first and last role, the best path's weight; a scan over a conversation's
chunks (a small fraction of its rows) fixes their first and last roles; then each
chunk is solved on its own. So a conversation that holds a third of all rows is
spread over many tasks. Transitions are counted within chunks, and from chunk to
chunk by their first and last rows.

Rows with equal conversation and turn are taken in the order of their text's
hash. Null texts are empty segments; a null turn comes first; each row without a
conv_id is a conversation of its own (equal ones are one); recorded roles outside
``ROLES`` count as none. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

ROLES = ("system", "user", "assistant")
TRUST, CHUNK = 0.98, 256
#: Names that mark a speaker at the start of a line, and pairs of such that are words of their own.
MARKERS = {"system": "system", "user": "user human", "assistant": "assistant bot ai chatbot"}
PAIRS = "q a, question answer, customer agent, client agent, customer support, prompt response, user model, human model, instruction response"
_ROLE_OF = {w: k for k, r in enumerate(ROLES) for w in MARKERS[r].split()}
_PAIRS = [tuple(p.split()) for p in PAIRS.split(", ")]
_WORDS = sorted({*_ROLE_OF, *(w for p in _PAIRS for w in p)}, key=len, reverse=True)
MARKER = re.compile(r"(?im)^[ \t]*(?:[#>*\[<|]{0,4}[ \t]*)(" + "|".join(_WORDS) + r")[ \t]*[\]>*|]{0,4}[ \t]*:[*|]{0,2}[ \t]*")
LENGTHS, LINES = 16, 4


def markers(text: str) -> list[tuple[int, int, int]]:
    """Role, start and end of each speaker marker of a text."""
    found = [(m[1].lower(), m.start(), m.end()) for m in MARKER.finditer(text)]
    role_of = dict(_ROLE_OF)
    for one, other in _PAIRS:
        turns = [w for w, *_ in found if w in (one, other)]
        if one in turns and other in turns and all(a != b for a, b in zip(turns, turns[1:], strict=False)):
            role_of |= {one: 1, other: 2}
    return [(role_of[w], a, b) for w, a, b in found if w in role_of]


def segments(text: str) -> list[tuple[int | None, str]]:
    """Marked role and body of each segment of a turn's text; only markers and line breaks beside them are left out."""
    out, at, role = [], 0, None
    for found, start, end in markers(text):
        if start > at or role is not None:
            out.append((role, text[at:start].strip("\n")))
        role, at = found, end
    if role is not None or at < len(text) or not out:
        out.append((role, text[at:].strip("\n") if role is not None else text[at:]))
    return out


def observe(body: str) -> tuple[int, int, int]:
    """Length class, whether it asks, and class of line counts."""
    return min(LENGTHS - 1, len(body).bit_length()), int("?" in body or "¿" in body), min(LINES - 1, body.count("\n"))


@dataclass(frozen=True)
class Model:
    """Logarithms of the start, transition and feature probabilities."""

    start: np.ndarray
    move: np.ndarray
    length: np.ndarray
    asks: np.ndarray
    lines: np.ndarray

    def weigh(self, body: str, marker: int | None) -> np.ndarray:
        n, q, k = observe(body)
        out = self.length[:, n] + self.asks[:, q] + self.lines[:, k]
        if marker is not None:
            out = out + np.log(np.where(np.arange(len(ROLES)) == marker, TRUST, (1 - TRUST) / (len(ROLES) - 1)))
        return out


def viterbi(start: np.ndarray, move: np.ndarray, weights: np.ndarray, last: int | None = None) -> list[int]:
    """The likeliest states, ending in ``last`` if given."""
    best, back = start + weights[0], []
    for w in weights[1:]:
        step = best[:, None] + move
        back.append(step.argmax(0))
        best = step.max(0) + w
    at = int(best.argmax()) if last is None else last
    out = [at]
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return out[::-1]


def span(move: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each first and last state the weight of the best path through all segments."""
    n = len(move)
    best = np.full((n, n), -np.inf)
    np.fill_diagonal(best, weights[0])
    for w in weights[1:]:
        best = (best[:, :, None] + move[None]).max(1) + w
    return best


def held_out(conv_id):
    """The fold that counting never sees."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 5 == 0


#: A conversation: its id, and for rows without one a hash of the row.
CONVERSATION = ["conv_id", "lone"]


def _rows(conversations: DataFrame) -> DataFrame:
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim(F.col("role").cast("string"))).alias("role"), F.col("text").cast("string").alias("text"))
    own = own.withColumns({"chunk": F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK).cast("long"), "tie": F.xxhash64("text", "role")})
    return own.withColumn("lone", F.when(F.col("conv_id").isNull(), F.xxhash64("tie", "turn")).otherwise(F.lit(0).cast("long")))


def fit(conversations: DataFrame) -> Model:
    """Count over all labelled turns that aren't held out."""
    rows = _rows(conversations).where(~held_out(F.coalesce("conv_id", F.lit(0))))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "tie")
    order = Window.partitionBy(*CONVERSATION, "chunk").orderBy(place)
    known = rows.where(F.col("role").isin(*ROLES))
    text = F.coalesce("text", F.lit(""))
    size = F.least(F.lit(LENGTHS - 1), F.when(F.length(text) > 0, F.floor(F.log2(F.length(text).cast("double"))) + 1).otherwise(0)).cast("int")
    asks = (text.contains("?") | text.contains("¿")).cast("int")
    lines = F.least(F.lit(LINES - 1), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("int")
    counts = known.groupBy("role", size.alias("n"), asks.alias("q"), lines.alias("k")).count().collect()  # a few hundred classes at most
    inner = known.select("role", F.lag("role").over(order).alias("before")).where(F.col("before").isNotNull())
    ends = known.groupBy(*CONVERSATION, "chunk").agg(F.min_by("role", place).alias("role"), F.max_by("role", place).alias("last"))
    across = ends.select("role", F.lag("last").over(Window.partitionBy(*CONVERSATION).orderBy("chunk")).alias("before"))  # a row for each chunk
    pairs = inner.unionByName(across).groupBy("before", "role").count().collect()
    at = {r: k for k, r in enumerate(ROLES)}
    s = len(ROLES)
    start, move, length, ask, line = np.ones(s), np.ones((s, s)), np.ones((s, LENGTHS)), np.ones((s, 2)), np.ones((s, LINES))
    for r in counts:
        length[at[r.role], r.n] += r["count"]
        ask[at[r.role], r.q] += r["count"]
        line[at[r.role], r.k] += r["count"]
    for r in pairs:
        if r.before is None:
            start[at[r.role]] += r["count"]
        else:
            move[at[r.before], at[r.role]] += r["count"]
    return Model(*(np.log(x / x.sum(-1, keepdims=True)) for x in (start, move, length, ask, line)))


def _weights(model: Model, texts: list[str | None]) -> tuple[list[int], list[str], np.ndarray, np.ndarray]:
    """Row and body of each segment of a chunk, and weights with and without markers."""
    owner, bodies, marked, plain = [], [], [], []
    for i, text in enumerate(texts):
        for marker, body in segments(text or ""):
            owner.append(i)
            bodies.append(body)
            plain.append(model.weigh(body, None))
            marked.append(model.weigh(body, marker))
    return owner, bodies, np.array(marked), np.array(plain)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows with equal first columns together; the rows come sorted."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[list[tuple]], names: list[str], types: list[pa.DataType], size: int = 5000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def pack() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for some in rows:
        out += some
        if len(out) >= size:
            yield pack()
            out = []
    yield pack()


RENDER = "<|{role}|>\n{text}\n<|end|>\n"
LONG, INT, TEXT = pa.int64(), pa.int32(), pa.string()


def format_chats(conversations: DataFrame, model: Model) -> DataFrame:
    """A row for each segment: conv_id, turn, recorded role, segment (its place in the chunk), found role, blind role (from the lines alone) and rendered turn."""
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*CONVERSATION, "chunk", F.col("turn").asc_nulls_first(), "tie"]
    rows = _rows(conversations).select(*CONVERSATION, "chunk", "turn", "tie", "role", "text")
    sorted_rows = rows.repartition(parts, *CONVERSATION, "chunk").sortWithinPartitions(*order)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for run in _runs(batches, 3):
                _, _, marked, plain = _weights(model, [r[6] for r in run])
                yield [(*run[0][:3], span(model.move, marked).ravel().tolist(), span(model.move, plain).ravel().tolist())]

        return _batches(each(), ["conv_id", "lone", "chunk", "marked", "plain"], [LONG, LONG, LONG, pa.list_(pa.float64()), pa.list_(pa.float64())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ends(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
            best, back = None, []
            for m in matrices:
                enter = np.diag(model.start) + np.where(np.eye(len(m)), 0, -np.inf) if best is None else best[:, None] + model.move
                first = enter.max(0)  # weight of each first state, and where it comes from
                back.append((enter.argmax(0), (first[:, None] + m).argmax(0)))
                best = (first[:, None] + m).max(0)
            at, out = int(best.argmax()), []
            for came, first in reversed(back):
                out.append((int(first[at]), at))
                at = int(came[out[-1][0]])
            return out[::-1]

        def each():
            s = len(ROLES)
            for run in _runs(batches, 2):
                a, b = (ends([np.array(r[k]).reshape(s, s) for r in run]) for k in (3, 4))
                yield [(*r[:3], *x, *y) for r, x, y in zip(run, a, b, strict=True)]

        return _batches(each(), ["conv", "alone", "part", "a", "b", "c", "d"], [LONG, LONG, LONG, INT, INT, INT, INT])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for run in _runs(batches, 3):
                owner, bodies, marked, plain = _weights(model, [r[6] for r in run])
                a, b, c, d = run[0][7:]
                fixed = lambda k: np.where(np.arange(len(ROLES)) == k, 0.0, -np.inf)
                found, blind = viterbi(fixed(a), model.move, marked, b), viterbi(fixed(c), model.move, plain, d)
                yield [(run[i][0], run[i][3], run[i][5], n, ROLES[f], ROLES[g], RENDER.format(role=ROLES[f], text=body)) for n, (i, body, f, g) in enumerate(zip(owner, bodies, found, blind, strict=True))]

        return _batches(each(), ["conv_id", "turn", "recorded", "segment", "role", "blind_role", "rendered"], [LONG, LONG, TEXT, LONG, TEXT, TEXT, TEXT])

    paths = sorted_rows.mapInArrow(spans, "conv_id long, lone long, chunk long, marked array<double>, plain array<double>")
    ends = cut(paths.repartition(parts, *CONVERSATION).sortWithinPartitions(*CONVERSATION, "chunk").mapInArrow(chain, "conv long, alone long, part long, a int, b int, c int, d int"))
    joined = rows.join(ends, rows["conv_id"].eqNullSafe(ends["conv"]) & (rows["lone"] == ends["alone"]) & (rows["chunk"] == ends["part"])).drop("conv", "alone", "part")
    return joined.repartition(parts, *CONVERSATION, "chunk").sortWithinPartitions(*order).mapInArrow(solve, "conv_id long, turn long, recorded string, segment long, role string, blind_role string, rendered string")
