"""Personal data: candidate spans judged by boosted trees.

Base spans follow fixed rules (see ``base_spans``) and always stay. Generators of
high recall propose further, overlapping spans: words around at-signs, spelled or
spaced addresses, clusters of digits with separators, and parts of those. Boosted
trees judge each proposal for each kind by its format and its surroundings.

The trees learn what the rules don't find, from all documents. Every base span is
written anew in a form that the rules miss ("name (at) host dot org", a phone
number without plus, other separators; see ``disguise``), in its own surroundings.
Proposals that overlap such a span well are positive; those of another kind or
extent there are negative, and so are proposals in the text as it was, unless they
meet a base span or a telling word stands before them: those stay unlabelled. Cases
of equal features are one row with their numbers. Trees need nothing but sums over
these rows: up to ``HELD`` rows are summed on the driver, more of them by Spark, with
the same trees. Each kind has trees of its own: all kinds are proposed at the same
digits, so taken together no feature alone tells right from wrong. On the documents that the trees didn't learn from (one half, by the
id's checksum) each kind's threshold is set to the lowest probability, in steps of
one in ``STEPS``, at which precision reaches ``PRECISION``; a kind with too few cases
adds nothing. Added spans never overlap others.

Offsets count code points, ends are exclusive. Null texts have no spans; equal
rows get equal spans; an empty table gives no rows and adds nothing.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Part, summed
from .common import cut, drop_cut, texts_of, with_columns

PRECISION, LEAST_CASES, STEPS, HELD = 0.98, 25, 1 << 16, 50_000
KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind string, start int, end int, base boolean, score double>>"

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can't start inside a run of digits unless the last one ended there, and matches end with their run
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: What stands before the national form of a phone number.
NATION = re.compile(r"\+[0-9]{1,3}[ .-]+(?=[(0-9])|\+")
NOT_DIGIT = re.compile(r"[^0-9]")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|@|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.|(?<= )dot(?= )) ?[A-Za-z0-9-]{1,63}){1,8}")
CLUSTER = re.compile(r"[+(]{0,2}[0-9][0-9 ()./_\[\]-]{5,60}[0-9]")
PARTS = re.compile(r"[+(]{0,2}[0-9](?:[0-9()./_\[\]-]| (?! ))*[0-9]")
#: Forms of signs that the rules don't know, by kind: at-signs, dots of hosts, dots of addresses, gaps of cards and of phone numbers.
AT, DOT, POINT, GAP, STROKE = (" (at) ", "(at)", " [at] ", " at "), (" (dot) ", "[dot]", " dot "), ("[.]", " . ", "-", "_"), (".", "/", "_", "  "), ("/", ".", " ", "-")
NEAR = re.compile(r"(?i)mail|phone|tel|call|fax|mobile|card|visa|credit|addr|host|server|\bip\b|contact|reach|rufen|appel|llam|karte|carte|tarjeta")


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed rules, leftmost and non-overlapping for each kind, in the order of KINDS and then of place."""
    out = []
    at = text.find("@")
    last = 0
    while at >= 0:
        # the leftmost start of a match at this sign is the start of the run of local characters before it
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans that may be personal data, of any kind that their form allows."""
    out = set()
    if "@" in text or "(at)" in text or "[at]" in text or (" at " in text and " dot " in text):
        out.update(("email", m.start(), m.end()) for m in SPELLED.finditer(text))
    if DIGIT.search(text):
        for m in CLUSTER.finditer(text):
            parts = [(m.start(), m.end())]
            # parts between wide gaps, and without an opening sign
            parts += [(m.start() + p.start(), m.start() + p.end()) for p in PARTS.finditer(m[0])]
            parts += [(a + 1, b) for a, b in parts if text[a] in "+("]
            for a, b in parts:
                if b - a >= 7:
                    out.update((kind, a, b) for kind in KINDS[1:])
    return sorted(out)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and surroundings of a span."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    found = re.findall(r"[0-9]+", span)
    groups = [len(g) for g in found] or [0]
    digits = sum(groups)
    edge = lambda c: 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0
    return [
        *(float(kind == k) for k in KINDS), float(len(span)), float(digits), digits / len(span), float(len(groups)), float(groups[0]), float(groups[-1]), float(max(groups)), float(min(groups)),
        float(span.count(".")), float(span.count("-")), float(span.count(" ")), float(span.count("(")), float("@" in span), float("  " in span), float(span.count("/")), float(span.count("[")), float(span.count("_")),
        float(len(set(re.findall(r"[^0-9A-Za-z]+", span)))), float(sum(c.isalpha() for c in span)), float(" at " in span), float(" dot " in span), float("(at)" in span or "[at]" in span),
        float(luhn("".join(found))), float(all(len(g) <= 3 and int(g) <= 255 for g in found)), float(span[:1] == "+"), float(span[:1] == "0"),
        edge(before[-1:]), edge(after[:1]), float(before[-1:] in '"=:#$'), float(bool(NEAR.search(before))),
    ]


def disguise(kind: str, span: str, pick: random.Random) -> str:
    """A base span in a form that the rules don't find."""
    if kind == "email":
        name, host = span.split("@", 1)
        return name + pick.choice(AT) + host.replace(".", pick.choice(DOT))
    if kind == "ip":
        return span.replace(".", pick.choice(POINT))
    digits = NOT_DIGIT.sub("", span)
    if kind == "card":
        return pick.choice(GAP).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if pick.random() < 0.4:  # as it was, without its plus
        # or in its national form
        return pick.choice(["", "00", "0"]) + span[1:] if pick.random() < 0.5 else NATION.sub("", span)
    cut = sorted(pick.sample(range(2, len(digits) - 1), min(3, len(digits) - 3)))
    return pick.choice(STROKE).join(digits[a:b] for a, b in zip([0, *cut], [*cut, len(digits)], strict=True))


def cases(text: str, seed: int) -> list[tuple[str, int, list[float]]]:
    """Kind, label and features of the proposals of a text and of its disguised form."""
    out, base, made, planted, at = [], base_spans(text), [], [], 0
    for p in proposals(text):
        if not any(p[1] < b[2] and b[1] < p[2] for b in base) and not NEAR.search(text[max(0, p[1] - 24) : p[1]]):
            out.append((p[0], 0, features(text, *p)))
    pick = random.Random(seed)
    for kind, start, end in sorted(base, key=lambda b: b[1:]):
        if start >= at:
            made.append(text[at:start])
            place = sum(map(len, made))
            made.append(disguise(kind, text[start:end], pick))
            planted.append((kind, place, place + len(made[-1])))
            at = end
    other = "".join([*made, text[at:]])
    rules = set(base_spans(other)) if planted else set()
    for p in proposals(other) if planted else ():
        if any(p[1] < b[2] and b[1] < p[2] for b in planted) and p not in rules:
            out.append((p[0], int(any(overlap(p, b) >= 0.8 for b in planted)), features(other, *p)))
    return out


def overlap(a: tuple, b: tuple) -> float:
    """Shared length over joint length of two spans of one kind."""
    if a[0] != b[0]:
        return 0.0
    both = min(a[2], b[2]) - max(a[1], b[1])
    return max(0, both) / (max(a[2], b[2]) - min(a[1], b[1]))


@dataclass(frozen=True)
class Model:
    trees: dict[str, Boosted]
    thresholds: dict[str, float]

    def spans(self, text: str) -> list[tuple[str, int, int, bool, float]]:
        """Base spans and the proposals selected beside them, by kind and place."""
        found = [(*s, True, 1.0) for s in base_spans(text)]
        if self.thresholds and (some := [p for p in proposals(text) if p[0] in self.thresholds]):
            some = [p for p in some if not any(p[1] < b[2] and b[1] < p[2] for b in found)]
            if some:
                x, kinds = np.array([features(text, *p) for p in some]), np.array([p[0] for p in some])
                scores = np.zeros(len(some))
                for kind in set(kinds.tolist()):
                    scores[kinds == kind] = self.trees[kind].probability(x[kinds == kind])
                taken: list[tuple] = []
                for score, p in sorted(zip(scores.tolist(), some, strict=True), key=lambda x: (-x[0], x[1])):
                    if score >= self.thresholds[p[0]] and not any(p[1] < t[2] and t[1] < p[2] for t in taken):
                        taken.append((*p, False, score))
                found += taken
        return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def counted(docs: DataFrame) -> DataFrame:
    """half, kind, x (features as bytes), positive and negative (numbers of cases) of all documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list[int]] = {}
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                half = crc32(str(doc).encode()) % 2
                for kind, label, x in cases(text, doc or 0):
                    found.setdefault((half, KINDS.index(kind), np.array(x).tobytes()), [0, 0])[1 - label] += 1
            columns = list(zip(*((*k, *n) for k, n in found.items()), strict=True)) or [()] * 5
            types = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["half", "kind", "x", "positive", "negative"])

    each = rows.mapInArrow(run, "half int, kind int, x binary, positive long, negative long")
    return each.groupBy("half", "kind", "x").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def _arrays(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), float)
    return x.reshape(table.num_rows, -1) if table.num_rows else np.empty((0, 0)), table.column("positive").to_numpy(zero_copy_only=False), table.column("negative").to_numpy(zero_copy_only=False)


def sums_over(rows: DataFrame, held: int = HELD):
    """A function that sums a ``Part`` over all rows of x, positive and negative; up to ``held`` of them are on the driver."""
    if rows.count() <= held:
        cases = _arrays(rows.toArrow())
        return lambda part: summed(*part(*cases))

    def sums(part: Part) -> tuple:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part(*_arrays(batch)), [pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True)], ["key", "value", "one", "two"])

        each = rows.select("x", "positive", "negative").mapInArrow(run, "key long, value double, one long, two long")
        # no more than features have values, nodes bins and probabilities steps
        got = each.groupBy("key", "value").agg(F.sum("one").alias("one"), F.sum("two").alias("two")).toArrow()
        return summed(*(got.column(c).to_numpy() for c in ("key", "value", "one", "two")))

    return sums


def fit(docs: DataFrame, precision: float = PRECISION, held: int = HELD) -> Model:
    """Learn from the proposals of all documents, as they are and disguised."""
    rows = cut(counted(docs))
    half = {(r.half, r.kind): r for r in rows.groupBy("half", "kind").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative")).collect()}
    all_trees, thresholds = {}, {}
    # a kind may have no wrong proposal, but not all of them
    both = all(any(r[label] for (h, _), r in half.items() if h == 0) for label in ("positive", "negative"))
    for k, kind in enumerate(KINDS):
        own = rows.where(F.col("kind") == k)
        if not both or (0, k) not in half or not half[0, k].positive or (1, k) not in half or half[1, k].positive < LEAST_CASES:
            continue
        trees = Boosted().fit_sums(sums_over(own.where("half = 0"), held))

        def reached(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, trees: Boosted = trees) -> tuple:
            return summed(np.zeros(len(x), np.int64), np.floor(trees.probability(x) * STEPS), positive, negative)

        _, steps, positive, negative = (c[::-1] for c in sums_over(own.where("half = 1"), held)(reached))
        if (good := np.flatnonzero(positive.cumsum() >= precision * (positive + negative).cumsum())).size:
            all_trees[kind], thresholds[kind] = trees, max(0.5, float(steps[good[-1]]) / STEPS)
    drop_cut(rows)
    return Model(all_trees, thresholds)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with spans; a column of that name is replaced."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
    names = ("kind", "start", "end", "base", "score")

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([[dict(zip(names, s, strict=True)) for s in model.spans(t)] for t in texts_of(batch)], kind)]

        return work

    return with_columns(docs, {"spans": SPANS}, ["text"], make)


def redact(text: str, spans: list[tuple]) -> str:
    """The text with each span (kind, start, end, ...) replaced by its kind in brackets; overlapping ones become one."""
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
