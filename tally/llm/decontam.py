"""Benchmark decontamination by template canonicalisation.

Texts become templates: words are folded to lower case (ASCII and Latin-1),
numbers, names (words with one capital, in front, within a sentence; a run of them as one) and
units after numbers become typed placeholders. Windows of ``window`` template
words are looked up among those of the benchmark. Matches of a document and an
item are gathered by their offset; the values in matching slots must agree: each
value of the item stands for one value of the document everywhere. An item whose
template is covered to ``cover`` at least is a leak: verbatim if all slot values
are equal too, else re-parameterised.

Texts are read twice: a word with one capital that opens a sentence is a word the
first time and a name the second, and the better match of the two is reported.
A number holds its decimals and groups of thousands.

Windows need ``literals`` words that aren't placeholders. Others are looked up by
what stood there, as exact copies, and an item with such windows is also found by
its whole template, if that has ``literals`` words with one at least that is no
placeholder. An item shorter than a window is one window of its own length. Null and empty texts, of documents or
items, match nothing; equal rows are reported each; an item given twice counts
under each of its ids; with an empty benchmark nothing is reported.

The benchmark's windows are a table. Documents are read once; their windows pass a
bitmap of ``BITS`` bits, made of all windows of the benchmark, whose size doesn't grow
with it, and what passes is joined with that table by hash, in a shuffle. Documents
and items that share a window are then compared, each document with its own items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, slices, texts_of
from .wordhash import BASE, U, combine, mix, words

NUMBER, NAME, UNIT = (U(k) for k in (0xA5A5_0001_0000_0001, 0xA5A5_0002_0000_0003, 0xA5A5_0003_0000_0005))
#: Units of measure and money.
UNITS = "km m cm mm mile miles meter meters metre metres foot feet inch inches yard yards kg g mg lb lbs pound pounds ounce ounces gram grams kilogram kilograms ton tons l ml liter liters litre litres gallon gallons hour hours minute minutes second seconds day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees kmh mph watt watts volt volts"
#: Bits of the bitmap that windows pass before the join; a power of two.
BITS = 1 << 22


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 capitals in lower case, at the same places."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    out[latin] += 32
    return out


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(UNITS.encode(), np.uint8)
    return np.sort(words(data)[2])


_UNITS = _unit_hashes()
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[ord(c) for c in ".!?\n\r:;\0"]] = True


def _numbers(raw: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which words go on with the number before: decimals, or three digits after a comma."""
    digit = np.concatenate([(raw >= 48) & (raw <= 57), np.zeros(4, bool)])
    mark = raw[end[:-1]]
    three = digit[start[1:] + 1] & digit[start[1:] + 2] & ~digit[start[1:] + 3]
    out = np.zeros(len(start), bool)
    out[1:] = number[1:] & number[:-1] & (start[1:] == end[:-1] + 1) & digit[end[:-1] - 1] & ((mark == 46) | ((mark == 44) & three))
    return out


def templates(texts: list[str], openers: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template word hashes of all texts, the hashes of what stood there, and where each text's words begin (one more entry at the end).

    With ``openers`` words that open a sentence can be names.
    """
    parts = [t.encode("utf-8", "replace") for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    raw = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    low = fold(raw)
    start, end, value = words(low)
    if not len(start):
        return value, value, np.zeros(len(texts) + 1, np.int64)
    first = raw[start]
    number = (first >= 48) & (first <= 57)
    # a name has one capital, in front; words all in capitals aren't names, nor are single letters
    folded = np.concatenate([[0], np.cumsum(low != raw)])
    ahead = folded[np.minimum(start + 1 + (first == 0xC3), end)] - folded[start]
    capital = (ahead == 1) & (folded[end] - folded[start] == 1) & (end - start > 1)
    # a word opens a sentence if a full stop or the like stands between it and the word before
    stops = np.concatenate([[0], np.cumsum(_SENTENCE[raw])])
    opens = np.ones(len(start), bool)
    opens[1:] = stops[start[1:]] > stops[end[:-1]]
    name = capital & ~number if openers else capital & ~opens & ~number
    unit = np.zeros(len(start), bool)
    after = np.flatnonzero(number[:-1] & ~opens[1:]) + 1
    unit[after] = _UNITS[np.minimum(np.searchsorted(_UNITS, value[after]), len(_UNITS) - 1)] == value[after]
    template = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, value)))
    kept = np.ones(len(start), bool)
    kept[1:] = ~(name[1:] & name[:-1] & ~opens[1:])
    more = _numbers(raw, start, end, number)
    if more.any():
        # the value of a number is that of all its parts
        parts = more | np.append(more[1:], False)
        heads = np.flatnonzero(~more[parts])
        place = np.arange(parts.sum()) - np.repeat(heads, np.diff(heads, append=parts.sum()))
        value = value.copy()
        value[parts & ~more] = np.add.reduceat(mix(value[parts] + place.astype(np.uint64) * BASE), heads)
        kept &= ~more
    return template[kept], value[kept], np.searchsorted(start[kept], bounds)


def is_slot(template: np.ndarray) -> np.ndarray:
    return (template == NUMBER) | (template == NAME) | (template == UNIT)


#: What a window is looked up for: its template, what stood there, or its item's whole template.
TEMPLATE, RAW, WHOLE = range(3)


def windows(template: np.ndarray, value: np.ndarray, window: int, literals: int) -> Iterator[tuple[int, int, int, int]]:
    """What for, length, hash and place of each window by which an item is looked up."""
    if not (n := min(window, len(template))):
        return
    plain = np.concatenate([[0], np.cumsum(~is_slot(template))])
    own = plain[n:] - plain[:-n]
    raw, runs = combine(value, n).tolist(), combine(template, n).tolist()
    for p, h in enumerate(runs):
        rich = own[p] >= min(literals, n)
        yield (TEMPLATE if rich else RAW, n, h if rich else raw[p], p)
    if own.min() < min(literals, n) and own.max() and len(template) >= literals:
        p = int(own.argmax())
        yield (WHOLE, n, runs[p], p)


class Index:
    """Windows of some items, by kind and length of window; ``room`` is the size of a table of hashes' low bits."""

    def __init__(self, items: list[tuple[int, str]], window: int, literals: int, openers: bool = False, room: int = 1 << 12):
        template, value, first = templates([t or "" for _, t in items], openers)
        self.room = U(room - 1)
        self.templates = [template[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.values = [value[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        # windows by (what they are looked up for, length)
        rows: dict[tuple[int, int], list] = {}
        for k, (t, v) in enumerate(zip(self.templates, self.values, strict=True)):
            for kind, n, h, p in windows(t, v, window, literals):
                rows.setdefault((kind, n), []).append((h, k, p))
        self.tables: dict[tuple[int, int], tuple] = {}
        for key, found in rows.items():
            found.sort()
            hashes = np.array([f[0] for f in found], np.uint64)
            maybe = np.zeros(room, bool)
            maybe[(hashes & self.room).astype(np.int64)] = True
            self.tables[key] = (hashes, np.array([f[1] for f in found]), np.array([f[2] for f in found]), maybe)


def _leaks(template: np.ndarray, value: np.ndarray, first: np.ndarray, index: Index, cover: float) -> Iterator[tuple[int, int, int, float, str]]:
    """Text's position, item's position, template words matched, share covered and kind."""
    hits: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
    for (kind, n), (hashes, items, places, maybe) in index.tables.items():
        runs = combine(value if kind == RAW else template, n)
        at = np.flatnonzero(maybe[(runs & index.room).astype(np.int64)])
        low, high = np.searchsorted(hashes, runs[at], "left"), np.searchsorted(hashes, runs[at], "right")
        for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            text = int(np.searchsorted(first, p, "right")) - 1
            if p + n <= first[text + 1]:
                for k in range(a, b):
                    item, offset, places_of = int(items[k]), p - int(places[k]), range(int(places[k]), int(places[k]) + n)
                    if kind == WHOLE:
                        whole = index.templates[item]
                        if offset < first[text] or offset + len(whole) > first[text + 1] or (template[offset : offset + len(whole)] != whole).any():
                            continue
                        places_of = range(len(whole))
                    hits.setdefault((text, item), set()).update((kind, offset, j) for j in places_of)
    for (text, item), found in sorted(hits.items()):
        size = len(index.templates[item])
        # offsets from the best covered on, those of templates first, as long as their slots agree with those before
        by_offset: dict[tuple[int, int], set[int]] = {}
        for kind, offset, place in found:
            by_offset.setdefault((kind, offset), set()).add(place)
        covered: set[int] = set()
        bound: dict[tuple, int] = {}
        same = True
        for (_, offset), own in sorted(by_offset.items(), key=lambda x: (x[0][0], -len(x[1]), x[0][1])):
            if not own - covered:
                continue
            slots, clash = {}, False
            for place in own:
                t = index.templates[item][place]
                if is_slot(np.array([t]))[0]:
                    key, got = (int(t), int(index.values[item][place])), int(value[offset + place])
                    if slots.setdefault(key, bound.get(key, got)) != got:
                        clash = True
            if not clash:
                covered |= own
                bound |= slots
                same &= all(key[1] == got for key, got in slots.items())
        if len(covered) >= cover * size and covered:
            yield text, item, len(covered), len(covered) / size, "verbatim" if same else "reparameterised"


def _key(hashes: np.ndarray, openers: bool, kind: int, n: int) -> np.ndarray:
    """Hashes of windows, told apart by reading, what they are looked up for, and length."""
    return mix(hashes ^ mix(np.array([1 + openers + 2 * kind + 8 * n], np.uint64)))


def _item_windows(window: int, literals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                out = []
                for item, text in zip(part.column(0).to_pylist(), texts_of(part), strict=True):
                    for openers in (False, True):
                        template, value, _ = templates([text], openers)
                        own = {(kind, n, h) for kind, n, h, _ in windows(template, value, window, literals)}
                        out += [(item, openers, kind, n, int(_key(np.array([h], np.uint64), openers, kind, n).view(np.int64)[0])) for kind, n, h in own]
                columns = list(zip(*out, strict=True)) or [()] * 5
                types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item", "openers", "kind", "n", "key"])

    return run


def _probes(forms: list[tuple[bool, int, int]], bitmap: bytes):
    """Documents with windows that pass the bitmap, and the keys of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").view(bool)
        place, number = TaskContext.get().partitionId() << 40, 0
        for whole in batches:
            for part in slices(whole):
                texts, found = texts_of(part), [[] for _ in range(part.num_rows)]
                for openers in (False, True):
                    own = [(kind, n) for o, kind, n in forms if o == openers]
                    if not own:
                        continue
                    template, value, first = templates(texts, openers)
                    for kind, n in own:
                        keys = _key(combine(value if kind == RAW else template, n), openers, kind, n)
                        at = np.flatnonzero(bits[(keys & U(BITS - 1)).astype(np.int64)])
                        text = np.searchsorted(first, at, "right") - 1
                        inside = at + n <= first[text + 1]
                        for t, k in zip(text[inside].tolist(), keys[at[inside]].view(np.int64).tolist(), strict=True):
                            found[t].append(k)
                kept = [i for i, keys in enumerate(found) if keys]
                rows = pa.array(kept, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([place + number + i for i in kept], pa.int64()), part.column(0).take(rows), part.column(1).take(rows), part.column(2).take(rows), pa.array([sorted(set(found[i])) for i in kept], pa.list_(pa.int64()))], ["at", "doc_id", "row", "text", "keys"])
                number += part.num_rows

    return run


def _compare(window: int, literals: int, cover: float):
    """Leaks of each document among its own items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, row, text, items in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                own, best = sorted((i["item"], i["text"]) for i in items), {}
                for openers in (False, True):
                    for _, i, n, c, kind in _leaks(*templates([text or ""], openers), Index(own, window, literals, openers), cover):
                        got = (kind == "verbatim", c, n, kind)
                        best[i] = max(best.get(i, got), got)
                out += [(doc, row, own[i][0], n, c, kind) for i, (_, c, n, kind) in sorted(best.items())]
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "row", "item", "matched", "cover", "kind"])

    return run


FOUND = "doc_id long, row long, item long, matched long, cover double, kind string"


def _found(docs: DataFrame, benchmark: DataFrame, window: int, literals: int, cover: float) -> tuple[DataFrame, DataFrame]:
    """The leaks by row of a document (its key) and text of an item (its hash); and item_id by that hash."""
    spark = docs.sparkSession
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    given = given.withColumn("item", F.xxhash64("text"))
    items = given.groupBy("item").agg(F.min("text").alias("text"))
    known = cut(items.select("item", "text").mapInArrow(_item_windows(window, literals), "item long, openers boolean, kind int, n int, key long"))
    forms = sorted(tuple(r) for r in known.select("openers", "kind", "n").distinct().collect())  # a few for each length of window
    if not forms:
        return spark.createDataFrame([], FOUND), given.select("item", "item_id")
    bits = np.zeros(BITS, bool)
    bits[[r[0] for r in known.select(F.col("key").bitwiseAND(F.lit(BITS - 1)).alias("bit")).distinct().collect()]] = True  # BITS at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", row_key("doc_id", "text").alias("row"), "text")
    probes = cut(rows.mapInArrow(_probes(forms, np.packbits(bits, bitorder="little").tobytes()), "at long, doc_id long, row long, text string, keys array<long>"))
    pairs = probes.select("at", F.explode("keys").alias("key")).join(known.select("key", "item"), "key").select("at", "item").distinct()
    wanted = pairs.join(items, "item").groupBy("at").agg(F.collect_list(F.struct("item", "text")).alias("items"))  # items that share a window with the document
    return probes.select("at", "doc_id", "row", "text").join(wanted, "at").select("doc_id", "row", "text", "items").mapInArrow(_compare(window, literals, cover), FOUND), given.select("item", "item_id")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, literals: int = 4, cover: float = 0.5) -> DataFrame:
    """doc_id, item_id, matched, cover and kind: a row for each document and benchmark item found in it."""
    found, ids = _found(docs, benchmark, window, literals, cover)
    return found.join(ids, "item").select("doc_id", "item_id", "matched", "cover", "kind")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, literals: int = 4, cover: float = 0.5) -> DataFrame:
    """The documents in which no item was found, with their own columns; those without a doc_id are judged too."""
    # documents with leaks: shuffled, as their count grows with the corpus
    bad = _found(docs, benchmark, window, literals, cover)[0].select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    return keyed.join(bad, (F.col("__key") == F.col("__row")) & docs["doc_id"].cast("long").eqNullSafe(F.col("__doc")), "left_anti").drop("__key")
