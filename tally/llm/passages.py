"""Documents that share a passage of many words with another document.

A passage is a run of ``WORDS`` words, without regard to case and what stands
between them. Each run has an anchor: the place in it whose hash of ``GRAM`` words
is least. Neighbouring runs mostly share theirs, so a document becomes a short list
of stretches, each one anchor's runs. A stretch that is equal as a whole in two
documents is a shared passage. Of anchors with several stretches one of each is
looked at again, and its runs are told by their hashes. Hashes have 64 bits; counts
are aggregated before they are shuffled, and no group is gathered anywhere.

Null, empty and short texts share nothing; rows that agree in doc_id and text are
one document. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, release, row_key, slices, texts_of, trimmed
from .suffix_dedup import sliding_least
from .wordhash import BASE, U, combine, join, powers, span_hash, words

WORDS, GRAM = 51, 16


class Runs:
    """The stretches of some texts: text, first and last run, hash of the anchor and of the whole."""

    def __init__(self, texts: list[str], n: int, gram: int):
        data, bounds = join(texts)
        start, _, hashes = words(data)
        first = np.searchsorted(start, bounds)
        self.n, self.sums = n, np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(BASE, len(hashes)), out=self.sums[1:])
        count = max(0, len(hashes) - n + 1)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))[:count]
        at = np.flatnonzero(np.arange(count) + n <= first[1:][owner])
        if not len(at):
            self.text = self.first = self.last = np.empty(0, np.int64)
            self.anchor = self.name = np.empty(0, np.uint64)
            return
        grams = combine(hashes, gram)
        rank = (grams & ~U(0xFFFFFFFF)) | (U(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
        anchor = (U(0xFFFFFFFF) - (sliding_least(rank, n - gram + 1) & U(0xFFFFFFFF))).astype(np.int64)[at]
        owner = owner[at]
        begins = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
        self.text, self.first, self.last = owner[begins], at[begins], at[np.concatenate([begins[1:], [len(at)]]) - 1]
        self.anchor, self.name = grams[anchor[begins]], span_hash(self.sums, self.first, self.last + n)

    def hashes(self, stretch: int) -> np.ndarray:
        """The hashes of a stretch's runs."""
        at = np.arange(self.first[stretch], self.last[stretch] + 1)
        return span_hash(self.sums, at, at + self.n)


def _stretches(n: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                runs = Runs(texts_of(part), n, gram)
                yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[runs.text]), pa.array(runs.anchor.view(np.int64)), pa.array(runs.name.view(np.int64))], ["row", "anchor", "name"])

    return run


def _runs(n: int, gram: int):
    """Hashes of the runs of some of each text's stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                runs = Runs(texts_of(part), n, gram)
                own = [{k["name"]: k["settled"] for k in kinds} for kinds in part.column(2).to_pylist()]
                rows, out = part.column(0).to_pylist(), []
                for i, (t, name) in enumerate(zip(runs.text.tolist(), runs.name.view(np.int64).tolist(), strict=True)):
                    if (settled := own[t].pop(name, None)) is not None:
                        out.append((rows[t], name, settled, runs.hashes(i).view(np.int64)))
                sizes = [len(x[3]) for x in out]
                columns = [pa.array(np.repeat(np.array([x[k] for x in out], kind), sizes)) for k, kind in ((0, np.int64), (1, np.int64), (2, bool))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([*(x[3] for x in out), np.empty(0, np.int64)]))], ["row", "name", "settled", "run"])

    return run


def sharing(docs: DataFrame, n: int = WORDS, gram: int = GRAM) -> DataFrame:
    """row (the key of doc_id and text) of the documents that hold a run of ``n`` words which another one holds too."""
    spark = docs.sparkSession
    rows = docs.select(row_key("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    found = cut(rows.mapInArrow(trimmed(_stretches(n, gram)), "row long, anchor long, name long"))
    kinds = cut(found.groupBy("anchor", "name").agg(F.min("row").alias("row"), (F.min("row") < F.max("row")).alias("settled")))
    release(spark)
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("settled").alias("all")).where((F.col("n") > 1) & ~F.col("all")).select("anchor")
    wanted = cut(kinds.join(several, "anchor").groupBy("row").agg(F.collect_list(F.struct("name", "settled")).alias("kinds")))  # no more than the row's own stretches
    each = cut(rows.join(wanted, "row").dropDuplicates(["row"]).select("row", "text", "kinds").mapInArrow(trimmed(_runs(n, gram)), "row long, name long, settled boolean, run long"))
    release(spark)
    again = each.groupBy("run").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.max("settled").alias("settled")).where((F.col("low") < F.col("high")) | F.col("settled")).select("run")
    names = kinds.where("settled").select("name").unionByName(each.join(again, "run").select("name"))
    out = cut(found.join(names.distinct(), "name").select("row").distinct())
    for done in (found, kinds, wanted, each):
        drop_cut(done)
    release(spark)
    return out
