"""Ranked lexical search of every document for a set of queries: presence-mask grouping.

1. One scan counts each document's terms and keeps those that some query has, as numbers: the postings, written once.
   Documents, terms and document frequencies are sums over them.
2. A scan of the postings takes them in blocks (`Sizes`). A block holds, for each term, the bitmap of its documents,
   their exact contributions to a score and the largest of these.
3. For each query the bitmaps of its terms are turned over into a mask for each document: which of the terms it holds.
   Documents of one mask are a group, whose score is at most the sum of the largest contributions of its terms. Groups are
   scored in descending order of that bound, until it is below the k-th best score that the task has met: what follows
   can't be among the k best (a group that just reaches it is scored, as ties go by id).
4. A task returns k documents a query; the k best of all tasks are ranked. Nothing else is shuffled.

Scores are exact: 64-bit integers, the weights' logarithms apart. Queries are taken in parts of some megabytes,
a scan of the texts each, so what is sent to tasks is bounded for any number of queries.

Rows: null and empty texts hold no term; texts of any length are counted a megabyte at a time; rows of a repeated id are
documents of their own; rows with a null id count in the statistics and aren't ranked. Queries: of a repeated id, the
union of the terms; a null id or no terms: no rows. No documents or no queries: no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravelsift.llm.common import bounded_batches, materialize, stable_bucket

#: Bytes of UTF-8 that belong to no term become spaces; A-Z become a-z; all of a letter beyond ASCII stay.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SLICE = 1 << 20
_POSTINGS = "doc_id long, n long, terms array<int>, counts array<long>"


def words(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    cleaned, at = text.encode("utf-8", "surrogatepass").translate(TERMS), 0
    while at < len(cleaned):
        end = cleaned.find(b" ", at + _SLICE)
        end = len(cleaned) if end < 0 else end
        yield cleaned[at:end].split()
        at = end


def term_counts(text: str | None) -> Counter[bytes]:
    found: Counter[bytes] = Counter()
    for part in words(text or ""):
        found.update(part)
    return found


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (all terms), terms (numbers, those in the vocabulary) and counts of each document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lengths, terms, counts, cuts = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                found = term_counts(text)
                lengths.append(found.total())
                some = found.keys() & known.keys()
                terms += [known[t] for t in some]
                counts += [found[t] for t in some]
                cuts.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _POSTINGS)


@dataclass(frozen=True)
class Sizes:
    """A block's bitmaps and contributions are some 100 MB at most."""

    block_docs: int = 32_768
    block_terms: int = 4_000_000
    bitmap_bytes: int = 32 << 20
    query_bytes: int = 8 << 20  #: of the queries' texts, for one scan
    scored: int = 256  #: documents scored at a time, at least


@dataclass
class Statistics:
    documents: int  #: with at least one term
    terms: int  #: of all of them, with repeats
    weights: np.ndarray  #: of the vocabulary

    @classmethod
    def of(cls, documents: int, terms: int, frequencies: np.ndarray) -> Statistics:
        return cls(documents, terms, np.array([floor(1000 * log((2 * documents + 2) / (2 * f + 1))) for f in frequencies.tolist()], np.int64))

    def share(self, n: np.ndarray) -> np.ndarray:
        """What a document's length does to its terms."""
        return 100 - 50 + (50 * n * self.documents) // max(self.terms, 1)

    def contributions(self, terms: np.ndarray, counts: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


class Block:
    """Documents of a task by term: bitmaps, contributions, the largest of them."""

    def __init__(self, frames: list[pd.DataFrame], statistics: Statistics, size: int):
        self.ids = np.concatenate([f.doc_id.to_numpy(np.int64) for f in frames])
        sizes = np.concatenate([f.terms.map(len).to_numpy(np.int64) for f in frames])
        lengths = np.concatenate([f.n.to_numpy(np.int64) for f in frames])
        terms, counts = (np.concatenate([np.empty(0, np.int64), *(x for f in frames for x in f[c])]).astype(np.int64) for c in ("terms", "counts"))
        docs = np.repeat(np.arange(len(self.ids)), sizes)
        gained = statistics.contributions(terms, counts, np.repeat(statistics.share(lengths), sizes))
        order = np.argsort(terms, kind="stable")  # by term, then by document
        self.docs, self.gained = docs[order], gained[order]
        self.cuts = np.searchsorted(terms[order], np.arange(size + 1))
        self.present = np.zeros((size, -(-len(self.ids) // 8)), np.uint8)  # a bitmap of documents for each term
        np.bitwise_or.at(self.present, (terms, docs // 8), (128 >> (docs % 8)).astype(np.uint8))
        self.most = np.zeros(size, np.int64)
        np.maximum.at(self.most, terms, gained)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct masks over some terms (rows of 0 and 1), the documents by mask, and where each mask's begin."""
        rows = np.packbits(np.unpackbits(self.present[terms], axis=1, count=len(self.ids)), axis=0).T  # a document's mask in bytes
        wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
        wide[:, : rows.shape[1]] = rows
        codes = wide.view(np.uint64)
        order = np.lexsort(codes.T) if codes.shape[1] > 1 else np.argsort(codes[:, 0], kind="stable")
        sorted_codes = codes[order]
        begins = np.concatenate([[0], np.flatnonzero((sorted_codes[1:] != sorted_codes[:-1]).any(axis=1)) + 1, [len(order)]])
        distinct = np.unpackbits(rows[order[begins[:-1]]], axis=1, count=len(terms))
        return distinct, order, begins

    def score(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The exact scores of documents."""
        total = np.zeros(len(docs), np.int64)
        for t in terms.tolist():
            held = self.docs[self.cuts[t] : self.cuts[t + 1]]
            at = np.minimum(np.searchsorted(held, docs), max(len(held) - 1, 0))
            if len(held):
                total += np.where(held[at] == docs, self.gained[self.cuts[t] : self.cuts[t + 1]][at], 0)
        return total

    def best(self, terms: np.ndarray, k: int, ids: np.ndarray, scores: np.ndarray, scored: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of (ids, scores), found so far, and this block's documents."""
        distinct, order, begins = self.masks(terms)
        bound = distinct @ self.most[terms]
        ranked = np.argsort(-bound, kind="stable")
        sizes, at = np.diff(begins)[ranked], 0
        upto = np.cumsum(sizes)
        while at < len(ranked) and (b := bound[ranked[at]]) > 0 and (len(scores) < k or b >= scores[-1]):
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + scored)) + 1
            docs = np.concatenate([order[begins[g] : begins[g + 1]] for g in ranked[at:end].tolist()])
            ids, scores = top(np.concatenate([ids, self.ids[docs]]), np.concatenate([scores, self.score(terms, docs)]), k)
            at = end
        return ids, scores


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0, ties by id."""
    keep = np.flatnonzero(scores > 0)
    if len(keep) > k:
        keep = keep[scores[keep] >= np.partition(scores[keep], len(keep) - k)[len(keep) - k]]
    keep = keep[np.lexsort((ids[keep], -scores[keep]))][:k]
    return ids[keep], scores[keep]


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text", size: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """item_id, rank (from 1), doc_id, score of the k best documents of each query."""
    asked = queries.select(F.col(query_id_col).alias("item_id"), F.col(query_text_col).alias("text")).where("item_id is not null and text is not null")
    kind = asked.schema["item_id"].dataType.simpleString()
    bytes_ = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts, found = ceil(bytes_ / size.query_bytes), None
    for part in range(parts):
        some = _search_part(docs, asked.where(stable_bucket("item_id", parts) == part), k, kind, id_col, text_col, size)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return found


def _search_part(docs: DataFrame, asked: DataFrame, k: int, kind: str, id_col: str, text_col: str, size: Sizes) -> DataFrame:
    spark = docs.sparkSession
    terms_of: dict[object, set[bytes]] = {}
    for row in asked.collect():  # some query_bytes of text
        terms_of.setdefault(row.item_id, set()).update(term_counts(row.text))
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*terms_of.values())))}
    held, _ = materialize(postings(docs, vocabulary, id_col, text_col), "search-postings")
    totals = held.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    frequencies = np.zeros(len(vocabulary), np.int64)
    for row in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the queries
        frequencies[row.t] = row["count"]
    statistics = Statistics.of(totals.documents, totals.terms, frequencies)
    plan = [(i, np.array(sorted(vocabulary[t] for t in own), np.int64)) for i, own in terms_of.items() if own]
    shared = spark.sparkContext.broadcast((statistics, plan, len(vocabulary), size))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        statistics, plan, known, size = shared.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in plan]
        for block in blocks(frames, statistics, known, size):
            for q, (_, terms) in enumerate(plan):
                best[q] = block.best(terms, k, *best[q], size.scored)
        for (item, _), (ids, scores) in zip(plan, best, strict=True):
            if len(ids):
                yield pd.DataFrame({"item_id": item, "doc_id": ids, "score": scores})

    local = held.where("doc_id is not null and size(terms) > 0").mapInPandas(run, f"item_id {kind}, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def blocks(frames: Iterator[pd.DataFrame], statistics: Statistics, known: int, size: Sizes) -> Iterator[Block]:
    """A task's rows as blocks; known: the terms of the vocabulary, of which a row holds each once at most."""
    most = max(1, min(size.block_docs, 8 * size.bitmap_bytes // max(1, known)))
    waiting, rows, entries = [], 0, 0
    for frame in frames:
        step = min(1024, most)
        for at in range(0, len(frame), step):
            part = frame.iloc[at : at + step]
            n = int(part.terms.map(len).sum())
            if waiting and (rows + len(part) > most or entries + n > size.block_terms):
                yield Block(waiting, statistics, known)
                waiting, rows, entries = [], 0, 0
            waiting.append(part)
            rows, entries = rows + len(part), entries + n
    if waiting:
        yield Block(waiting, statistics, known)
