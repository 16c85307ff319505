"""Ranked lexical search by inner products: norm buckets, coordinate bounds, exact integer scores.

Method (after LEMP). A document is a vector of term impacts, an item a vector of term weights, the score their
inner product. Document vectors are ordered by length and cut into buckets. For an item whose k-th best score so
far is `floor`:

1. Cauchy-Schwarz: no vector of a bucket scores more than |item| * (longest vector of the bucket), so
   the bucket is passed over where that is below the floor.
2. Coordinate bounds: inside a bucket the item's heaviest coordinates are summed first. What
   the others can add is bounded twice, by Cauchy-Schwarz over the coordinates that are left and by
   each left coordinate's greatest impact in the bucket. Vectors below the floor go.
3. The rest are scored again from their own coordinates in 64-bit integers.

How it is dealt out. Items are a stated query set: their distinct terms go to the tasks in blocks of whole items
of about `block_terms` terms (one item is never cut), and only these terms make coordinates. One pass
over the documents counts them; document frequencies come from grouping these short vectors. The impacts
are range-partitioned by norm, ties by row, so a much-repeated document is spread, and stored. A first pass over the
longest bucket of each task gives every item a floor, which is a score that k rows reach; the
second pass over all buckets starts from these floors, reads only norms that can reach one, and gives at
most k rows an item from each task. Nothing is dropped that could be among the k best, at any size.

Null texts and texts without terms are no documents: they aren't counted and never found. Items without terms
give no rows; rows that share an item id, null included, are one item with the terms of all. Repeated
documents count and rank as rows of their own; equal scores go by ascending id, null last. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ontide.llm.common import batch_of, input_parts, map_rows, parts, raw
from ontide.llm.decontaminate import item_words
from ontide.session import stage


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    bucket: int = 2048  # vectors a bucket
    block_terms: int = 200_000  # terms of items that are searched at once
    rest_share: float = 0.3  # share of the floor that coordinates beyond the focus may still add


def document_length(n: int, documents: int, terms: int) -> int:
    """A document's m: its terms against the mean, by the ranking's fixed values."""
    return 100 - 90 + (90 * n * documents) // terms


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def item_blocks(items: DataFrame, block_terms: int, id_col: str, text_col: str) -> Iterator[list]:
    """Lists of (item id, distinct terms), one bounded list on the driver at a time."""

    def process():
        def rows(batch):
            for item_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                for term in set(item_words(text)):
                    yield item_id, term

        return rows

    source = items.select(items[id_col].cast("bigint"), items[text_col])
    pairs = map_rows(source, process, "item_id bigint, term binary").distinct()
    block, size = [], 0
    for row in pairs.orderBy("item_id", "term").toLocalIterator():
        if not block or block[-1][0] != row["item_id"]:
            if size >= block_terms:
                yield block
                block, size = [], 0
            block.append((row["item_id"], []))
        block[-1][1].append(bytes(row["term"]))
        size += 1
    if block:
        yield block


VECTORS = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Per document with terms: n, and the numbers and counts of those in the vocabulary."""

    def process():
        known = vocabulary.get

        def rows(batch):
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                words = item_words(text)
                if words:
                    counts = Counter(map(known, words))
                    counts.pop(None, None)
                    yield doc_id, len(words), list(counts), list(counts.values())

        return rows

    return map_rows(docs.select(docs[id_col].cast("bigint"), docs[text_col]), process, VECTORS)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column as one array, and the length of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


IMPACTS = "doc_id bigint, terms array<int>, impacts array<bigint>, norm double"


def impact_vectors(vectors: DataFrame, documents: int, terms: int) -> DataFrame:
    """The vectors that have coordinates, as impacts, with their norm."""
    names = [name for name, _ in parts(IMPACTS)]

    def run(batches):
        for batch in batches:
            tfs, lengths = flat(batch.column(3))
            m = [document_length(n, documents, terms) for n in batch.column(1).to_pylist()]
            values = impacts(tfs.astype(np.int64), np.repeat(np.array(m, np.int64), lengths))
            squares = np.concatenate([[0.0], np.cumsum(values.astype(np.float64) ** 2)])
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            # a running sum's rounding is made good by the slack of every bound
            norms = np.sqrt(np.maximum(squares[offsets[1:]] - squares[offsets[:-1]], 0.0))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists, pa.array(norms)], names)

    return vectors.filter(F.size("terms") > 0).mapInArrow(run, IMPACTS)


class Query:
    """An item's terms, heaviest first, with their weights."""

    def __init__(self, item_id: int | None, weighted: list[tuple[int, int]]):
        ordered = sorted((pair for pair in weighted if pair[1] > 0), key=lambda p: (-p[1], p[0]))
        self.item_id = item_id
        self.terms = np.array([t for t, _ in ordered], np.int64)
        self.weights = np.array([w for _, w in ordered], np.int64)
        squares = self.weights.astype(np.float64) ** 2
        # norm of the coordinates from each one on
        self.left = np.sqrt(np.append(np.cumsum(squares[::-1])[::-1], 0.0))
        self.norm = float(self.left[0])


SLACK = 1 + 1e-9


class Bucket:
    """Vectors of similar length: by rows for exact scores, by coordinates for bounds."""

    def __init__(self, ids: list, terms: np.ndarray, values: np.ndarray, lengths: np.ndarray, vocabulary: int):
        self.ids, self.terms, self.values = ids, terms.astype(np.int64), values
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        rows = np.repeat(np.arange(len(ids)), lengths)
        squares = values.astype(np.float64) ** 2
        self.squares = np.bincount(rows, squares, len(ids))
        self.longest = math.sqrt(self.squares.max(initial=0.0))
        order = np.argsort(self.terms, kind="stable")
        self.by_term, self.rows, self.impacts = self.terms[order], rows[order], values[order]
        self.starts = np.searchsorted(self.by_term, np.arange(vocabulary + 1))
        self.greatest = np.zeros(vocabulary, np.int64)
        np.maximum.at(self.greatest, self.terms, values)

    def survivors(self, query: Query, floor: int, rest_share: float) -> np.ndarray:
        """Rows whose coordinate bounds reach the floor."""
        most = query.weights * self.greatest[query.terms]
        left = np.append(np.cumsum(most[::-1])[::-1], 0)  # what the coordinates from each one on can add
        focus = int(np.argmax(left <= max(0, rest_share * floor)))
        sums = np.zeros(len(self.ids), np.int64)
        seen = np.zeros(len(self.ids))
        for term, w in zip(query.terms[:focus].tolist(), query.weights[:focus].tolist()):
            low, high = self.starts[term], self.starts[term + 1]
            if low < high:
                rows, values = self.rows[low:high], self.impacts[low:high]
                sums[rows] += w * values
                seen[rows] += values.astype(np.float64) ** 2
        lengths = np.sqrt(np.maximum(self.squares - seen, 0.0) + 1e-9 * self.squares)
        rest = np.minimum(query.left[focus] * lengths * SLACK, left[focus])
        reach = sums + rest
        return np.flatnonzero((reach > 0) & (reach * SLACK >= floor))

    def scores(self, query: Query, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of rows from their own coordinates; `weights` is all zeros, by term."""
        weights[query.terms] = query.weights
        lengths = self.offsets[rows + 1] - self.offsets[rows]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.offsets[rows] - (ends - lengths), lengths)
        sums = np.concatenate([[0], np.cumsum(weights[self.terms[at]] * self.values[at])])
        weights[query.terms] = 0
        return sums[ends] - sums[ends - lengths]


def ordered(found: list[tuple]) -> list[tuple]:
    """(score, id) by descending score, then ascending id, null last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1]))


def search_buckets(
    buckets: Iterator[Bucket], queries: list[Query], floors: list[int], vocabulary: int, params: SearchParams
) -> list[list[tuple]]:
    """The k best (score, id) of each query, among those that reach its floor."""
    best: list[list[tuple]] = [[] for _ in queries]
    floors, weights = list(floors), np.zeros(vocabulary, np.int64)
    for bucket in buckets:
        for i, query in enumerate(queries):
            if query.norm * bucket.longest * SLACK < floors[i] or not len(query.terms):
                continue
            rows = bucket.survivors(query, floors[i], params.rest_share)
            if not len(rows):
                continue
            scores = bucket.scores(query, rows, weights)
            good = scores >= max(1, floors[i])
            new = [(s, bucket.ids[r]) for s, r in zip(scores[good].tolist(), rows[good].tolist())]
            if new:
                best[i] = ordered(best[i] + new)[: params.k]
                if len(best[i]) == params.k:
                    floors[i] = max(floors[i], best[i][-1][0])
    return best


FOUND = "item bigint, doc_id bigint, score bigint"


def best_rows(
    vectors: DataFrame,
    queries: list[Query],
    floors: list[int],
    vocabulary: int,
    params: SearchParams,
    first_only: bool = False,
) -> DataFrame:
    """(item, doc_id, score): each task's k best rows for every query; items by their place in `queries`."""
    fields = parts(FOUND)

    def run(batches):
        def buckets():
            for batch in batches:
                for start in range(0, batch.num_rows, params.bucket):
                    piece = batch.slice(start, params.bucket)
                    terms, lengths = flat(piece.column(1))
                    values, _ = flat(piece.column(2))
                    yield Bucket(piece.column(0).to_pylist(), terms, values, lengths, vocabulary)
                    if first_only:
                        return

        best = search_buckets(buckets(), queries, floors, vocabulary, params)
        yield batch_of([(i, doc_id, score) for i, rows in enumerate(best) for score, doc_id in rows], fields)
        for _ in batches:  # the rest of the task's input
            pass

    # a task may hold several files; their buckets keep the order of norms inside each
    return vectors.select("doc_id", "terms", "impacts").mapInArrow(run, FOUND)


def k_best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, block: list, params: SearchParams, id_col: str, text_col: str) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block of items."""
    vocabulary = {term: i for i, term in enumerate(sorted({t for _, terms in block for t in terms}))}
    vectors = stage(term_vectors(docs, vocabulary, id_col, text_col))
    totals = vectors.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    documents, terms = totals["documents"], totals["terms"] or 0
    counted = vectors.select(F.explode("terms").alias("term")).groupBy("term").count()
    df = {row["term"]: row["count"] for row in counted.toLocalIterator()}  # a block's terms at most
    queries = [
        Query(item, [(vocabulary[t], weight(df[vocabulary[t]], documents)) for t in own if vocabulary[t] in df])
        for item, own in block
    ]
    norms = impact_vectors(vectors, documents, max(1, terms))
    spread = norms.withColumn("row", F.monotonically_increasing_id())
    order = [F.desc("norm"), "row"]
    ranged = spread.repartitionByRange(input_parts(vectors), *order).sortWithinPartitions(*order)
    stored = stage(ranged.drop("row"))
    size = len(vocabulary)
    # floors: scores that k rows of the longest buckets reach
    first = best_rows(stored, queries, [0] * len(queries), size, params, first_only=True)
    full = k_best(first, params.k).filter(F.col("rank") == params.k).select("item", "score")
    floors = [0] * len(queries)
    for row in full.toLocalIterator():
        floors[row["item"]] = row["score"]
    # Cauchy-Schwarz as a filter of the scan: no shorter vector can reach any item's floor
    shortest = min((f / q.norm for f, q in zip(floors, queries) if q.norm), default=0.0) / SLACK**2
    rows = best_rows(stored.filter(F.col("norm") >= shortest), queries, floors, size, params)
    ids = docs.sparkSession.createDataFrame(
        [(i, query.item_id) for i, query in enumerate(queries)], "item bigint, item_id bigint"
    )
    best = k_best(rows, params.k).join(ids, "item")  # one small row an item of the block
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_documents(
    docs: DataFrame,
    items: DataFrame,
    params: SearchParams = SearchParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for every item."""
    out = None
    for block in item_blocks(items, params.block_terms, item_id_col, item_text_col):
        rows = stage(search_block(docs, block, params, id_col, text_col))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        schema = "item_id bigint, rank int, doc_id bigint, score bigint"
        return docs.sparkSession.createDataFrame([], schema)
    return out
