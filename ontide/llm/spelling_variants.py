"""Groups spelling variants: words one inserted, deleted or replaced letter apart, by search schemes on FM-indexes.

Method. Two words are near if one edit turns one into the other. Of a word of p letters either half then stays as it is:
the scheme matches one half exactly and extends over the other with one error. Both run on an FM-index
of the delimited vocabulary, which maps a string and a letter before it to intervals of suffix ranks.
The index of the words is read from right to left, for an exact right half; the index of the mirrored words serves
an exact left half. A match is a word where its interval has a delimiter in front. An insertion
counts at the one place where it parts the longest common beginning, so each pair is found once.

How it is dealt out. A search is known by (p, window): the error lies in the window of the shorter word's letters, all
outside is exact. Words of p and p + 1 letters with the same letters outside share a key, so they
can be searched apart from all others, and keys are packed into blocks of about `block_letters`; each block has
its own indexes. A key with more letters than that is dealt again with its window halved, which
splits it by further letters, until it fits or the window is one letter, where a key has few words by itself. A word is in
at most four keys, twice as many for each halving. Each block gives one row a word: how many near words it found
and the best of them; pairs aren't written. Forms are followed to their last by joining the
links with themselves, which doubles their reach each time; counts grow fivefold a link, so rounds are few.

Words are runs of Latin letters (to U+00FF), only A-Z lower-cased; each code point is a byte of Latin-1. A null text
has no words, a null id counts as empty text. Repeated rows count as often as they occur. Words of
any length are indexed whole. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ontide.llm.common import ASCII_LOWER, SLICE_ROWS, batch_of, input_parts, map_rows, parts, raw
from ontide.session import stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")


@dataclass(frozen=True)
class SpellingParams:
    least_letters: int = 6
    least_count: int = 5
    ratio: int = 5  # how many times a word's count its form must have
    block_letters: int = 1 << 19
    flush_words: int = 200_000  # words of a task's table before it is sent
    flush_letters: int = 1 << 24


# --- Words


def with_slip(doc_id: bytes, run: str, one_in: int) -> str:
    """The run, without one letter where the hash of document and run says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc_id + b":"))
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(
    docs: DataFrame,
    params: SpellingParams = SpellingParams(),
    slip_one_in: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, n) of all documents, from `least_letters` and `least_count` on. `slip_one_in` plants a lost
    letter in one of so many (document, word), as a known source of variants."""
    fields = parts("word string, n bigint")

    def run(batches):
        table, letters = Counter(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(start, SLICE_ROWS)
                for doc_id, data in zip(piece.column(0).to_pylist(), raw(piece.column(1))):
                    if not data:
                        continue
                    own = b"" if doc_id is None else str(doc_id).encode()
                    for word, n in Counter(RUN.findall(data.translate(ASCII_LOWER).decode())).items():
                        if len(word) < params.least_letters:
                            continue
                        if slip_one_in:
                            word = with_slip(own, word, slip_one_in)
                            if len(word) < params.least_letters:
                                continue
                        if word not in table:
                            letters += len(word)
                        table[word] += n
                if len(table) >= params.flush_words or letters >= params.flush_letters:
                    yield batch_of(list(table.items()), fields)
                    table, letters = Counter(), 0
        yield batch_of(list(table.items()), fields)

    found = docs.select(docs[id_col], docs[text_col]).mapInArrow(run, "word string, n bigint")
    counts = found.groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= params.least_count)


# --- Index


class Index:
    """FM-index of delimited words: rows are the words' endings in order, 0 is the delimiter."""

    def __init__(self, words: list[bytes]):
        text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        present = np.unique(text)
        code = np.zeros(256, np.int64)
        code[present] = np.arange(len(present))
        self.code, self.letters = code, np.arange(1, len(present))
        symbols = code[text]
        self.size = len(text)
        self.delimiters = np.flatnonzero(text == 0)
        order = self._ordered(symbols)
        before = np.where(order > 0, symbols[order - 1], 0)
        by_symbol = np.argsort(before, kind="stable")
        # symbol and row as one number; how many lie below one is the row that the symbol in front leads to
        self.keys = before[by_symbol] * self.size + by_symbol
        starts = order[by_symbol[: len(self.delimiters)]]  # rows with a delimiter in front start a word
        self.words = np.searchsorted(self.delimiters, starts) - 1

    def _ordered(self, symbols: np.ndarray) -> np.ndarray:
        """Places of all endings, each up to its delimiter, in order; equal ones by place. Doubles prefixes."""
        places = np.arange(self.size)
        left = self.delimiters[np.searchsorted(self.delimiters, places)] - places
        rank, reach = symbols, 1
        while reach <= left.max():
            further = np.where(left >= reach, rank[np.minimum(places + reach, self.size - 1)], 0)
            rank = np.unique(rank * (rank.max() + 1) + further, return_inverse=True)[1]
            reach *= 2
        return np.argsort(rank, kind="stable")

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the strings with a symbol put in front."""
        base = symbol * self.size
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def complete(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which intervals hold a whole word, and the word."""
        n = len(self.delimiters)
        at = np.searchsorted(self.keys[:n], low)
        found = (at < n) & (self.keys[np.minimum(at, n - 1)] < high)
        return found, self.words[np.minimum(at, n - 1)]


def near_words(index: Index, queries: np.ndarray, low: int, high: int, mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row of `queries`, word) of all words one error away, the error in letters low to high.

    A row of `queries` is a word's symbols. An insertion before letter a belongs to the window if a does, at the
    word's end if the window ends there; in mirrored words the same places count from the other end.
    """
    count, p = queries.shape
    own = np.arange(count)
    exact = np.zeros(count, np.int64), np.full(count, len(index.delimiters))
    alive = [np.empty(0, np.int64)] * 3  # query, interval: with the error made

    def branches():
        letters = np.broadcast_to(index.letters, (count, len(index.letters)))
        first, last = index.extend(exact[0][:, None], exact[1][:, None], letters)
        return first, last, letters

    def joined(branch, forbidden):
        first, last, letters = branch
        good = first < last
        if forbidden is not None:
            good &= letters != forbidden[:, None]
        query, letter = np.nonzero(good)
        new = query, first[query, letter], last[query, letter]
        return [np.concatenate([a, b]) for a, b in zip(alive, new)]

    def inserts(a):
        if mirrored:
            return low < a <= high or a == low == 0
        return low <= a < high or a == high == p

    def parted(a):
        """The letter that an inserted one must differ from, so that only one place counts."""
        if mirrored:
            return queries[:, a - 1] if a else None
        return queries[:, a] if a < p else None

    for j in range(p - 1, -1, -1):
        letter, replaces = queries[:, j], low <= j < high
        branch = branches() if replaces or inserts(j + 1) else None
        if inserts(j + 1):
            alive = joined(branch, parted(j + 1))
        first, last = index.extend(alive[1], alive[2], letter[alive[0]])
        good = first < last
        alive = [alive[0][good], first[good], last[good]]
        if replaces:
            alive = joined(branch, letter)
        exact = index.extend(*exact, letter)
    if inserts(0):
        alive = joined(branches(), parted(0))
    found, words = index.complete(alive[1], alive[2])
    return own[alive[0][found]], words[found]


# --- Dealing out


def windows(p: int) -> list[tuple[int, int]]:
    """The two halves of p letters."""
    return [(0, p // 2), (p // 2, p)]


def is_mirrored(p: int, low: int, high: int) -> bool:
    """The longer exact side is matched first; it is the left one in mirrored words."""
    return low > p - high


def search_key(word: str, p: int, low: int, high: int) -> int:
    """Hash of the letters outside the window, for a word of p or p + 1 letters."""
    outside = f"{p}:{low}:{high}:{word[:low]}|{word[high + len(word) - p :]}"
    return int.from_bytes(hashlib.blake2b(outside.encode(), digest_size=8).digest(), "little", signed=True)


SEARCHES = "word string, n bigint, p int, low int, high int, key bigint"


def first_searches(words: DataFrame, least_letters: int) -> DataFrame:
    """The searches by halves of each word: as the shorter or an equally long one, and as the longer."""

    def process():
        def rows(batch):
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p in (len(word), len(word) - 1):
                    if p >= least_letters:
                        for low, high in windows(p):
                            yield word, n, p, low, high, search_key(word, p, low, high)

        return rows

    return map_rows(words.select("word", "n"), process, SEARCHES)


def halved_searches(searches: DataFrame) -> DataFrame:
    def process():
        def rows(batch):
            for word, n, p, low, high in zip(*(batch.column(i).to_pylist() for i in range(5))):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle, high)):
                    yield word, n, p, a, b, search_key(word, p, a, b)

        return rows

    return map_rows(searches.select("word", "n", "p", "low", "high", "key"), process, SEARCHES)


def fitting_searches(words: DataFrame, params: SpellingParams) -> DataFrame:
    """Searches whose keys fit a block each, large ones dealt again with half the window."""
    searches = stage(first_searches(words, params.least_letters))
    out = None
    while True:
        sizes = searches.groupBy("key").agg(
            F.sum(F.length("word")).alias("letters"), F.max(F.col("high") - F.col("low")).alias("width")
        )
        large = stage(sizes.filter((F.col("letters") > params.block_letters) & (F.col("width") > 1)).select("key"))
        last = large.isEmpty()
        fits = searches if last else searches.join(large, "key", "left_anti")
        fits = fits.select("word", "n", "p", "low", "high", "key")
        out = fits if out is None else out.unionByName(fits)
        if last:
            return out
        searches = stage(halved_searches(searches.join(large, "key", "left_semi")))


NEAR = "word string, n_near bigint, best_n bigint, best string"


def block_matches(rows: pa.Table, batch_queries: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    """(word, near word, words, counts) of the searches of one block, for each index."""
    table = {name: rows.column(name).to_pylist() for name in rows.column_names}
    for mirrored in (False, True):
        chosen = [
            i for i, key in enumerate(zip(table["p"], table["low"], table["high"])) if is_mirrored(*key) == mirrored
        ]
        if not chosen:
            continue
        counts = {table["word"][i].encode("latin-1"): table["n"][i] for i in chosen}
        words = sorted(counts)
        number = {word: i for i, word in enumerate(words)}
        index = Index([word[::-1] for word in words] if mirrored else words)
        groups: dict[tuple[int, int, int], set[bytes]] = {}
        for i in chosen:
            word, p = table["word"][i].encode("latin-1"), table["p"][i]
            if len(word) == p:
                low, high = table["low"][i], table["high"][i]
                if mirrored:
                    low, high = p - high, p - low
                groups.setdefault((p, low, high), set()).add(word)
        found = []
        for (p, low, high), members in sorted(groups.items()):
            queries = sorted(members)
            at = np.array([number[word] for word in queries])
            # long words go in smaller batches
            step = max(1, min(batch_queries, (1 << 22) // p))
            for start in range(0, len(queries), step):
                some = queries[start : start + step]
                symbols = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), p)
                symbols = index.code[symbols[:, ::-1] if mirrored else symbols]
                query, near = near_words(index, symbols, low, high, mirrored)
                query = at[start + query]
                longer = np.fromiter((len(words[w]) > p for w in near.tolist()), bool, len(near))
                # equally long words find each other, longer ones are found by the shorter alone
                found.append((np.append(query, near[longer]), np.append(near, query[longer])))
        if found:
            one, other = (np.concatenate(column) for column in zip(*found))
            yield one, other, words, np.array([counts[word] for word in words])


def near_counts(searches: DataFrame, params: SpellingParams) -> DataFrame:
    """(word, n_near, best_n, best): near words and the best of them, a row a word and block."""
    fields = parts(NEAR)

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for one, other, words, counts in block_matches(rows):
            order = np.lexsort((other, -counts[other], one))
            one, other = one[order], other[order]
            first = np.flatnonzero(np.diff(one, prepend=-1))
            sizes = np.diff(np.append(first, len(one)))
            for word, best, size in zip(one[first].tolist(), other[first].tolist(), sizes.tolist()):
                out.append((words[word].decode("latin-1"), size, int(counts[best]), words[best].decode("latin-1")))
        return pa.Table.from_batches([batch_of(out, fields)])

    letters = searches.agg(F.sum(F.length("word"))).first()[0] or 0
    blocks = max(1, -(-2 * letters // params.block_letters))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    rows = searches.select("word", "n", "p", "low", "high", block).repartition(blocks, "block")
    return rows.groupBy("block").applyInArrow(run, NEAR)


# --- Forms


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends, for words that have a form."""
    reached = stage(links.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage(reached.join(further, "root", "left").select("word", "root", "next"))
        reached = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter("next is not null").isEmpty():
            return reached


def spelling_groups(words: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct words (word, n)."""
    words = stage(words.select("word", "n"))
    near = near_counts(fitting_searches(words, params), params).groupBy("word")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))).alias("best")
    counted = words.join(near.agg(F.sum("n_near").alias("n_near"), best), "word", "left")
    strong = -F.col("best.less") >= params.ratio * F.col("n")
    rows = stage(
        counted.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(strong, F.col("best.form")).alias("form"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        )
    )
    ends = roots(rows.filter("form is not null"))
    joined = rows.join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
