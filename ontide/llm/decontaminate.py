"""Benchmark decontamination with the multi-pattern search of Wu and Manber, over words.

A pattern is a window of ten words of a benchmark item, or a whole shorter item. Patterns of a length class
share a shift table: for every block of two words, how far the search may jump, which is the
smallest distance of such a block to the end of any pattern. Where the shift is 0, the block's
bucket lists the patterns that end with it; a second key, the pattern's first words, sorts out
most of them, and direct comparison of the words confirms an occurrence. Full windows and
shorter items are searched apart, so that one short item doesn't shorten every jump.

The benchmark is a stated query set. It is sent to the tasks in blocks of at most `block_windows`
windows; each block passes over all documents, and the passes are combined per row.

Null texts and texts without words have no words and match nothing; an item without words is no
pattern. Repeated items count by their id, repeated documents are searched alike, empty tables give
no rows or no hits. A null item id isn't listed. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ontide.llm.common import map_rows, raw
from ontide.session import stage

WINDOW = 10

# The bytes of words: digits, letters and all beyond ASCII; A-Z become a-z, the rest parts words.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def item_words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


class WindowSearch:
    """Shift tables, suffix buckets and comparison for word windows with the ids of their items."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[int]]):
        self.windows = windows
        classes = defaultdict(list)
        for window in windows:
            classes[len(window) == WINDOW].append(window)
        self.classes = [self._tables(patterns) for patterns in classes.values()]

    @staticmethod
    def _tables(patterns):
        least = min(map(len, patterns))
        block = min(2, least)
        longest_jump = least - block + 1
        shift, buckets = {}, defaultdict(lambda: defaultdict(list))
        for pattern in patterns:
            head = pattern[:least]  # the searched part of longer patterns
            for end in range(block, least + 1):
                key = head[end - block : end]
                jump = least - end
                if jump < shift.get(key, longest_jump):
                    shift[key] = jump
            buckets[head[-block:]][pattern[0]].append(pattern)
        return least, block, longest_jump, shift, {k: dict(v) for k, v in buckets.items()}

    def occurrences(self, words: list[bytes]):
        """(start, window) of every occurrence."""
        n = len(words)
        for least, block, longest_jump, shift, buckets in self.classes:
            get, at = shift.get, least - block  # where the block starts
            while at + block <= n:
                key = tuple(words[at : at + block])
                jump = get(key, longest_jump)
                if jump:
                    at += jump
                    continue
                start = at + block - least
                for pattern in buckets[key].get(words[start], ()):
                    stop = start + len(pattern)
                    if stop <= n and tuple(words[start:stop]) == pattern:
                        yield start, pattern
                at += 1

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Covered runs (start, end) of words in order, and the items that occur."""
        found = sorted((start, start + len(window), window) for start, window in self.occurrences(words))
        runs, items = [], set()
        for start, stop, window in found:
            items.update(self.windows[window])
            if runs and start <= runs[-1][1]:
                runs[-1][1] = max(stop, runs[-1][1])
            else:
                runs.append([start, stop])
        return [tuple(run) for run in runs], items


def item_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, window): the distinct windows of the items, words joined by a space."""

    def process():
        def rows(batch):
            for item_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                words = item_words(text)
                size = min(WINDOW, len(words))
                if size and item_id is not None:
                    for window in {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}:
                        yield item_id, b" ".join(window)

        return rows

    source = benchmark.select(benchmark[id_col].cast("bigint"), benchmark[text_col])
    return map_rows(source, process, "item_id bigint, window binary").distinct()


def window_blocks(benchmark: DataFrame, block_windows: int, id_col: str, text_col: str):
    """The windows with their items in blocks of bounded size, one block on the driver at a time."""
    windows = item_windows(benchmark, id_col, text_col)
    block: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
    size = 0
    for row in windows.orderBy("window", "item_id").toLocalIterator():
        key = tuple(bytes(row["window"]).split())
        if size >= block_windows:
            yield dict(block)
            block, size = defaultdict(list), 0
        block[key].append(row["item_id"])
        size += 1
    if size:
        yield dict(block)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_windows: int = 200_000,
    keep_text: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per document: n_words, spans (start and end of hit runs of words, flat), items, (`keep_text`) the
    text, and the columns that `carry` names.

    With one block the documents are read once and nothing is shuffled. With more, every block
    adds its findings to the rows in a further pass over them, stored before the next.
    """
    fields = "doc_id bigint, n_words bigint, spans array<bigint>, items array<bigint>, text string"
    start = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        docs[text_col].alias("text"),
        F.lit(None).cast("array<bigint>").alias("spans"),
        F.lit(None).cast("array<bigint>").alias("items"),
        *(docs[c] for c in carry),
    )
    blocks = window_blocks(benchmark, block_windows, item_id_col, item_text_col)
    windows = next(blocks, {})
    while windows is not None:
        following = next(blocks, None)

        def process(windows=windows, with_text=keep_text or following is not None):
            search = WindowSearch(windows)

            def rows(batch):
                ids, old_spans, old_items = (batch.column(i).to_pylist() for i in (0, 2, 3))
                texts = raw(batch.column(1))
                strings = batch.column(1).to_pylist() if with_text else [None] * len(ids)
                for doc_id, data, string, had, knew in zip(ids, texts, strings, old_spans, old_items):
                    words = item_words(data)
                    runs, items = search.hits(words)
                    spans = merged(had or [], [x for run in runs for x in run])
                    yield doc_id, len(words), spans, sorted(items | set(knew or ())), string

            return rows

        start = map_rows(start.select("doc_id", "text", "spans", "items", *carry), process, fields, carry)
        if following is not None:
            start = stage(start)
        windows = following
    return start if keep_text else start.drop("text")


def merged(first: list[int], second: list[int]) -> list[int]:
    """Union of two flat lists of runs."""
    if not first or not second:
        return first or second
    runs = sorted([*zip(first[::2], first[1::2]), *zip(second[::2], second[1::2])])
    out = [list(runs[0])]
    for start, stop in runs[1:]:
        if start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [x for run in out for x in run]


def leak_report(leaks: DataFrame) -> DataFrame:
    """Counts and digest per document of `find_leaks`."""
    run = F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2))
    lengths = F.transform(run, lambda i: F.get("spans", i + 1) - F.get("spans", i))
    n_hit = F.when(F.size("spans") > 0, F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x))
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return leaks.select(
        "doc_id",
        "n_words",
        F.coalesce(n_hit, F.lit(0)).cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
