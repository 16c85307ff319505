"""Removes bytes of repeated 400-byte strings, found with enhanced suffix arrays.

Method. Suffixes that begin alike are sorted; the sorted order with the common-prefix lengths of neighbours is an
enhanced suffix array. A stack scan lists its common-prefix intervals, and within each interval
the strings to the left are compared: where left extensions differ, a repeat can't be
extended for all its occurrences, so each interval gives the maximal repeat groups with all their
occurrences, not just pairs of neighbours.

How it is dealt out. In every 400-byte window the 24-byte string with the smallest hash (the leftmost
of equals) is the window's anchor. It depends on the window's bytes alone, so equal windows have equal anchors
at equal offsets. An anchor owns a run of windows, about 190; its context is their bytes. Only anchors
whose hash occurs twice or more keep their contexts, and a bucket is the suffixes of one hash: it
finds every repeated window that its anchors own. A hash of more than `chunk` occurrences is hot. Its
equal contexts become one class first, combined before the shuffle. Then its classes are dealt by the bytes that
equal windows must share: windows that start `low` to `high` bytes before the anchor agree in the `low`
bytes left and the `length - high` bytes right of its start. Two halves of the offsets make two
rows a class; a bucket that is still large is halved again, down to one offset. Classes of a bucket that have equal
bytes in all windows of its offsets repeat there whole, and one of them goes on: near copies stay apart only in the
halves where they differ. So every bucket that is searched is small, and rows grow with the classes, not with their
pairs.

Equal texts are one class from the start: of 400 bytes or more they are removed whole, and one of them
is searched for the others' sake. A document's own equal contexts are matched on the spot.

Null texts count as empty: no bytes, none removed. Texts under 400 bytes are kept whole. Strings are judged
on the input, matches never cross rows, and a row's own repeats count. Rows with null or
repeated ids are rows like others. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ontide.llm.common import batch_of, map_rows, parts, raw
from ontide.session import stage

GRAM = 24
SEGMENT = 4 << 20
PLACE_BITS = 24


@dataclass(frozen=True)
class RepeatParams:
    length: int = 400
    chunk: int = 256


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of the 24 bytes from every place."""
    n = len(data) - GRAM + 1

    def eight(offset):
        return np.ndarray((n,), "<u8", data, offset, (1,))

    x = eight(0) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += eight(8)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x += eight(16)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """hash, place, first and last owned window of a text's anchors; long texts go by segments."""
    found = []
    for start in range(0, max(1, len(data) - length + 1), SEGMENT):
        piece = data[start : start + SEGMENT + length - 1]
        windows = len(piece) - length + 1
        if windows < 1:
            break
        hashes, width = gram_hashes(piece), length - GRAM + 1
        high = ~np.uint64((1 << PLACE_BITS) - 1)
        values = (hashes & high) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(values)] = values
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows])
        place = (least & ~high).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], windows) - 1
        at = place[first]
        found.append((hashes[at], at + start, first + start, last + start))
    if not found:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(column) for column in zip(*found))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def prefix_intervals(common: list[int]):
    """(length, first, last) of the common-prefix intervals of a suffix array, by one stack scan.

    `common[i]` is the common prefix of the suffixes i and i + 1.
    """
    stack: list[tuple[int, int]] = []  # common prefix, first suffix
    for i, length in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > length:
            depth, first = stack.pop()
            yield depth, first, i
        if not stack or stack[-1][0] < length:
            stack.append((length, first))


@dataclass
class Occurrence:
    """An anchor's context: the bytes right of the anchor's start, and those left of it, backwards."""

    text_key: bytes
    place: int
    right: bytes
    left: bytes
    before: int = 0  # how far repeats reach to the left and to the right
    after: int = 0


def maximal_repeats(members: list[Occurrence], length: int):
    """(left, right, occurrences) of the maximal repeats of `length` bytes or more around an anchor."""
    if len(members) == 2:
        one, two = members
        right, left = common_prefix(one.right, two.right), common_prefix(one.left, two.left)
        if left + right >= length:
            yield left, right, members
        return
    array = sorted(members, key=lambda m: m.right)
    common = [common_prefix(array[i].right, array[i + 1].right) for i in range(len(array) - 1)]
    for right, first, last in prefix_intervals(common):
        need = length - right
        group = sorted(array[first : last + 1], key=lambda m: m.left)
        if need > max(len(m.left) for m in group):
            continue
        shared = [common_prefix(group[i].left, group[i + 1].left) for i in range(len(group) - 1)]
        # left extensions: where they differ a group ends, and what it has in common is maximal
        for left, low, high in prefix_intervals(shared):
            if left >= need:
                yield left, right, group[low : high + 1]


def mark_repeats(members: list[Occurrence], length: int) -> None:
    for left, right, group in maximal_repeats(members, length):
        for member in group:
            member.before = max(member.before, left)
            member.after = max(member.after, right)


ANCHORS = "hash bigint, text_key binary, place bigint, first bigint, last bigint"


def anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    """Anchors of the texts (text_key, text) of `length` bytes or more."""
    names = [name for name, _ in parts(ANCHORS)]

    def run(batches):
        for batch in batches:
            keys, columns, rows = batch.column(0), [], []
            for i, data in enumerate(raw(batch.column(1))):
                if data is not None and len(data) >= length:
                    columns.append(anchors(data, length))
                    rows.append(np.full(len(columns[-1][0]), i))
                if len(rows) >= 512 or (rows and i == batch.num_rows - 1):
                    yield made(keys, columns, rows)
                    columns, rows = [], []
            if rows:
                yield made(keys, columns, rows)

    def made(keys, columns, rows):
        hashes, places, first, last = (np.concatenate(c) for c in zip(*columns))
        arrays = [hashes.view(np.int64), keys.take(pa.array(np.concatenate(rows))), places, first, last]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)

    return keyed.select("text_key", "text").mapInArrow(run, ANCHORS)


CONTEXTS = "hash bigint, mark binary, text_key binary, place bigint, lead bigint, context binary, stop bigint"


def context_rows(texts: DataFrame, length: int) -> DataFrame:
    """Contexts of shared anchors (column anchors of `texts`), with the digest of each. Rows without context
    are finished runs from `place` to `stop`."""

    def process():
        def rows(batch):
            keys, lists = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for key, data, listed in zip(keys, raw(batch.column(1)), lists):
                own = defaultdict(list)
                for anchor in listed:
                    first, last = anchor["first"], anchor["last"] + length
                    lead = anchor["place"] - first
                    own[anchor["hash"], lead, data[first:last]].append(first)
                for (number, lead, context), firsts in own.items():
                    mark = hashlib.blake2b(b"%d:%d:" % (number, lead) + context, digest_size=16).digest()
                    yield number, mark, key, firsts[0] + lead, lead, context, None
                    if len(firsts) > 1:
                        for first in firsts:
                            yield None, None, key, first, None, None, first + len(context)

        return rows

    return map_rows(texts.select("text_key", "text", "anchors"), process, CONTEXTS)


RUNS = "text_key binary, start bigint, stop bigint"


def bucket_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """Runs (start, stop) of bytes that repeat among the contexts of a hash."""
    fields = parts(RUNS)

    def run(batches):
        current, members = None, []

        def finished():
            if len(members) > 1:
                mark_repeats(members, length)
            for m in members:
                if m.before + m.after:
                    yield m.text_key, m.place - m.before, m.place + m.after

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            out = []
            for number, key, place, lead, context, stop in zip(*columns):
                if context is None:
                    out.append((key, place, stop))
                    continue
                if number != current:
                    out += finished()
                    current, members = number, []
                members.append(Occurrence(key, place, context[lead:], context[:lead][::-1]))
            yield batch_of(out, fields)
        yield batch_of(list(finished()), fields)

    # finished runs have no hash; they are dealt by their text
    salt = F.when(F.col("context").isNull(), F.xxhash64("text_key", "place"))
    rows = contexts.select("hash", "text_key", "place", "lead", "context", "stop")
    return rows.repartition("hash", salt).sortWithinPartitions("hash").mapInArrow(run, RUNS)


SHARED = "mark binary, low bigint, high bigint, key binary, span binary, before bigint, after bigint, lead bigint, context binary"


def shared_rows(classes: DataFrame, length: int) -> DataFrame:
    """The two halves of each (low, high), with the digest of what windows in it share and that of all bytes they
    lie in, `before` and `after` the anchor; a half that the context is too short for has none."""

    def process():
        def digest(head, data):
            return hashlib.blake2b(head + data, digest_size=16).digest()

        def rows(batch):
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for mark, lead, context, low, high in zip(*columns):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    if a <= lead and length - b <= len(context) - lead and a <= b:
                        outside = context[lead - a : lead + length - b]
                        before, after = min(b, lead), min(length - a, len(context) - lead)
                        every = context[lead - before : lead + after]
                        key = digest(b"%d:%d:" % (a, b), outside)
                        span = digest(b"%d:%d:%d:%d:" % (a, b, before, after), every)
                        yield mark, a, b, key, span, before, after, lead, context

        return rows

    return map_rows(classes.select("mark", "lead", "context", "low", "high"), process, SHARED)


EXTENTS = "mark binary, before bigint, after bigint"


def class_extents(shared: DataFrame, length: int) -> DataFrame:
    """How far repeats reach around the anchor of each class, from the buckets of one key."""
    fields = parts(EXTENTS)

    def run(batches):
        current, members = None, []

        def finished():
            mark_repeats(members, length)
            return [(m.text_key, m.before, m.after) for m in members if m.before + m.after]

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            out = []
            for mark, key, lead, context in zip(*columns):
                if key != current:
                    if len(members) > 1:
                        out += finished()
                    current, members = key, []
                members.append(Occurrence(mark, lead, context[lead:], context[:lead][::-1]))
            yield batch_of(out, fields)
        if len(members) > 1:
            yield batch_of(finished(), fields)

    rows = shared.select("mark", "key", "lead", "context").repartition("key")
    return rows.sortWithinPartitions("key").mapInArrow(run, EXTENTS)


def hot_repeats(contexts: DataFrame, params: RepeatParams) -> DataFrame:
    """Runs of bytes that repeat among the contexts of hot hashes."""
    length = params.length
    contexts = stage(contexts)
    finished = contexts.filter("context is null").select("text_key", F.col("place").alias("start"), "stop")
    members = contexts.filter("context is not null")
    # the lead is part of the mark
    classes = stage(
        members.groupBy("mark").agg(
            F.count("*").alias("n"), F.first("lead").alias("lead"), F.first("context").alias("context")
        )
    )
    # equal contexts repeat whole
    size = F.length("context").cast("bigint")
    extents = classes.filter("n > 1").select("mark", F.col("lead").alias("before"), (size - F.col("lead")).alias("after"))
    rows = classes.select("mark", "lead", "context", F.lit(0).alias("low"), F.lit(length).alias("high"))
    while True:
        shared = stage(shared_rows(rows, length))
        # equal spans repeat whole; one of them is searched for the others' sake
        equal = F.struct("mark", "low", "high", "lead", "context")
        spans = stage(
            shared.groupBy("key", "span").agg(F.count("*").alias("copies"), F.min_by(equal, "mark").alias("one"))
        )
        copied = spans.filter("copies > 1").select("span")
        extents = extents.unionByName(stage(shared.join(copied, "span").select("mark", "before", "after")))
        counts = stage(spans.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
        several = spans.join(counts, "key").select("key", "n", "one.*")
        fits = several.filter(F.col("n") <= params.chunk)
        extents = extents.unionByName(stage(class_extents(fits, length)))
        # one offset: equal keys have equal spans, so none is large
        rows = several.filter(F.col("n") > params.chunk)
        if counts.filter(F.col("n") > params.chunk).isEmpty():
            break
    reach = extents.groupBy("mark").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    found = members.select("mark", "text_key", "place").join(stage(reach), "mark")
    start, stop = F.col("place") - F.col("before"), F.col("place") + F.col("after")
    return finished.unionByName(found.select("text_key", start.alias("start"), stop.alias("stop")))


def repeated_runs(docs: DataFrame, params: RepeatParams, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(text_key, start, stop) of repeated bytes between different texts or within one, and the
    (text_key, text) that they lie in. Texts that are equal as a whole count once here."""
    text = docs[text_col]
    keyed = docs.select(F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))
    found = stage(anchor_rows(keyed, params.length).distinct())
    # stored, so that the join below reads plain exchanges, and a hot hash is split there
    counts = stage(found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"))
    anchor, hot = F.struct("hash", "place", "first", "last"), F.col("n") > params.chunk
    # a text's own anchors: one in some 190 bytes
    by_text = stage(
        found.join(counts, "hash").groupBy("text_key").agg(
            F.collect_list(F.when(~hot, anchor)).alias("anchors"), F.collect_list(F.when(hot, anchor)).alias("hot")
        )
    )
    first = keyed.join(by_text.select("text_key"), "text_key").groupBy("text_key")
    texts = stage(first.agg(F.first("text").alias("text")))

    def contexts(kind):
        listed = by_text.select("text_key", F.col(kind).alias("anchors")).filter(F.size("anchors") > 0)
        return context_rows(texts.join(listed, "text_key"), params.length)

    runs = stage(bucket_repeats(contexts("anchors"), params.length))
    if not counts.filter(hot).isEmpty():
        runs = runs.unionByName(hot_repeats(contexts("hot"), params))
    return runs, texts


def remove_repeats(
    docs: DataFrame,
    params: RepeatParams = RepeatParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    with_kept: bool = False,
) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans, kept_sha256, and (`with_kept`) the bytes that stay."""
    runs, texts = repeated_runs(docs, params, text_col)
    spans = runs.groupBy("text_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    fields = "text_key binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"

    def process():
        def rows(batch):
            keys, lists = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for key, data, listed in zip(keys, raw(batch.column(1)), lists):
                kept, at, n = [], 0, 0
                for start, stop in sorted((s["start"], s["stop"]) for s in listed):
                    if start > at or n == 0:
                        kept.append(data[at:start])
                        n += 1
                    at = max(at, stop)
                rest = b"".join([*kept, data[at:]])
                digest = hashlib.sha256(rest).hexdigest()
                yield key, len(data) - len(rest), n, digest, rest if with_kept else None

        return rows

    cut = map_rows(texts.join(spans, "text_key").select("text_key", "text", "spans"), process, fields)
    body = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.unhex(F.md5(docs[text_col])).alias("text_key"),
        F.length(body).cast("bigint").alias("n_bytes"),
        F.sha2(body, 256).alias("sha"),
        *([body.alias("body")] if with_kept else []),
    )
    # copies are settled by their number alone, so only texts without one meet their cuts; null texts meet nothing
    known = docs.filter(docs[text_col].isNotNull()).select(F.unhex(F.md5(docs[text_col])).alias("text_key"))
    copies = known.groupBy("text_key").agg(F.count("*").alias("copies"))
    copied = stage(copies.filter("copies > 1"))
    marked = rows.filter("text_key is not null").join(copied, "text_key", "left")
    alone = marked.filter("copies is null").join(cut, "text_key", "left")
    none = [F.lit(None).cast(dict(cut.dtypes)[c]).alias(c) for c in cut.columns if c != "text_key"]
    nulls = rows.filter("text_key is null").withColumn("copies", F.lit(None).cast("bigint"))
    all_rows = alone.unionByName(marked.filter("copies > 1").unionByName(nulls).select("*", *none))
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= params.length)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    out = all_rows.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *(
            [F.when(whole, F.lit("").cast("binary")).otherwise(F.coalesce("kept", "body")).alias("kept")]
            if with_kept
            else []
        ),
    )
    return out
