"""Language identification with rank-order profiles of character n-grams.

Method (Cavnar and Trenkle). A profile is a ranked list of the most frequent n-grams of one to three characters:
lower-cased letters, with one blank at each end of a word. A language's profile comes from all training texts
in it. A document's profile is compared with each language's by the out-of-place distance: for each
of its n-grams the difference of the two ranks, or the profile's size where the language's
profile lacks it. The nearest language is predicted; of equally near ones the first in code-point order.
The score is 1 minus the distance as a share of the greatest possible one.

How it is dealt out. Training counts n-grams per language inside the tasks, in tables of bounded size, and adds
them up by (language, n-gram), so a language of a third of all rows is spread over its n-grams. Each
language's most frequent n-grams are picked with a limit on both sides of the exchange. Profiles go to the
tasks in blocks of `block_languages`; a block reads the documents once, and each pass keeps the nearer language.

An n-gram of up to three code points is one 63-bit number; nothing is hashed or cut, whole texts count.
Null texts and texts without letters are "und" with score 0, as is everything where nothing was learned. Rows
with null text or language teach nothing. Repeated rows count as often as they occur. Empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ontide.llm.common import SLICE_ROWS, map_rows
from ontide.session import stage

UNKNOWN = "und"
BITS = 21  # of a code point
BLANK = 32
PIECE = 1 << 20  # code points counted at once


@dataclass(frozen=True)
class ProfileParams:
    size: int = 300
    fold: int = 4
    held: int = 2  # the remainder that is held out of training
    block_languages: int = 500
    flush: int = 500_000  # n-grams of a task's tables before they are sent


def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def word_codes(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased letters, each run of others as one blank, blanks around all."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    letter = letters[codes]
    codes = np.where(letter, codes, np.uint64(BLANK))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first of a run of others
    return codes[keep]


def grams(codes: np.ndarray, starts: int) -> np.ndarray:
    """The n-grams that start in the first places, without those that have a blank inside or no letter."""
    letter, shift = codes != BLANK, np.uint64(BITS)
    one = codes[:starts][letter[:starts]]
    two = codes[:-1] << shift | codes[1:]
    three = (two[:-1] << shift | codes[2:])[:starts]
    return np.concatenate([one, two[:starts], three[letter[1:-1][:starts]]])


def gram_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text with their counts; long texts are counted in pieces."""
    codes = word_codes(text, letters)
    found = [
        np.unique(grams(codes[at : at + PIECE + 2], PIECE), return_counts=True)
        for at in range(0, len(codes), PIECE)
    ]
    return found[0] if len(found) == 1 else added(found)


def added(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of count tables."""
    codes, where = np.unique(np.concatenate([t[0] for t in tables]), return_inverse=True)
    counts = np.concatenate([t[1] for t in tables])
    return codes, np.bincount(where, counts, len(codes)).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order: by count, then by code."""
    if len(codes) > size:
        least = -np.partition(-counts, size - 1)[size - 1]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:size]


def learn_profiles(labelled: DataFrame, params: ProfileParams, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, place): the ranked n-grams of each language, from 0."""
    source = labelled.select(labelled[text_col].alias("text"), labelled[lang_col].cast("string").alias("lang"))

    def run(batches):
        letters, tables, size = letter_table(), defaultdict(list), 0

        def flushed():
            for lang, parts in tables.items():
                codes, counts = added(parts)
                columns = [pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                piece, texts = batch.slice(start, SLICE_ROWS), defaultdict(list)
                for text, lang in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    texts[lang].append(text)
                for lang, own in texts.items():
                    # the blank between two texts parts their words
                    counted = gram_counts(" ".join(own), letters)
                    size += len(counted[0])
                    tables[lang].append(counted)
                    if len(tables[lang]) >= 32:
                        size -= sum(len(codes) for codes, _ in tables[lang])
                        tables[lang] = [added(tables[lang])]
                        size += len(tables[lang][0][0])
                if size >= params.flush:
                    yield from flushed()
                    tables, size = defaultdict(list), 0
        yield from flushed()

    known = source.filter("text is not null and lang is not null")
    counts = known.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.agg(F.sum("n").alias("n")).withColumn("place", F.row_number().over(order) - 1)
    return ranked.filter(F.col("place") < params.size).select("lang", "gram", "place")


def profile_blocks(profiles: DataFrame, block_languages: int):
    """Lists of (lang, n-grams by code, their places), one bounded list on the driver at a time."""
    block: list[tuple[str, list, list]] = []
    for row in profiles.orderBy("lang", "gram").toLocalIterator():
        if not block or block[-1][0] != row["lang"]:
            if len(block) >= block_languages:
                yield arrays(block)
                block = []
            block.append((row["lang"], [], []))
        block[-1][1].append(row["gram"])
        block[-1][2].append(row["place"])
    if block:
        yield arrays(block)


def arrays(block: list) -> list[tuple[str, np.ndarray, np.ndarray]]:
    return [(lang, np.array(codes, np.int64).view(np.uint64), np.array(places)) for lang, codes, places in block]


def distance(ranked: np.ndarray, codes: np.ndarray, places: np.ndarray, size: int) -> int:
    """Out-of-place distance of a ranked document profile to a language's."""
    at = np.minimum(np.searchsorted(codes, ranked), len(codes) - 1)
    known = codes[at] == ranked
    return int(np.where(known, np.abs(places[at] - np.arange(len(ranked))), size).sum())


PREDICTED = "doc_id bigint, held_out boolean, text string, lang_pred string, score double"


def predict(docs: DataFrame, profiles: list, params: ProfileParams, carry_text: bool) -> DataFrame:
    """One pass of a block of profiles over (doc_id, held_out, text, lang_pred, score)."""

    def process():
        letters = letter_table()

        def rows(batch):
            for doc_id, held, text, lang, score in zip(*(batch.column(i).to_pylist() for i in range(5))):
                codes, counts = gram_counts(text, letters) if text else ((), ())
                if len(codes):
                    ranked = top(codes, counts, params.size)
                    for name, known, places in profiles:
                        # doubles of the same whole numbers: equal distances have equal scores
                        near = 1 - distance(ranked, known, places, params.size) / (params.size * len(ranked))
                        if score is None or near > score:
                            lang, score = name, near
                yield doc_id, held, text if carry_text else None, lang, score

        return rows

    return map_rows(docs, process, PREDICTED)


def held_out(id_column: Column, params: ProfileParams) -> Column:
    """Whether the id's fold is the one held out; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % params.fold == params.held


def identify_languages(
    docs: DataFrame,
    params: ProfileParams = ProfileParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Per row: held_out, lang_pred, score. Learns from the rows that aren't held out."""
    held = held_out(docs[id_col], params)
    profiles = stage(learn_profiles(docs.filter(~held), params, text_col, lang_col))
    rows = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        held.alias("held_out"),
        docs[text_col].alias("text"),
        F.lit(UNKNOWN).alias("lang_pred"),
        F.lit(None).cast("double").alias("score"),
    )
    blocks = profile_blocks(profiles, params.block_languages)
    block = next(blocks, [])
    while block is not None:
        following = next(blocks, None)
        rows = predict(rows, block, params, carry_text=following is not None)
        if following is not None:
            rows = stage(rows)
        block = following
    return rows.select("doc_id", "held_out", "lang_pred", F.coalesce("score", F.lit(0.0)).alias("score"))
