"""Line-first cleaning of documents.

Every line is judged on its own by three rules; lines that fail are removed; a document that
loses too much of its text, or fails the base rules, is rejected.

- punctuation: a line needs the end of a sentence somewhere, and fails when three words of ten
  carry doubled marks or runs of symbols.
- navigation: a line fails when a fifth of its words are bare separators.
- boilerplate: a line fails when it holds a stock phrase of page furniture, or shouts (five words
  or more with more capitals than small letters).

Null texts have no words: all counts are 0, the base rules fail, the document isn't kept. Lines without
a word are neither judged nor counted. Rows are independent, so repeated rows and ids give equal
rows, and an empty table gives none. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ontide.llm.common import map_rows, raw

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PCT = 20

# Stock phrases of page furniture.
PHRASES = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "we use cookies",
    "accept all cookies",
    "enable javascript",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "click here to",
    "share this article",
    "skip to main content",
    "back to top",
    "log in to comment",
    "powered by wordpress",
)

SENTENCE_END = "(?:[.!?]|…)(?:(?:[\"')\\]]|”|’)*(?:[ \\t\\r]|$))"
LOUD_WORD = "!!|\\?\\?|[#*$%&]{2}"
SEPARATOR_WORD = "^(?:[|]|»|›|•|·)+$"
SEPARATORS = ("|", "»", "›", "•", "·")
PHRASE = "|".join(PHRASES)
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = CAPITALS.lower()


@dataclass(frozen=True)
class QualityParams:
    """Shares are in per cent of a line's words or of a document's characters in words."""

    loud_pct: int = 30
    separator_pct: int = 20
    shout_words: int = 5
    max_lost_pct: int = 30


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur twice or more in the text."""
    grams = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    total = end = 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


def line_judge(text: bytes, params: QualityParams) -> Callable[[bytes], str | None]:
    """Function of a line of `text` that names the failed rule, or gives None.

    A rule that nothing in the whole text can break isn't looked at line by line.
    """
    sentence = re.compile(SENTENCE_END.encode()).search
    loud = re.compile(LOUD_WORD.encode()).search
    separator = re.compile(SEPARATOR_WORD.encode()).match
    phrase = re.compile(PHRASE.encode()).search
    lower = text.lower()
    may_be_loud = loud(text) is not None
    may_navigate = any(mark.encode() in text for mark in SEPARATORS)
    may_be_stock = any(stock.encode() in lower for stock in PHRASES)

    def judge(line: bytes) -> str | None:
        if not sentence(line):
            return "punctuation"
        if may_be_loud and loud(line):
            words = line.split()
            n = sum(loud(word) is not None for word in words)
            if 100 * n >= params.loud_pct * len(words):
                return "punctuation"
        if may_navigate:
            words = line.split()
            n = sum(separator(word) is not None for word in words)
            if n and 100 * n >= params.separator_pct * len(words):
                return "navigation"
        if may_be_stock and phrase(line.lower()):
            return "boilerplate"
        capitals = len(line) - len(line.translate(None, CAPITALS))
        if capitals > 1 and capitals > len(line) - len(line.translate(None, SMALL)):
            if len(line.split()) >= params.shout_words:
                return "boilerplate"
        return None

    return judge


def characters(data: bytes) -> int:
    """Code points inside words."""
    joined = b"".join(data.split())
    return len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))


FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, lost_chars bigint, "
    "lines_punctuation bigint, lines_navigation bigint, lines_boilerplate bigint"
)


def clean_documents(
    docs: DataFrame,
    params: QualityParams = QualityParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: its counts, the verdict, (`with_text`) the text without failed lines, and
    the columns that `carry` names."""
    fields = f"doc_id bigint, {FIELDS}" + (", cleaned_text string" if with_text else "")

    def process():
        rules = ("punctuation", "navigation", "boilerplate")

        def rows(batch):
            ids, texts = batch.column(0).to_pylist(), raw(batch.column(1))
            for doc_id, text in zip(ids, texts):
                text = text or b""
                judge, words, word_chars = line_judge(text, params), text.split(), characters(text)
                lost, duplicates, seen, fails, good = 0, 0, set(), dict.fromkeys(rules, 0), []
                for line in text.split(b"\n"):
                    rule = None
                    if line.strip():
                        duplicates += line in seen
                        seen.add(line)
                        rule = judge(line)
                    if rule is None:
                        good.append(line)
                    else:
                        fails[rule] += 1
                        lost += characters(line)
                repeats = repeated_words(words)
                failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED_PCT * len(words)
                kept = not failed and 100 * lost <= params.max_lost_pct * word_chars
                row = (
                    doc_id,
                    len(words),
                    word_chars,
                    len(text) - len(text.translate(None, SYMBOLS)),
                    duplicates,
                    repeats,
                    failed,
                    kept,
                    lost,
                    *fails.values(),
                )
                yield (*row, b"\n".join(good).decode("utf-8", "replace")) if with_text else row

        return rows

    source = docs.select(docs[id_col].cast("bigint"), docs[text_col], *(docs[c] for c in carry))
    return map_rows(source, process, fields, carry)
