"""Personal data in texts, plain and disguised, with spans in the source's characters.

Base patterns find e-mail addresses, IP addresses, card and phone numbers as they stand. Then a text with
signs of disguise passes through transducers that write a normalised text and, for every character of
it, the source span it came from:

- homoglyphs: full-width forms, digits of other scripts, look-alikes of Latin letters, dots and at signs
  become ASCII; characters without width vanish;
- spelled digits: number words become digits in runs of digits and number words that the separators of phone and
  card numbers part, where four words follow each other or the run has two words and ten digits in all;
  a "plus" before such a run becomes its sign;
- at and dot: "(at)", "[at]", "{at}" and "(dot)" and so on become marks everywhere. Bare "at" and "dot" do
  in addresses: names parted by dots, an at sign, labels parted by dots, where signs and dots may be real,
  bracketed or bare. A bare "at" needs a disguised dot. After a bare dot the ending is a top-level domain;
  one that is an English word too needs another sign of an address, so that running text stays.

The same patterns run over the normalised text; what they find is mapped back to the source
and added unless a base span of its kind holds it; where a base pattern saw only a piece of it, both stand.

Null texts count as empty: no spans. Rows are independent, repeated rows give equal rows, an empty
table gives none, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ontide.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile("[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]+)+")
IP = re.compile("(?<![0-9])[0-9]++(?:\\.[0-9]++)(?:\\.[0-9]++)(?:\\.[0-9]++)")
CARD = re.compile("[0-9](?:[\\x20-]?[0-9])+")
PHONE = re.compile("\\+[0-9][\\x20().0-9-]+[0-9]")

# Characters that look like ASCII ones, beside those that compatibility forms give.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοɡı․‧∙⋅。﹒﹫",
        "ABEKMHOPCTYXaeopcyxijsdhqwABEZHIKMNOPTYXogi......@",
        strict=False,
    )
)
UNSEEN = frozenset("​‌‍⁠﻿­")
NUMBER_WORDS = {
    word: str(n)
    for n, word in enumerate("zero one two three four five six seven eight nine".split())
} | {"oh": "0"}
NUMBER = "(?:" + "|".join(NUMBER_WORDS) + ")"
SPELLED = re.compile(f"{NUMBER}(?![A-Za-z])(?:[ ().,-]{{1,3}}{NUMBER}(?![A-Za-z]))*", re.I)
UNIT = f"(?:{NUMBER}(?![A-Za-z])|[0-9]++(?![A-Za-z]))"
NUMBER_RUN = re.compile(
    f"(?<![A-Za-z0-9])(?:(plus)[ (,.-]{{1,3}})?{UNIT}(?:[ ().,-]{{1,3}}{UNIT})*+", re.I
)
NUMBER_WORD = re.compile(NUMBER, re.I)
LEAST_WORDS, LEAST_DIGITS = 2, 10
BRACKETED = re.compile(
    "[ ]?[\\[({<][ ]?(?:(at|@)|(dot|punkt|punto|point|\\.)|(plus)|(dash|minus))[ ]?[\\])}>][ ]?", re.I
)
# An address of numbers: groups of digits or number words, parted by dots of any form.
BARE_DOT = " {1,3}dot {1,3}|[ ]?[\\[({<][ ]?(?:dot|punkt|punto|point|\\.)[ ]?[\\])}>][ ]?"
IP_GROUP = f"(?:[0-9]++(?![A-Za-z])|{NUMBER}(?![A-Za-z])(?:[ -]{NUMBER}(?![A-Za-z]))*+)"
IP_RUN = re.compile(f"(?<![A-Za-z0-9.]){IP_GROUP}(?:(?:\\.|{BARE_DOT}){IP_GROUP})*+", re.I)
IP_PART = re.compile(f"({BARE_DOT})|\\.|({IP_GROUP})", re.I)
# Top-level domains, first those that are English words or common in running text.
WORD_ENDINGS = frozenset(
    "ad ae am an as at be by do go gg hm id in is it la ma me mr ms my no pa so st to tm us ai ac sc "
    "art bar best bid blue click club cool date design email eu fun game games golf group guru help home "
    "host house info land life link live love market media money name network news one online party "
    "photo photos plus press pro red review rest run sale school shop show site social space store "
    "studio style support team tech tips today tools top town trade video watch website wiki win work "
    "works world zone academy agency center company digital global international museum post travel".split()
) - {"eu", "info"}
ENDINGS = WORD_ENDINGS | frozenset(
    "com org net edu gov mil int info biz io co app dev xyz icu vip asia cat coop jobs mobi tel aero arpa "
    "cloud blog wien berlin hamburg koeln bayern paris london nyc tokyo swiss gmbh ltd llc inc "
    "af ag ai al ao aq ar au aw ax az ba bb bd bf bg bh bi bj bm bn bo br bs bt bv bw bz ca cc cd cf "
    "cg ch ci ck cl cm cn cr cu cv cw cx cy cz de dj dk dm dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge "
    "gf gh gi gl gm gn gp gq gr gs gt gu gw gy hk hn hr ht hu ie il im iq ir je jm jo jp ke kg kh ki km kn kp kr "
    "kw ky kz lb lc li lk lr ls lt lu lv ly mc md mg mh mk ml mm mn mo mp mq mt mu mv mw mx mz na nc ne nf ng ni "
    "nl np nr nu nz om pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sb sd se sg sh si sj sk sl sm "
    "sn sr ss su sv sx sy sz tc td tf tg th tj tk tl tn tr tt tv tw tz ua ug uk uy uz va vc ve vg vi vn vu wf "
    "ws ye yt za zm zw sa".split()
)
# Words before a noun, which are neither names nor hosts.
ARTICLES = frozenset("the a an this that these those each every any some his her its our your their my".split())
AT = re.compile("(@)|( {1,3}at {1,3})|[ ]?[\\[({<][ ]?(?:at|@)[ ]?[\\])}>][ ]?", re.I)
DOT = re.compile("( {1,3}dot {1,3})|[ ]?[\\[({<][ ]?(?:dot|punkt|punto|point|\\.)[ ]?[\\])}>][ ]?", re.I)
LABELS = re.compile("[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)*+")


def lookalike_table() -> dict[int, str]:
    """One ASCII character for each look-alike: compatibility forms and decimal digits of any script."""
    table = {}
    for code in range(0x80, 0x1F000):
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        digit = unicodedata.decimal(char, None)
        if digit is not None:
            table[code] = str(digit)
        elif char in LOOKALIKES:
            table[code] = LOOKALIKES[char]
        elif len(plain) == 1 and "!" <= plain <= "~" and 0xFF00 <= code <= 0xFF60:
            table[code] = plain
    return table


LOOKS = lookalike_table()
SIGN_CHARACTERS = frozenset(map(chr, LOOKS)) | UNSEEN
NUMBER_BYTES = frozenset(word.encode() for word in NUMBER_WORDS)
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"(),.-" else b for b in range(256))
IN_SPELLED = 4  # words of a run that has no need of further digits


def disguised(text: str) -> bool:
    """Whether a transducer may have something to rewrite."""
    if not text.isascii() and not SIGN_CHARACTERS.isdisjoint(text):
        return True
    lower = text.encode("utf-8", "replace").translate(WORD_BYTES)
    if b" dot " in lower:
        return True
    if any(mark in text for mark in "[({<") and BRACKETED.search(text):
        return True
    return sum(map(NUMBER_BYTES.__contains__, lower.split())) >= LEAST_WORDS


def luhn(digits: str) -> bool:
    total = 0
    for i, char in enumerate(reversed(digits)):
        value = int(char) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str):
    """Matches of the e-mail pattern, found from their at signs: linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def in_range(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, code points, by start and kind."""
    spans = [("email", *span) for span in emails(text)]
    for found in IP.finditer(text):
        if all(map(in_range, found[0].split("."))):
            spans.append(("ip", *found.span()))
    for found in CARD.finditer(text):
        if 14 <= found.end() - found.start() <= 37:
            digits = found[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *found.span()))
    if "+" in text:
        for found in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, found[0])) <= 15:
                spans.append(("phone", *found.span()))
    return in_order(spans)


def in_order(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Normalised:
    """A text under rewriting: `text`, and the source start and end of every character."""

    def __init__(self, source: str):
        self.text = source
        self.starts = list(range(len(source)))
        self.ends = list(range(1, len(source) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (start, end, text) in order; all of a new text maps to the whole old span."""
        text, starts, ends, at = [], [], [], 0
        for start, end, new in edits:
            if start < at:
                continue
            text += [self.text[at:start], new]
            starts += self.starts[at:start] + [self.starts[start]] * len(new)
            ends += self.ends[at:start] + [self.ends[end - 1]] * len(new)
            at = end
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def number_addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits that write disguised ip addresses plainly: four groups, each at most 255."""
    edits = []
    for run in IP_RUN.finditer(text):
        dots, groups = [], []
        for part in IP_PART.finditer(text, *run.span()):
            if part[2]:
                words = NUMBER_WORD.findall(part[2])
                digits = "".join(NUMBER_WORDS[w.lower()] for w in words) or part[2]
                groups.append((*part.span(), digits))
            elif part[1]:
                dots.append((*part.span(), "."))
        if dots and len(groups) == 4 and all(in_range(digits) for *_, digits in groups):
            edits += sorted([*dots, *groups])
    return edits


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Edits that write the number words of runs as digits."""
    edits = []
    for run in NUMBER_RUN.finditer(text):
        words = [(group, NUMBER_WORD.findall(group[0])) for group in SPELLED.finditer(text, *run.span())]
        n = sum(len(w) for _, w in words)
        digits = n + sum(map(str.isdigit, run[0]))
        enough = n >= LEAST_WORDS and digits >= LEAST_DIGITS
        if run[1] and enough:
            edits.append((run.start(1), run.end(1) + 1, "+"))
        for group, own in words:
            if enough or len(own) >= IN_SPELLED:
                edits.append((*group.span(), "".join(NUMBER_WORDS[w.lower()] for w in own)))
    return edits


def address_marks(text: str) -> list[tuple[int, int, str]]:
    """Edits that write the bare "at" and "dot" of addresses as marks, found from their at signs: each is
    followed to both sides, so the time is linear in the text."""
    edits, floor = [], 0
    dots = {found.start(): found for found in DOT.finditer(text)}
    before = {found.end(): found for found in dots.values()}
    if not dots:
        return edits
    at_sign = AT.search(text)
    while at_sign:
        start, end, local_dots = at_sign.start(), at_sign.end(), []
        while True:
            label = start
            while label > floor and text[label - 1] in LOCAL:
                label -= 1
            dot = before.get(label)
            if label == start or text[label:start].lower() in ARTICLES:
                break
            start = label
            if not dot or dot.start() <= floor or text[dot.start() - 1] not in LOCAL:
                break
            local_dots.append(dot)
            start = dot.start()
        if local_dots and start == local_dots[-1].start():
            start = local_dots.pop().end()
        reach, host = end, []  # (dot before the labels or None, labels)
        dot, label = None, LABELS.match(text, end) if start < at_sign.start() else None
        while label:
            host.append((dot, label))
            reach = label.end()
            dot = dots.get(reach)
            label = LABELS.match(text, dot.end()) if dot else None
        while host and not address(text, start, at_sign, local_dots, host):
            host.pop()
        if host:
            marks = [(*dot.span(1), ".") for dot in [*local_dots, *(d for d, _ in host if d)] if dot[1]]
            edits += sorted([*marks, *([(*at_sign.span(2), "@")] if at_sign[2] else [])])
            floor = host[-1][1].end()
        at_sign = AT.search(text, max(end, floor) if host else end - 1 if at_sign[2] else end)
    return edits


def address(text: str, start: int, at_sign: re.Match, local_dots: list, host: list) -> bool:
    """Whether a local part, an at sign and the labels of a host are an address."""
    host_dots = [dot for dot, _ in host if dot]
    disguised_dots = [*local_dots, *host_dots]
    last, labels = host[-1]
    ending = labels[0].rsplit(".", 1)[-1].lower()
    if not host_dots and "." not in labels[0]:
        return False
    if at_sign[2] and (not disguised_dots or host[0][1][0].lower() in ARTICLES):
        return False
    if not at_sign[2] and (not last or not last[1]):
        return True  # as the base pattern has it
    if last and not last[1]:
        return True
    if ending not in ENDINGS:
        # a sign that only addresses have, and a host without an ending so far
        alone = len(host) == 2 and "." not in host[0][1][0] and ending.isalpha() and len(ending) > 1
        return not at_sign[2] and alone and ending not in ARTICLES
    if ending not in WORD_ENDINGS:
        return True
    local = text[start : at_sign.start()]
    signs = not at_sign[2] or len(disguised_dots) > 1 or any(not dot[1] for dot in disguised_dots)
    named = any(c in "._%+-" or c.isdigit() for c in local)
    after = text[labels.end() : labels.end() + 2]
    return signs or named or not (after[:1] == " " and after[1:].isalpha())


def normalise(source: str) -> Normalised:
    """The transducers, one after the other."""
    state = Normalised(source)
    state.text = source.translate(LOOKS)
    state.rewrite([(i, i + 1, "") for i, c in enumerate(state.text) if c in UNSEEN])
    state.rewrite(number_addresses(state.text))
    state.rewrite(spelled_digits(state.text))
    state.rewrite(address_marks(state.text))
    state.rewrite(
        [
            (*found.span(), "@" if found[1] else "." if found[2] else "+" if found[3] else "-")
            for found in BRACKETED.finditer(state.text)
        ]
    )
    return state


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans with those that only the normalised text shows."""
    base = base_spans(text)
    if not disguised(text):
        return base, base
    state, spans = normalise(text), list(base)
    taken = {kind: [s[1:] for s in base if s[0] == kind] for kind in KINDS}
    for kind, start, end in base_spans(state.text):
        start, end = state.source(start, end)
        if not any(a <= start and end <= b for a, b in taken[kind]):
            spans.append((kind, start, end))
    return base, in_order(spans)


def written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def masked(text: str, spans) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are one."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_masked: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per document: base counts per kind, base digest, all spans, (`with_masked`) the masked text, and
    the columns that `carry` names."""
    fields = (
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
        "base_sha256 string, spans string" + (", masked string" if with_masked else "")
    )

    def process():
        def rows(batch):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, spans = all_spans(text or "")
                counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                row = (doc_id, *counts, digest, written(spans))
                yield (*row, None if text is None else masked(text, spans)) if with_masked else row

        return rows

    source = docs.select(docs[id_col].cast("bigint"), docs[text_col], *(docs[c] for c in carry))
    return map_rows(source, process, fields, carry)
