"""BPE encoding and decoding with content-defined chunks.

A text is cut where a rolling hash of its last bytes meets a mask, so equal passages of different
documents are cut alike. Every distinct chunk is encoded once per task and kept in a bounded
store. A cut may fall inside a word. There the joint is encoded again, from the last place before the cut
to the first one behind it where the tokenizer parts words in any surroundings (blanks, ASCII digits,
ideographs beside ideographic stops). What the chunk gave stays where its ends agree with what the joints
cover of it; otherwise the piece widens over the whole chunk. Cuts without such a place between them have
one joint, so every byte is encoded a fixed number of times, also in texts without blanks.

Chunks of plain characters (ASCII, Latin-1 letters, common punctuation) go through a byte-pair
encoder on ranks taken from the same file: the end-of-word mark is a byte that no word holds, so
"x + mark" are the first merges. All other chunks go through the tokenizer itself.

Null texts count as empty: no tokens, digests of nothing. Rows are independent; repeated rows give
equal rows, an empty table gives none, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from ontide.llm.common import map_rows, raw

# Rolling hash: the sum of the last SPAN bytes, each byte a fixed random number, times powers of two.
SPAN = 32
LEAST_CHUNK = 512
MASK_BITS = 11
GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 63, 256, dtype=np.uint64)

# What the vocabulary file's normaliser and pre-tokenizer do to plain characters.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ‘’“”–—…]*")
PRETOKEN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\\s\x00-\x20a-zà-öø-ÿ0-9]+"
)
WORD_END = "</w>"
LONG_WORD = 64  # characters; longer words are not remembered


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of a text, the text's end included."""
    n = len(data)
    if n <= LEAST_CHUNK:
        return [n] if n else []
    gear = GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < SPAN:  # sums of the last 1, 2, 4, ... bytes
        older = gear[:-width] << np.uint64(width)
        gear = gear.copy()
        gear[width:] += older
        width *= 2
    hits = np.flatnonzero((gear >> np.uint64(64 - MASK_BITS)) == 0) + 1
    cuts, last = [], 0
    for cut in hits.tolist():
        if cut - last >= LEAST_CHUNK and cut < n:
            while cut < n and data[cut] & 0xC0 == 0x80:  # not inside a character
                cut += 1
            cuts.append(cut)
            last = cut
    if last < n:
        cuts.append(n)
    return cuts


def parted(data: bytes) -> np.ndarray:
    """Ascending places at which the pre-tokenizer parts a text whatever stands around them."""
    d = np.frombuffer(data, np.uint8)
    blank = (d == 32) | (d == 9) | (d == 10) | (d == 13)
    digit = (d >= 48) & (d <= 57)
    place = np.zeros(len(d) + 1, bool)
    # a digit with a combining mark behind it is left alone
    place[1:-1] = blank[:-1] | blank[1:] | digit[1:] | (digit[:-1] & (d[1:] < 0x80))
    # U+5000 to U+8FFF are ideographs throughout; the stops are U+3001, U+3002 and U+FF0C
    ideograph = (d >= 0xE5) & (d <= 0xE8)
    at = np.flatnonzero((d[:-2] == 0xE3) | (d[:-2] == 0xEF))
    second, third = d[at + 1], d[at + 2]
    full = (d[at] == 0xE3) & (second == 0x80) & ((third == 0x81) | (third == 0x82))
    at = at[full | ((d[at] == 0xEF) & (second == 0xBC) & (third == 0x8C))]
    left = at[at >= 3]
    place[left[ideograph[left - 3]]] = True
    right = at[at + 3 < len(d)] + 3
    place[right[ideograph[right]]] = True
    place[0] = place[-1] = True
    return np.flatnonzero(place)


def byte_letters() -> dict[str, int]:
    """The printable letter of every byte in byte-level vocabularies: visible bytes stand for
    themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class PlainWords(dict):
    """Ids of words of plain characters, worked out when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = [word] if word.isalpha() else PRETOKEN.findall(word)
        ids = tuple(self.encode(" ".join(parts) + " "))
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids


class ChunkEncoder:
    """Encodes texts as the tokenizer of `spec` (the JSON text of its file) does."""

    def __init__(self, spec: str, store_bytes: int = 16 << 20, most_words: int = 250_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = json.loads(spec)["model"]["vocab"]
        letters = byte_letters()
        ranks = {}
        for token, number in vocabulary.items():
            ended = token.endswith(WORD_END) and token != WORD_END
            letters_of = token.removesuffix(WORD_END) if ended else token
            ranks[bytes(letters[c] for c in letters_of) + b" " * ended] = number
        spare = len(vocabulary) + 1000
        for byte in range(256):
            ranks.setdefault(bytes([byte]), spare + byte)
        plain = tiktoken.Encoding(
            "words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}
        )
        self.words, self.most_words = PlainWords(plain.encode_ordinary), most_words
        added = json.loads(spec)["added_tokens"]
        self.special = tuple(token["content"] for token in added)
        names = {number: token for token, number in vocabulary.items()}
        names |= {token["id"]: token["content"] for token in added}
        self.names = [names.get(number, "") for number in range(max(names) + 1)]
        self.store: dict[bytes, list[int]] = {}
        self.stored, self.store_bytes = 0, store_bytes
        self.reused = self.repaired = 0

    def encode_piece(self, data: bytes) -> list[int]:
        text = data.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and not any(token in text for token in self.special):
            if len(self.words) > self.most_words:
                self.words.clear()
            return list(chain.from_iterable(map(self.words.__getitem__, text.lower().split())))
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_chunk(self, data: bytes) -> list[int]:
        ids = self.store.get(data)
        if ids is not None:
            self.reused += 1
            return ids
        ids = self.encode_piece(data)
        if self.stored > self.store_bytes:
            self.store.clear()
            self.stored = 0
        self.store[data] = ids
        self.stored += len(data) + 8 * len(ids)
        return ids

    def encode(self, data: bytes) -> list[int]:
        """Ids of a whole text."""
        ends = cut_points(data)
        if len(ends) < 2:
            return list(self.encode_chunk(data)) if data else []
        places = parted(data)
        # the last place up to each chunk's end, and the first from there on
        lefts = places[np.searchsorted(places, ends, "right") - 1].tolist()
        rights = places[np.searchsorted(places, ends, "left")].tolist()
        out: list[int] = []
        start = done = 0  # `out` holds the ids of data[:done]; the chunk begins at `start`
        for end, left, right in zip(ends, lefts, rights):
            if end > done:
                ids = self.inside(data, start, end, done, left) if left > done else []
                if ids is None:
                    left = done
                    ids = []
                out += ids
                if right > left:
                    self.repaired += 1
                    out += self.encode_piece(data[left:right])
                done = right
            start = end
        return out

    def inside(self, data: bytes, start: int, end: int, left: int, right: int) -> list[int] | None:
        """Ids of data[left:right] by those of the chunk data[start:end], None if these disagree at an end."""
        ids = self.encode_chunk(data[start:end])
        head = self.encode_piece(data[start:left]) if left > start else []
        tail = self.encode_piece(data[right:end]) if right < end else []
        last = len(ids) - len(tail)
        if last < len(head) or ids[: len(head)] != head or ids[last:] != tail:
            return None
        return ids[len(head) : last]

    def decode(self, ids: list[int]) -> str:
        """What the tokenizer's own decode gives: the file names no decoder, so tokens by a blank."""
        return " ".join(map(self.names.__getitem__, ids))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_documents(
    docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids): token ids per document."""

    def process():
        encoder = ChunkEncoder(spec)

        def rows(batch):
            for doc_id, data in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                yield doc_id, encoder.encode(data or b"")

        return rows

    source = docs.select(docs[id_col].cast("bigint"), docs[text_col])
    return map_rows(source, process, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, spec: str) -> DataFrame:
    """(doc_id, text): the decoded text of rows of `encode_documents`; null ids give null."""

    def process():
        encoder = ChunkEncoder(spec)

        def rows(batch):
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield doc_id, None if ids is None else encoder.decode(ids)

        return rows

    return map_rows(encoded.select("doc_id", "ids"), process, "doc_id bigint, text string")


def token_digests(
    docs: DataFrame,
    spec: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256, and (`with_ids`) the ids, by encoding and
    decoding in one pass."""

    def process():
        encoder = ChunkEncoder(spec)

        def rows(batch):
            for doc_id, data in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                ids = encoder.encode(data or b"")
                packed = np.array(ids, "<u4").tobytes()
                row = (
                    doc_id,
                    len(ids),
                    hashlib.sha256(packed).hexdigest(),
                    hashlib.sha256(encoder.decode(ids).encode()).hexdigest(),
                )
                yield (*row, ids) if with_ids else row

        return rows

    fields = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    fields += ", ids array<int>" if with_ids else ""
    return map_rows(docs.select(docs[id_col].cast("bigint"), docs[text_col]), process, fields)
