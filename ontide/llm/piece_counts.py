"""Counts of greedy word pieces by a linear longest-match automaton.

The vocabulary is a trie with failure links (Song et al., 2021). Where no longer piece can follow, the
link leads to the state of what is left after the longest pieces so far are taken off; here each
link carries only how many pieces that takes off, so a word's count is a sum along its
characters and no piece is ever built. The time is linear in the word, whatever the pieces.

A word is a run without white space. With the spare pieces of a model file every word can be spelled: where
no piece starts a word, the bare mark does, as one token, and a character without a piece is one token
for each of its UTF-8 bytes. A word that the pieces can't spell counts as one unknown token. Null and empty texts have no words and no tokens. Repeated rows give equal rows; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ontide.llm.common import map_rows

START, INNER = 0, 1
MARK = "▁"


@dataclass(frozen=True)
class SparePieces:
    """What spells words beside the pieces: the bare mark, and bytes that are pieces themselves."""

    mark: bool = False
    bytes: frozenset[int] = frozenset()

    def spelled(self, char: str) -> int | None:
        """Tokens of a character that isn't a piece, or None where its bytes aren't pieces either."""
        data = char.encode()
        return len(data) if self.bytes.issuperset(data) else None


class PieceCounter:
    """`count(word)`: the number of pieces, or None where the vocabulary can't spell the word."""

    def __init__(self, initial: set[str], inner: set[str], spare: SparePieces = SparePieces()):
        self.spare = spare
        self.edges: list[dict[str, int]] = [{}, {}]
        ends: list[int] = [0, 0]  # tokens of the piece that ends at a node
        spelled = {char: n for char in set().union(*initial, *inner) - inner if (n := spare.spelled(char))}
        for root, pieces in ((START, initial), (INNER, inner), (INNER, spelled)):
            for piece in pieces:
                node = root
                for char in piece:
                    if char not in self.edges[node]:
                        self.edges[node][char] = len(self.edges)
                        self.edges.append({})
                        ends.append(0)
                    node = self.edges[node][char]
                if piece:
                    ends[node] = spelled[piece] if pieces is spelled else 1
        self.link: list[int | None] = [None] * len(self.edges)
        self.popped = [0] * len(self.edges)
        marked = 1 if spare.mark else spare.spelled(MARK)
        if marked:
            self.link[START], self.popped[START] = INNER, marked
        queue = deque([START, INNER])
        while queue:
            node = queue.popleft()
            for char, child in self.edges[node].items():
                queue.append(child)
                if ends[child]:
                    self.link[child], self.popped[child] = INNER, ends[child]
                    continue
                popped, target = self.popped[node], self.link[node]
                while target is not None and char not in self.edges[target]:
                    popped += self.popped[target]
                    target = self.link[target]
                if target is not None:
                    self.link[child], self.popped[child] = self.edges[target][char], popped

    def count(self, word: str) -> int | None:
        edges, link, popped = self.edges, self.link, self.popped
        node, total = START, 0
        for char in word:
            following = edges[node].get(char)
            while following is None:
                if node == INNER and (spelled := self.spare.spelled(char)):
                    total, following = total + spelled, INNER
                    break
                total += popped[node]
                node = link[node]
                if node is None:
                    return None
                following = edges[node].get(char)
            node = following
        while node != INNER:
            total += popped[node]
            node = link[node]
            if node is None:
                return None
        return total


def piece_vocabulary(model_file: str) -> tuple[set[str], set[str]]:
    """Pieces that start a word and pieces inside one, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    initial = {piece[1:] for piece in pieces if piece.startswith(MARK)} - {""}
    return initial, {piece for piece in pieces if not piece.startswith(MARK)}


def spare_pieces(model_file: str) -> SparePieces:
    """The bare mark and the byte pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    values = frozenset(int(model.id_to_piece(i)[1:-1], 16) for i in ids if model.is_byte(i))
    return SparePieces(any(model.id_to_piece(i) == MARK for i in ids), values)


def count_pieces(
    docs: DataFrame,
    vocabulary: tuple[set[str], set[str]],
    id_col: str = "doc_id",
    text_col: str = "text",
    memo_words: int = 200_000,
    spare: SparePieces = SparePieces(),
) -> DataFrame:
    """Per document: n_words, n_tokens, n_unknown (words that the pieces can't spell).

    The vocabulary is a file of fixed size that goes to the tasks with the code. Counts of
    words met before are kept per task, `memo_words` of them at most.
    """
    initial, inner = vocabulary

    def process():
        counter, memo = PieceCounter(initial, inner, spare), {}

        def rows(batch):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode().split() if text else []
                tokens = unknown = 0
                for word in words:
                    n = memo.get(word, -1)
                    if n == -1:
                        if len(memo) >= memo_words:
                            memo.clear()
                        n = memo[word] = counter.count(word.decode())
                    if n is None:
                        unknown += 1
                    else:
                        tokens += n
                yield doc_id, len(words), tokens + unknown, unknown

        return rows

    fields = "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint"
    return map_rows(docs.select(docs[id_col].cast("bigint"), docs[text_col]), process, fields)
