"""Token counts by dynamic programming on a trie (operator 8).

The model is a unigram one: a pre-token is cut into the vocabulary pieces of the highest total score. The distinct
pre-tokens of a slice are put into a trie, letter by letter. Each node holds the best score of the path to it, the pieces
that this takes, and the vocabulary pieces that are still open there; so a prefix that many pre-tokens share is scored
once, and each terminal node stores its count. A task keeps its trie from slice to slice, up to a bounded size; a pre-token
that is longer than words are shares no prefix worth keeping and is scored by the same recurrence without nodes.
"""

from __future__ import annotations

import gc
import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

SPACE = "▁"
#: Nodes that a task's trie may have before it is begun anew. Pre-tokens over LONG letters are scored without a node for each letter.
MOST_NODES, LONG = 200_000, 200
#: Letters of stored pre-tokens up to which a task keeps their counts for its next slice.
MOST_LETTERS = 8_000_000


def scores_of(path: str) -> dict[str, float]:
    """Piece -> log probability, from the order of the vocabulary in a SentencePiece file: the n-th has one by Zipf's law.

    Byte and control pieces are left out. The order is by merge, so by falling frequency in the text that it came from.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / n for n in range(1, len(pieces) + 1)))
    return {p: -math.log(n) - total for n, p in enumerate(pieces, 1)}


class Trie:
    """Counts of pieces in pre-tokens. A letter that no piece covers costs ``unknown`` and is one piece for each of its bytes.

    Of cuts of equal score that with fewer pieces counts.
    """

    def __init__(self, scores: dict[str, float], most: int = MOST_NODES):
        self.vocabulary: dict = {}  # letter -> [score or None, dict]
        for piece, score in scores.items():
            inside = self.vocabulary
            for letter in piece:
                node = inside.setdefault(letter, [None, {}])
                inside = node[1]
            node[0] = score
        self.unknown = 2 * min(scores.values(), default=-1.0)
        self.most = most
        self.clear()

    def restart(self) -> None:
        self.root: list = [(0.0, 0), [(0.0, 0, self.vocabulary)], {}]  # (-score, pieces), open pieces, children
        self.nodes = 0

    def clear(self) -> None:
        self.restart()
        self.terminal: dict[str, int] = {}
        self.letters = 0

    def step(self, node: list, letter: str) -> list:
        """The node behind ``node`` and a letter; neither is changed."""
        (cost, pieces), open_pieces, _ = node
        best, still = (math.inf, 0), []
        for start, before, inside in open_pieces:
            found = inside.get(letter)
            if found:
                if found[0] is not None and (reached := (start - found[0], before + 1)) < best:
                    best = reached
                if found[1]:
                    still.append((start, before, found[1]))
        if best[0] == math.inf:
            best = cost - self.unknown, pieces + len(letter.encode("utf-8", "surrogatepass"))
        still.append((*best, self.vocabulary))
        return [best, still, {}]

    def child(self, node: list, letter: str) -> list:
        node[2][letter] = made = self.step(node, letter)
        self.nodes += 1
        return made

    def rolled(self, pretoken: str) -> int:
        """The pieces of a long pre-token by the same recurrence; what is held is the last node, so the pieces that are open there."""
        node = self.step(self.root, SPACE)
        for letter in pretoken:
            node = self.step(node, letter)
        return node[0][1]

    def insert(self, pretokens: list[str]) -> None:
        """Store the pieces of each, behind the mark of a blank; nodes are made only for what no earlier one began with.

        A trie of too many nodes is begun anew in between; what is stored stays.
        """
        collecting = gc.isenabled()
        gc.disable()  # it would go over the whole trie again and again
        try:
            for pretoken in pretokens:
                if len(pretoken) > LONG:
                    self.terminal[pretoken] = self.rolled(pretoken)
                    continue
                if self.nodes > self.most:
                    self.restart()
                node = self.root[2].get(SPACE) or self.child(self.root, SPACE)
                for letter in pretoken:
                    node = node[2].get(letter) or self.child(node, letter)
                self.terminal[pretoken] = node[0][1]
            self.letters += sum(map(len, pretokens))
        finally:
            if collecting:
                gc.enable()


@cache
def _trie(path: str) -> Trie:
    return Trie(scores_of(path))


def pretokens(text: str) -> list[str]:
    """Runs without white space, each behind the mark of a blank."""
    return text.split()


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens): a row for each of ``docs``; both are 0 for a null or empty text.

    Whole texts are counted; rows may repeat, a null id stays null, other columns are unused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(model_path)
        for part in by_bytes(batches, 1):
            counted = [Counter(pretokens(t)) if t else Counter() for t in part.column(1).to_pylist()]
            if trie.nodes > trie.most or len(trie.terminal) > trie.most or trie.letters > MOST_LETTERS:
                trie.clear()
            trie.insert(sorted(set().union(*counted).difference(trie.terminal)))
            known = trie.terminal
            tokens = [sum(known[p] * n for p, n in c.items()) for c in counted]
            yield pa.record_batch([part.column(0), pa.array([c.total() for c in counted], pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
