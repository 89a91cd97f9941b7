"""Token counts by a linear longest-match automaton.

A word's pieces are found greedily: the longest piece of the vocabulary that the rest of the word starts
with, and so on; a word that cannot be cut to its end is one unknown token. The automaton is a trie of the
vocabulary. Each node has a failure link, where matching goes on when no child fits, and the number of pieces
that are popped on the way; so a word's count takes time linear in its length, and no piece is ever built.

Words are runs of anything but ASCII white space, each read with ``mark`` before it. A null or empty text has
0 tokens. A very long word is cut like any other, but not remembered, so a worker's memory has a bound. Rows that
repeat are counted each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sign that stands for the space before a word in the vocabulary read by ``read_pieces``.
MARK = "▁"
#: Counts of words that a worker remembers before it starts anew, and bytes of the longest of these words; longer ones are counted each time.
REMEMBER, LONGEST = 200_000, 64


def read_pieces(model_file: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file (no control, unknown or byte pieces)."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    return [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class LongestMatch:
    """Trie with failure links; ``count`` gives the number of greedy pieces of a word."""

    def __init__(self, pieces: Iterable[str]):
        self.child: dict[tuple[int, str], int] = {}
        whole, depth_first = [False], [{}]
        for piece in pieces:
            node = 0
            for c in piece:
                if (node, c) not in self.child:
                    self.child[node, c] = len(whole)
                    depth_first[node][c] = len(whole)
                    whole.append(False)
                    depth_first.append({})
                node = self.child[node, c]
            whole[node] = node > 0
        #: -1: nothing matches from here on.
        self.fail, self.popped = [-1] * len(whole), [0] * len(whole)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, to in depth_first[node].items():
                queue.append(to)
                if whole[to]:
                    self.fail[to], self.popped[to] = 0, 1
                    continue
                at, popped = self.fail[node], self.popped[node]
                while at >= 0 and (at, c) not in self.child:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[to], self.popped[to] = self.child[at, c], popped

    def count(self, word: str) -> int:
        node = n = 0
        child, fail, popped = self.child, self.fail, self.popped
        for c in word:
            while (to := child.get((node, c))) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


class _Counts(dict):
    """Counts of words met so far."""

    def __init__(self, match: LongestMatch, mark: str):
        super().__init__()
        self.match, self.mark = match, mark

    def __missing__(self, word: bytes) -> int:
        n = self.match.count(self.mark + word.decode("utf-8", "surrogatepass"))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, pieces: list[str], mark: str = MARK) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row. The vocabulary, a file of fixed size, goes to the executors once."""
    kept = docs.sparkSession.sparkContext.broadcast(LongestMatch(pieces))

    @F.pandas_udf("n_words long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Counts(kept.value, mark)
        for texts in batches:
            out = [(len(w), sum(map(known.__getitem__, w))) for w in ((t or "").encode("utf-8", "surrogatepass").split() for t in texts)]
            yield pd.DataFrame(out, columns=["n_words", "n_tokens"], dtype="int64")

    return docs.select("doc_id", count(F.col("text").cast("string")).alias("n")).select("doc_id", "n.n_words", "n.n_tokens")
