"""Token counts by greedy longest-match word pieces, in time linear in the text.

The vocabulary is a trie of word-initial pieces and a trie of continuation pieces.  Each
node has a failure link (where matching goes on after the longest pieces behind it are
taken) and the number of pieces taken on the way, both made once, breadth first.  A word
is then read once, character by character, and its number of pieces falls out without
any piece being built.  A word that the vocabulary cannot cover is one unknown token.

Words are ``[^\\x20\\x09-\\x0D]+``.  Within a batch each distinct word is matched once.

Defined results: null and empty texts have no words and no tokens; texts are read whole;
rows are counted one by one, so ties, repeated rows and null ids do not matter; an empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import slices, words_of
from .common import text_of
from .sentencepiece_codec import NORMAL, USER_DEFINED, parse_model

START, REST = 0, 1
_CACHED = 500_000


class PieceAutomaton:
    """Counts greedy longest-match pieces; ``count(word)`` gives (tokens, unknown)."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        self.ends: list[bool] = [False, False]
        for root, pieces in ((START, initial), (REST, continuing)):
            for piece in pieces:
                if piece:
                    self._insert(root, piece)
        self.fail: list[int] = [-1] * len(self.next)
        self.popped: list[int] = [0] * len(self.next)
        self._link()

    def _insert(self, node: int, piece: str) -> None:
        for c in piece:
            if c not in self.next[node]:
                self.next[node][c] = len(self.next)
                self.next.append({})
                self.ends.append(False)
            node = self.next[node][c]
        self.ends[node] = True

    def _link(self) -> None:
        queue = deque((START, REST))
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if self.ends[v]:
                    self.fail[v], self.popped[v] = REST, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], n

    def count(self, word: str) -> tuple[int, bool]:
        step, fail, popped = self.next, self.fail, self.popped
        node, n = START, 0
        for c in word:
            while c not in step[node]:
                if fail[node] < 0:
                    return 1, True
                n += popped[node]
                node = fail[node]
            node = step[node][c]
        while node > REST:
            if fail[node] < 0:
                return 1, True
            n += popped[node]
            node = fail[node]
        return n, False


def vocabulary(model: bytes) -> tuple[list[str], list[str]]:
    """Word-initial and continuation pieces of a SentencePiece vocabulary."""
    pieces = [p.text for p in parse_model(model).pieces if p.kind in (NORMAL, USER_DEFINED)]
    return [p[1:] for p in pieces if p.startswith("▁") and len(p) > 1], [p for p in pieces if not p.startswith("▁")]


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown."""
    with open(model_path, "rb") as f:
        initial, continuing = vocabulary(f.read())

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = PieceAutomaton(initial, continuing), {}
        for batch in batches:
            for part in slices(batch):
                words, bounds = words_of(part.column("text"), lower=False)
                coded = words.dictionary_encode()
                tokens, unknown = np.zeros((2, len(coded.dictionary)), dtype=np.int64)
                for i, w in enumerate(coded.dictionary.to_pylist()):
                    hit = known.get(w)
                    if hit is None:
                        if len(known) >= _CACHED:
                            known.clear()
                        hit = known[w] = automaton.count(w.decode("utf-8", "replace"))
                    tokens[i], unknown[i] = hit
                code = coded.indices.to_numpy()
                sums = [np.concatenate([[0], np.cumsum(x[code])]) for x in (tokens, unknown)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), *[pa.array(s[bounds[1:]] - s[bounds[:-1]], pa.int64()) for s in sums]], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(counts, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
