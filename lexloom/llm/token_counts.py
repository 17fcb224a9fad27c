"""Word-piece token counts without pieces: a linear longest-match automaton.

The vocabulary becomes a trie with two roots (word starts and continuations). As in the published linear maximum matching for word
pieces (Song et al., 2021), every node has a failure link and the number of tokens popped on the way along it, computed once, breadth
first; a word's count is then the sum of the pops met while its characters are read once. Many distinct words advance together, one
character a step, in numpy.

Words are runs of word characters or single other characters between white space, of any length (`max_chars` sets a limit, beyond which a word is
unknown, as in some implementations of the rule). A word that the vocabulary can't spell counts as one unknown token. A null or empty text counts 0; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .sentencepiece_codec import BYTE, CONTROL, MARK, UNKNOWN, Model
from .wordcache import ChunkCache

START, CONTINUE = 0, 1
LONG = 100  # characters of a word from which it is read by itself


def word_pieces(path: str) -> tuple[set[str], set[str]]:
    """Pieces that begin a word (marked ones) and that continue one (the others); single characters do both."""
    m = Model.load(path)
    own = [p for p, k in zip(m.pieces, m.kinds, strict=True) if k not in (BYTE, CONTROL, UNKNOWN)]
    begin = {p[1:] for p in own if p[:1] == MARK and len(p) > 1 and MARK not in p[1:]}
    more = {p for p in own if MARK not in p}
    single = {p for p in begin | more if len(p) == 1}
    return begin | single, more | single


class Automaton:
    def __init__(self, begin: Iterable[str], more: Iterable[str]):
        goto: dict[tuple[int, str], int] = {}
        final, level, edges = {}, [START, CONTINUE], []
        for root, words in ((START, begin), (CONTINUE, more)):
            for word in sorted(words):
                at = root
                for c in word:
                    nxt = goto.get((at, c))
                    if nxt is None:
                        nxt = goto[at, c] = len(edges) + 2
                        edges.append((at, c))
                    at = nxt
                final[at] = True
        size = len(edges) + 2
        fail, pops = [-1] * size, [0] * size
        children: dict[int, list[int]] = {}
        for k, (at, _) in enumerate(edges):
            children.setdefault(at, []).append(k + 2)
        while level:
            level = [v for u in level for v in children.get(u, ())]
            for v in level:
                u, c = edges[v - 2]
                if final.get(v):
                    fail[v], pops[v] = CONTINUE, 1
                    continue
                z, popped = fail[u], pops[u]
                while z >= 0 and (z, c) not in goto:
                    popped += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = goto[z, c], popped
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for _, c in edges}))}
        self.width = len(self.alphabet) + 1
        keys = np.array([at * self.width + self.alphabet[c] for at, c in edges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], (order + 2).astype(np.int64)
        self.fail, self.pops = np.array(fail, dtype=np.int64), np.array(pops, dtype=np.int64)
        self.code = np.zeros(0x110000, dtype=np.int32)
        for c, i in self.alphabet.items():
            self.code[ord(c)] = i
        self.goto: dict[int, int] | None = None

    def count_long(self, word: str) -> int:
        """The same for one long word, where a step in numpy for each character would cost more."""
        if self.goto is None:
            self.goto, self.links = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True)), (self.fail.tolist(), self.pops.tolist())
        fail, pops = self.links
        state, count = START, 0
        for c in self.code[np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)].tolist():
            while state >= 0 and (to := self.goto.get(state * self.width + c)) is None:
                count += pops[state]
                state = fail[state]
            if state < 0:
                return -1
            state = to
        while state >= 0 and state != CONTINUE:
            count += pops[state]
            state = fail[state]
        return -1 if state < 0 else count

    def counts(self, words: list[str], max_chars: int | None = None) -> np.ndarray:
        """Tokens of each word; -1 where the word is unknown."""
        length = np.array([len(w) for w in words], dtype=np.int64)
        out = np.zeros(len(words), dtype=np.int64)
        most = int(length.max(initial=0)) if max_chars is None else max_chars
        out[length > most] = -1
        for i in np.flatnonzero((length > LONG) & (length <= most)).tolist():
            out[i] = self.count_long(words[i])
        order = np.argsort(-length, kind="stable")
        order = order[length[order] <= min(most, LONG)]
        if not len(order):
            return out
        codes = self.code[np.frombuffer("".join(words[i] for i in order).encode("utf-32-le"), dtype=np.uint32)].astype(np.int64)
        length = length[order]
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        state, count = np.full(len(order), START, dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        for k in range(int(length[0])):
            n = int(np.searchsorted(-length, -k, side="left"))
            todo = np.flatnonzero(state[:n] >= 0)
            c = codes[start[todo] + k]
            while len(todo):
                key = state[todo] * self.width + c
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                state[todo[hit]] = self.to[at[hit]]
                todo, c = todo[~hit], c[~hit]
                count[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
                on = state[todo] >= 0
                todo, c = todo[on], c[on]
        todo = np.flatnonzero((state >= 0) & (state != CONTINUE) & (length > 0))
        while len(todo):
            count[todo] += self.pops[state[todo]]
            state[todo] = self.fail[state[todo]]
            todo = todo[(state[todo] >= 0) & (state[todo] != CONTINUE)]
        count[state < 0] = -1
        out[order] = count
        return out


class Counter:
    """(words, tokens, unknown words) of texts, with the counts of distinct chunks kept."""

    def __init__(self, path: str, max_chars: int | None):
        import regex

        self.automaton, self.max_chars = Automaton(*word_pieces(path)), max_chars
        self.split = regex.compile(r"\n|\w+|[^\w\s]").findall
        self.words, self.chunks = ChunkCache(self._words), ChunkCache(self._chunks)

    def _words(self, words: list[str]) -> list[int]:
        return self.automaton.counts(words, self.max_chars).tolist()

    def _chunks(self, raw: list[bytes]) -> list[int]:
        """Three counts in one integer, 40 bits apart."""
        found = self.split(b"\n".join(raw).decode())
        known = self.words.get({x for x in found if x != "\n"})
        out, own = [], 0
        for x in found:
            if x == "\n":
                out.append(own)
                own = 0
            else:
                n = known[x]
                own += 1 + (n << 40) if n >= 0 else 1 + (1 << 40) + (1 << 80)
        return [*out, own]

    def count(self, texts: list[str]) -> list[tuple[int, int, int]]:
        words = [x.encode().split() for x in texts]
        known = self.chunks.get(set().union(*words)) if words else {}
        low = (1 << 40) - 1
        return [((n := sum(map(known.__getitem__, w))) & low, n >> 40 & low, n >> 80) for w in words]


@lru_cache(maxsize=2)
def counter(path: str, max_chars: int | None) -> Counter:
    return Counter(path, max_chars)


def count_tokens(docs: DataFrame, path: str, max_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, max_chars)
        for part in chunks(batches):
            rows = [(d, *n) for d, n in zip(part["doc_id"], own.count(part["text"]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
