"""Token counts by a linear longest-match automaton.

Greedy word pieces: a word takes the longest vocabulary piece that begins it, then the longest
continuation piece that begins the rest, and so on; a word that cannot be spelled so is one unknown token.
Where the vocabulary has the bare mark, it is the shortest piece that begins any word: a word that no other
piece begins takes it as a token of its own and goes on with continuation pieces.
The vocabulary is a trie over bytes with failure links. Where no edge goes on, the automaton has already
settled some pieces: their number is stored with the failure link, so a word is read once from left to
right and its piece count is a sum of stored numbers. No piece is ever built.

The automaton runs over the distinct words of a slice of texts at once, one byte of every word a step; the few words of
more than ``LONG`` bytes are run one by one.
Words are runs of anything but ASCII white space, so punctuation is spelled with the word it touches.

Null and empty texts have no words and no tokens. Rows with null or repeated ids, and repeated rows, each keep their row;
no other column is read, whatever its name. A text, and a word, of any length is counted whole. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm._shared import texts
from docketry.llm._words import SPACED, Words, sliced

SENTENCEPIECE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of a word that is run on its own, as so few words are left at that step that they gain nothing from each other.
LONG = 256


def pieces_of(path: str = SENTENCEPIECE) -> tuple[list[bytes], list[bytes]]:
    """``(word-initial pieces, continuation pieces)`` of a sentencepiece vocabulary: the mark begins a word.
    The bare mark is the empty word-initial piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, more = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith(MARK):
            first.append(piece[1:].encode())
        else:
            more.append(piece.encode())
    return first, more


class Automaton:
    """Edges as sorted keys ``state * 256 + byte``; per state a failure link and the pieces settled by taking it.

    State 0 is the start of a word, state 1 the start of a continuation; state -1 is nowhere.
    """

    def __init__(self, first: list[bytes], more: list[bytes]):
        edges: dict[tuple[int, int], int] = {}
        ends: set[int] = set()
        states = 2
        parent: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
        for root, pieces in ((0, first), (1, more)):
            for piece in pieces:
                at = root
                for byte in piece:
                    to = edges.get((at, byte))
                    if to is None:
                        edges[at, byte] = to = states
                        parent.append((at, byte))
                        states += 1
                    at = to
                if at > 1:
                    ends.add(at)
        fail = np.full(states, -1, np.int64)
        pops = np.zeros(states, np.int64)
        if b"" in first:
            fail[0], pops[0] = 1, 1
        level, order = [0, 1], []
        children: dict[int, list[int]] = {}
        for state in range(2, states):
            children.setdefault(parent[state][0], []).append(state)
        while level:
            level = [c for s in level for c in children.get(s, ())]
            order += level
        for state in order:
            if state in ends:
                fail[state], pops[state] = 1, 1
                continue
            at, byte = parent[state]
            to, settled = fail[at], pops[at]
            while to >= 0 and (to, byte) not in edges:
                settled += pops[to]
                to = fail[to]
            if to >= 0:
                fail[state], pops[state] = edges[int(to), byte], settled
        self.fail, self.pops = fail, pops
        keys = np.array([s * 256 + b for s, b in edges], np.int64)
        to = np.array(list(edges.values()), np.int64)
        by = np.argsort(keys)
        self.keys, self.to = keys[by], to[by]
        self.edges: dict | None = None

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        want = state * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.to[at], -1)

    def one(self, word: bytes) -> tuple[int, bool]:
        """``(tokens, whether known)`` of a single word."""
        if self.edges is None:
            self.edges = dict(zip(self.keys.tolist(), self.to.tolist()))
        edges, fail, pops = self.edges, self.fail, self.pops
        state = count = 0
        for byte in word:
            to = edges.get(state * 256 + byte)
            while to is None:
                back = int(fail[state])
                if back < 0:
                    return 1, False
                count += int(pops[state])
                state = back
                to = edges.get(state * 256 + byte)
            state = to
        while state > 1:
            back = int(fail[state])
            if back < 0:
                return 1, False
            count += int(pops[state])
            state = back
        return count, True

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(tokens, whether unknown)`` of the words ``data[starts[i] : ends[i]]``."""
        n = len(starts)
        count, known = np.zeros(n, np.int64), np.ones(n, bool)
        if not len(self.keys):
            return np.ones(n, np.int64), known
        long_ = np.flatnonzero(ends - starts > LONG)
        if len(long_):
            short = np.flatnonzero(ends - starts <= LONG)
            count[short], lost = self.counts(data, starts[short], ends[short])
            known[short] = ~lost
            for i in long_.tolist():
                count[i], known[i] = self.one(data[starts[i] : ends[i]].tobytes())
            return np.where(known, count, 1), ~known
        state = np.zeros(n, np.int64)
        size = ends - starts
        by = np.argsort(-size, kind="stable")
        live = n
        for depth in range(int(size.max()) if n else 0):
            live = int(np.searchsorted(-size[by], -depth, side="left"))
            now = by[:live]
            now = now[known[now]]
            if not len(now):
                break
            byte = data[starts[now] + depth].astype(np.int64)
            to = self.step(state[now], byte)
            while True:
                stuck = np.flatnonzero(to < 0)
                if not len(stuck):
                    break
                who = now[stuck]
                back = self.fail[state[who]]
                lost = back < 0
                known[who[lost]] = False
                count[who] += np.where(lost, 0, self.pops[state[who]])
                state[who] = np.where(lost, 0, back)
                to[stuck] = np.where(lost, 0, self.step(state[who], byte[stuck]))
            state[now] = to
        # what is left over at the end of a word is settled along the failure links
        while True:
            who = np.flatnonzero(known & (state > 1))
            if not len(who):
                break
            back = self.fail[state[who]]
            known[who[back < 0]] = False
            count[who] += np.where(back < 0, 0, self.pops[state[who]])
            state[who] = np.where(back < 0, 0, back)
        return np.where(known, count, 1), ~known


def counted(docs: DataFrame, vocabulary: str = SENTENCEPIECE, pieces: tuple | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every text.

    ``vocabulary`` is read once, on the driver; what is sent to the tasks grows with it, not with the corpus.
    """
    docs = texts(docs)
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(*(pieces or pieces_of(vocabulary))))
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(batches):
        automaton, cache = sent.value, {}
        for part in sliced(batches):
            w = Words(part.column("text"), SPACED, cache, fold=False)
            _, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
            tokens, unknown = automaton.counts(w.bytes, w.starts[at], w.ends[at])
            total = lambda x: np.diff(np.append(0, np.cumsum(x[back]))[w.first])  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(w.first)), pa.array(total(tokens)), pa.array(total(unknown.astype(np.int64)))], schema=out)

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
