"""Token counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of
pieces that are popped when the link is followed. A word's greedy longest-match
length is then the sum of popped numbers along one walk over its bytes; pieces
are never built and no byte is read twice.

A word is a run of non-white-space characters and is matched as a space
followed by its UTF-8 bytes. A word that the vocabulary can't cover counts as
one unknown token.

Defined results: null or white-space-only text has 0 words and 0 tokens;
repeated rows give repeated results; other columns are ignored unless named in
``keep``.
"""

from __future__ import annotations

import base64
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from granella.llm.common import tidy

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose lengths a worker remembers; the memory is emptied when it is full.
REMEMBERED = 400_000


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a rank file: base64 piece and rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    """Trie with failure links and popped-piece counts."""

    def __init__(self, pieces: list[bytes]):
        goto: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            u = 0
            for c in piece:
                v = goto[u].get(c)
                if v is None:
                    v = len(goto)
                    goto[u][c] = v
                    goto.append({})
                    ends.append(False)
                u = v
            if u:
                ends[u] = True
        link: list[int] = [-1] * len(goto)  # -1: no way on, the word is unknown
        pops = [0] * len(goto)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in goto[u].items():
                if ends[v]:
                    link[v], pops[v] = 0, 1
                else:
                    z, n = link[u], pops[u]
                    while z >= 0 and c not in goto[z]:
                        n += pops[z]
                        z = link[z]
                    if z >= 0:
                        link[v], pops[v] = goto[z][c], n
                queue.append(v)
        self.goto, self.link, self.pops = goto, link, pops

    def length(self, word: bytes) -> int:
        """Number of pieces of the greedy longest match; 1 if there is none; 0 for no bytes."""
        goto, link, pops, u, n = self.goto, self.link, self.pops, 0, 0
        for c in word:
            v = goto[u].get(c)
            while v is None:
                z = link[u]
                if z < 0:
                    return 1
                n += pops[u]
                u = z
                v = goto[u].get(c)
            u = v
        while u:
            if link[u] < 0:
                return 1
            n += pops[u]
            u = link[u]
        return n


class _Lengths(dict):
    def __init__(self, automaton: LongestMatch):
        self.length = automaton.length

    def __missing__(self, word: str) -> int:
        n = self.length(b" " + word.encode("utf-8", "surrogatepass"))
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n
        return n


_built: dict[str, _Lengths] = {}


def _lengths(key: str, pieces) -> _Lengths:
    """This worker's automaton for a vocabulary, built once."""
    if key not in _built:
        _built.clear()
        _built[key] = _Lengths(LongestMatch(pieces.value))
    return _built[key]


def count_tokens(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_words and n_tokens of every row. The vocabulary's size bounds the broadcast."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    fields = [docs.schema[c] for c in keep]

    def run(batches):
        lengths = _lengths(vocabulary, pieces)
        for b in batches:
            words, tokens = [], []
            for t in b.column(text).to_pylist():
                w = (t or "").split()
                words.append(len(w))
                tokens.append(sum(map(lengths.__getitem__, w)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*keep, "n_words", "n_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_words bigint", "n_tokens bigint"])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run), schema)
