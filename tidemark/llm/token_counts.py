"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

The best segmentation of a pre-token under a unigram model maximises the sum of
its pieces' scores (ties: fewest pieces).  Its forward score at a prefix depends
on that prefix alone, so pre-tokens go into a trie whose nodes hold the best
score and the number of pieces so far; a prefix that pre-tokens share is scored
once, and a pre-token's count is read at its terminal node.

Pre-tokens are the words between white space, with the word mark in front.  A
character that no piece covers costs the lowest score less ``unknown`` and
counts as its UTF-8 bytes.

Each worker keeps a trie of about ``max_nodes`` nodes, which starts anew beyond
that, and the counts at the terminal nodes of frequent pre-tokens: memory stays
bounded and the counts do not depend on what is kept.  Null
and empty texts have no tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Cache, small, undisturbed

MARK = "▁"
#: Longer pre-tokens are counted by the same steps and leave no nodes.
LONG = 64


def rank_scores(path: str) -> dict[str, float]:
    """Piece -> log-probability by Zipf's law over the ranks of a sentencepiece file (which has no unigram scores of its own)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and (p := model.id_to_piece(i))]
    norm = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - norm for r, p in enumerate(pieces, 1)}


class Trie:
    """Tokens of pre-tokens.  A node is [score, tokens, children, alive].

    ``alive`` has, for each earlier boundary from which a piece may still end
    further on, the place in the vocabulary's own trie and the score and tokens
    up to the boundary: a new node follows its parent's by one character and
    looks at nothing else.
    """

    def __init__(self, scores: dict[str, float], unknown: float = 10.0, max_nodes: int = 300_000):
        self.max_nodes = max_nodes
        self.floor = min(scores.values(), default=0.0) - unknown
        self.vocabulary: dict = {}
        for piece, score in scores.items():
            at = self.vocabulary
            for c in piece:
                at = at.setdefault(c, {})
            at[""] = score
        self.reset()

    def reset(self) -> None:
        self.nodes = 1
        self.root = [0.0, 0, None, []]

    def step(self, node: list, c: str) -> list:
        """The node one character further: best score, then fewest tokens."""
        score, tokens, _, open_ = node
        alive, best, fewest = [], -math.inf, 0
        for at, s, n in (*open_, (self.vocabulary, score, tokens)):
            at = at.get(c)
            if at is not None:
                alive.append((at, s, n))
                own = at.get("")
                if own is not None and (s + own > best or s + own == best and n + 1 < fewest):
                    best, fewest = s + own, n + 1
        if "" not in self.vocabulary.get(c, ()):  # no piece for the character alone
            s, n = score + self.floor, tokens + len(c.encode("utf-8"))
            if s > best or s == best and n < fewest:
                best, fewest = s, n
        return [best, fewest, None, alive]

    def count(self, word: str) -> int:
        text = MARK + word
        if self.nodes > self.max_nodes:
            self.reset()
        node, keep = self.root, len(text) <= LONG
        for c in text:
            children = node[2]
            child = children.get(c) if children is not None else None
            if child is None:
                child = self.step(node, c)
                if keep:
                    if children is None:
                        node[2] = {c: child}
                    else:
                        children[c] = child
                    self.nodes += 1
            node = child
        return node[1]


_tries: dict = {}


def count(df: DataFrame, text: str, scores_of, source: str, out: str = "n_tokens", max_nodes: int = 300_000) -> DataFrame:
    """``df`` with ``n_pretokens`` and ``out``.  ``scores_of(source)`` gives the vocabulary's scores, once in each worker."""
    df = df.drop("n_pretokens", out)
    names = df.columns
    fields = "".join(f"`{n}` {t}, " for n, t in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (source, max_nodes) not in _tries:
            _tries[source, max_nodes] = Cache(Trie(scores_of(source), max_nodes=max_nodes).count, limit=300_000)
        tokens = _tries[source, max_nodes].__getitem__
        for b in small(batches):
            pre, total = [], []
            with undisturbed():
                for t in b.column(names.index(text)).to_pylist():
                    words = t.split() if t else []
                    pre.append(len(words))
                    total.append(sum(map(tokens, words)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pre, pa.int64()), pa.array(total, pa.int64())], [*names, "n_pretokens", out])

    return df.mapInArrow(run, f"{fields}n_pretokens long, `{out}` long").select(*[F.col(f"`{n}`") for n in names], "n_pretokens", out)
