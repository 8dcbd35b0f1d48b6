"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens (words between white space, with the word-start sign before them) of a batch
are the paths of a trie. A node's forward score is the best score of any segmentation of its prefix;
it depends on the node's ancestors alone, so it is computed once for all pre-tokens that share the
prefix, level by level. A pre-token's count of tokens stands at its last node; a document's is the sum.
Once only a few pre-tokens are left, as when one is far longer than all others, no prefix of theirs is
shared any more: each goes on by itself from its node's scores, by the pieces that end at each byte.

Scores come from the vocabulary's order: a piece of rank r costs log(r + 2). A byte that no piece
covers is a piece of its own, at the cost of the whole vocabulary's logarithm times two. Of equal
scores the segmentation with fewer tokens counts, then the one with the longer last piece.

Null and blank texts have no tokens, an empty table gives an empty result, equal rows get equal counts,
and other columns are ignored. The time for a text, of one word or of many, grows with its length.
Nothing is shuffled; memory is bounded by a batch of texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import _BASE, _BYTE_VALUES, NOT_SPACE, Powers, U, mix, words

START = "▁".encode()
#: From so few pre-tokens on, each goes on by itself.
FEW = 96
_UP = Powers(_BASE)


class Vocabulary:
    """Pieces by their hash, with costs."""

    def __init__(self, pieces: list[str]):
        ranked: dict[bytes, float] = {}
        for rank, piece in enumerate(pieces):
            if piece:
                ranked.setdefault(piece.encode(), math.log(rank + 2))
        self.cost = ranked
        self.byte_cost = 2 * math.log(len(pieces) + 2)
        self.longest = max(map(len, ranked), default=1)
        #: All ends of pieces: where a run of bytes is none, no longer piece ends there either.
        self.ends = {piece[k:] for piece in ranked for k in range(len(piece))}
        hashes = np.array([piece_hash(p) for p in ranked], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.costs = hashes[order], np.array(list(ranked.values()))[order]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """The ordinary pieces of a sentencepiece model, in its order."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def piece_hash(piece: bytes) -> int:
    """sum of value(byte k) * base^(n - 1 - k), mixed with the length."""
    h = 0
    for b in piece:
        h = (h * _BASE + int(_BYTE_VALUES[b])) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([h], np.uint64) + U(len(piece)))[0])


def counts(texts: list[bytes], own: Vocabulary) -> np.ndarray:
    """The number of tokens of each of the distinct, sorted pre-tokens."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    up = _UP.upto(own.longest + 1)[0]
    done = np.zeros(len(texts), np.int64)
    live = np.arange(len(texts))
    node = np.zeros(len(texts), np.int64)
    # per level, of its nodes: parent, hash of the prefix, score, tokens
    levels = [(np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64))]
    depth = 0
    while True:
        ended = lengths[live] == depth
        done[live[ended]] = levels[-1][3][node[ended]]
        live, node = live[~ended], node[~ended]
        if len(live) <= FEW:
            return _finish(texts, own, done, live, node, levels, depth)
        byte = data[starts[live] + depth]
        # texts are sorted, so those that share a prefix are neighbours
        fresh = np.ones(len(live), bool)
        fresh[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
        parent, last = node[fresh], byte[fresh]
        node = np.cumsum(fresh) - 1
        depth += 1
        prefix = levels[-1][1][parent] * U(_BASE) + _BYTE_VALUES[last]
        score = levels[-1][2][parent] + own.byte_cost
        tokens = levels[-1][3][parent] + 1
        above = parent
        for size in range(1, min(depth, own.longest) + 1):
            _, hashes, scores, n = levels[-size]
            piece = mix(prefix - hashes[above] * up[size] + U(size))
            place = np.minimum(np.searchsorted(own.hashes, piece), len(own.hashes) - 1)
            new = np.where(own.hashes[place] == piece, scores[above] + own.costs[place], np.inf)
            m = n[above] + 1
            better = (new < score - 1e-9) | (np.abs(new - score) <= 1e-9) & (m <= tokens)
            score, tokens = np.where(better, new, score), np.where(better, m, tokens)
            above = levels[-size][0][above]
        levels.append((parent, prefix, score, tokens))
        if len(levels) > own.longest + 1:
            levels.pop(0)


def _finish(texts: list[bytes], own: Vocabulary, done: np.ndarray, live: np.ndarray, node: np.ndarray, levels: list, depth: int) -> np.ndarray:
    """done, with the counts of the live texts, whose first depth bytes stand at the nodes."""
    known = min(depth, own.longest)
    above, history = node, []
    for k in range(known + 1):
        parent, _, scores, n = levels[-1 - k]
        history.append((scores[above].tolist(), n[above].tolist()))
        above = parent[above]
    for i, place in enumerate(live.tolist()):
        text = texts[place]
        # of the prefixes that end with each byte, from known bytes before depth on
        score = [history[k][0][i] for k in range(known, -1, -1)]
        tokens = [history[k][1][i] for k in range(known, -1, -1)]
        first = depth - known
        for end in range(depth + 1, len(text) + 1):
            best, least = score[-1] + own.byte_cost, tokens[-1] + 1
            for size in range(1, min(end, own.longest) + 1):
                piece = text[end - size : end]
                if piece not in own.ends:
                    break
                if (cost := own.cost.get(piece)) is not None:
                    new, m = score[end - size - first] + cost, tokens[end - size - first] + 1
                    if new < best - 1e-9 or abs(new - best) <= 1e-9 and m <= least:
                        best, least = new, m
            score.append(best)
            tokens.append(least)
        done[place] = tokens[-1]
    return done


def count_tokens(documents: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words (pre-tokens), n_tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            n_words, n_tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            parts, place = [], {}
            for block in words(batch.column(1), NOT_SPACE, None):
                raw = block.data.tobytes()
                first, inverse = np.unique(block.hashes, return_index=True, return_inverse=True)[1:]
                ids = np.array([place.setdefault(raw[a:b], len(place)) for a, b in zip(block.starts[first].tolist(), block.ends[first].tolist(), strict=True)], np.int64)
                parts.append((block.docs, block.bounds, ids[inverse] if len(ids) else inverse))
                n_words[block.docs] = block.counts
            distinct = sorted(START + w for w in place)
            order = np.array([place[w[len(START) :]] for w in distinct], np.int64)
            of = np.zeros(len(place), np.int64)
            of[order] = counts(distinct, own)
            for docs, bounds, ids in parts:
                sums = np.concatenate([[0], np.cumsum(of[ids])])
                n_tokens[docs] = sums[bounds[1:]] - sums[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_tokens)], [doc_id, "n_words", "n_tokens"])

    own = documents.select(F.col(doc_id), F.col(text).cast("string"))
    return own.mapInArrow(counted, f"`{doc_id}` {own.schema[0].dataType.simpleString()}, n_words long, n_tokens long")
