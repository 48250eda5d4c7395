r"""Token counts of whole texts under a unigram vocabulary, by dynamic programming over a trie.

The distinct pre-tokens (words `[^\x20\x09-\x0D]+`, each with a leading space mark) of a slice go into one trie. Forward
scores run down it level by level: the best segmentation of a node's prefix is that of an ancestor and one piece more, so a
prefix that many words share is scored once. Terminal nodes hold the token counts of their words, and a text's count is the
sum over its words.

Pieces are a public tokenizer's; a piece's probability follows Zipf's law in its rank. A character without a piece costs a
token for each UTF-8 byte. Of equal scores the segmentation with fewer tokens counts. Pieces are found by 64-bit hashes of code
points. Defined cases: null and blank texts have no tokens; repeated rows count alike; other columns are ignored; texts and
words are never cut.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, split_words

MARK, BASE = 0x2581, np.uint64(0x9E3779B97F4A7C15)
#: Log probability that a byte of an unknown character costs, below the rarest piece's.
PENALTY = 10.0


class Vocabulary:
    """Pieces and scores; lookup by length and hash."""

    def __init__(self, pieces: list[str], scores: np.ndarray):
        self.scores, self.longest = np.asarray(scores, float), max(map(len, pieces), default=1)
        self.unknown = float(self.scores.min(initial=0)) - PENALTY
        self.power = np.array([pow(int(BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        keys = np.array([self.key(np.array([self.code(p)], np.uint64), len(p))[0] for p in pieces], np.uint64) if pieces else np.zeros(0, np.uint64)
        self.lengths = sorted({len(p) for p in pieces})
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        bits = max(16, int(np.ceil(np.log2(max(len(pieces), 1)))) + 5)
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        at = (self.keys >> self.shift).astype(np.int64)
        twice = np.bincount(at, minlength=1 << bits) > 1
        self.slot[at] = np.arange(len(at))
        self.slot[twice] = -2

    @staticmethod
    def code(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) % (1 << 64)
        return h

    @staticmethod
    def key(code: np.ndarray, length: int) -> np.ndarray:
        return mix(code + np.uint64(length << 56))

    def find(self, code: np.ndarray, length: int) -> np.ndarray:
        """Score of the piece with that code and length; -inf where there is none."""
        k = self.key(code, length)
        i = self.slot[(k >> self.shift).astype(np.int64)].astype(np.int64)
        several = np.flatnonzero(i == -2)
        if len(several):
            i[several] = np.minimum(np.searchsorted(self.keys, k[several]), len(self.keys) - 1)
        hit = i >= 0
        hit[hit] = self.keys[i[hit]] == k[hit]
        out = np.full(len(code), -np.inf)
        out[hit] = self.scores[self.order[i[hit]]]
        return out


@lru_cache(maxsize=2)
def zipf_vocabulary(model: str) -> Vocabulary:
    """The plain pieces of a sentencepiece model, by rank."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    rank = np.arange(1, len(ids) + 1)
    return Vocabulary([sp.id_to_piece(i) for i in ids], -np.log(rank) - np.log((1 / rank).sum()))


def trie_counts(words: pa.Array, v: Vocabulary) -> np.ndarray:
    """Tokens of each distinct word."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    order = pc.array_sort_indices(words).to_numpy()  # by bytes, which is by code points
    sorted_ = words.take(pa.array(order))
    size = pc.utf8_length(sorted_).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    start = np.cumsum(size) - size
    points = np.full(int(size.sum()), MARK, np.int64)
    inner = np.ones(len(points), bool)
    inner[start] = False
    points[inner] = np.frombuffer("".join(sorted_.to_pylist()).encode("utf-32-le"), np.uint32)
    # trie: node[start + d - 1] is the node of a word's prefix of d characters; shared ones are the word's before
    node = np.empty(len(points), np.int64)
    live, parents, made, d = np.arange(n), np.zeros(n, np.int64), 1, 0
    all_score, all_count, all_code = np.zeros(1 << 16), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint64)
    while True:
        d += 1
        keep = size[live] >= d
        live, parents = live[keep], parents[keep]
        if not len(live):
            break
        char = points[start[live] + d - 1]
        new = np.concatenate([[True], (parents[1:] != parents[:-1]) | (char[1:] != char[:-1])])
        mine = made + np.cumsum(new) - 1
        node[start[live] + d - 1] = mine
        word, up, c = live[new], parents[new], char[new]
        top = made + len(word)
        while top > len(all_score):
            all_score, all_count, all_code = (np.concatenate([x, np.zeros_like(x)]) for x in (all_score, all_count, all_code))
        own = all_code[up] * BASE + c.astype(np.uint64) + np.uint64(1)
        all_code[made:top] = own
        best, least = np.full(len(word), -np.inf), np.zeros(len(word), np.int64)
        for length in v.lengths:
            if length > d:
                break
            before = node[start[word] + d - length - 1] if length < d else np.zeros(len(word), np.int64)
            piece = v.find(own - all_code[before] * v.power[length], length)
            if length == 1:
                unknown = np.isinf(piece)
                width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                piece, tokens = np.where(unknown, v.unknown * width, piece), np.where(unknown, width, 1)
            else:
                tokens = 1
            s, t = all_score[before] + piece, all_count[before] + tokens
            better = (s > best) | ((s == best) & (t < least))
            best, least = np.where(better, s, best), np.where(better, t, least)
        all_score[made:top], all_count[made:top] = best, least
        made, parents = top, mine
    out = np.empty(n, np.int64)
    out[order] = all_count[node[start + size - 1]]
    return out


def _rows(batches, model):
    v = zipf_vocabulary(model)
    for b in slices(batches, "text", rows=4096):
        codes, words, owner = split_words(b.column("text"))
        tokens = np.bincount(owner, trie_counts(words, v)[codes] if len(codes) else None, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.bincount(owner, minlength=b.num_rows).astype(np.int64)), pa.array(tokens.astype(np.int64))], ["doc_id", "n_pretokens", "n_tokens"])


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row of docs (doc_id, text); model: path of a sentencepiece model."""
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.mapInArrow(partial(_rows, model=model), "doc_id long, n_pretokens long, n_tokens long")
