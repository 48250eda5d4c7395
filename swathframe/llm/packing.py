"""Lexical retrieval packing: sequences of bounded length filled with documents that share words.

Texts become token ids (a public tokenizer's, then an end id) and are sorted by which of their ids weighted sampling picks
(the BM25 weight in the whole corpus is the chance, so that documents which share telling ids lie together). The sorted
documents are cut into shards of bounded size. Every shard keeps a BM25 inverted index over its documents' ids, with the
corpus' document frequencies and mean length. A seed document asks the index for its unused neighbours, and these fill its
window greedily, best first; where no whole one fits any more the best is cut, and its rest seeds the next window. So all
windows of a shard are full but its last. Documents of more than a window give whole windows first.

A seed does not search other shards than its own: that finds every neighbour but grows with the square of the corpus.

The tokenizer drops white space and never joins across it, so a text's ids are those of its words; each worker remembers
the ids of words' parts in a table of bounded size.

Defined cases: null text is empty and has the end id only; repeated rows and equal doc_ids are packed row by row, told
apart by row_id; a null doc_id stays null; other columns are ignored; an empty table gives no rows. Texts are never cut
short: each id of each row is in exactly one piece.
"""

from __future__ import annotations

import os
import zlib
from functools import partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, runs, settle, slices, split_words

WINDOW, END, K1, B = 4096, 2, 1.2, 0.75
#: Characters of a shard, about; parts that a worker remembers.
SHARD_CHARS, REMEMBERED = 2 << 20, 300_000
#: Shards of a partition, about; ids picked for a document's place.
SHARDS_A_PART, LEVELS = 4, 3
#: Documents a partition, about, whose places part the documents.
SAMPLED = 100


#: Words of these characters (ASCII and the letters of Latin-1) need no normalisation but lower case, and split by PARTS.
PLAIN, PARTS = "^[!-~À-ÖØ-öø-ÿ]+$", "('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+)"


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i], ..., start[i] + size[i] - 1 of all i in turn."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Words:
    """Token ids of words, by pre-tokens that a worker remembers.

    A plain word's pre-tokens go to the tokenizer's model one by one; any other word goes through the whole tokenizer.
    """

    held: dict[str, Words] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # the visible character that stands for a byte
        self.byte = {c: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.ids, self.start = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.int64)
        self.used = 0

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def encoded(self, part: str) -> list[int]:
        if part[0] == "\0":
            return self.whole.encode(part[1:], add_special_tokens=False).ids
        if not part.isascii():
            part = "".join(self.byte.get(c, c) for c in part)
        return [t.id for t in self.model.tokenize(part)]

    def rows(self, parts: list[str]) -> np.ndarray:
        """Row of each part in the table; row r has ids[start[r]:start[r + 1]]."""
        index = self.index
        new = [x for x in parts if x not in index]
        if len(index) + len(new) > REMEMBERED and index:
            self.clear()
            index, new = self.index, parts
        if new:
            found = [self.encoded(x) for x in new]
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.uint16, int(size.sum()))
            n, rows = len(index), len(index) + len(new) + 1
            if rows > len(self.start):
                self.start = np.resize(self.start, 2 * rows)
            if self.used + len(flat) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * (self.used + len(flat)))
            self.ids[self.used : self.used + len(flat)] = flat
            self.start[n:rows] = self.used + np.concatenate([[0], np.cumsum(size)])
            self.used += len(flat)
            index.update(zip(new, range(n, rows)))
        return np.fromiter(map(index.__getitem__, parts), np.int64, len(parts))

    def parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the parts of all words, and each word's first and number of them."""
        # "<|" may begin a special token, which the whole tokenizer knows
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|"))
        split = pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), PARTS, " \\1 ")
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(split))
        split = pc.list_flatten(split), pc.list_value_length(split).to_numpy(zero_copy_only=False)
        plain = plain.to_numpy(zero_copy_only=False)
        others = pc.binary_join_element_wise("\0", words.filter(pa.array(~plain)), "")
        coded = pa.concat_arrays([split[0], others]).dictionary_encode()
        rows = self.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        count = np.ones(len(words), np.int64)
        count[plain] = split[1]
        first = np.empty(len(words), np.int64)
        first[plain] = np.cumsum(split[1]) - split[1]
        first[~plain] = len(split[0]) + np.arange(len(others))
        return rows, first, count


def token_ids(texts: pa.Array, path: str) -> list[np.ndarray]:
    """The ids of each text, without the end id."""
    codes, words, owner = split_words(texts)
    if not len(codes):
        return [np.zeros(0, np.uint16)] * len(texts)
    table = Words.of(path)
    rows, first, count = table.parts(words)
    size = table.start[rows + 1] - table.start[rows]
    flat = table.ids[_gather(table.start[rows], size)]  # ids of the distinct words' parts in turn
    # a word's parts lie together, so its ids do
    begin = np.concatenate([[0], np.cumsum(size)])
    begin, end = begin[first], begin[first + count]
    ids = flat[_gather(begin[codes], (end - begin)[codes])]
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, (end - begin)[codes], len(texts)).astype(np.int64))])
    return [ids[at[i] : at[i + 1]] for i in range(len(texts))]


def _encode(batches, path):
    for b in slices(batches, "text", rows=8192, size=8 << 20):
        ids = [np.append(x, np.uint16(END)).tobytes() for x in token_ids(b.column("text"), path)]
        chars = pc.add(pc.fill_null(pc.utf8_length(b.column("text")), 0).cast(pa.int64()), 8)
        yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"), chars, pa.array(ids, pa.binary())], ["row_id", "doc_id", "chars", "ids"])


class Corpus(NamedTuple):
    """Number and mean length of the pieces of a corpus, and in how many of them each id is."""

    n: int
    mean: float
    df: np.ndarray


def _rests(ids: pa.Array, window: int) -> list[np.ndarray]:
    """What whole windows leave of each document."""
    ids = [np.frombuffer(x, np.uint16) for x in ids.to_pylist()]
    return [x[len(x) // window * window :] for x in ids]


def _terms(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, id and frequency of the distinct ids of each piece in turn."""
    flat = np.concatenate(pieces).astype(np.int64) if pieces else np.zeros(0, np.int64)
    pair, tf = np.unique(np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]) << 16 | flat, return_counts=True)
    return pair >> 16, pair & 0xFFFF, tf


def _counts(batches, window):
    """Documents and summed length of pieces by id; under id -1 of all pieces."""
    df, n, size = np.zeros(1 << 16, np.int64), 0, 0
    for b in slices(batches, "ids"):
        pieces = [p for p in _rests(b.column("ids"), window) if len(p)]
        df += np.bincount(_terms(pieces)[1], minlength=1 << 16)
        n, size = n + len(pieces), size + sum(map(len, pieces))
    term = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(term, -1)), pa.array(np.append(df[term], n)), pa.array(np.append(0 * term, size))], ["term", "n", "size"])


def _keyed(batches, window, corpus, bounds):
    """Each document's place: ids picked with their BM25 weights as chances, the same pick of equal ids. With bounds (key, row_id) the
    whole document under the part that its place is in, else the place alone."""
    for b in slices(batches, "ids"):
        pieces = _rests(b.column("ids"), window)
        piece, term, tf = _terms(pieces)
        key = np.zeros(len(pieces), np.int64)
        if len(piece):
            weight, start = _bm25(corpus, term, tf, np.array([len(p) for p in pieces])[piece]), np.flatnonzero(np.diff(piece, prepend=-1))
            many = np.diff(np.append(start, len(piece)))
            for level in range(LEVELS):
                chance = (mix(term + ((level + 1) << 32)) >> np.uint64(11)).astype(np.float64) + 0.5
                value = -np.log(chance / (1 << 53)) / weight
                least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, start), many))
                key[piece[start]] = key[piece[start]] << 16 | term[least[runs(piece[least])]]
        if bounds is None:
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column("row_id")], ["key", "row_id"])
        else:
            part = _part(bounds, key, b.column("row_id").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key), *b.columns], ["part", "key", *b.schema.names])


def _part(bounds: tuple[np.ndarray, np.ndarray], key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many of the bounds (key, row_id), which are sorted, lie before each key and row."""
    first, last = (np.searchsorted(bounds[0], key, side=s) for s in ("left", "right"))
    part = first.copy()
    tied = first < last
    for i in np.unique(first[tied]):  # bounds of the same key
        at = np.flatnonzero(tied & (first == i))
        part[at] = i + np.searchsorted(bounds[1][i : last[at[0]]], row[at])
    return part.astype(np.int32)


def _bounds(found: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows that part a sample of documents into equal parts."""
    found = found.sort_by([("key", "ascending"), ("row_id", "ascending")])
    at = np.arange(1, parts) * found.num_rows // parts if found.num_rows else np.zeros(0, np.int64)
    return tuple(found.column(c).to_numpy()[at] for c in ("key", "row_id"))


def _bm25(corpus: Corpus, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
    df = corpus.df[term]
    return np.log(1 + (corpus.n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(corpus.mean, 1)))


class Index:
    """BM25 postings of pieces (arrays of ids); corpus: what they are of (none: they are all)."""

    def __init__(self, pieces: list[np.ndarray], corpus: Corpus | None = None):
        n = len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        flat = np.concatenate(pieces).astype(np.int64) if n else np.zeros(0, np.int64)
        pair, tf = np.unique(flat * n + np.repeat(np.arange(n), size), return_counts=True) if n else (flat, flat)
        self.n, self.piece, term = n, pair % max(n, 1), pair // max(n, 1)
        self.start = np.searchsorted(term, np.arange(int(term.max(initial=0)) + 2))
        if n and corpus is None:
            corpus = Corpus(n, size.mean(), np.diff(self.start))
        self.weight = _bm25(corpus, term, tf, size[self.piece]) if n else tf
        order = np.argsort(self.piece, kind="stable")  # terms of each piece
        self.terms, self.at = term[order], np.searchsorted(self.piece[order], np.arange(n + 1))

    def scores(self, piece: int) -> np.ndarray:
        """BM25 of all pieces for the distinct ids of one."""
        t = self.terms[self.at[piece] : self.at[piece + 1]]
        size = self.start[t + 1] - self.start[t]
        at = np.repeat(self.start[t] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(self.piece[at], self.weight[at], self.n)


def fill(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length)."""
    out, start = [], []
    for d, ids in enumerate(docs):
        whole = len(ids) // window * window
        out += [[(d, s, window)] for s in range(0, whole, window)]
        start.append(whole)
    pool = [d for d, ids in enumerate(docs) if len(ids) > start[d]]
    index = Index([docs[d][start[d] :] for d in pool], corpus)
    begin = [start[d] for d in pool]
    left = np.array([len(docs[d]) - start[d] for d in pool], np.int64)
    seeds, i, seed = np.argsort(-left, kind="stable"), 0, None
    while True:
        if seed is None or not left[seed]:
            while i < len(seeds) and not left[seeds[i]]:
                i += 1
            if i == len(seeds):
                return out
            seed = int(seeds[i])
        space, row = window, []

        def put(p: int, n: int):
            row.append((pool[p], begin[p], n))
            begin[p] += n
            left[p] -= n

        n = int(left[seed])
        put(seed, n)
        space -= n
        score = index.scores(seed)
        live = np.flatnonzero(left)
        ranked = live[np.argsort(-score[live], kind="stable")]
        first, seed = None, None
        for p in ranked.tolist() if space else ():
            n = int(left[p])
            if n <= space:
                put(p, n)
                space -= n
                if not space:
                    break
            elif first is None:
                first = p
        if space and first is not None:
            put(first, space)
            seed = first
        out.append(row)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long, row_id long"


def _pack(shard: int, group: pa.Table, window: int, corpus: Corpus) -> pa.RecordBatch:
    group = group.sort_by("row_id")
    ids = [np.frombuffer(x, np.uint16) for x in group.column("ids").to_pylist()]
    doc_id, row_id = group.column("doc_id").to_pylist(), group.column("row_id").to_pylist()
    rows = []
    for s, pieces in enumerate(fill(ids, window, corpus)):
        size = sum(n for _, _, n in pieces)
        offset = 0
        for d, start, n in pieces:
            crc = zlib.crc32(ids[d][start : start + n].astype("<u4").tobytes())
            rows.append((doc_id[d], start, n, crc, len(ids[d]), shard << 32 | s, offset, size if size & (size - 1) == 0 else window, row_id[d]))
            offset += n
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)


def _shards(batches, window, corpus, shard_chars):
    """Consecutive documents of a partition, packed shard by shard."""
    shard, held, chars = TaskContext.get().partitionId() << 11, [], 0
    for b in batches:
        at, ends = 0, np.cumsum(b.column("chars").to_numpy())
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = min(int(np.searchsorted(ends, before + shard_chars - chars)) + 1, b.num_rows)
            held.append(b.slice(at, to - at))
            chars += int(ends[to - 1] - before)
            at = to
            if chars >= shard_chars:
                yield _pack(shard, pa.Table.from_batches(held), window, corpus)
                shard, held, chars = shard + 1, [], 0
    if held:
        yield _pack(shard, pa.Table.from_batches(held), window, corpus)
    settle()


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of docs (doc_id, text) by sequence; tokenizer: path of a tokenizer file of fewer than 65,536 ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_id", F.monotonically_increasing_id())
    coded = "row_id long, doc_id long, chars long, ids binary"
    work = Scratch(docs.sparkSession, "packing").keep(docs.mapInArrow(partial(_encode, path=tokenizer), coded), "coded")
    # at most 65,536 ids
    found = work.select("ids").mapInArrow(partial(_counts, window=window), "term long, n long, size long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()
    df, n, size = np.zeros(1 << 16, np.int64), 0, 0
    for r in found:
        if r.term < 0:
            n, size = r.n, r.size
        else:
            df[r.term] = r.n
    corpus = Corpus(n, size / max(n, 1), df)
    chars = work.agg(F.sum("chars")).first()[0] or 0
    # places of a sample of the documents part them evenly; any bounds would do
    parts = max(1, -(-chars // (SHARD_CHARS * SHARDS_A_PART)))
    share = min(1.0, SAMPLED * parts / max(n, 1))
    some = work.filter(F.pmod(F.xxhash64("row_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    bounds = _bounds(some.mapInArrow(partial(_keyed, window=window, corpus=corpus, bounds=None), "key long, row_id long").toArrow(), parts)
    keyed = work.mapInArrow(partial(_keyed, window=window, corpus=corpus, bounds=bounds), f"part int, key long, {coded}")
    # row_id: equal keys (exact copies) may be many
    near = keyed.repartitionById(parts, "part").drop("part").sortWithinPartitions("key", "row_id")
    return near.mapInArrow(partial(_shards, window=window, corpus=corpus, shard_chars=SHARD_CHARS), SCHEMA)
