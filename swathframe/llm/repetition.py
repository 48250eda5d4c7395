r"""Repetition rules over whole texts by suffix arrays.

The words of a slice of texts get one suffix array by prefix doubling, in which a suffix ends with its text. Each round
sorts only positions whose rank is still shared. Ranks of every round give the longest common prefixes of neighbouring
suffixes by binary descent. Intervals of the prefixes (maximal runs of suffixes that share so many words) are the maximal
repeated substrings; the union of the spans of those of MIN_REPEAT words or more is what is covered. A text is kept unless
too large a share of its words is covered, its longest repeat is too long, or one of the base limits is exceeded.

Words are `[^\x20\x09-\x0D]+`, compared exactly. Defined cases: null and blank texts have no words, fail the base (fewer
than 50 words) and aren't kept; repeated rows get equal results; other columns are ignored; texts are never cut.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running, slices, split_words

#: Words of a repeat that counts; most covered share of the words; most words of one repeat.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 5, 0.4, 50
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])


def suffix_ranks(codes: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until no two are equal. Texts come in order; equal ranks: equal words."""
    n = len(codes)
    end = np.searchsorted(owner, owner, side="right")
    key = owner.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], key[order][1:] != key[order][:-1]])[:n]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    ranks, h = [rank], 1
    shared = ~(first & np.concatenate([first[1:], [True]])[:n])
    live = order[shared]
    while len(live):
        after = live + h
        inside = after < end[live]
        then = np.zeros(len(live), np.int64)
        then[inside] = rank[after[inside]].astype(np.int64) + 1
        base = rank[live].astype(np.int64)
        key = base * (n + 1) + then
        o = np.argsort(key, kind="stable")
        live, base, key = live[o], base[o], key[o]
        i = np.arange(len(live))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], base[1:] != base[:-1]]), i, 0))
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[live] = base + np.maximum.accumulate(np.where(first, i, 0)) - group
        ranks.append(rank)
        live = live[~(first & np.concatenate([first[1:], [True]]))]
        h *= 2
    return ranks


def common_prefixes(ranks: list[np.ndarray], owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the words that each suffix shares with the one before it (0 if fewer than `least`)."""
    n = len(owner)
    sa = np.empty(n, np.int64)
    sa[ranks[-1]] = np.arange(n)
    end = np.searchsorted(owner, owner, side="right")
    level = 0
    while 2 << level <= least and level + 1 < len(ranks):
        level += 1
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(ranks[level][sa[1:]] == ranks[level][sa[:-1]]) + 1 if n else np.zeros(0, np.int64)
    p, q = sa[at - 1], sa[at]
    size = np.zeros(len(at), np.int64)
    for t in range(len(ranks) - 1, -1, -1):
        x, y = p + size, q + size
        ok = (x < end[p]) & (y < end[q])
        ok[ok] = ranks[t][x[ok]] == ranks[t][y[ok]]
        size[ok] += 1 << t
    lcp[at] = np.where(size >= least, size, 0)
    return sa, lcp


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(words, first, last) of every interval of the suffix array whose suffixes share `least` words or more, and no longer run does."""
    out, stack, before = [], [], -2
    for i in np.flatnonzero(lcp >= least).tolist():
        v, low = int(lcp[i]), i - 1
        if i != before + 1:
            out += [(w, a, before) for w, a in reversed(stack)]
            stack = []
        while stack and stack[-1][0] > v:
            w, low = stack.pop()
            out.append((w, low, i - 1))
        if not stack or stack[-1][0] < v:
            stack.append((v, low))
        before = i
    return out + [(w, a, before) for w, a in reversed(stack)]


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the spans cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step)[:n] > 0


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts and what repeats, of each text."""
    texts, m = pc.fill_null(texts.cast(pa.string()), ""), len(texts)
    codes, words, owner = split_words(texts)
    n = len(codes)
    per = lambda w=None: np.bincount(owner, w, m).astype(np.int64)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False) if n else np.zeros(0)
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + m + 1].astype(np.int64)
    sums = running(SYMBOLS[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]]).astype(np.int64)
    lines = pc.split_pattern(texts, "\n")
    doc = np.repeat(np.arange(m), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    lines = lines.flatten()
    real = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    _, first = np.unique(doc * (len(lines) + 1) + code, return_index=True)
    again = real.copy()
    again[first] = False
    out = {"n_words": per(), "word_chars": per(sizes[codes] if n else None), "n_symbols": sums[off[1:] - off[0]] - sums[off[:-1] - off[0]], "n_dup_lines": np.bincount(doc[again], minlength=m)}

    ranks = suffix_ranks(codes, owner)
    sa, lcp = common_prefixes(ranks, owner, 3)
    most = np.zeros(n, np.int64)
    at = np.flatnonzero(lcp)
    np.maximum.at(most, sa[at], lcp[at])
    np.maximum.at(most, sa[at - 1], lcp[at])
    three = np.flatnonzero(most >= 3)
    out["n_repeat_words"] = per(covered(three, np.full(len(three), 3), n))
    found = intervals(lcp, MIN_REPEAT)
    start = np.array([sa[a] for _, a, _ in found], np.int64)
    out["n_repeats"] = np.bincount(owner[start], minlength=m) if len(start) else np.zeros(m, np.int64)
    longest = np.zeros(m, np.int64)
    if len(start):
        np.maximum.at(longest, owner[start], np.array([w for w, _, _ in found], np.int64))
    # a suffix's longest interval spans its others, so the spans' union is that of the longest ones
    long = np.flatnonzero(most >= MIN_REPEAT)
    out["n_covered"], out["longest_repeat"] = per(covered(long, most[long], n)), longest
    return out


def verdicts(m: dict[str, np.ndarray], max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """base_failed, kept."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return failed, ~failed & (m["n_covered"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_covered", "longest_repeat", "n_repeats")


def _rows(batches, max_covered, max_longest):
    for b in slices(batches, "text"):
        m = measures(b.column("text"))
        failed, kept = verdicts(m, max_covered, max_longest)
        columns = [pa.array(m[c].astype(np.int64)) for c in COUNTS] + [pa.array(failed), pa.array(kept)] + [pa.array(m[c].astype(np.int64)) for c in EXTRA]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *COUNTS, "base_failed", "kept", *EXTRA])


def repetition(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Of every row of docs (doc_id, text): doc_id, base counts, base_failed, kept, and words covered, longest repeat, maximal repeats."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} long" for c in EXTRA)
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.mapInArrow(partial(_rows, max_covered=max_covered, max_longest=max_longest), schema)
