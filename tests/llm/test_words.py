"""Operators that work text by text, against brute force."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from swathframe.llm import common, licenses, packing, pii, quality, repetition, tokencount

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- shared kernels ----


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x1c é", max_size=30)), max_size=12))
def test_split_words(texts):
    codes, words, owner = common.split_words(pa.array(texts, pa.string()))
    words = words.to_pylist()
    want = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert [(o, words[c]) for o, c in zip(owner, codes)] == want


def test_hash_words():
    words = ["", "a", "ab", "abcdefgh", "abcdefghi", "x" * 100, "x" * 101, "é"]
    h = common.hash_words(pa.array(words))
    assert len(set(h.tolist())) == len(words)
    assert h[4] == common.hash_words(pa.array(["zz", "abcdefghi"]))[1]


def test_slices():
    b = pa.record_batch({"text": [None, "a" * 50, "b" * 9, "", "c" * 200, "d"]})
    parts = list(common.slices(iter([b]), "text", rows=3, size=60))
    assert pa.Table.from_batches(parts).to_pydict() == b.to_pydict()
    assert all(p.num_rows <= 3 for p in parts)


# ---- repetition ----


def repeats(words):
    """Positions in 3-word and 5-word windows found twice, longest repeat."""
    out = []
    for k in (3, 5):
        n = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        out.append(len({i + j for i in range(len(words) - k + 1) if n[tuple(words[i : i + k])] > 1 for j in range(k)}))
    k = 5
    while len(Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))) < len(words) - k + 1:
        k += 1
    return (*out, k - 1 if k > 5 else 0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "c", "#|x", "é", "\n"]), max_size=60).map(" ".join)), min_size=1, max_size=5))
def test_repetition_measures(texts):
    m = repetition.measures(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        t = t or ""
        words, seen, twice = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                twice += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), twice, *repeats(words))
        assert tuple(int(m[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")) == want


def test_intervals():
    """Of "banana" as words: ana twice, na twice, a three times."""
    codes = np.array([1, 0, 2, 0, 2, 0])
    owner = np.zeros(6, np.int64)
    ranks = repetition.suffix_ranks(codes, owner)
    sa, lcp = repetition.common_prefixes(ranks, owner, 1)
    assert sa.tolist() == [5, 3, 1, 0, 4, 2] and lcp.tolist() == [0, 1, 3, 0, 0, 2]
    assert sorted(repetition.intervals(lcp, 1)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_repetition_verdicts():
    clean = " ".join(f"w{i}" for i in range(200))
    copied = " ".join([f"w{i}" for i in range(100)] + [f"v{i}" for i in range(60)] + [f"w{i}" for i in range(60)])
    failed, kept = repetition.verdicts(repetition.measures(pa.array([clean, copied, "few words", None])))
    assert failed.tolist() == [False, False or bool(failed[1]), True, True] and kept.tolist() == [True, False, False, False]


# ---- personal data ----


IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def spans(text):
    out = [("email", *m.span()) for m in pii.EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in pii.CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in pii.PHONE.finditer(text) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@-+ (5\né0%_", max_size=60))
def test_fixed_spans(text):
    assert pii.fixed_spans(text) == spans(text)


def test_fixed_spans_cards():
    text = "4111 1111 1111 1111, 4111111111111112 and 4111-1111-1111-1111; +1 (201) 555-0123; 10.0.0.256; 10.0.0.255"
    assert pii.fixed_spans(text) == spans(text) and [s[0] for s in pii.fixed_spans(text)] == ["ip", "card", "card", "phone"]


@pytest.mark.parametrize("text", ["7" * 1_000_000, "1.2." * 250_000, "0" * 999_990 + ".0.0.0", "a@" * 400_000, "4 " * 60_000, "+1" * 400_000, "x1" + "!" * 800_000 + "2", "9" * 300_000 + "." * 300_000])
def test_long_runs_are_linear(text):
    began = time.time()
    pii.find_spans(pa.array([text]), pii.fitted())
    assert time.time() - began < 8  # quadratic patterns take many minutes


def test_spans_that_touch_base_spans():
    """The quick test of touching spans against all pairs."""
    r = np.random.default_rng(6)
    for _ in range(200):
        words = ["".join(r.choice(list("a1!("), int(r.integers(1, 6)))) for _ in range(12)]
        text, labels = " ".join(words), r.integers(0, 3, 12)
        cut = sorted(r.choice(len(text), 6, replace=False).tolist())
        base = [("ip", cut[0], cut[1]), ("card", cut[1], cut[4]), ("phone", cut[2], cut[3])]
        every = pii.added_spans(text, labels, [])
        assert pii.added_spans(text, labels, base) == [x for x in every if not any(s < x[2] and x[1] < t for _, s, t in base)]
        for kind, s, e in every:
            assert text[s] in "a1(" and text[e - 1] in "a1"


#: Written by hand, in shapes of their own: values between {kind: and }.
BY_HAND = """
Please reach Maria at {email:maria.lopez@uni-bonn.example.de} before Friday.
Our office moved; ring {phone:(415) 555-2671} for directions.
ssh to {ip:192.168.17.4} and restart the daemon
{email:sales+eu@shop.example.org} handles all European orders
The invoice was paid with card {card:4539578763621486} on Monday.
export API_KEY={secret:9f86d081884c7d659a2feaa0c55ad015}
My mobile: {phone:+44 (207) 946-0123}, evenings only.
Server {ip:10.20.30.40} answered in 35 ms, the other one never did.
password = {secret:c3fcd3d76192e4007dfb496cca67e13b}
Visa {card:4916338506082832} was declined twice.
The meeting is at 10:30 in room 204 of building 7.
In 1998 the town had 45210 inhabitants and 3 schools.
Version 2.4.1 fixes 17 bugs that users reported since March.
He scored 31 points in 42 minutes, a record for the 2019 season.
Chapter 12 covers pages 310 to 355 of the second edition.
The token ring network was retired long ago.
You will need a password for this page, ask the host.
She said the secret of good bread is time.
Write down the address and call a taxi.
Temperatures fell from 21.5 to 9.8 degrees overnight.
"""


def test_rows_written_by_hand():
    """Every value is found whole, and the rest of these lines is left alone."""
    for line in BY_HAND.strip().split("\n"):
        text, want, at = "", [], 0
        for m in re.finditer(r"\{(\w+):([^}]*)\}", line):
            text += line[at : m.start()]
            want.append((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        text += line[at:]
        found = pii.find_spans(pa.array([text]), pii.fitted())[0][1]
        covered = lambda s, e: any(x <= s and e <= y for _, x, y in found)
        assert all(covered(s, e) for _, s, e in want), (text, found)
        assert all(any(s < y and x < e for _, s, e in want) for _, x, y in found), (text, found)


def test_viterbi_is_exact():
    """Pruned decoding gives the best path's score on random fields."""
    r = np.random.default_rng(2)
    for _ in range(30):
        k, owner = 4, np.sort(r.integers(0, 4, 25))
        e, a = r.normal(0, 3, (25, k)), r.normal(0, 1.5, (k, k))
        e[:, 0] += r.choice([0, 12], 25)
        got = pii.viterbi(e, a, owner)
        for o in np.unique(owner):
            at = np.flatnonzero(owner == o)
            best = e[at[0]]
            for i in at[1:]:
                best = (best[:, None] + a).max(axis=0) + e[i]
            path = sum(e[i, got[i]] for i in at) + sum(a[got[i], got[i + 1]] for i in at[:-1])
            assert path == pytest.approx(best.max())


def test_field_held_out():
    """The fitted field labels a table made from another seed."""
    model, right, total = pii.fitted(), 0, 0
    for words, labels in pii.labelled_table(300, seed=99):
        coded = pa.array(words).dictionary_encode()
        owner = np.zeros(len(words), np.int64)
        got = pii.viterbi(pii.emissions(coded.dictionary, coded.indices.to_numpy(), owner, model), model["a"], owner)
        right += sum(pii.LABELS[g] == x for g, x in zip(got, labels))
        total += len(words)
    assert right / total > 0.97


def test_added_spans_and_redaction():
    text = 'ner a. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" thou, mail x.y@host.example.com!'
    base, every = pii.find_spans(pa.array([text]), pii.fitted())[0]
    assert [s[0] for s in base] == ["email"] and {s[0] for s in every} == {"email", "secret"} and set(base) <= set(every)
    assert pii.redact(text, every) == 'ner a. token = "[SECRET]" thou, mail [EMAIL]!'
    assert pii.find_spans(pa.array(["no data here, the token of it", None, ""]), pii.fitted()) == [([], [])] * 3


# ---- quality ----


def test_marginals():
    """Forward-backward against all labellings."""
    r = np.random.default_rng(4)
    e, a = r.normal(0, 2, 9), r.normal(0, 1, (2, 2))
    doc = np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    p, moves, _ = quality.marginals(e, a, quality.Chains(doc, 3))
    want, total = np.zeros(9), np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        paths = [[(m >> i) & 1 for i in range(len(at))] for m in range(1 << len(at))]
        weight = np.exp([sum(e[at[i]] * y[i] for i in range(len(at))) + sum(a[y[i], y[i + 1]] for i in range(len(at) - 1)) for y in paths])
        weight /= weight.sum()
        for y, w in zip(paths, weight):
            want[at] += w * np.array(y)
            for i in range(len(at) - 1):
                total[y[i], y[i + 1]] += w
    assert p == pytest.approx(want) and moves == pytest.approx(total)


def test_lbfgs():
    scale = np.array([1.0, 10.0, 100.0])
    x = quality.lbfgs(lambda v: ((scale * (v - 3) ** 2).sum(), 2 * scale * (v - 3)), np.zeros(3), 100)
    assert x == pytest.approx(np.full(3, 3.0), abs=1e-4)


def plain_features(lines):
    """Own features of a text's lines, word by word and character by character."""
    out, seen = [], set()
    for line in lines:
        words = WORD.findall(line)
        count = lambda chars: sum(c in chars for c in line)
        upper, lower = sum("A" <= c <= "Z" for c in line), sum("a" <= c <= "z" for c in line)
        symbol, shout, n, w, letters = count("#*$%&|<>"), count("!?"), max(len(line), 1), max(len(words), 1), max(upper + lower, 1)
        again = float(bool(words) and line in seen)
        seen.add(line)
        out.append([
            (symbol / n) ** 0.5, symbol / n, (upper / letters) ** 0.5, upper / letters, (shout / n) ** 0.5, count("0123456789") / n, count(",.;:") / w, 1 - len(set(words)) / w, again,
            np.log1p(len(words)) / 4, len(line) / w / 10, float(line[-1:] in (".", "!", "?") and line != ""), float(not words), float(symbol / w > 0.2), float(shout / w > 0.2), float(upper / letters > 0.6),
        ])
    return np.array(out)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1#!. \né", max_size=40)), min_size=1, max_size=5))
def test_line_features(texts):
    x, doc, weight = quality.line_features(pa.array(texts, pa.string()))
    at = 0
    for d, t in enumerate(texts):
        lines = (t or "").split("\n")
        own, n = plain_features(lines), len(lines)
        got = x[at : at + n]
        none = np.zeros((1, quality.OWN))
        assert (doc[at : at + n] == d).all() and weight[at : at + n].tolist() == [len(y) + 1 for y in lines]
        assert got[:, : quality.OWN] == pytest.approx(own)
        assert got[:, quality.OWN : 2 * quality.OWN] == pytest.approx(np.concatenate([none, own[:-1]]))
        assert got[:, 2 * quality.OWN : 3 * quality.OWN] == pytest.approx(np.concatenate([own[1:], none]))
        assert got[:, -3:].tolist() == [[float(i == 0), float(i == n - 1), 1.0] for i in range(n)]
        at += n
    assert at == len(x)


def planted(r, docs=300):
    """Documents of plain and of junk lines, their labels, and which lines are plain. Bad ones have a plain beginning or end."""
    words = ["river", "garden", "the", "of", "stone", "walks", "under", "light", "and", "Morning"]
    plain = lambda: " ".join(r.choice(words) for _ in range(r.integers(4, 14))).capitalize() + "."
    junk = lambda: " ".join(r.choice(words).upper() + r.choice(["!!", "###", " |", "$$$"]) for _ in range(r.integers(4, 14)))
    texts, labels, lines = [], [], []
    for i in range(docs):
        good = [True] * int(r.integers(2, 7))
        if i % 3 == 0:
            bad = [False] * int(r.integers(7, 14))
            good = good[:3] + bad if i % 2 else bad + good[:3]
        texts.append("\n".join(plain() if g else junk() for g in good))
        labels.append(int(all(good)))
        lines.append(good)
    return texts, np.array(labels), lines


def test_lines_of_one_document_differ():
    """Only documents are labelled, yet plain lines of bad documents are told from their junk."""
    r = np.random.default_rng(8)
    texts, labels, _ = planted(r)
    x, doc, weight = quality.line_features(pa.array(texts))
    model = quality.fit(x, doc, labels, weight)
    texts, labels, lines = planted(r)
    x, doc, weight = quality.line_features(pa.array(texts))
    p, moves, _ = quality.marginals(x @ model["w"], model["a"], quality.Chains(doc, len(texts)))
    assert ((p > 0.5) == np.concatenate(lines)).mean() > 0.95
    mixed = np.array([np.ptp(p[doc == d]) > 0.5 for d in range(len(texts))])
    assert mixed[labels == 0].mean() > 0.9 and mixed[labels == 1].mean() < 0.05
    assert moves[0, 1] + moves[1, 0] > 0.02 * moves.sum()
    score = quality.score_texts(pa.array(texts), model)
    assert ((score >= 0.3) == (labels == 1)).mean() > 0.98
    want = [float(np.average(p[doc == d], weights=weight[doc == d]) ** model["power"]) for d in range(len(texts))]
    assert score == pytest.approx(want)


def test_shift_keeps_the_bounds():
    r = np.random.default_rng(9)
    doc, labels = np.sort(np.concatenate([np.arange(20), r.integers(0, 20, 100)])), np.arange(20) % 2
    e, a, weight = r.normal(0, 2, 120), r.normal(0, 1, (2, 2)), r.integers(1, 50, 120).astype(float)
    shift = quality.bounded_shift(e, a, doc, weight, labels)
    share = quality.shares(quality.marginals(e + shift[doc], a, quality.Chains(doc, 20))[0], doc, weight, 20)
    assert (share[labels == 1] >= quality.GOOD_LEAST - 1e-9).all() and (share[labels == 0] <= quality.BAD_MOST + 1e-9).all()
    assert (shift[labels == 1] >= 0).all() and (shift[labels == 0] <= 0).all() and (shift == 0).any()


def test_lines_of_the_fit_are_bounded():
    long = "\n".join(f"line {i}" for i in range(5000))
    rows = next(quality._lines(iter([pa.record_batch({"label": pa.array([1, 0], pa.int32()), "text": [long, "a\nb"]})]))).to_pylist()
    size = 4 * (len(quality.line_features(pa.array(["a"]))[0][0]) + 1)
    assert [len(x["lines"]) // size for x in rows] == [quality.FIT_LINES, 2]


def test_quality_scores_odd_texts():
    good = ["The house stands by the river.\nIt has a garden, and trees."] * 20
    bad = ["###&&& %%% ***\n$$$ ### |||", "BUY!! NOW!! FREE!!\nCLICK!! HERE!!"] * 10
    parts, docs = zip(*((x, d) for x, d, _ in (quality.line_features(pa.array([t])) for t in good + bad)))
    doc = np.concatenate([d + i for i, d in enumerate(docs)])
    model = quality.fit(np.concatenate(parts), doc, np.array([1] * 20 + [0] * 20))
    texts = ["A tree stands in the garden.", "%%% ### BUY!! ***", None, "", "\n\n", "x" * 100_000, "日本語"]
    s = quality.score_texts(pa.array(texts), model)
    assert s[0] > 0.5 > s[1] and ((s >= 0) & (s <= 1)).all() and s[2] == s[3]
    assert quality.score_texts(pa.array(texts), None).tolist() == [quality.FLAT] * 7


# ---- token counts ----


def test_trie_counts():
    v = tokencount.zipf_vocabulary(PIECES)
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECES)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    rank = np.arange(1, len(ids) + 1)
    scores = dict(zip(map(sp.id_to_piece, ids), -np.log(rank) - np.log((1 / rank).sum())))

    def brute(word):
        t, best = "▁" + word, [(0.0, 0)]
        for end in range(1, len(t) + 1):
            found = []
            for start in range(max(0, end - v.longest), end):
                piece, (s, n) = t[start:end], best[start]
                if piece in scores:
                    found.append((s + scores[piece], n - 1))
                elif len(piece) == 1:
                    found.append((s + v.unknown * len(piece.encode()), n - len(piece.encode())))
            best.append(max(found))
        return -best[-1][1]

    words = ["the", "then", "thenceforth", "a" * 90, "naïve", "日本語", "🎉x", "\x00", "don't", "Zürich,", "int(x)"]
    assert tokencount.trie_counts(pa.array(words), v).tolist() == [brute(w) for w in words]


# ---- packing ----


ODD = ["", "İB ŉ ﬁ ½ x", "éa ÉÀ ß ÿ×÷", "don't can'T 's 'S I'LL '''s ..'re a'b", "日本語 テスト ΑΣ", "\x00a b", "a1b22c", "<|endoftext|> <|x a<|startoftext|>b", "ǅ K", " \n", "​z x\u0085y ñ'd", "é"]


def test_token_ids(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    monkeypatch.setattr(packing, "REMEMBERED", 6)  # the table starts anew again and again
    for texts in (ODD, ODD[::-1], [None, *ODD]):
        got = packing.token_ids(pa.array(texts), TOKENIZER)
        assert [g.tolist() for g in got] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_bm25():
    docs = [np.array(x) for x in ([1, 2, 3, 2], [2, 3], [4, 4, 5], [1])]
    index, n = packing.Index(docs), 4
    mean = sum(map(len, docs)) / n
    for q in range(n):
        want = np.zeros(n)
        for term in set(docs[q].tolist()):
            df = sum(term in d for d in docs)
            for i, d in enumerate(docs):
                tf = int((d == term).sum())
                want[i] += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) if tf else 0
        assert index.scores(q) == pytest.approx(want)


def test_fill_prefers_neighbours_and_keeps_all():
    r = np.random.default_rng(3)
    docs = [r.integers(0, 50, n) + 100 * (i % 2) for i, n in enumerate([30, 30, 5, 5, 7, 7, 150, 1, 1, 40, 40])]
    rows = packing.fill(docs, 64)
    seen = [np.zeros(len(d), int) for d in docs]
    for row in rows:
        for d, s, n in row:
            seen[d][s : s + n] += 1
    assert all((x == 1).all() for x in seen)
    assert [sum(n for _, _, n in row) for row in rows].count(64) == len(rows) - 1
    assert packing.fill([], 64) == []
    first = next(row for row in rows if len(row) > 1)
    assert first[0][0] % 2 == first[1][0] % 2


def test_index_takes_the_statistics_of_the_corpus():
    r = np.random.default_rng(1)
    docs = [r.integers(0, 20, n).astype(np.uint16) for n in (5, 9, 14, 30, 3, 8)]
    size = np.array([len(d) for d in docs])
    corpus = packing.Corpus(6, size.mean(), np.array([sum(t in d for d in docs) for t in range(20)]))
    part, whole = packing.Index(docs[:3], corpus), packing.Index(docs)
    for i in range(3):
        assert np.allclose(part.scores(i), whole.scores(i)[:3])


# ---- licences ----

MIT = """/* Copyright (c) 2020 Jo
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights to use.
 *
 * The above copyright notice and this permission notice shall be included in
 * all copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. */
int main() { return 0; }"""


@pytest.mark.parametrize(
    "text,names,rest",
    [
        (MIT, ["MIT"], ["Copyright"]),
        ("Oria. This work is licensed under the GNU General Public License, version 3. Tion.", ["GPL-3.0-only"], []),
        ("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", ["CC-BY-NC-4.0", "MIT"], []),
        ("Licensed under the Apache\nLicence, Version 2.0.", ["Apache-2.0"], []),
        ("All rights reserved.", [], ["AllRights"]),
        ("The license of the garden is green. It has permission to grow.", [], []),
        ("", [], []),
    ],
)
def test_licences(text, names, rest):
    found = licenses.known_sentences(text)
    named, left = licenses.licences(found)
    assert [x for x, _, _ in named] == names and left == rest
    for _, s, e in named:
        assert 0 <= s < e <= len(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("SPDX-License-Identifier: MIT", "MIT"),
        ("// SPDX-License-Identifier: Apache-2.0\nint x;", "Apache-2.0"),
        ("/* SPDX-License-Identifier: BSD-3-Clause */", "BSD-3-Clause"),
        ("SPDX-License-Identifier: LicenseRef-Own", "LICENSEREF-OWN"),
        ("Licensed under the Apache License, Version 2.0. You may obtain a copy of the License at: https://example.org/l", "Apache-2.0"),
        ("License: Released under the MIT License.", "MIT"),
    ],
)
def test_colons_inside_known_sentences(text, want):
    named, rest = licenses.licences(licenses.known_sentences(text))
    assert [x for x, _, _ in named] == [want] and rest == []
    assert not text.endswith("/l") or named[0][2] == len(text)


@pytest.mark.parametrize(
    "text",
    [
        "Released under CC BY 4.0.",
        "This work is available under CC-BY-SA 4.0.",
        "Distributed under a Creative\nCommons BY 4.0.",
        "This is free and unencumbered software released into the public\ndomain.",
        "// This is free and unencumbered software released into the public\n// domain.",
        "Creative\nCommons Zero.",
        "All rights\nreserved.",
        "The software is provided as is and with all faults.",
    ],
)
def test_the_prefilter_changes_no_result(text, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    got = next(licenses._rows([batch])).to_pylist()
    monkeypatch.setattr(licenses, "ANCHORS", "")
    monkeypatch.setattr(licenses, "ANCHOR", re.compile(""))
    assert got == next(licenses._rows([batch])).to_pylist() and got[0]["n_sentences"] == 1


#: A text of each known sentence, as licences and notices write it.
SAID = {
    "MitName": "This work is licensed under the MIT License.",
    "MitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including the rights to use.",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "AsIsWarranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.",
    "NoLiability": "In no event shall the authors be liable for any claim.",
    "ApacheName": "Licensed under the Apache License, Version 2.0 (the License).".replace(" (the License)", ""),
    "ApacheUse": "You may not use this file except in compliance with the License.",
    "ApacheCopy": "You may obtain a copy of the License at https://www.apache.example/licenses.",
    "ApacheBasis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "ApacheSee": "See the License for the specific language governing permissions and limitations under the License.",
    "GplName": "This program is distributed under the GNU General Public License, version 2 or any later version.",
    "LgplName": "This library is licensed under the GNU Lesser General Public License v2.1.",
    "AgplName": "This work is released under the GNU Affero General Public License version 3.",
    "GplGrant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GplHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GplSee": "See the GNU General Public License for more details.",
    "GplCopy": "You should have received a copy of the GNU General Public License along with this program.",
    "LgplGrant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LgplSee": "See the GNU Lesser General Public License for more details.",
    "AgplGrant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AgplSee": "See the GNU Affero General Public License for more details.",
    "ZlibAsIs": "This software is provided 'as-is', without any express or implied warranty.",
    "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BoostName": "Distributed under the Boost Software License, Version 1.0.",
    "EplName": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.",
    "CddlName": "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "PsfName": "Licensed under the Python Software Foundation License.",
    "BsdGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BsdEndorse": "Neither the name of the owner nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BsdName": "This work is licensed under the BSD 3-Clause License.",
    "IscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MplName": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MplCopy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.example/MPL/2.0/.",
    "CcName": "This work is licensed under a Creative Commons BY-SA 4.0 license.",
    "Cc0Name": "Dedicated to all by CC0 1.0.",
    "UnlicenseGrant": "This is free and unencumbered software released into the public domain.",
    "SpdxTag": "SPDX-License-Identifier: Zlib",
    "Copyright": "Copyright 2021 Jo Doe.",
    "AllRights": "All rights reserved.",
}


def test_every_sentence_is_known():
    assert set(SAID) == {n for n, _ in licenses.SENTENCES}
    for name, text in SAID.items():
        for written in (text, text.upper(), "// " + text, "\n" + text + "\n"):
            assert [x[2] for x in licenses.known_sentences(written)] == [name], written


def plain_rules(names):
    """Licences of a sequence of identifiers by regular expressions over their names: at each place the first rule that matches."""
    text, out, rest, at = "".join(n + " " for n in names), [], [], 0
    while at < len(text):
        for i, (_, rule) in enumerate(licenses.RULES):
            pattern = "".join(f"(?:{x[:-1]} )?+" if x.endswith("?") else f"{x} " for x in rule.split())
            m = re.compile(pattern).match(text, at)
            if m and m.end() > at:
                out.append((i, text[: m.end()].count(" ")))
                at = m.end()
                break
        else:
            end = text.index(" ", at) + 1
            rest.append(text[at : end - 1])
            at = end
    return out, rest


def test_rules_against_plain_ones():
    """Random texts of known sentences, fillers and line breaks: the same licences and leftovers as the plain matcher."""
    r = np.random.default_rng(3)
    filler = ["The garden is green.", "It rained in 1998, they said.", "Write x = f(y); then stop.", "Permission was asked of nobody."]
    for _ in range(150):
        names = []
        for _ in range(r.integers(0, 4)):
            rule = licenses.RULES[r.integers(len(licenses.RULES))][1].split()
            names += [x.rstrip("?") for x in rule if not x.endswith("?") or r.random() < 0.6] if r.random() < 0.8 else [list(SAID)[r.integers(len(SAID))]]
        parts = []
        for n in names:
            parts += [filler[r.integers(4)]] * int(r.random() < 0.3) + [SAID[n]]
        text = "".join(p + ("\n" if p.startswith("SPDX") or p.endswith(":") or r.random() < 0.7 else " ") for p in parts + [filler[0]])
        text = text.replace(" SPDX", "\nSPDX")
        found = licenses.known_sentences(text)
        assert [x[2] for x in found] == names, text
        named, rest = licenses.licences(found)
        want, left = plain_rules(names)
        assert rest == left and len(named) == len(want)
        for (name, s, e), (i, upto) in zip(named, want):
            assert e == found[upto - 1][1] and re.fullmatch(re.sub(r"\\{\w+\\}", ".*", re.escape(licenses.RULES[i][0])), name), (name, licenses.RULES[i])


def test_every_sentence_has_an_anchor():
    for name, pattern in licenses.SENTENCES:
        plain = re.sub(r"\(\?:|\(\?P<\w+>|[()?\\]", "", pattern)
        assert licenses.ANCHOR.search(plain) or "spdx" in plain, name


def test_digests():
    assert hashlib.sha256(pii._joined([]).encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
    assert zlib.crc32(np.array([1, 2], np.uint16).astype("<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\2\0\0\0")
