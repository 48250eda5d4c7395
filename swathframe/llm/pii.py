r"""Personal data by fixed patterns and a linear-chain conditional random field over words.

Fixed patterns find e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers. The field labels every word
(`[^\x20\x09-\x0D]+`) of the whole text from word-shape features of it and its neighbours; it is fitted by L-BFGS on a small
labelled table, and adds spans where it labels words that no fixed pattern has: credentials, numbers in national or spoken
form and so on. Viterbi runs in numpy batches. Where a word's evidence for "outside" exceeds all that transitions could
gain, its label is decided without the recursion, so that only the rest is decoded step by step; the result is the same.

Positions are code points, ends exclusive. Defined cases: null text is empty text; no words give no spans; repeated rows
give the same spans; other columns are ignored. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renamed, running, slices, split_words
from .quality import lbfgs

BASE = ("email", "ip", "card", "phone")
LABELS = ("outside", *BASE, "secret")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Only whole runs of digits can begin or end a part, which makes this linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def fixed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind, then start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:  # a match has one @, and starts with the run of local characters before it
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    if not DIGITS.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(x) < 4 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(DIGITS.findall(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- the field ----

#: Words that name what follows them.
NAMED = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "passphrase", "apikey", "api_key", "api-key", "access_key", "secret_key", "auth_token", "bearer", "credential"),
    "phone": ("phone", "tel", "telephone", "mobile", "fax", "call", "cell"),
    "card": ("card", "visa", "mastercard", "amex"),
    "ip": ("ip", "ipv4", "host", "address"),
    "email": ("email", "e-mail", "mail", "contact", "write"),
}
CHARS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "@", ".", "-", "()", "\"'`", "=:", "+", "_/")


def _chars() -> np.ndarray:
    t = np.zeros((len(CHARS), 256), np.uint8)
    for i, chars in enumerate(CHARS):
        t[i, [ord(c) for c in chars]] = 1
    return t


TABLE = _chars()


def shapes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of the distinct words have a shape worth features, and the features of those; all others share the plain one."""
    raw = words.cast(pa.large_binary())
    n = len(raw)
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    count = []
    for t in TABLE:
        c = running(t[data])
        count.append(c[off[1:]] - c[off[:-1]])
    digit, hexa, small, big, at, dot, dash, paren, quote, sign, plus, other = count
    bare = pc.ascii_lower(pc.ascii_trim(words.cast(pa.string()), "\"'`.,;:=()[]{}<>!?"))
    named = [pc.is_in(bare, value_set=pa.array(v)).to_numpy(zero_copy_only=False) for v in NAMED.values()]
    odd = (digit > 0) | (at > 0) | (quote > 0) | (sign > 0) | (plus > 0) | np.any(named, axis=0)
    w = np.flatnonzero(odd)
    if not len(w):
        return w, np.zeros((0, SHAPES))
    size = np.diff(off)[w].astype(float)
    digit, hexa, small, big, at, dot, dash, paren, quote, sign, plus, other = (c[w] for c in count)
    first = data[off[:-1][w]]
    valid = np.zeros(len(w), bool)
    for i in np.flatnonzero((digit >= 13) & (digit <= 19)):
        valid[i] = luhn("".join(DIGITS.findall(words[int(w[i])].as_py())))
    letters = hexa + small + big
    only = letters == 0
    feats = [
        digit > 0, only & (digit >= 1) & (digit <= 2), only & (digit == 3), only & (digit == 4), only & (digit >= 5) & (digit < 13), only & (digit >= 13) & valid, only & (digit >= 13) & ~valid,
        (dot == 3) & only & (digit >= 4), (dot >= 1) & only, (at == 1) & (dot >= 1) & (letters > 3), (at == 1) & (dot == 0), first == ord("+"), (first == ord("+")) & only & (digit >= 1),
        (paren > 0) & (digit == 3) & only, (dash == 1) & (digit == 7) & only, (dash == 2) & (digit == 10) & only, (dash > 2) & (digit > 0), (size == 1) & (sign == 1), (size > 1) & (sign > 0), quote == 2, quote == 1,
        (digit > 0) & (letters > 0) & (size >= 16) & (at == 0), (digit > 0) & (letters > 0) & (size < 16) & (at == 0), (digit + hexa >= 20) & (digit >= 3), size >= 24, (big > 0) & (small > 0) & (digit > 0) & (size >= 12), other > 0, only & (dash > 0) & (digit >= 4),
        *(x[w] for x in named),
    ]
    return w, np.stack(feats, axis=1).astype(float)


SHAPES = 28 + len(NAMED)


def features(count: int, w: np.ndarray, x: np.ndarray, codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of each word: bias, own shape, the shapes of two words on either side in its text (dense; for fitting)."""
    own = np.zeros((count, SHAPES))
    own[w] = x
    own = own[codes]
    out = [np.ones((len(codes), 1)), own]
    for d in (-2, -1, 1, 2):
        near = np.zeros_like(own)
        i = np.arange(len(codes))
        ok = (i + d >= 0) & (i + d < len(codes))
        ok[ok] = owner[i[ok] + d] == owner[i[ok]]
        near[ok] = own[i[ok] + d]
        out.append(near)
    return np.concatenate(out, axis=1)


def _value(kind: str, r: random.Random) -> str:
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(n - 2)) + "a7"
    if kind == "email":
        return f"{r.choice(SYLLABLES)}.{r.choice(SYLLABLES)}{digits(r.randrange(3))}@{r.choice(SYLLABLES)}{digits(1)}.example.{r.choice(('com', 'org', 'net'))}"
    if kind == "ip":
        return ".".join(str(r.randrange(1, 256)) for _ in range(4))
    if kind == "card":
        d = digits(15)
        return next(d + c for c in "0123456789" if luhn(d + c))
    if kind == "phone":
        return r.choice((f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"))
    return r.choice((f'"{hexa(40)}"', f'"{mixed(24)}"', hexa(32), mixed(32)))


#: Rows of the labelled table: <kind> stands for a value of that kind, ~ for some plain words, # for a harmless number.
ROWS = (
    "~ <email> ~", "~ write to <email> ~ today", "contact: <email> ~", "~ <ip> ~", "~ host <ip> ~", "~ <card> ~", "card <card> ~", "~ <phone> ~", "call <phone> ~", "tel: <phone> ~",
    "~ token = <secret> ~", "password = <secret> ~", "~ api_key = <secret> ~", "secret: <secret> ~", "~ auth_token = <secret>", "bearer <secret> ~", "~ token = <secret>",
    "~", "~ # ~", "~ # ~ # ~", "the token of ~", "~ key = value ~", "version #.#.# ~", "~ on 2021-0#-1# ~", "~ page # of # ~", "call ~ mail ~ card ~", "~ secret ~ password ~", "~ = # ~", '"~" ~', "~ it's ~",
    "~ user@host ~", "~ room ### ~", "~ ####-#### ~", "~ $### ~", "phone ~ # ~", "~ 1#########2#### ~", "the token = ~", "~ a1b2 ~", "~ sha ~ x# ~", "~ ip ~ host ~", "+# ~", "~ (#) ~",
)
SYLLABLES = ("and", "the", "ra", "ner", "ou", "tion", "el", "mi", "sto", "ver", "en", "ka", "lo", "pa", "sei", "que")


def labelled_table(rows: int = 420, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The small labelled table, made by rule: words and their labels."""
    r, out = random.Random(seed), []
    for i in range(rows):
        words, labels = [], []
        for part in ROWS[i % len(ROWS)].split():
            if part == "~" or part == '"~"':
                plain = [("".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4)))) + r.choice(("", "", "", ".", ",")) for _ in range(r.randrange(1, 5))]
                plain = [r.choice(("THE", "### ", "|", "&&&", "Are.")).strip() if r.random() < 0.05 else x for x in plain]
                if part != "~":
                    plain[0], plain[-1] = '"' + plain[0], plain[-1] + '"'
                words += plain
                labels += ["outside"] * len(plain)
            elif m := re.fullmatch(r"<(\w+)>", part):
                found = (_value(m[1], r) + r.choice(("", "", ".", "***", ","))).split()
                words += found
                labels += [m[1]] * len(found)
            else:
                words.append("".join(r.choice("0123456789") if c == "#" else c for c in part))
                labels.append("outside")
        out.append((words, labels))
    return out


def _forward(e, a, steps):
    f = np.zeros_like(e)
    for t, at in enumerate(steps):
        f[at] = e[at]
        if t:
            x = f[prev[: len(at)]][:, :, None] + a[None]
            top = x.max(axis=1)
            f[at] += top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        prev = at
    return f


@lru_cache(maxsize=2)
def fitted(rows: int = 420, ridge: float = 0.05) -> dict:
    """The field's weights, from the labelled table."""
    from .quality import Chains

    table = labelled_table(rows)
    owner = np.repeat(np.arange(len(table)), [len(w) for w, _ in table])
    coded = pa.array([x for w, _ in table for x in w]).dictionary_encode()
    codes = coded.indices.to_numpy()
    w, x = shapes(coded.dictionary)
    feats = features(len(coded.dictionary), w, x, codes, owner)
    gold = np.array([LABELS.index(x) for _, v in table for x in v])
    k, n = len(LABELS), feats.shape[1]
    steps = Chains(owner, len(table)).steps
    onehot = np.eye(k)[gold]
    pairs = np.zeros((k, k))
    inner = owner[1:] == owner[:-1]
    np.add.at(pairs, (gold[:-1][inner], gold[1:][inner]), 1)

    def loss(v):
        u, a = v[: n * k].reshape(n, k), v[n * k :].reshape(k, k)
        e = feats @ u
        f = _forward(e, a, steps)
        b = np.zeros_like(e)
        for t in range(len(steps) - 1, 0, -1):
            at, prev = steps[t], steps[t - 1][: len(steps[t])]
            y = a[None] + (e[at] + b[at])[:, None, :]
            top = y.max(axis=2)
            b[prev] = top + np.log(np.exp(y - top[:, :, None]).sum(axis=2))
        last = f[steps[0]] + b[steps[0]]
        top = last.max(axis=1)
        total = top + np.log(np.exp(last - top[:, None]).sum(axis=1))
        z = np.zeros(len(e))
        for at in steps:
            z[at] = total[: len(at)]
        p = np.exp(f + b - z[:, None])
        moves = np.zeros((k, k))
        for t in range(1, len(steps)):
            at, prev = steps[t], steps[t - 1][: len(steps[t])]
            moves += np.exp(f[prev][:, :, None] + a[None] + (e[at] + b[at])[:, None, :] - z[at][:, None, None]).sum(axis=0)
        value = total.sum() - (e * onehot).sum() - (a * pairs).sum() + ridge * (v @ v)
        return value, np.concatenate([(feats.T @ (p - onehot)).ravel(), (moves - pairs).ravel()]) + 2 * ridge * v

    v = lbfgs(loss, np.zeros(n * k + k * k), 120)
    return {"u": v[: n * k].reshape(n, k), "a": v[n * k :].reshape(k, k)}


def viterbi(e: np.ndarray, a: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The best labels of each text's words (e: a row a word). Words that must be outside are not recursed on."""
    n, k = e.shape
    out = np.zeros(n, np.int64)
    if not n:
        return out
    # what a label other than 0 can gain from transitions on both sides at most, over 0
    before = (a - a[:, :1]).max(axis=0)
    after = (a - a[:1, :]).max(axis=1)
    sure = (e[:, 0, None] - e[:, 1:] > np.maximum(before, 0)[1:] + np.maximum(after, 0)[1:]).all(axis=1)
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return out
    # runs of open words inside a text; a sure neighbour is a fixed 0
    new = np.concatenate([[True], (open_[1:] != open_[:-1] + 1) | (owner[open_[1:]] != owner[open_[:-1]])])
    start = open_[new]
    size = np.diff(np.append(np.flatnonzero(new), len(open_)))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    led = (start > 0) & (owner[np.maximum(start - 1, 0)] == owner[start])
    stop = start + size
    followed = (stop < n) & (owner[np.minimum(stop, n - 1)] == owner[start])
    back, t = [], 0
    alive = len(start)
    final = e[start] + led[:, None] * a[0]
    while True:
        t += 1
        alive = int(np.searchsorted(-size[:alive], -t, side="left"))
        if not alive:
            break
        x = final[:alive][:, :, None] + a[None]
        back.append(x.argmax(axis=1))
        final[:alive] = x.max(axis=1) + e[start[:alive] + t]
    label = (final + followed[:, None] * a[:, 0]).argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = size > t
        out[start[live] + t] = label[live]
        if t:
            m = len(back[t - 1])
            label[:m] = back[t - 1][np.arange(m), label[:m]]
    return out


def emissions(words: pa.Array, codes: np.ndarray, owner: np.ndarray, model: dict) -> np.ndarray:
    """Scores of the labels at each word: what a shape adds to itself and to two words on either side."""
    u, k = model["u"], len(LABELS)
    w, x = shapes(words)
    e = np.repeat(u[:1], len(codes), axis=0)
    row = np.full(len(words), -1, np.int64)
    row[w] = np.arange(len(w))
    at = np.flatnonzero(row[codes] >= 0)
    mine = row[codes[at]]
    for i, d in enumerate((0, -2, -1, 1, 2)):
        adds = x @ u[1 + i * SHAPES : 1 + (i + 1) * SHAPES]
        to = at - d  # the word whose neighbour at distance d this is
        ok = (to >= 0) & (to < len(codes))
        ok[ok] = owner[to[ok]] == owner[at[ok]]
        e[to[ok]] += adds[mine[ok]]
    assert e.shape[1] == k
    return e


#: What is not part of a value at its begin, and (backwards) at its end.
BEFORE, AFTER = re.compile(r"[^0-9A-Za-z+(]*"), re.compile(r"[^0-9A-Za-z)]*")


def added_spans(text: str, labels: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of equally labelled words, without punctuation around them, that touch no base span and hold a digit or @."""
    out, places, i = [], [m.span() for m in WORD.finditer(text)], 0
    base = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    while i < len(labels):
        j = i + 1
        while labels[i] and j < len(labels) and labels[j] == labels[i]:
            j += 1
        if labels[i]:
            start, end = places[i][0], places[j - 1][1]
            piece = text[start:end]
            start, end = start + BEFORE.match(piece).end(), end - min(AFTER.match(piece[::-1]).end(), len(piece) - 1)
            before = bisect_left(starts, end)  # base spans that begin before this one ends
            if end > start and re.search("[0-9@]", text[start:end]) and not (before and reach[before - 1] > start):
                out.append((LABELS[labels[i]], start, end))
        i = j
    return out


def find_spans(texts: pa.Array, model: dict) -> list[tuple[list, list]]:
    """Of each text: base spans; all spans. Both by kind as listed, then start."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    codes, words, owner = split_words(texts)
    labels = viterbi(emissions(words, codes, owner, model), model["a"], owner)
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    hit = np.zeros(len(texts), bool)
    hit[owner[labels > 0]] = True
    marked = pc.match_substring_regex(texts, "[0-9@]").to_numpy(zero_copy_only=False)
    out: list[tuple[list, list]] = [([], [])] * len(texts)
    rank = {k: i for i, k in enumerate(LABELS)}
    for i in np.flatnonzero(hit | marked):
        text = texts[int(i)].as_py()
        base = fixed_spans(text) if marked[i] else []
        more = added_spans(text, labels[at[i] : at[i + 1]], base) if hit[i] else []
        out[i] = (base, sorted(base + more, key=lambda s: (rank[s[0]], s[1])))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _report(batches, model):
    for b in slices(batches, "text"):
        found = find_spans(b.column("text"), model)
        counts = [pa.array([sum(k == x[0] for x in base) for base, _ in found], pa.int64()) for k in BASE]
        sha = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, sha, pa.array([_joined(every) for _, every in found], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans, their digest, all spans."""
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.mapInArrow(partial(_report, model=fitted()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in capitals."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _redact(batches, model, text):
    for b in slices(batches, text):
        texts = b.column(text).to_pylist()
        for i, (_, spans) in enumerate(find_spans(b.column(text), model)):
            if spans:
                texts[i] = redact(texts[i], spans)
        i = b.schema.get_field_index(text)
        yield b.set_column(i, text, pa.array(texts, pa.string()))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data in `text` replaced; a column n_chars follows the text's new length; all else as it was."""
    work, names = renamed(docs)
    text, size = names["text"], names.get("n_chars")
    work = work.withColumn(text, F.col(text).cast("string"))
    out = work.mapInArrow(partial(_redact, model=fitted(), text=text), work.schema)
    if size:
        out = out.withColumn(size, F.when(F.col(text).isNull(), F.col(size)).otherwise(F.char_length(text)).cast(work.schema[size].dataType))
    return out.toDF(*docs.columns)
