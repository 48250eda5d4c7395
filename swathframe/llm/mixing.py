r"""Soft-membership mixing: document rates by which a corpus meets target token weights of domains.

A naive Bayes classifier is learned from a labelled table: word counts of at most FIT_ROWS labelled documents, taken in the
order of a hash of doc_id, over each domain's VOCABULARY most frequent words (vocabulary=None: all of them). It predicts every document's posterior over the domains
(soft: log odds grow with the root of the number of known words). With tokens t and posteriors p, nonnegative rates w shall give
expected domain totals sum(w t p_k) = T_k. Projected gradient descent on the squared differences, then where it stalls or a
domain is off its own target, projected Newton steps, each step over the whole table at once: only sums by domain reach the
driver, never a document's row. Everything else is DataFrame operations.

Tokens are words `[^\x20\x09-\x0D]+`. Defined cases: null and blank texts have no tokens and the prior as posterior; a domain without
documents can't be reached and leaves a residual; repeated rows are fitted row by row; without labelled rows all documents
belong to the one domain "unknown"; an empty table gives no rows. Rates are never capped; `floor` is their lower bound (0).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, renamed

FIT_ROWS, VOCABULARY, SMOOTH = 4000, 2000, 0.1
#: Steps at most; residuals that are enough, of all domains together and of each to its own target; steps between written tables.
STEPS, ENOUGH, ENOUGH_EACH, EVERY = 40, 1e-3, 0.01, 8
#: Parts of a Newton step that are tried.
PARTS = (1.0, 0.5, 0.25, 0.1, 0.02)
SPACE = "[\\x20\\x09-\\x0D]+"


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each word, and one without a word for a text that has none."""
    return docs.select(*keep, F.explode_outer(F.split(F.col("text"), SPACE)).alias("word"))


def learned(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = FIT_ROWS, size: int | None = VOCABULARY) -> tuple[list[str], list[float], DataFrame]:
    """Domains, their log priors, and the table (word, l0, l1, ...) of log likelihoods: of each domain's `size` most frequent words, None: of all words."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).filter("doc_id is not null and domain is not null")
    chosen = chosen.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = scratch.keep(chosen, "chosen")
    share = {r.domain: r.n for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(share) or ["unknown"]
    prior = np.log([share.get(d, 1) / max(sum(share.values()), 1) for d in domains]).tolist()
    # bounded by `rows` ids: broadcast
    words = _words(docs.join(F.broadcast(chosen), "doc_id"), "domain").filter("word <> ''")
    counts = words.groupBy("word").agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)))
    if size is not None and share:
        counts = scratch.keep(counts, "counts")
        first = [counts.filter(f"n{k} > 0").orderBy(F.desc(f"n{k}"), "word").limit(size).select("word") for k in range(len(domains))]
        counts = counts.join(F.broadcast(reduce(DataFrame.unionByName, first).distinct()), "word", "left_semi")
    top = scratch.keep(counts, "vocabulary")
    total = top.agg(F.count("*").alias("v"), *(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(domains)))).first()
    like = [(F.log(F.col(f"n{k}") + SMOOTH) - float(np.log((total[f"n{k}"] or 0) + SMOOTH * max(total["v"], 1)))).alias(f"l{k}") for k in range(len(domains))]
    return domains, prior, top.select("word", *like)


def posteriors(docs: DataFrame, domains: list[str], prior: list[float], words: DataFrame, few: bool = True) -> DataFrame:
    """row, doc_id, n_tokens and p0, p1, ... of every row of docs (row, doc_id, text). few: whether `words` is bounded."""
    k = range(len(domains))
    # at most VOCABULARY words a domain: broadcast; a text's words are in one task, so that partial sums leave one row a text
    known = _words(docs, "row", "doc_id").join(F.broadcast(words) if few else words, "word", "left")
    sums = known.groupBy("row", "doc_id").agg(F.count_if(F.col("word") != '').alias("n_tokens"), F.count("l0").alias("known"), *(F.sum(f"l{i}").alias(f"s{i}") for i in k))
    score = [F.lit(prior[i]) + F.coalesce(F.col(f"s{i}") / F.sqrt(F.col("known")), F.lit(0.0)) if len(domains) > 1 else F.lit(0.0) for i in k]
    sums = sums.withColumn("known", F.greatest("known", F.lit(1))).select("row", "doc_id", "n_tokens", *(x.alias(f"s{i}") for i, x in enumerate(score)))
    top = F.greatest(*(F.col(f"s{i}") for i in k)) if len(domains) > 1 else F.col("s0")
    odds = sums.select("row", "doc_id", "n_tokens", *(F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in k))
    whole = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return odds.select("row", "doc_id", "n_tokens", *((F.col(f"e{i}") / whole).alias(f"p{i}") for i in k))


def _dot(k: int, c) -> F.Column:
    return sum((F.col(f"p{i}") * float(c[i]) for i in range(k)), F.lit(0.0))


def _sums(members: DataFrame, k: int, columns: dict[str, F.Column]) -> dict[str, np.ndarray]:
    """Token sums by domain, weighted by each column."""
    row = members.agg(*(F.sum(c * F.col("n_tokens") * F.col(f"p{i}")).alias(f"{n}_{i}") for n, c in columns.items() for i in range(k))).first()
    return {n: np.array([row[f"{n}_{i}"] or 0.0 for i in range(k)]) for n in columns}


def rates(members: DataFrame, targets: np.ndarray, scratch: Scratch, floor: float = 0.0) -> DataFrame:
    """members with the column `rate`: projected gradient on sum_k (sum(rate * n_tokens * p_k) - targets_k)^2 from rates of 1.

    A step moves a rate by the gradient over n_tokens (the metric in which long and short documents of a domain move alike),
    as far as is best along the unprojected line, then projects on rates >= floor. Where that stalls, or has met the targets
    together but not each, Newton steps in each domain's own scale follow, over the rows that are free to move.
    """
    k = len(targets)
    g = _sums(members, k, {f"{i}": F.col(f"p{i}") for i in range(k)})
    g = np.array([g[f"{i}"] for i in range(k)])
    now, scale, best = members.withColumn("rate", F.lit(max(1.0, floor))), max(float(np.abs(targets).sum()), 1.0), None

    def moved(c) -> F.Column:
        return F.greatest(F.lit(float(floor)), F.col("rate") - _dot(k, c))

    for step in range(STEPS):
        r = _sums(now, k, {"t": F.col("rate")})["t"] - targets
        off = float(np.abs(r).sum()) / scale
        if off <= ENOUGH or (best is not None and off >= best * 0.999 and step > 10):
            break
        best = off if best is None else min(best, off)
        down = g @ r
        now = now.withColumn("rate", moved(float(r @ down) / max(float(down @ down), 1e-300) * r))
        if step % EVERY == EVERY - 1:
            now = scratch.keep(now, f"rates{step}")

    # each domain in its own scale
    own = 1 / np.maximum(targets, ENOUGH * scale / k)
    r = _sums(now, k, {"t": F.col("rate")})["t"] - targets
    for step in range(STEPS):
        if np.all(np.abs(r) * own <= ENOUGH_EACH):
            break
        free = ((F.col("rate") > float(floor)) | (_dot(k, own * own * r) < 0)).cast("double")
        some = _sums(now, k, {f"{i}": free * F.col(f"p{i}") for i in range(k)})
        ways = []
        for m in (np.array([some[f"{i}"] for i in range(k)]), g):
            c = own * np.linalg.lstsq(own[:, None] * m * own, own * r, rcond=1e-12)[0]
            ways += [part * c for part in PARTS]
        found = _sums(now, k, {f"w{i}": moved(c) for i, c in enumerate(ways)})
        off = [float(np.sum(((found[f"w{i}"] - targets) * own) ** 2)) for i in range(len(ways))]
        way = int(np.argmin(off))
        if not off[way] < 0.999 * float(np.sum((r * own) ** 2)):
            break  # what is left can't be reached
        now, r = now.withColumn("rate", moved(ways[way])), found[f"w{way}"] - targets
        if step % EVERY == EVERY - 1:
            now = scratch.keep(now, f"newton{step}")
    return now


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.7, budget: float | None = None, floor: float = 0.0, vocabulary: int | None = VOCABULARY) -> tuple[DataFrame, list[str]]:
    """(row, doc_id, n_tokens, p0, ..., rate) of every row of docs (row, doc_id, text), and the domains' names.

    labels: doc_id, domain. weights: target share of each domain's tokens; none: the domains' own shares to the power
    `temper`, rescaled. budget: target tokens in all; none: as many as there are, or if floor >= 1, so many that no
    domain's target is under floor times its own tokens.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    domains, prior, words = learned(docs, labels, scratch, size=vocabulary)
    members = scratch.keep(posteriors(docs, domains, prior, words, vocabulary is not None), "members")
    k = range(len(domains))
    own = members.agg(*(F.sum(F.col("n_tokens") * F.col(f"p{i}")).alias(f"t{i}") for i in k)).first()
    own = np.array([own[f"t{i}"] or 0.0 for i in k])
    share = np.array([weights.get(d, 0.0) for d in domains]) if weights else (own / max(own.sum(), 1e-300)) ** temper
    share = share / max(share.sum(), 1e-300)
    if budget is None:
        budget = own.sum() if floor < 1 else max([floor * o / s for o, s in zip(own, share) if s > 0], default=0.0)
    return rates(members, budget * share, scratch, floor), domains


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def mixing_rates(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior (by domain), rate of every row of docs (doc_id, text)."""
    out, domains = mixed(numbered(docs), labels, **how)
    k = range(len(domains))
    top = F.greatest(*(F.col(f"p{i}") for i in k)) if len(domains) > 1 else F.col("p0")
    domain = F.coalesce(*(F.when(F.col(f"p{i}") == top, F.lit(d)) for i, d in enumerate(domains)))
    posterior = F.create_map(*(x for i, d in enumerate(domains) for x in (F.lit(d), F.col(f"p{i}"))))
    return out.select("doc_id", "n_tokens", domain.alias("domain"), posterior.alias("posterior"), "rate")


def resampled(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Rows of docs, each as often as its rate says: its whole part, and once more by a hash with the rest as probability."""
    work, names = renamed(docs)
    # numbered once and stored: a second evaluation might number otherwise
    rows = Scratch(docs.sparkSession, "numbered").keep(work.withColumn("row", F.monotonically_increasing_id()), "rows")
    found, _ = mixed(rows.select("row", F.col(names["doc_id"]).cast("long").alias("doc_id"), F.col(names["text"]).cast("string").alias("text")), labels, **how)
    chance = F.pmod(F.xxhash64("row", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    copies = found.select("row", (F.floor(F.col("rate") + 1e-9) + (chance < F.col("rate") - F.floor(F.col("rate") + 1e-9)).cast("long")).cast("int").alias("copies"))
    out = rows.join(copies, "row").filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*work.columns).toDF(*docs.columns)
