r"""N-gram Jaccard self-join by parity sketches.

A text's set holds its distinct w-word shingles (lower-cased A-Z; words `[^\x20\x09-\x0D]+`); a text of fewer
words has its whole sequence as one. Two sets link when 100 * |A & B| >= t * |A | B|.

Sets that link differ in at most D = (100 - t)(|A| + |B|) / (100 + t) shingles. XOR-hashing deals the shingles of a
set out over k cells; each cell holds the XOR of its shingles' hashes. A shingle that two sets share leaves no
trace in the XOR of their sketches, and one that they do not share changes one cell: the number of unequal cells is
a lower bound of the symmetric difference. So linked sets agree in at least k - D cells (pigeonhole), and joining on
(size band, cell, content) finds every link. k exceeds D by more than the usual number of empty cells, so those need
no join; a set with more empty cells is dealt out again under other seeds, and under the last also joins on them.
One-bit cells (a bit sketch of two to four bits a shingle, which folds to its half) give the same bound and reject most
of what the join brings before exact verification.

A key that very many sets share (a passage, a group of near copies) meets in no single task: a task that sees it often, in a
slice of texts or in all that it reads, deals its sets out to salted groups and tells the key's own group by a mark; all of them then name the bucket after the key, so
that its members are one bucket again, as rows.

Equal sets are one node from the start. A group of near copies costs links to pivots, not all pairs: a bucket's pivot is
its member that shares most buckets, and the first round verifies one pivot a node. Further rounds verify what else may
link sets that are not yet connected: other pivots, and inside a bucket other members, compared by their bits in tiles of
bounded size. A round puts off a node's candidates beyond its nearest few; rounds follow, with more each, until none is put
off. Only pairs that pass the bound on bits have their texts fetched.

Defined cases: null or blank text has the empty set, n_shingles 0, component_id its own doc_id; a null doc_id takes no
part in links, component_id null; repeated rows and equal texts share a component; an empty table gives no rows; other
columns are ignored. Texts are never cut.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash_words, mix, renamed, runs, slices, split_words, spread_join

#: Keys that one group of the bucket join holds about, and sets in a tile of the second round.
GROUP_KEYS, TILE = 1 << 20, 1024
#: Groups of the bucket join at least, and rows of small buckets that are compared together.
GROUPS, CHUNK = 64, 1 << 11
#: Candidates of a node that the second round verifies from one group; each further round takes FEW times as many.
FEW = 8
#: Bits of the filter that is broadcast (2 MB at most).
BITMAP = 1 << 24
SEEDS = 4
#: Sets of a slice, and of a task, that make a key hot; keys that a task counts at most (that changes cost, not results);
#: parts that a hot key's sets are dealt out to, and the node that marks such a key.
HOT, HOT_TASK, TALLY, SALTS, MARK = 64, 256, 1 << 17, 32, np.iinfo(np.int64).min
U = np.uint64


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most 1024 texts: shingle hash (54 bits) and text of each member of the sets, by hash; the sets' sizes."""
    codes, words, owner = split_words(texts.cast(pa.string()))
    words = pa.compute.ascii_lower(words)
    h = hash_words(words)[codes]
    n = len(texts)
    count = np.bincount(owner, minlength=n)
    start = np.concatenate([[0], np.cumsum(count)])
    s = h.copy()
    for i in range(1, width):  # words past the end of a short text do not enter
        s[: len(h) - i] = mix(s[: len(h) - i] + U(0x9E3779B97F4A7C15 * i & (2**64 - 1))) ^ h[i:] if len(h) > i else s[: len(h) - i]
    place = np.arange(len(h)) - start[owner]
    full = place <= count[owner] - width
    out_h, out_o = [s[full]], [owner[full]]
    for d in np.flatnonzero((count > 0) & (count < width)):
        x = U(count[d])
        for v in h[start[d] : start[d + 1]]:
            x = mix(np.array([x ^ v]))[0] + U(1)
        out_h.append(np.array([x], U))
        out_o.append(np.array([d]))
    h, o = np.concatenate(out_h), np.concatenate(out_o)
    c = np.sort((mix(h) & ~U(1023)) | o.astype(U))
    c = c[runs(c)]
    o = (c & U(1023)).astype(np.int64)
    return c >> U(10), o, np.bincount(o, minlength=n)


def set_ids(h: np.ndarray, o: np.ndarray, n: int) -> np.ndarray:
    """A signed 64-bit id of each set."""
    out = np.zeros(n, U)
    np.add.at(out, o, mix(h + U(0x51ED270B)))
    return mix(out).view(np.int64)


class Bands:
    """Size bands by the ratio that linked sets may have at most; a set joins in its own band and the next."""

    def __init__(self, percent: int):
        self.t = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent + 1))
        self.low = np.array(edges, np.int64)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1

    def differ(self, total: np.ndarray) -> np.ndarray:
        return (100 - self.t) * total // (100 + self.t)

    def cells(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most unequal cells of linked sets whose larger one is in the band, and the number of cells."""
        d = self.differ(2 * (self.low[band + 1] - 1))
        return d, d + 4 + (15 * d + 99) // 100


def keys_of(h: np.ndarray, o: np.ndarray, size: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Join keys (64 bits) and the set of each."""
    own, keys, sets = bands.of(np.maximum(size, 1)), [], []
    for up in (0, 1):
        band = own + up
        d, k = bands.cells(band)
        live = size > 0
        for seed in range(SEEDS):
            use = live[o]
            at = np.concatenate([[0], np.cumsum(np.where(live, k, 0))])
            owner = np.repeat(np.arange(len(size)), np.diff(at))
            cell = np.zeros(at[-1], U)
            if len(cell) == 0:
                break
            hs, os = h[use], o[use]
            place = (mix(hs + U(0xA24BAED4 * (seed + 1))) >> U(32)) * k[os].astype(U) >> U(32)
            flat = at[os] + place.astype(np.int64)
            np.bitwise_xor.at(cell, flat, mix(hs ^ U(0xC2B2AE3D27D4EB4F)))
            filled = np.zeros(len(cell), bool)
            filled[flat] = True
            empty = np.bincount(owner[~filled], minlength=len(size))
            bare = live & (empty >= k - d)  # all agreeing cells might be empty ones
            out = filled | bare[owner] if seed == SEEDS - 1 else filled
            index = np.arange(len(cell)) - at[owner]
            key = mix(cell + mix((band[owner] * SEEDS + seed).astype(U) << U(40) | index.astype(U)))
            keys.append(key[out])
            sets.append(owner[out])
            live = bare
            if not live.any():
                break
    return (np.concatenate(keys), np.concatenate(sets)) if keys else (np.zeros(0, U), np.zeros(0, np.int64))


def sketch(h: np.ndarray) -> np.ndarray:
    """Parity bits of one set, as 64-bit words; a power of two of bits, two a shingle at least."""
    m = 64
    while m < 2 * len(h):
        m *= 2
    bits = np.bincount((mix(h ^ U(0x27D4EB2F165667C5)) & U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(U)


def _sizes(batches, width):
    for b in slices(batches, "text"):
        h, o, size = shingle_sets(b.column("text"), width)
        ids = set_ids(h, o, b.num_rows)
        h, at = h[np.argsort(o, kind="stable")], np.concatenate([[0], np.cumsum(size)])
        bits = [sketch(h[at[i] : at[i + 1]]).tobytes() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(ids, mask=size == 0), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "node", "bits"])


def _packed(gid: np.ndarray, node: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Rows (gid, blob) of keys and their nodes: in a blob, the nodes, how many keys each has, the keys."""
    order = np.lexsort((node, gid))
    gid, node, keys = gid[order], node[order], keys[order].astype(np.uint32)
    starts, out = runs(gid), []
    for i, j in zip(starts, np.append(starts[1:], len(gid))):
        r = runs(node[i:j])
        many = np.diff(np.append(r, j - i)).astype(np.uint32)
        out.append(np.array([len(r)], np.uint32).tobytes() + node[i:j][r].tobytes() + many.tobytes() + keys[i:j].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(gid[starts], pa.int64()), pa.array(out, pa.binary())], ["gid", "blob"])


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, nodes = [], []
    for blob in blobs:
        m = int(np.frombuffer(blob, np.uint32, 1)[0])
        nodes.append(np.repeat(np.frombuffer(blob, np.int64, m, 4), np.frombuffer(blob, np.uint32, m, 4 + 8 * m)))
        keys.append(np.frombuffer(blob, np.uint32, offset=4 + 12 * m))
    return np.concatenate(keys), np.concatenate(nodes)


class Tally:
    """Which keys a task has met often: counts of those that several sets of a slice have, the rarest dropped when they get many."""

    def __init__(self, often: int = HOT_TASK):
        self.count: dict[int, int] = {}
        self.often, self.hot = often, np.zeros(0, U)

    def met(self, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether each of a slice's distinct keys is hot by now."""
        several, new = count > 1, []
        for k, n in zip(keys[several].tolist(), count[several].tolist()):
            total = self.count[k] = self.count.get(k, 0) + n
            if total >= self.often:
                new.append(k)
        self.hot = np.union1d(self.hot, np.array(new, U))
        least = 2
        while len(self.count) > TALLY:
            self.count, least = {k: n for k, n in self.count.items() if n > least}, 2 * least
        return (count >= HOT) | np.isin(keys, self.hot)


def _blobs(batches, width, percent, groups, often):
    """The keys of the task's distinct sets, by the group that a key goes to; sets of a key that is hot here, by salted groups."""
    bands, seen, tally = Bands(percent), set(), Tally(often)
    for b in slices(batches, "text"):
        h, o, size = shingle_sets(b.column("text"), width)
        ids = set_ids(h, o, b.num_rows)
        new = np.zeros(b.num_rows, bool)
        for i, x in enumerate(ids.tolist()):
            if size[i] and x not in seen:
                seen.add(x)
                new[i] = True
        use = new[o]
        keys, sets = keys_of(h[use], o[use], np.where(new, size, 0), bands)
        gid, node = ((keys >> U(32)) * U(groups) >> U(32)).astype(np.int64), ids[sets]
        order = np.argsort(keys)
        start = runs(keys[order])
        count = np.diff(np.append(start, len(keys)))
        often, hot = tally.met(keys[order[start]], count), np.zeros(len(keys), bool)
        hot[order] = np.repeat(often, count)
        mark = order[start[often]]  # one entry of each hot key
        told = gid[mark]
        gid[hot] += groups * (1 + (node[hot].view(U) % U(SALTS)).astype(np.int64))
        yield _packed(np.concatenate([gid, told]), np.concatenate([node, np.full(len(mark), MARK)]), np.concatenate([keys, keys[mark]]))


def _buckets(group: pa.Table, groups: int) -> pa.Table:
    """(bucket, node): members of each key that several sets have, once for each list of members; all members of hot keys."""
    gid = group.column("gid")[0].as_py()
    keys, nodes = _unpacked(group.column("blob").to_pylist())
    named = lambda k: mix(k.astype(U) | U(gid % groups << 32)).view(np.int64)
    if gid >= groups:
        return pa.table({"bucket": named(keys), "node": nodes})
    marked = np.unique(keys[nodes == MARK])
    mine = nodes != MARK
    keys, nodes = keys[mine], nodes[mine]
    hot = np.isin(keys, marked)
    out_bucket, out_node = [named(keys[hot])], [nodes[hot]]
    keys, nodes = keys[~hot], nodes[~hot]
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    several = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(k) else np.zeros(0, bool)
    k, v = k[several], nodes[order][several]
    order = np.lexsort((v, k))
    k, v = k[order], v[order]
    first = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])[: len(k)]  # the same set from another task
    k, v = k[first], v[first]
    start = runs(k)
    size = np.diff(np.append(start, len(k)))
    if len(k):
        bucket = mix(np.add.reduceat(mix(v.view(U)), start) + size.astype(U)).view(np.int64)
        _, pick = np.unique(bucket, return_index=True)
        take = np.zeros(len(start), bool)
        take[pick[size[pick] > 1]] = True
        use = np.repeat(take, size)
        out_bucket.append(np.repeat(bucket, size)[use])
        out_node.append(v[use])
    return pa.table({"bucket": np.concatenate(out_bucket), "node": np.concatenate(out_node)})


def _same(batches, width):
    """The texts that are their node's (not another text under the same doc_id)."""
    for b in slices(batches, "text"):
        h, o, _ = shingle_sets(b.column("text"), width)
        mine = set_ids(h, o, b.num_rows) == b.column("node").to_numpy(zero_copy_only=False)
        yield b.select(["node", "text"]).filter(pa.array(mine))


def _members(table: pa.Table, text: str, width: int):
    """The set of each row, in order."""
    for b in slices(iter(table.combine_chunks().to_batches()), text):
        h, o, size = shingle_sets(b.column(text), width)
        h, at = h[np.argsort(o, kind="stable")], np.concatenate([[0], np.cumsum(size)])
        yield from (h[at[i] : at[i + 1]] for i in range(b.num_rows))


def _verify(pairs: pa.Table, pivots: pa.Table, width: int, percent: int) -> pa.Table:
    """Pairs (node, pivot) whose sets link."""
    y = next(_members(pivots, "own", width), np.zeros(0, U))
    ok = []
    for x in _members(pairs, "text", width):
        both = np.sort(np.concatenate([x, y]))
        shared = int((both[1:] == both[:-1]).sum())
        ok.append(100 * shared >= percent * (len(both) - shared))
    return pairs.select(["node", "pivot"]).filter(pa.array(ok, pa.bool_()))


class Bits:
    """Sketches of many sets, and which pairs of them may link."""

    def __init__(self, bits: pa.ChunkedArray | pa.Array, size: np.ndarray, bands: Bands):
        parts = [np.frombuffer(x, U) for x in bits.to_pylist()]
        self.width = np.array([len(x) for x in parts], np.int64)
        self.flat = np.concatenate(parts) if parts else np.zeros(0, U)
        self.at, self.size, self.bands = np.cumsum(self.width) - self.width, size, bands

    def near(self, i: np.ndarray, j: np.ndarray, other: Bits | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Whether set i of these and set j of these (or the others) differ in no more bits and size than linked sets may; in how many."""
        other = other or self
        a, b = self.size[i], other.size[j]
        ok = 100 * np.minimum(a, b) >= self.bands.t * np.maximum(a, b)
        most, apart = self.bands.differ(a + b), np.zeros(len(i), np.int64)
        kind = self.width[i] << 32 | other.width[j]
        for k in np.unique(kind[ok]):
            w, v = int(k >> 32), int(k & 0xFFFFFFFF)
            at = np.flatnonzero(ok & (kind == k))
            step = max(1, (1 << 19) // max(w, v))
            for p in range(0, len(at), step):
                part = at[p : p + step]
                x = self.flat[self.at[i[part]][:, None] + np.arange(w)]
                y = other.flat[other.at[j[part]][:, None] + np.arange(v)]
                while x.shape[1] > y.shape[1]:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                while y.shape[1] > x.shape[1]:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                apart[part] = np.bitwise_count(x ^ y).sum(axis=1)
                ok[part] = apart[part] <= most[part]
        return ok, apart


def _stars(batches, percent):
    """The pairs (node, pivot) that pass the bound."""
    bands = Bands(percent)
    for b in batches:
        x, y = (Bits(b.column(c), b.column(n).to_numpy(zero_copy_only=False), bands) for c, n in (("bits", "n"), ("pivot_bits", "pivot_n")))
        i = np.arange(b.num_rows)
        yield b.select(["node", "pivot", "degree"]).filter(pa.array(x.near(i, i, y)[0]))


def _tile(group: pa.Table, percent: int, few: int) -> pa.Table:
    """Pairs inside the buckets of a group (or between two parts of a large one) of sets that aren't connected yet and pass the
    bound: each node's `few` nearest. more: whether one of the pair has others."""
    group = group.sort_by([("bucket", "ascending"), ("node", "ascending")])
    bucket, node, part, label, size = (group.column(c).to_numpy() for c in ("bucket", "node", "part", "label", "n"))
    bits = Bits(group.column("bits"), size, Bands(percent))
    ta, tb = group.column("ta")[0].as_py(), group.column("tb")[0].as_py()
    out, i, d = [], np.arange(len(node)), 1
    while True:
        i = i[i + d < len(node)]
        i = i[bucket[i] == bucket[i + d]]
        if not len(i):
            break
        j = i + d
        ok = (label[i] != label[j]) & ((part[i] == ta) & (part[j] == tb) | (part[i] == tb) & (part[j] == ta))
        x, y = i[ok], j[ok]
        near, apart = bits.near(x, y)
        out.append(np.stack([np.maximum(node[x], node[y])[near], np.minimum(node[x], node[y])[near], apart[near]]))
        d += 1
    pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((3, 0), np.int64)
    n = pairs.shape[1]
    ends, other = np.concatenate([pairs[0], pairs[1]]), np.tile(np.arange(n), 2)
    order = np.lexsort((other, pairs[2][other], ends))
    start = runs(ends[order])
    count = np.diff(np.append(start, 2 * n))
    rank = np.arange(2 * n) - np.repeat(start, count)
    take, more = np.zeros(n, bool), np.zeros(n, bool)
    take[other[order][rank < few]] = True
    more[other[order][np.repeat(count > few, count)]] = True
    return pa.table({"node": pairs[0][take], "pivot": pairs[1][take], "more": more[take]})


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches, by alternating large-star and small-star steps."""
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges, before, turn = scratch.keep(edges, f"{name}0"), None, 0
    while True:
        # large-star: every larger neighbour of u moves to u's smallest neighbour (u itself where it is that)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small-star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        new = scratch.keep(small, f"{name}{turn}")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{turn - 1}")
        edges = new
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now


def fetched(docs: DataFrame, need: DataFrame) -> DataFrame:
    """node and text of the documents in need (node, doc_id). A broadcast bitmap of bounded size keeps most others from the shuffle."""
    word = F.shiftright(F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)), 6)
    bit = f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {BITMAP}) % 64 as int))"
    words = need.groupBy(word.alias("word")).agg(F.bit_or(F.expr(bit)).alias("mask"))
    likely = docs.withColumn("word", word).join(F.broadcast(words), "word").filter(f"(mask & {bit}) != 0")
    return likely.join(need, "doc_id").select("node", "text")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "parity")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = scratch.keep(docs.mapInArrow(partial(_sizes, width=width), "doc_id long, n_shingles long, node long, bits binary"), "sizes")
    total = sizes.filter("doc_id is not null and node is not null").agg(F.sum("n_shingles")).first()[0] or 0
    groups = max(GROUPS, round(0.6 * total / GROUP_KEYS))

    nodes = scratch.keep(sizes.filter("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")), "nodes")
    blobs = docs.filter("doc_id is not null").mapInArrow(partial(_blobs, width=width, percent=percent, groups=groups, often=HOT_TASK), "gid long, blob binary")
    found = blobs.groupBy("gid").applyInArrow(lambda group: _buckets(group, groups), "bucket long, node long")
    buckets = scratch.keep(found.distinct(), "buckets")

    # a bucket's pivot: the member with most buckets (of a group of near copies the one that most are copies of)
    degree = buckets.groupBy("node").agg(F.count("*").alias("degree"))
    ranked = buckets.select("bucket", "node").join(degree, "node")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("top")).select("bucket", F.col("top.node").alias("pivot"), F.col("top.degree").alias("degree"))
    buckets = scratch.keep(buckets.select("bucket", "node").join(pivots, "bucket"), "pivots")

    # first bound, on bits, of every pair of a node and a pivot
    bits = buckets.select("node").distinct().join(nodes, "node").join(sizes.select("node", "doc_id", "bits"), ["node", "doc_id"])
    bits = scratch.keep(bits.dropDuplicates(["node"]).select("node", "doc_id", "n", "bits"), "bits")
    stars = buckets.filter("node != pivot").select("node", "pivot", "degree").distinct()
    stars = stars.join(bits.select("node", "n", "bits"), "node").join(bits.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("bits").alias("pivot_bits")), "pivot")
    stars = scratch.keep(stars.mapInArrow(partial(_stars, percent=percent), "node long, pivot long, degree long"), "stars")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose sets link. A node's text travels once for each pair, a pivot's once for each part of some hundreds of its pairs."""
        need = pairs.select(F.explode(F.array("node", "pivot")).alias("node")).distinct().join(bits.select("node", "doc_id"), "node")
        texts = scratch.keep(fetched(docs, need).mapInArrow(partial(_same, width=width), "node long, text string"), name)
        many = pairs.groupBy("pivot").agg(F.expr("cast(ceil(count(*) / 256) as int)").alias("parts"))
        left = pairs.join(many, "pivot").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(texts, "node")
        right = many.select(F.col("pivot").alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")).join(texts.select(F.col("node").alias("p"), F.col("text").alias("own")), "p")
        return left.select("pivot", "part", "node", "text").groupBy("pivot", "part").cogroup(right.groupBy("p", "q")).applyInArrow(lambda x, y: _verify(x, y, width, percent), "node long, pivot long").distinct()

    def compared(few: int):
        return lambda group: _tile(group, percent, few)

    first = stars.groupBy("node").agg(F.max_by("pivot", F.struct("degree", "pivot")).alias("pivot"))
    tried = scratch.keep(first, "tried")
    labels = components(verified(tried, "texts"), scratch, "near")

    # further rounds: what may link sets that are still apart
    few = FEW
    while True:
        known = labels.withColumnRenamed("label", "known")
        named = buckets.filter("node != pivot").select("bucket", "node").join(known, "node", "left").select("bucket", "node", F.coalesce("known", "node").alias("label"))
        # of a large bucket, members of its largest component meet the others, which also meet each other, but not themselves
        sized = named.groupBy("bucket", "label").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("s"), F.count("*").alias("labels")).filter("labels > 1")
        parts = lambda rows, small: F.expr(f"cast(if(s > {TILE}, ceil(({rows}) / {TILE}), {small}) as int)")
        apart = sized.select("bucket", F.col("top.label").alias("main"), parts("top.k", 0).alias("mains"), parts("s - top.k", 1).alias("rest"))
        tiles = scratch.keep(named.join(apart, "bucket"), f"apart{few}")
        chunks = max(1, tiles.count() // CHUNK)
        dealt = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")
        own = (F.col("mains") > 0) & (F.col("label") == F.col("main"))
        tiles = tiles.withColumn("part", F.when(own, dealt("mains")).otherwise(F.col("mains") + dealt("rest"))).withColumn("other", F.explode(F.sequence(F.when(own, F.col("mains")).otherwise(0), F.col("mains") + F.col("rest") - 1)))
        group = F.when(F.col("mains") == 0, F.pmod("bucket", F.lit(chunks))).otherwise(F.col("bucket"))
        tiles = tiles.select("bucket", group.alias("chunk"), "node", "label", "part", F.least("part", "other").alias("ta"), F.greatest("part", "other").alias("tb")).join(bits.select("node", "n", "bits"), "node")
        inside = tiles.groupBy("chunk", "ta", "tb").applyInArrow(compared(few), "node long, pivot long, more boolean")
        here, there = known.select("node", F.col("known").alias("la")), known.select(F.col("node").alias("pivot"), F.col("known").alias("lb"))
        others = stars.join(here, "node", "left").join(there, "pivot", "left").filter("coalesce(la, node) != coalesce(lb, pivot)").select(F.greatest("node", "pivot").alias("node"), F.least("node", "pivot").alias("pivot"), F.lit(False).alias("more"))
        ordered = tried.select(F.greatest("node", "pivot").alias("node"), F.least("node", "pivot").alias("pivot"))
        offered = scratch.keep(inside.unionByName(others).groupBy("node", "pivot").agg(F.max("more").alias("more")), f"offered{few}")
        more = offered.agg(F.coalesce(F.bool_or("more"), F.lit(False))).first()[0]  # of all pairs, those tried before too
        pairs = scratch.keep(offered.select("node", "pivot").join(ordered, ["node", "pivot"], "left_anti"), f"pairs{few}")
        if not pairs.isEmpty():
            labels = components(labels.select("node", F.col("label").alias("pivot")).unionByName(verified(pairs, f"others{few}")), scratch, f"all{few}")
        if not more:
            break
        tried, few = tried.unionByName(pairs), few * FEW

    marked = nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = marked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = marked.join(least, "label").select("node", "component_id")
    # equal texts share a node, and texts without words have none
    return spread_join(sizes.select("doc_id", "n_shingles", "node"), of, "node").select("doc_id", "n_shingles", F.expr("case when doc_id is not null then coalesce(component_id, doc_id) end").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The row of docs with a component's smallest doc_id, all columns; rows without a doc_id stay; of repeated doc_ids one row stays."""
    work, names = renamed(docs)
    me, text = names["doc_id"], names["text"]
    found = jaccard_components(work.select(F.col(me).alias("doc_id"), F.col(text).alias("text")), width, percent)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    named = work.filter(F.col(me).isNotNull()).join(kept, F.col(me) == F.col("kept"), "left_semi")
    # the join leaves equal doc_ids together, so that this needs no further exchange
    return named.dropDuplicates([me]).unionByName(work.filter(F.col(me).isNull())).toDF(*docs.columns)
