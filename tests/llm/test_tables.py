"""Operators over odd tables and empty ones; those across rows against brute force."""

import gzip
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from swathframe.llm import licenses, mixing, packing, parity, pii, quality, queries, repetition, tokencount, topk, warc

TOKENIZER, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture
def labels(spark, odd_rows):
    return spark.createDataFrame([(r[0], int(r[0] % 2), 0, "x") for r in odd_rows if r[0] is not None], "doc_id long, quality int, toxic int, text string")


def each(labels):
    return {
        "counts": lambda d: tokencount.token_counts(d, PIECES),
        "repetition": repetition.repetition,
        "licences": licenses.license_scan,
        "pii": pii.personal_data,
        "quality": lambda d: quality.quality_scores(d, labels),
        "mixing": lambda d: mixing.mixing_rates(d, labels.selectExpr("doc_id", "if(quality = 1, 'a', 'b') as domain")),
    }


@pytest.mark.parametrize("name", ["counts", "repetition", "licences", "pii", "quality", "mixing"])
def test_odd_and_empty(odd, none, labels, odd_rows, name):
    f = each(labels)[name]
    rows = f(odd).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r.doc_id for r in rows), key=key) == sorted((r[0] for r in odd_rows), key=key)
    assert f(none).count() == 0
    same = [tuple(x for c, x in r.asDict().items()) for r in rows if r.doc_id == 9]
    assert len(same) == 3 and all(str(x) == str(same[0]) for x in same)


def test_whole_rows_stay(odd, none, labels):
    assert quality.keep_good(odd, labels).columns == odd.columns and quality.keep_good(none, labels).count() == 0
    out = pii.redacted(odd)
    assert out.schema.simpleString() == odd.schema.simpleString() and out.count() == odd.count()
    domains = labels.selectExpr("doc_id", "if(quality = 1, 'a', 'b') as domain")
    out = mixing.resampled(odd, domains, floor=1.0)
    assert out.columns == odd.columns and out.count() >= odd.count()
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in odd.select("doc_id").collect()}


CLASHES = ["_score", "_kept", "_row", "_copy", "score", "kept", "row", "copies", "copy", "rate", "n_tokens", "p0", "node", "component_id", "word", "mask", "c0", "c1", "a.b", "a`b", "label", "domain", "h"]


def test_columns_of_any_name_stay(spark, labels):
    """Every stage that returns documents keeps other columns, whatever their names, with their values."""
    texts = [f"The river number {i} runs by the old garden, mail a{i}@b.example." for i in range(8)] + [None]
    rows = [(*(f"{c}{i}" for c in CLASHES), i, t, len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, [*CLASHES, "doc_id", "text", "n_chars"]).select(*(f"`{c.replace('`', '``')}`" for c in CLASHES[:9]), "doc_id", "text", *(f"`{c.replace('`', '``')}`" for c in CLASHES[9:]), "n_chars")
    domains = labels.selectExpr("doc_id", "if(quality = 1, 'a', 'b') as domain")
    stages = [lambda d: quality.keep_good(d, labels, threshold=0.0), lambda d: parity.one_of_each(d), pii.redacted, lambda d: mixing.resampled(d, domains, floor=1.0)]
    for stage in stages:
        out = stage(docs)
        assert out.columns == docs.columns
        found = [dict(zip(out.columns, r)) for r in out.collect()]
        assert {r["doc_id"] for r in found} == set(range(9))
        assert all(r[c] == f"{c}{r['doc_id']}" for r in found for c in CLASHES)


def test_null_ids_are_not_held_out(spark, labels):
    docs = spark.createDataFrame([(None, "a"), (1, "b")], "doc_id long, text string")
    rows = quality.quality_scores(docs, labels).collect()
    assert all(isinstance(r.held_out, bool) and r.predicted in (0, 1) for r in rows) and len(rows) == 2


def test_shared_folder_is_asked_for(spark, monkeypatch):
    from swathframe.llm import common

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(type("S", (), {"sparkContext": Context}))


def test_spread_join(spark):
    """A key of many rows, null keys and unknown keys: as a left join."""
    left = spark.createDataFrame([(1 if i % 3 else (i if i % 2 else None), i) for i in range(300)], "k long, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 200)], "k long, name string")
    from swathframe.llm.common import spread_join

    order = lambda df: sorted((str(r.k), r.v, str(r.name)) for r in df.select("k", "v", "name").collect())
    for share in (2, 1000):
        assert order(spread_join(left, right, "k", share)) == order(left.join(right, "k", "left"))
    assert spread_join(left.limit(0), right, "k").count() == 0


def test_quality_without_labels(odd, labels):
    assert {r.score for r in quality.quality_scores(odd, labels.filter("false")).collect()} == {quality.FLAT}


def test_pieces(odd, none, odd_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = packing.packed(odd, TOKENIZER, window=256).collect()
    assert packing.packed(none, TOKENIZER).count() == 0
    want = sorted(str((r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in odd_rows)
    by_row, by_sequence = {}, {}
    for r in rows:
        by_row.setdefault(r.row_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    texts = {str((i, ids)): (i, ids) for i, ids in ((r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in odd_rows)}
    found = []
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r.start)
        at = 0
        for r in pieces:
            assert r.start == at
            at += r.length
        match = next(k for k, (i, ids) in texts.items() if i == pieces[0].doc_id and len(ids) == at == pieces[0].doc_tokens and all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in pieces))
        found.append(match)
    assert sorted(found) == want
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist() and sum(r.length for r in pieces) <= 256


def test_near_copies_share_a_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_CHARS", 20_000)
    r = np.random.default_rng(4)
    words = ["".join(map(chr, r.integers(97, 123, 5))) for _ in range(3000)]
    texts = [" ".join(words[i] for i in r.integers(0, 3000, 80)) for _ in range(300)]
    docs = spark.createDataFrame([(i, texts[i % 300] + (" tail" if i >= 300 else "")) for i in range(600)], "doc_id long, text string").repartition(5, "doc_id")
    rows = packing.packed(docs, TOKENIZER, window=256).collect()
    shard = {x.doc_id: x.sequence_id >> 32 for x in rows}
    assert len(shard) == 600 and len(set(shard.values())) > 10
    assert sum(shard[i] == shard[i + 300] for i in range(300)) > 180  # dealt at random: a tenth or less


# ---- mixing ----


def test_rates_meet_targets(spark):
    r = np.random.default_rng(1)
    p = r.dirichlet([0.3, 0.3, 0.3], 400)
    rows = [(i, i, int(r.integers(1, 900)), *map(float, p[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "row long, doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    tokens = np.array([x[2] for x in rows])
    own = tokens @ p
    targets = own.sum() * np.array([0.6, 0.3, 0.1])
    from swathframe.llm.common import Scratch

    got = {x.row: x.rate for x in mixing.rates(df, targets, Scratch(spark, "t")).collect()}
    w = np.array([got[i] for i in range(400)])
    assert (w >= 0).all() and np.abs((w * tokens) @ p - targets).sum() <= 1e-3 * targets.sum()
    # the same descent in numpy
    v, g = np.ones(400), (p * tokens[:, None]).T @ p
    for _ in range(mixing.STEPS):
        d = (v * tokens) @ p - targets
        if np.abs(d).sum() <= mixing.ENOUGH * targets.sum():
            break
        down = g @ d
        v = np.maximum(0, v - (d @ down) / (down @ down) * (p @ d))
    assert w == pytest.approx(v, rel=1e-6, abs=1e-9)
    # a target that needs projection: rates stay nonnegative
    far = mixing.rates(df, own.sum() * np.array([3.0, 0.0, 0.0]), Scratch(spark, "t")).collect()
    assert min(x.rate for x in far) == 0.0


@pytest.mark.parametrize("shares, floor", [((0.7, 0.2, 0.09, 0.01), 0.0), ((0.9, 0.09, 0.009, 0.001), 0.0), ((0.7, 0.2, 0.09, 0.01), 1.0)])
def test_each_small_domain_meets_its_target(spark, shares, floor):
    from swathframe.llm.common import Scratch

    kind = np.repeat(range(4), np.round(np.array(shares) * 2000).astype(int))
    p = np.where(np.arange(4) == kind[:, None], 0.97, 0.01)
    df = spark.createDataFrame([(i, i, 100, *map(float, x)) for i, x in enumerate(p)], "row long, doc_id long, n_tokens long, p0 double, p1 double, p2 double, p3 double")
    own = 100 * p.sum(0)
    share = (own / own.sum()) ** 0.7
    share /= share.sum()
    targets = share * (own.sum() if floor < 1 else max(own / share))
    w = np.array([x.rate for x in mixing.rates(df, targets, Scratch(spark, "t"), floor).orderBy("row").collect()])
    assert w.min() >= floor and (100 * w) @ p == pytest.approx(targets, rel=0.011)


def test_posteriors_and_totals(spark):
    rows = [(i, " ".join(f"{'ab'[i % 2]}{(i * 7 + j) % 11}" for j in range(20 + i))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "AB"[i % 2]) for i in range(40)], "doc_id long, domain string")
    out = {r.doc_id: r for r in mixing.mixing_rates(docs, labels, weights={"A": 0.8, "B": 0.2}).collect()}
    assert all(out[i].domain == "AB"[i % 2] and out[i].n_tokens == 20 + i for i in range(60))
    total = {k: sum(r.rate * r.n_tokens * r.posterior[k] for r in out.values()) for k in "AB"}
    assert total["A"] / sum(total.values()) == pytest.approx(0.8, abs=0.01)


# ---- search ----


def brute_top(rows, k, every, scale=64):
    use = [(i, np.floor(scale * np.array(v, float)).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    use = [(i, [int(x) for x in v]) for i, v in use]
    out = []
    for i, q in use:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in use if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("big", [1.0, 1e4, 1e7])
def test_top_k(spark, monkeypatch, big):
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "SHARD_ROWS", 7)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    r = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in r.choice([-1, 0, 0.5, 0.3], 6) * big]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (None, [1.0] * 6), (203, []), (204, [1.0, 1.0]), (205, [float("inf")] * 6), (20, [1.0] * 6), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, v string")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, k=5, every=10).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 5, 10)


def test_top_k_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(20, [1.0])], schema)).count() == 0
    assert [(r.query_id, r.vec_id) for r in topk.top_k(spark.createDataFrame([(20, [1.0]), (3, [1.0])], schema)).collect()] == [(20, 3)]


# ---- archives ----


def test_round_trip(spark):
    same = "payload " * 40
    rows = [(5, "http://a.example/x?y=1#z", same), (3, "http://b.example", same), (9, None, same), (4, "odd url\r\nX: y", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (3, "http://b.example", same), (None, "u", same)]
    rows += [(10, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n" * 9), (11, "u", "é日🎉\x00" * 50), (12, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, row int, digest string")
    got = sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in warc.round_trip(pages).collect())
    want, first = [], False
    for i, _, h in rows:
        data = (h or "").encode()
        again = h == same and (i != 3 or first)
        first = first or i == 3
        want.append(str((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None)))
    assert got == sorted(want)
    assert warc.round_trip(pages.filter("false")).count() == 0


def test_nested_captures_and_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/p", "<p>one</p>" * 20), (2, "http://a.example/q", "<p>one</p>" * 20)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w"), payload=True)
    assert sorted(r.record_type for r in records.collect() if r.record_type != "warcinfo") == ["metadata", "metadata", "request", "request", "response", "revisit"]
    assert bytes(records.filter("record_type = 'response'").first().payload) == b"<p>one</p>" * 20
    found = {r.metadata.page_id: r for r in warc.captures(records).collect()}
    assert found[1].original is None and found[2].original.page_id == 1
    assert found[2].request.target_uri == found[2].response.target_uri == "http://a.example/q"


def test_bad_archive():
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 50\r\n\r\nshort"
    for data in (b"not an archive", record, gzip.compress(record), gzip.compress(b"x" * 9000)[:-12], b"WARC/1.1\r\nno end"):
        with pytest.raises(ValueError):
            list(warc.parsed(data))


def test_members_and_long_headers():
    """A gzip member each record, padding between members, one member of all, plain files; a header of 100 KiB before a payload."""
    head = b"HTTP/1.1 200 OK\r\nX-Long: " + b"y" * 102_400 + b"\r\nContent-Length: 160\r\n\r\n"
    blocks = [head + b"p" * 160, b"no header", b"", b"\r\n\r\n" + bytes(3_000_000), b"a\r\n\r\nWARC/1.1"]
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(b), b) for i, b in enumerate(blocks)]
    whole = b"".join(records)
    for data in (b"".join(gzip.compress(r) for r in records), b"\0\0".join(gzip.compress(r) for r in records) + b"\0", gzip.compress(whole), whole):
        assert [b for _, b in warc.parsed(data)] == blocks
    rows = [warc._row(f, b) for f, b in warc.parsed(whole)]
    assert (rows[0][6], rows[0][8], rows[0][9]) == (160, 160, hashlib.sha256(b"p" * 160).hexdigest())
    assert [r[8] for r in rows] == [160, 9, 0, 3_000_000, 8]
    batches = list(warc._parse(iter([pa.record_batch({"content": [whole]})]), True))
    assert sum(b.num_rows for b in batches) == 5


def test_files_are_bounded_and_records_are_members(spark, tmp_path, monkeypatch):
    pages = [[f"WARC/1.1\r\nContent-Length: 1000\r\n\r\n{np.random.default_rng(i).bytes(500).hex()}"] * 3 for i in range(40)]
    monkeypatch.setattr(warc, "FILE_BYTES", 10_000)
    files = [b.column("value")[0].as_py() for b in warc._files(iter([pa.record_batch({"records": pages})]))]
    assert len(files) > 5 and all(len(f) < 13_000 for f in files)
    kinds = [[f.get("warc-type") for f, _ in warc.parsed(data)] for data in files]
    assert all(k[0] == "warcinfo" and set(k[1:]) == {None} for k in kinds) and sum(len(k) - 1 for k in kinds) == 120
    d = zlib.decompressobj(31)
    assert d.decompress(files[0]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and d.unused_data[:2] == b"\x1f\x8b"


def test_one_payload_of_many_pages(spark):
    """Ten thousand equal payloads: one response. No task of the join gets all of them."""
    same = spark.range(10_000).selectExpr("id as page_id", "concat('http://h.example/', id) as url", "if(id < 9000, repeat('same payload ', 20), concat('page ', id, repeat(' text', 30))) as html")
    rows = warc.round_trip(same.repartition(8)).collect()
    assert len(rows) == 10_000
    revisits = [r for r in rows if r.record_type == "revisit"]
    assert len(revisits) == 8999 and {r.refers_to for r in revisits} == {0} and {r.payload_bytes for r in revisits} == {260}
    assert all(r.refers_to is None for r in rows if r.record_type == "response")


# ---- queries ----


def test_names():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and set(queries.oracle_sql()) <= set(names)


def test_bounds_of_places():
    """Bounds part equal keys by row."""
    key, row = np.array([1, 1, 1, 1, 1, 1, 5, 9]), np.arange(8)
    bounds = packing._bounds(pa.table({"key": key[::-1], "row_id": row[::-1]}), 4)
    part = packing._part(bounds, key, row)
    assert part.tolist() == sorted(part.tolist()) and np.bincount(part).max() <= 3 and part.max() == 3
    assert packing._part(packing._bounds(pa.table({"key": key[:0], "row_id": row[:0]}), 1), key, row).tolist() == [0] * 8
