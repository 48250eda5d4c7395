"""The pipeline's stages on the smallest tables against plain versions of them."""

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from swathframe.llm import pii, quality
from swathframe.llm.queries import tokenizer_path

from .test_parity import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")


def test_stages(spark, tmp_path):
    docs, columns, seen = spark.read.parquet(f"{DATA}/documents.parquet"), None, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = columns or docs.columns
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs)
        assert i == 4 or docs.columns == columns
    raw = spark.read.parquet(f"{DATA}/documents.parquet")
    good, single, clean, mixed, pieces = ([tuple(r) for r in d.collect()] for d in seen)

    # quality: the same model, scored here
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.train(raw, labels.selectExpr("doc_id", "quality as label").filter(~quality.held_out()))
    rows = [tuple(r) for r in raw.collect()]
    keep = quality.score_texts(pa.array([r[1] for r in rows]), model) >= 0.3
    assert sorted(good) == sorted(r for r, k in zip(rows, keep) if k)
    wrong = {r.doc_id: r.quality for r in labels.collect()}
    right = [bool(wrong[r[0]]) == bool(k) for r, k in zip(rows, keep) if r[0] in wrong]
    assert sum(right) >= 0.95 * len(right)

    # one document of each component
    first = {i for i, (_, c) in brute([(r[0], r[1]) for r in good]).items() if i == c}
    assert sorted(single) == sorted(r for r in good if r[0] in first)

    # personal data
    spans = pii.find_spans(pa.array([r[1] for r in single]), pii.fitted())
    want = [(r[0], pii.redact(r[1], s), r[2], r[3]) for r, (_, s) in zip(single, spans)]
    assert sorted(r[:4] for r in clean) == sorted(want) and all(r[4] == len(r[1]) for r in clean)

    # mixture: every document, small domains more often
    count = Counter(r[0] for r in mixed)
    assert set(count) == {r[0] for r in clean} and set(mixed) == set(clean)
    tokens = lambda rows, lang: sum(len(r[1].split()) for r in rows if r[2] == lang) / sum(len(r[1].split()) for r in rows)
    assert tokens(mixed, "en") < tokens(clean, "en")

    # packing: every id of every row once
    from tokenizers import Tokenizer

    t, names = Tokenizer.from_file(tokenizer_path()), seen[4].columns
    by = {}
    for p in pieces:
        p = dict(zip(names, p))
        by.setdefault((p["doc_id"], p["row_id"]), []).append(p)
    assert Counter(i for i, _ in by) == count
    ids = {r[0]: [*t.encode(r[1], add_special_tokens=False).ids, 2] for r in mixed}
    for (doc, _), parts in by.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(ids[doc][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[doc])


def test_run_is_the_stages(spark):
    names = corpus_pipeline.run(spark, DATA).columns
    assert names[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
