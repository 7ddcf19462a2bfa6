"""The pipeline against its stages by brute force on the smallest table."""

import re
import zlib

import numpy as np

import corpus_pipeline
from test_operators import jaccard_brute
from tidemark.llm import langid, pii, tokens


def test_pipeline(spark, small):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    net, kept = langid.train(spark.read.parquet(f"{small}/documents.parquet")), {}
    for i, t in docs.items():
        if t and re.search(r"[^\W\d_]", t) and net.positions(np.frombuffer(t.encode(), np.uint8)[None])[:, 0].mean(0).max() >= 0.5:
            kept[i] = t
    root = jaccard_brute(list(kept.items()), 5, 80, 100)
    kept = {i: t for i, t in kept.items() if root[i][1] == i}
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(f" {x} " in f" {words(t)} " for x in items)}
    finder, library, want = pii.Finder(), Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json")), {}
    for i, t in kept.items():
        ids = np.array([*library.encode(pii.masked(t, finder.spans(t)), add_special_tokens=False).ids, 0], "<u4")
        want[i] = (len(ids), zlib.crc32(ids[: len(ids) % 2048 or min(2048, len(ids))].tobytes()))
    got = {}
    for r in corpus_pipeline.run(spark, small).collect():
        n, crc = got.get(r.doc_id, (0, None))
        got[r.doc_id] = (n + r.length, r.ids_crc32 if r.piece == 0 else crc)
    assert got == want
