"""The pipeline's rows against a brute-force version of its stages."""

from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import language_id, mixing, packing, tokenize
from tests.llm.test_operators import (SF, needs_data, needs_vocabulary,
                                      shingle_sets, smallest)


@needs_data
@needs_vocabulary
def test_pipeline_against_brute_force(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # language ID is trained: its own decisions are checked on held-out rows
    model = language_id.fit(docs.where(~language_id.held_out(
        F.col("doc_id"))))
    known = {r.doc_id: r.text for r in language_id.identify(docs, model)
             .where("not ambiguous").collect()}
    last = {}
    for key in sorted(known):
        last[known[key] or ""] = key
    texts = {key: known[key] for key in last.values()}
    sets = shingle_sets(texts)
    links = [(a, b) for a, b in combinations(sorted(texts), 2)
             if min(len(sets[a]), len(sets[b])) * 100
             >= 80 * max(len(sets[a]), len(sets[b])) > 0
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = smallest(texts, links)
    kept = [key for key in texts if component[key] == key]
    mixed = Counter(r.doc_id for r in mixing.mix(docs.where(
        F.col("doc_id").isin(kept))).select("doc_id").collect())
    assert set(mixed) == set(kept)
    encode = tokenize.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for key, times in mixed.items():
        ids = [*encode(texts[key] or ""), packing.END_ID]
        for piece, (start, n) in enumerate(packing.cut_pieces(
                ids, packing.CAPACITY)):
            want[key, piece, start, n] += times

    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length)
                   for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert (sum(n for *_, n in want.elements())
            > 0.9 * packing.CAPACITY * len(sequences))
