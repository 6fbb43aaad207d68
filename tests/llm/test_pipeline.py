"""run() of the pipeline against all its stages by brute force: what is kept, what is left of it, and how it is packed."""

from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_model_operators import brute_classes
from test_text_operators import WORD, checked_packing, kept_lines, words

from tidemark.llm import language_id
from tidemark.llm.common import bucket_of

SF = "/root/testdata/sf0.001"


def contaminated(text, windows):
    own, hit = words(text), set()
    for n in {len(w) for w in windows}:
        for k in range(len(own) - n + 1):
            if tuple(own[k : k + n]) in windows:
                hit |= set(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(own)


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    encoders = language_id.Encoders(language_id.dictionaries(docs.where(bucket_of(F.col("doc_id")) != 0)), 7, 512)
    kept = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if not encoders(r.text, 0.01)[2]}
    assert 0 < len(kept) <= docs.count()

    left = {doc: text for doc, text in kept_lines(list(kept.items()))}
    kept = {k: left[k] for k in kept if left[k] == kept[k] or left[k].strip()}

    groups = defaultdict(list)
    for doc, c in zip(kept, brute_classes(list(kept.values())), strict=True):
        groups[c].append(doc)
    kept = {min(own): kept[min(own)] for own in groups.values()}

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = words(r.text)
        windows |= {tuple(own[k : k + 13]) for k in range(max(1, len(own) - 12))} if own else set()
    kept = {k: t for k, t in kept.items() if not contaminated(t, windows)}

    wanted = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    found = corpus_pipeline.run(spark, SF).collect()
    bins = checked_packing(wanted, found, Tokenizer.from_file(WORD), 4096)
    assert len(bins) <= -(-sum(r.length for r in found) // 4096) * 1.15 + 2
