"""The pipeline against brute force: which documents are kept, and their tokens in the pieces."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from conftest import DATA  # noqa: E402

import corpus_pipeline  # noqa: E402
from chatspark.llm.queries import tokenizer_path  # noqa: E402


def test_pipeline(spark):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path()).encode
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    unique = {d for d, _, _, kept, _ in brute.exact(docs) if kept}  # every document is in one of the languages
    docs = [x for x in docs if x[0] in unique]
    near = {d for d, _, c in brute.jaccard(docs, 5, 80) if d == c}
    docs = [x for x in docs if x[0] in near]
    clean = {r[0] for r in brute.contamination(docs, items) if not r[5]}
    texts = {d: t for d, t in docs if d in clean}
    pieces = {}
    for r in corpus_pipeline.run(spark, DATA).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for d, t in texts.items():
        ids, at = encode(t, add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == brute.crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
