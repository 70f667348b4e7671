"""The operators' queries over whole tables: with DuckDB where they have SQL, else with brute force."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import oracle  # noqa: E402
from conftest import DATA  # noqa: E402

from chatspark.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, DATA), oracle.connect(DATA), ORACLE_SQL[name]) is None


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def test_suffix_dedup(spark):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted(tuple(r[c] for c in columns) for r in QUERIES["op7_suffix_array_dedup"](spark, DATA).collect())
    assert got == brute.repeated_bytes(documents(spark))


def test_records_and_packing(spark):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path()).encode
    ids = {d: encode(t or "", add_special_tokens=False).ids for d, t in documents(spark)}
    at, want = 0, []
    for d in sorted(ids):
        want.append((d, at, len(ids[d]) + 1, brute.crc(ids[d] + [2])))
        at += len(ids[d]) + 1
    out = QUERIES["op10_binary_output"](spark, DATA)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out.collect()) == want
    sequences = {}
    for r in QUERIES["op1_packing"](spark, DATA).collect():
        whole = ids[r.doc_id] + [1]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == brute.crc(whole[r.start : r.start + r.length])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    ends = [max(a + n for a, n in s) for s in sequences.values()]
    assert sum(ends) == sum(len(x) + 1 for x in ids.values()) and all(n == 2048 or n & (n - 1) == 0 for n in ends)
