"""Alignment of two tokenizers against a loop over whole texts."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest import DATA  # noqa: E402

from chatspark.llm import alignment  # noqa: E402
from chatspark.llm.queries import QUERIES, tokenizer_path  # noqa: E402

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PATHS = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def tokenised(text, a, b):
    """Ids and ends of both tokenizers over the whole text; None if the bytes differ."""
    alphabet = alignment.byte_alphabet()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    want = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == want == b"".join(bytes_b) else None


def ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def expected(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    found, counts = [], Counter()
    for _, text in rows:
        made = tokenised(text, a, b) if text else None
        if made is None:
            found.append(None)
            continue
        ids_a, bytes_a, ids_b, bytes_b = made
        end_a, end_b = ends(bytes_a), ends(bytes_b)
        links = []
        place = {e: i for i, e in enumerate(end_b)}
        groups, from_a, from_b = [], 0, 0
        for i, e in enumerate(end_a):
            if e in place:
                links.append((ids_a[i], ids_b[place[e]]))
                groups.append(",".join(map(str, ids_a[from_a : i + 1])) + "|" + ",".join(map(str, ids_b[from_b : place[e] + 1])))
                from_a, from_b = i + 1, place[e] + 1
        counts.update(links)
        found.append((len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for (doc, _), f in zip(rows, found):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, sha = f
            out.append((doc, n_a, n_b, len(links), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=str)


def texts():
    rng = random.Random(4)
    odd = [None, "", " ", "  ", "a", " a", "a ", "a  ", "  a  b ", "a\n b", "a \n b\t", "é  x", "x▁ y", "▁", "<|endoftext|> </s> <s> <0x41>", "it's  don't 'S", "日本語 テキスト", "a\x00b", "x　 y", "naïve — “q”", "\r\n \r\n", "🙂 🙂🙂", "﻿x", "é ﬁ"]
    words = ["the", "of", "token", "Straße", "1234", "(x)", "it's", "foo\nbar", "", "", "\t", "ümlaut,", "x" * 40, "日本"]
    for _ in range(60):
        odd.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))))
    for _ in range(30):
        odd.append("".join(rng.choice("ab é\n\t ▁' 1,.") for _ in range(rng.randrange(1, 60))))
    odd += [" ".join(rng.choice(words[:8]) for _ in range(3000)), odd[-1], odd[-1]]
    return [(None if i == 30 else i % 100, t) for i, t in enumerate(odd)]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, n_a long, pairs string, _row long")


def test_brute_force(spark):
    rows = texts()
    out = got(alignment.cross_tokenizer_alignment(frame(spark, rows), *PATHS))
    assert out == expected(rows) and sum(r[1] == 0 for r in out) < len(out) / 3


def test_parts_and_shuffled_counts(spark, monkeypatch):
    """Texts in parts, a cache that overflows, and counts that are too many to broadcast."""
    monkeypatch.setattr(alignment, "PART_CHARS", 50)
    monkeypatch.setattr(alignment, "MAX_BROADCAST_PAIRS", 0)
    rows = texts()
    assert ["".join(alignment.units_of(t)).replace(" ", "") for _, t in rows if t] == [t.replace(" ", "") for _, t in rows if t]
    aligner = alignment.Aligner(*PATHS)
    monkeypatch.setattr(alignment, "CACHE_UNITS", 3)
    whole = {t: aligner.align([t])["groups"][0].as_py() for _, t in rows if t}
    for text, groups in whole.items():
        import pyarrow as pa

        parts = list(alignment.parts_of(text))
        facts, _ = aligner.texts(pa.array([alignment.units_of(p) for p in parts], pa.large_list(pa.large_string())))
        if all(facts["valid"].to_pylist()):
            assert ";".join(facts["groups"].to_pylist()) == groups, text
    assert got(alignment.cross_tokenizer_alignment(frame(spark, rows), *PATHS)) == expected(rows)


def test_empty(spark):
    assert got(alignment.cross_tokenizer_alignment(frame(spark, []), *PATHS)) == []


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert got(QUERIES["op11_cross_tokenizer_alignment"](spark, DATA)) == expected(docs)


@pytest.mark.parametrize("text", ["a  b", " lead", "trail ", "a\n b"])
def test_units(text):
    assert " ".join(alignment.units_of(text)) == text
