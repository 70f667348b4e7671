"""Alignment of two tokenizers over the same bytes, in Arrow.

Both tokenizers part a text wherever a character that isn't white space is followed by a space, and never join across. So a
text falls into units, mostly words, and each different unit of a block is tokenised once. The units' token lists are
flattened, their bytes summed within each unit, and an Acero hash join on the place where a token ends finds the tokens that end
together; Table.group_by counts the linked id pairs of each text, and Spark merges these counts over the corpus.

A: byte-level BPE of a space and the text. B: SentencePiece, which puts the space itself. Texts that are null or empty, or
that either tokenizer doesn't give back byte for byte, have no tokens. Rows keep their doc_id, null or repeated; an empty
table gives no rows; other columns are ignored. Long texts go through in parts of PART_CHARS.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatspark.llm.stage import written

#: Bytes of texts that are aligned together, and characters of a part of a longer text.
BLOCK_BYTES = 2 << 20
PART_CHARS = 1 << 20
#: A worker's cache of units begins anew with the present block's beyond this many.
CACHE_UNITS = 150_000
#: Id pairs up to this many are broadcast (16 bytes each); more are joined by shuffle.
MAX_BROADCAST_PAIRS = 1_000_000
#: White space of any definition, and SentencePiece's sign for a space: no unit ends behind one.
_WHITE = r"\s\x0B\x1C-\x1F" + "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581"
_ODD = rf"(^|[{_WHITE}]) | $"
_CUT = re.compile(rf"(?<=[^{_WHITE}])(?= )")
_SCHEMA = "doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, pairs array<struct<a: int, b: int, m: long>>"
_loaded: dict[tuple[str, str], Aligner] = {}


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def units_of(text: str) -> list[str]:
    """The units of any text, each without the space before it."""
    cut = _CUT.split(text)
    if len(cut) > 1 and cut[-1] == " ":
        cut[-2:] = [cut[-2] + " "]
    return [cut[0], *(u[1:] for u in cut[1:])]


def parts_of(text: str) -> Iterator[str]:
    """A long text in parts that begin where units do; each but the first without its space."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = next((m.start() for m in _CUT.finditer(text, at + PART_CHARS)), None)
        if cut is None or cut + 1 >= len(text):
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _joined(strings: pa.Array, offsets: np.ndarray, between: str) -> pa.Array:
    """The strings of each list as one."""
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, strings), pa.scalar(between, pa.large_string()))


class Tokens:
    """One tokenizer's ids of units, and the bytes of its entries."""

    def __init__(self, entries: list[bytes], encode):
        self.bytes = pa.array(entries, pa.large_binary())
        self.sizes = pc.binary_length(self.bytes).to_numpy()
        self.names = pa.array([str(i) for i in range(len(entries))], pa.large_string())
        self.encode = encode

    def lists(self, units: list[str]) -> pa.LargeListArray:
        ids = self.encode(units)
        offsets = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        return pa.LargeListArray.from_arrays(offsets, np.fromiter(chain.from_iterable(ids), np.int64, int(offsets[-1])))

    def ends(self, lists: pa.LargeListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, bytes from its begin to the token's end, bytes of each unit): sums segmented by unit."""
        parent = pc.list_parent_indices(lists).to_numpy()
        total = np.concatenate([[0], pc.cumulative_sum(pa.array(self.sizes[lists.flatten().to_numpy()])).to_numpy()])
        base = total[lists.offsets.to_numpy()]
        return parent, total[1:] - base[parent], base[1:] - base[:-1]

    def same(self, lists: pa.LargeListArray, sizes: np.ndarray, want: bytes, starts: np.ndarray) -> np.ndarray:
        """Whether each unit's tokens have its bytes."""
        taken = self.bytes.take(lists.flatten())
        joined = bytes(taken.buffers()[2] or b"") if len(taken) else b""
        if joined == want and np.array_equal(sizes, np.diff(starts)):
            return np.ones(len(sizes), bool)
        at = np.concatenate([[0], np.cumsum(sizes)])
        return np.array([joined[a:b] == want[c:d] for a, b, c, d in zip(at[:-1], at[1:], starts[:-1], starts[1:])], bool)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(path_a)
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        own = {i: w for w, i in a.get_vocab().items()}
        special = set(a.get_added_tokens_decoder())
        entries = [own.get(i, "").encode() if i in special else bytes(alphabet[c] for c in own.get(i, "")) for i in range(max(own) + 1)]
        pieces = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())]
        if any(re.search("[^▁]▁", b.id_to_piece(i)) for i in range(b.vocab_size())):
            raise ValueError("a piece joins text across a space")
        self.a = Tokens(entries, lambda units: [e.ids for e in a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)])
        self.b = Tokens(pieces, lambda units: b.encode(units, num_threads=1))
        self.units, self.known = pa.array([], pa.large_string()), None

    @classmethod
    def load(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in _loaded:
            _loaded[path_a, path_b] = cls(path_a, path_b)
        return _loaded[path_a, path_b]

    def align(self, units: list[str]) -> pa.Table:
        """Of each unit: valid, n_a, n_b, links (id pairs as a * ids of B + b) and groups (text)."""
        data = [b" " + u.encode() for u in units]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)])
        want = b"".join(data)
        lists = [t.lists(units) for t in (self.a, self.b)]
        (parent_a, end_a, size_a), (parent_b, end_b, size_b) = (t.ends(x) for t, x in zip((self.a, self.b), lists))
        valid = self.a.same(lists[0], size_a, want, starts) & self.b.same(lists[1], size_b, want, starts)
        ids, keys, keep = [x.flatten().to_numpy() for x in lists], [], []
        for parent, end in ((parent_a, end_a), (parent_b, end_b)):
            keep.append(valid[parent])
            keys.append(starts[parent][keep[-1]] + end[keep[-1]])
        ids = [x[k] for x, k in zip(ids, keep)]
        sides = [pa.table({"end": k, f"id_{n}": i, f"at_{n}": np.arange(len(i))}) for n, k, i in zip("ab", keys, ids)]
        links = sides[0].join(sides[1], keys="end", join_type="inner", use_threads=False).sort_by("end")
        at_a, at_b, end = (links[c].to_numpy() for c in ("at_a", "at_b", "end"))
        groups = [_joined(t.names.take(pa.array(i)), np.concatenate([[0], at + 1]), ",") for at, t, i in zip((at_a, at_b), (self.a, self.b), ids)]
        bounds = np.searchsorted(end, starts, "right")
        code = links["id_a"].to_numpy() * len(self.b.sizes) + links["id_b"].to_numpy()
        text = _joined(pc.binary_join_element_wise(*groups, pa.scalar("|", pa.large_string())), bounds, ";")
        counts = [np.where(valid, pc.list_value_length(x).to_numpy(), 0) for x in lists]
        return pa.table({"valid": valid, "n_a": counts[0], "n_b": counts[1], "links": pa.LargeListArray.from_arrays(bounds, code), "groups": text})

    def lookup(self, units: pa.Array) -> tuple[np.ndarray, pa.Table]:
        """(row of each unit, table) of different units."""
        place = pc.index_in(units, value_set=self.units)
        new = units.filter(place.is_null())
        index = place.to_numpy(zero_copy_only=False).astype(np.float64)
        if len(new):
            index[np.isnan(index)] = len(self.units) + np.arange(len(new))
            found = self.align(new.to_pylist())
            known = found if self.known is None else pa.concat_tables([self.known, found]).combine_chunks()
        else:
            known = self.known
        index = index.astype(np.int64)
        if len(self.units) + len(new) > CACHE_UNITS:
            self.units, self.known = units, known.take(pa.array(index)).combine_chunks()
        elif len(new):
            self.units, self.known = pa.concat_arrays([self.units, new]), known
        return index, known

    def texts(self, units: pa.LargeListArray) -> tuple[pa.Table, pa.Table]:
        """(valid, n_a, n_b, n_links, groups) of each text given by its units, and (text, code, m): its linked id pairs with their counts."""
        found = units.flatten().dictionary_encode()
        index, known = self.lookup(found.dictionary)
        offsets = units.offsets.to_numpy() - units.offsets[0].as_py()
        place = index[found.indices.to_numpy()]
        taken = pa.array(place)
        column = {c: known[c].combine_chunks() for c in known.column_names}
        summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[place])])[offsets])
        links = column["links"].take(taken)
        per = pc.list_value_length(column["links"]).to_numpy()
        text = np.repeat(np.arange(len(units)), np.diff(offsets))
        valid = summed(column["valid"].to_numpy(zero_copy_only=False).astype(np.int64)) == np.diff(offsets)
        pairs = pa.table({"text": text[pc.list_parent_indices(links).to_numpy()], "code": links.flatten()}).group_by(["text", "code"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["text", "code", "m"])
        joined = _joined(column["groups"].take(taken), offsets, ";")
        return pa.table({"valid": valid, "n_a": summed(column["n_a"].to_numpy()), "n_b": summed(column["n_b"].to_numpy()), "n_links": summed(per), "groups": joined}), pairs


def _runs(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, parts) of about BLOCK_BYTES, in order; null and empty texts are left out."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for part in parts_of(text) if text else ():
            if size and size + len(part) > BLOCK_BYTES:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(part)
            size += len(part)
    if rows:
        yield rows, parts


def _aligned(path_a: str, path_b: str):
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("m", pa.int64())]))

    def pieces(aligner: Aligner, rows: np.ndarray, parts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table, pa.Table]]:
        """Texts whose spaces all part units are split by Arrow, the others by units_of."""
        odd = pc.match_substring_regex(parts, _ODD).to_numpy(zero_copy_only=False)
        for places, split in ((np.nonzero(~odd)[0], lambda x: pc.split_pattern(x, " ")), (np.nonzero(odd)[0], lambda x: pa.array(map(units_of, x.to_pylist()), pa.list_(pa.large_string())))):
            if len(places):
                yield (places, rows[places], *aligner.texts(split(parts.take(pa.array(places))).cast(pa.large_list(pa.large_string()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.load(path_a, path_b)
        ids_b = len(aligner.b.sizes)
        for batch in batches:
            n = batch.num_rows
            sums, valid, hashes, counted = np.zeros((3, n), np.int64), np.ones(n, bool), [None] * n, []
            for at, parts in _runs(batch["text"].to_pylist()):
                groups: dict[int, tuple[int, str]] = {}
                for places, rows, facts, pairs in pieces(aligner, np.array(at), pa.array(parts, pa.large_string())):
                    np.logical_and.at(valid, rows, facts["valid"].to_numpy())
                    for i, name in enumerate(("n_a", "n_b", "n_links")):
                        np.add.at(sums[i], rows, facts[name].to_numpy())
                    groups.update(zip(places.tolist(), zip(rows.tolist(), facts["groups"].to_pylist())))
                    counted.append(pairs.set_column(0, "text", pa.array(rows[pairs["text"].to_numpy()])))
                for place in sorted(groups):
                    row, text = groups[place]
                    if hashes[row] is None:
                        hashes[row] = hashlib.sha256(text.encode())
                    else:
                        hashes[row].update(b";" + text.encode())
            for row in np.nonzero(~valid)[0]:
                hashes[row] = None
            sums[:, ~valid] = 0
            offsets, lists = np.zeros(n + 1, np.int32), [pa.array([], t.type) for t in kind.value_type]
            if counted:
                pairs = pa.concat_tables(counted)
                pairs = pairs.filter(pa.array(valid[pairs["text"].to_numpy()])).sort_by("text")
                code = pairs["code"].to_numpy()
                offsets[1:] = np.cumsum(np.bincount(pairs["text"].to_numpy(), minlength=n))
                lists = [pa.array(x, t.type) for x, t in zip((code // ids_b, code % ids_b, pairs["m"].to_numpy()), kind.value_type)]
            digests = ["" if h is None else h.hexdigest() for h in hashes]
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(lists, fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, sums), pa.array(digests, pa.string()), listed], names=["doc_id", "n_a", "n_b", "n_links", "groups_sha256", "pairs"])

    return run


def aligned_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_links, groups_sha256, pairs) of each row; pairs (a, b, m) are its linked ids with counts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_aligned(path_a, path_b), _SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n): the links of each id pair over the corpus."""
    return aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("m").alias("n"))


def cross_tokenizer_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    rows = written(aligned_pairs(docs, path_a, path_b).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(rows), "pairs")
    facts = counts.join(counts.groupBy("b").agg(F.max("n").alias("_top")), "b").select("a", "b", "n", (F.col("n") == F.col("_top")).alias("_best"))
    if counts.count() <= MAX_BROADCAST_PAIRS:
        facts = F.broadcast(facts)
    linked = rows.select("_row", F.inline("pairs")).join(facts, ["a", "b"])
    scored = linked.groupBy("_row").agg(F.sum(F.when(F.col("_best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    out = rows.drop("pairs").join(scored, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
