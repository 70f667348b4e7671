"""Token ids of whole texts; each word of a block of texts is looked up once.

The tokenizer never joins text across ASCII white space, so the ids of a text are those of its chunks in
order. Arrow splits the texts and numbers their distinct chunks. A chunk of Latin letters with ASCII marks
behind them falls into two pieces in every context: none of these letters decomposes or composes with a mark
in normalisation, and the tokenizer parts letters from marks. So the letters are looked up in lower case by
the model itself. Every other chunk (digits, apostrophes, other scripts, combining marks) goes through the
whole tokenizer as it stands. A tokenizer of another make gets whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker's cache of words begins anew with the present block's beyond this many.
CACHE_WORDS = 200_000
#: Bytes of a block of texts whose chunks are looked up together.
BLOCK_BYTES = 4 << 20
#: The parts of the tokenizer that the lookup of words relies on.
_PARTS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
#: Letters that normalisation leaves alone, and the ASCII marks but the apostrophe, which may begin a contraction.
_WORD = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
_loaded: dict[str, ChunkEncoder] = {}


def _kinds(part: dict | None, inner: str) -> list[str]:
    return [p["type"] for p in (part or {}).get(inner, [])]


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        made = json.loads(self.tokenizer.to_str())
        self.by_word = _kinds(made["normalizer"], "normalizers") + _kinds(made["pre_tokenizer"], "pretokenizers") == _PARTS
        letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if chr(c) != "÷"]
        #: the byte alphabet of the model for the lower-case letters
        self.alphabet = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters} if self.by_word else {}
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    @classmethod
    def load(cls, path: str) -> ChunkEncoder:
        """The worker's own encoder: one for each path."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _packed(self, ids: list[list[int]]) -> pa.Array:
        """Lists of ids as one array of bytes."""
        offsets = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        data = np.fromiter(chain.from_iterable(ids), self.dtype, int(offsets[-1]))
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets * self.dtype.itemsize), pa.py_buffer(data)])

    def _whole(self, chunks: list[str]) -> pa.Array:
        return self._packed([e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])

    def _lookup(self, words: pa.Array) -> pa.Array:
        """The ids of distinct lower-case words."""
        place = pc.index_in(words, value_set=self.words)
        new = words.filter(place.is_null())
        alphabet, model = self.alphabet, self.tokenizer.model.tokenize
        texts = (w if w.isascii() else w.translate(alphabet) for w in new.to_pylist())
        known = pa.concat_arrays([self.ids, self._packed([[t.id for t in model(w)] if w else [] for w in texts])])
        index = place.to_numpy(zero_copy_only=False)
        if len(new):
            missing = np.isnan(index)
            index[missing] = len(self.words) + np.arange(len(new))
        ids = known.take(pa.array(index.astype(np.int64)))
        if len(known) > CACHE_WORDS:
            self.words, self.ids = words, ids
        else:
            self.words, self.ids = pa.concat_arrays([self.words, new]), known
        return ids

    def _chunks(self, chunks: pa.Array) -> pa.Array:
        """The ids of each distinct chunk, as bytes."""
        parts = pc.extract_regex(chunks, pattern=_WORD)
        word = pc.utf8_lower(pc.struct_field(parts, "word")).dictionary_encode()
        tail = pc.struct_field(parts, "tail").dictionary_encode()
        ids = [self._lookup(word.dictionary).take(word.indices), self._whole(tail.dictionary.to_pylist()).take(tail.indices)]
        odd = parts.is_null()
        both = pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.large_binary()))
        return pc.replace_with_mask(both, odd, self._whole(chunks.filter(odd).to_pylist()))

    def _block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if not self.by_word:
            yield from (np.frombuffer(x.as_buffer(), self.dtype) for x in self._whole(texts.to_pylist()))
            return
        chunks = pc.ascii_split_whitespace(texts)
        found = chunks.flatten().dictionary_encode()
        ids = self._chunks(found.dictionary).take(found.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1]
        lists = chunks.offsets.to_numpy()
        ends = ends[lists - lists[0]] // self.dtype.itemsize
        every = np.frombuffer(data, self.dtype) if data is not None else np.zeros(0, self.dtype)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield every[a:b]

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, without special tokens; null has none."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(texts):
            before = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + BLOCK_BYTES, "right")))
            yield from self._block(pc.fill_null(texts.slice(at, to - at).cast(pa.large_string()), ""))
            at = to

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all(pa.array([text], pa.string())))
