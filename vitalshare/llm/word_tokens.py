"""Token ids of whole texts, each distinct chunk of text tokenised once per worker while it is
remembered.

The tokenizer drops white space and splits at it, so the ids of a text are those of its
white-space chunks one after the other. Chunks are found, numbered and looked up with Arrow, and
only those a worker does not remember go to the tokenizers library. Upper-case ASCII letters are
lowered first and ASCII punctuation is parted from the plain letter or digit before it: the tokenizer
does both anyway, and fewer chunks differ. Texts that hold ``<|`` (special tokens) are left as
they are. Chunks of plain letters go to the library many to a text, as every word of it ends
with an id that only ends words.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vitalshare.llm.common import held, room, slices, spread

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

REMEMBERED = 200_000
#: Bytes of text encoded at once; what that takes in memory is some 20 times as much.
SLICE = 1 << 20
#: Words to a text and texts to a call of the library.
JOINED = 128
CALL = 160
#: Letters the tokenizer neither splits into others nor, before one of them or ASCII, composes.
LETTER = "a-zß-öø-ÿÀ-ÖØ-Þ"


class ChunkEncoder:
    """Encodes Arrow arrays of texts; remembers the ids of up to ``remembered`` chunks, in
    arrays without Python objects. Of more, the half used in most calls stays."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.remembered = remembered
        self.chunks = pa.array([], pa.string())
        self.ids = np.empty(0, np.uint32)
        self.lengths = self.calls = np.empty(0, np.int64)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text) by the library."""
        ids, lengths = [], []
        for at in range(0, len(texts), CALL):
            found = self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False)
            found = [x.ids for x in found]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
        if not ids:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate(ids), np.concatenate(lengths)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_library`` for chunks of plain letters."""
        cuts = np.append(np.arange(0, len(words), JOINED), len(words)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), " ")
        ids, _ = self._library(joined.to_pylist())
        lengths = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        # only with another vocabulary
        return (ids, lengths) if len(lengths) == len(words) else self._library(words.to_pylist())

    def _learn(self, chunks: pa.Array) -> np.ndarray:
        """Rows of the chunks, none of which is remembered."""
        plain = pc.match_substring_regex(chunks, f"^[{LETTER}]+$")
        words, others = chunks.filter(plain), chunks.filter(pc.invert(plain))
        word_ids, word_lengths = self._words(words)
        other_ids, other_lengths = self._library(others.to_pylist())
        rows = np.empty(len(chunks), np.int64)
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        rows[order] = len(self.chunks) + np.arange(len(chunks))
        self.chunks = pa.concat_arrays([self.chunks, words, others])
        self.ids = np.concatenate([self.ids, word_ids, other_ids])
        self.lengths = np.concatenate([self.lengths, word_lengths, other_lengths])
        self.calls = np.concatenate([self.calls, np.zeros(len(chunks), np.int64)])
        return rows

    def _forget(self) -> None:
        """Keeps the half used in most calls, and none of those used in one."""
        best = np.argsort(-self.calls, kind="stable")[: self.remembered // 2]
        best = np.sort(best[self.calls[best] > 1])
        starts = np.cumsum(self.lengths) - self.lengths
        self.ids = self.ids[spread(starts[best], self.lengths[best])]
        self.chunks, self.lengths = self.chunks.take(pa.array(best)), self.lengths[best]
        self.calls = self.calls[best] // 2

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); null is an empty text."""
        texts = pc.fill_null(texts, "")
        plain = pc.replace_substring_regex(
            pc.ascii_lower(texts), rf"([{LETTER}0-9])([!-/:-@\[-`{{-~])", r"\1 \2"
        )
        special = pc.match_substring(texts, "<|")
        if pc.any(special).as_py():
            plain = pc.if_else(special, texts, plain)
        lists = pc.ascii_split_whitespace(plain)
        offsets = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        chunks = coded.dictionary
        if len(self.chunks) > self.remembered:
            self._forget()
        found = pc.index_in(chunks, value_set=self.chunks)
        rows = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if found.null_count:
            rows[rows < 0] = self._learn(chunks.filter(found.is_null()))
        self.calls[rows] += 1
        rows = rows[coded.indices.to_numpy()]
        lengths = self.lengths[rows]
        starts = np.cumsum(self.lengths) - self.lengths
        ids = self.ids[spread(starts[rows], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[offsets[1:]] - ends[offsets[:-1]]


ENCODERS: dict[str, ChunkEncoder] = held()


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in ENCODERS:
        ENCODERS[path] = ChunkEncoder(path)
    return ENCODERS[path]


def encoded(batches, path: str, end_id: int):
    """For slices of Arrow batches of (doc_id, text): (doc ids, list of id arrays), each
    text's ids followed by ``end_id``."""
    for batch in batches:
        texts = batch.column(1)
        for start, stop in slices(texts, SLICE):
            ids, counts = encoder(path).encode(texts.slice(start, stop - start))
            ends = np.cumsum(counts + 1)
            whole = np.full(int(ends[-1]), end_id, np.uint32)
            whole[spread(ends - counts - 1, counts)] = ids
            yield batch.column(0).slice(start, stop - start), np.split(whole, ends[:-1])
