"""Byte-level BPE: propose, verify, repair.

Texts fall into pieces at white space (numbered by Arrow, each distinct piece handled once per
worker), pieces into words by the vocabulary's pattern. For the words of a batch

1. *speculate*: a greedy longest match over all of them at once proposes tokens,
2. *verify*: an encoding is right exactly if every two neighbouring tokens, merged as a text of
   their own, come out as these two tokens; all neighbours of the batch are looked up together
   in a table of pairs, and only pairs never met are worked out and added,
3. *repair*: words with a failing pair go through the merges one by one.

Decoding joins the tokens' bytes; bytes that are no UTF-8 become U+FFFD.

Defined results: null and empty texts have no ids and decode to the empty text; rows are kept
as they come, repeated ones too; an empty table gives no row; other columns are dropped. A
special token's string in a text is that token.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalshare.llm.common import room, slices, spread

# The split pattern of this vocabulary and Unicode's white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"

REMEMBERED = 450_000
LONG_WORD = 40
SLICE = 4 << 20


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary: printable bytes are themselves,
    the others the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {chr(b) if b in shown else chr(next(hidden)): b for b in range(256)}


class Codec:
    """One vocabulary. Inside, bytes are the characters 0 to 255 of a str."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = {ord(k): chr(v) for k, v in byte_alphabet().items()}
        plain = lambda token: token.translate(alphabet)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {plain(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.rank = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[plain(left), plain(right)] = i
        self.vocab = vocab
        self.machine = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.machine.add_word(token, i)
        self.machine.make_automaton()
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for token, i in vocab.items():
            self.token[i] = token.encode("latin-1")
        for token, i in self.special.items():
            self.token[i] = token.encode()
        self.token_length = np.fromiter(map(len, self.token), np.int64, size)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.text = [x.decode("latin-1") for x in self.token]
        self.words = regex.compile(PATTERN)
        inside = "".join(f"\\u{ord(c):04x}" for c in SPACES)
        self.pieces = regex.compile(rf" ?[^{inside}]+|[{inside}]+(?![^{inside}])|[{inside}]+")
        self.odd = f"(?:^|[{SPACES}]) | (?:[{SPACES}]|$)"
        if self.special:
            self.odd += "|" + "|".join(regex.escape(x, special_only=True) for x in self.special)
            self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.remembered = remembered
        self.pairs, self.good = np.empty(0, np.int64), np.empty(0, bool)
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {"": 0}  # by piece
        self.word: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.used, self.rows = 0, 1
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)

    def _store(self, found: list[np.ndarray]) -> int:
        """Keeps id arrays in rows of their own; the first row."""
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        first, self.rows = self.rows, self.rows + len(found)
        start, self.used = self.used, self.used + int(lengths.sum())
        self.ids = room(self.ids, self.used)
        self.starts, self.lengths = room(self.starts, self.rows), room(self.lengths, self.rows)
        if found:
            self.ids[start : self.used] = np.concatenate(found)
        self.lengths[first : self.rows] = lengths
        self.starts[first : self.rows] = start + np.cumsum(lengths) - lengths
        return first

    # exact merging

    def merge(self, word: str) -> list[int]:
        """Ids of one word by the merges alone."""
        if len(word) > LONG_WORD:
            return self._merge_long(word)
        parts, rank, none = list(word), self.rank.get, 1 << 30
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
        return [self.vocab[x] for x in parts]

    def _merge_long(self, word: str) -> list[int]:
        parts: list[str | None] = list(word)
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p[0], p[1]) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    pair = (parts[k], parts[after[k]])
                    if (r := rank.get(pair)) is not None:
                        heapq.heappush(heap, (r, k, *pair))
        return [self.vocab[x] for x in parts if x is not None]

    # speculate and verify

    def _fits(self, pairs: np.ndarray) -> np.ndarray:
        """For codes left << 20 | right: whether the two tokens may stand together."""
        unique, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.pairs, unique)
        at[at == len(self.pairs)] = 0
        new = unique[self.pairs[at] != unique] if len(self.pairs) else unique
        if len(new):
            text, mask = self.text, (1 << 20) - 1
            good = [self.merge(text[p >> 20] + text[p & mask]) == [p >> 20, p & mask] for p in new.tolist()]
            pairs_ = np.concatenate([self.pairs, new])
            order = np.argsort(pairs_, kind="stable")
            self.pairs, self.good = pairs_[order], np.concatenate([self.good, good])[order]
        return self.good[np.searchsorted(self.pairs, unique)][back]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words (already in the byte alphabet), all at once."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        found = list(chain.from_iterable(self.machine.iter_long("Ā".join(words))))
        ends, ids = np.array(found[::2], np.int64), np.array(found[1::2], np.int64)
        word = np.searchsorted(begins, ends, side="right") - 1
        covered = np.bincount(word, self.token_length[ids], len(words))
        wrong = covered != sizes
        inner = np.flatnonzero(word[1:] == word[:-1])
        if len(inner):
            fits = self._fits(ids[inner] << 20 | ids[inner + 1])
            wrong[word[inner[~fits]]] = True
        alone = np.flatnonzero(np.bincount(word, minlength=len(words)) == 1)
        first = np.searchsorted(word, np.arange(len(words) + 1))
        for w, i in zip(alone.tolist(), ids[first[alone]].tolist()):
            if not wrong[w] and not self._whole(i):
                wrong[w] = True
        out = np.split(ids, first[1:-1])
        for w in np.flatnonzero(wrong).tolist():
            out[w] = np.array(self.merge(words[w]), np.int64)
        return out

    def _whole(self, i: int) -> bool:
        """Whether a token's own text comes out as that token."""
        memo = self.__dict__.setdefault("_alone", {})
        if i not in memo:
            memo[i] = self.merge(self.text[i]) == [i]
        return memo[i]

    def _learn(self, pieces: list[str]) -> None:
        words = [self.words.findall(x) for x in pieces]
        known = self.word
        new = list(dict.fromkeys(w for w in chain.from_iterable(words) if w not in known))
        first = self._store(self.encode_words([w.encode().decode("latin-1") for w in new]))
        known.update(zip(new, range(first, first + len(new))))
        self.row.update((x, known[own[0]]) for x, own in zip(pieces, words) if len(own) == 1)
        many = [(x, own) for x, own in zip(pieces, words) if len(own) > 1]
        sizes = np.fromiter((len(own) for _, own in many), np.int64, len(many))
        rows = np.fromiter((known[w] for _, own in many for w in own), np.int64, int(sizes.sum()))
        lengths = self.lengths[rows]
        ids = self.ids[spread(self.starts[rows], lengths)]
        ends = np.cumsum(lengths)[np.cumsum(sizes) - 1] if many else []
        first = self._store(np.split(ids, ends)[: len(many)])
        self.row.update(zip((x for x, _ in many), range(first, first + len(many))))

    def _rows(self, pieces: list[str]) -> np.ndarray:
        new = [x for x in pieces if x not in self.row]
        if len(self.row) + len(new) > self.remembered:
            self._forget()
            new = [x for x in pieces if x]
        self._learn(new)
        row = self.row
        return np.fromiter((row[x] for x in pieces), np.int64, len(pieces))

    def _split(self, text: str) -> list[str]:
        """Pieces of one text; a special token is a piece of its own."""
        if not any(x in text for x in self.special):
            return self.pieces.findall(text)
        out = []
        for part in self.cut.split(text):
            out += ["\0" + part] if part in self.special else self.pieces.findall(part)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = coded.indices.to_numpy().astype(np.int64)
        # first chunks of a text have no space before them; odd texts are split one by one
        firsts = [chunks[i] for i in codes[offsets[:-1]].tolist()]
        own = [self._split(x) for x in texts.filter(pa.array(odd)).to_pylist()]
        parts = [" " + x for x in chunks] + firsts + list(chain.from_iterable(own))
        names = list(dict.fromkeys(parts))
        number = dict(zip(names, range(len(names))))
        special = {"\0" + k: v for k, v in self.special.items()}
        marks = [x for x in names if x in special]
        known = self._rows([x if x not in special else "" for x in names])
        if marks:
            first = self._store([np.array([special[x]], np.int32) for x in marks])
            known[[number[x] for x in marks]] = np.arange(first, first + len(marks))
        row = known[np.fromiter((number[x] for x in parts), np.int64, len(parts))]
        sequence = row[codes]
        sequence[offsets[:-1]] = row[len(chunks) : len(chunks) + len(firsts)]
        counts = np.diff(offsets)
        if own:
            whole = np.split(sequence, offsets[1:-1])
            rest = iter(np.split(row[len(chunks) + len(firsts) :], np.cumsum([len(x) for x in own])[:-1]))
            whole = [next(rest) if o else x for x, o in zip(whole, odd.tolist())]
            counts = np.fromiter(map(len, whole), np.int64, len(whole))
            sequence = np.concatenate(whole).astype(np.int64)
        per = self.lengths[sequence]
        out = self.ids[spread(self.starts[sequence], per)]
        ends = np.concatenate([[0], np.cumsum(per)])
        stops = np.cumsum(counts)
        return out, ends[stops] - ends[stops - counts]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of consecutive runs of ids."""
        lengths = self.token_length[ids]
        data = self.token_bytes[spread(self.token_start[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = ends[np.concatenate([[0], np.cumsum(counts)])]
        texts = pa.Array.from_buffers(
            pa.binary(), len(counts), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)]
        )
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str, back: bool = False) -> DataFrame:
    """doc_id, ids array<int> of every whole text; with ``back`` also text, decoded from them
    in the same pass."""

    def task(batches):
        for batch in batches:
            texts = batch.column(1)
            for start, stop in slices(texts, SLICE):
                ids, counts = codec(vocabulary).encode(texts.slice(start, stop - start))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns = [
                    batch.column(0).slice(start, stop - start),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                ]
                if back:
                    columns.append(codec(vocabulary).decode(ids, counts))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(task, "doc_id long, ids array<int>" + ", text string" * back)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, text: the text the ids stand for."""

    def task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                lists = part.column(1)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = codec(vocabulary).decode(lists.flatten().to_numpy(), counts.astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, texts], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, ids array<int>, text string")
