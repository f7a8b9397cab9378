"""Periodic runs of words, found in a Re-Pair grammar.

*Grammar.* The words of each text are numbered and the most frequent adjacent pairs replaced by
new symbols, again and again while some pair occurs twice in its text without overlap. Of pairs
that touch, the more frequent one is replaced; pairs that do not touch are replaced in one
round, for all texts of a slice at once. What is left of a text is folded in halves up to a
single root, so every text is a binary derivation tree.

*Runs.* A run lies whole in the node where the paths of its first and last word part, and
crosses that node's boundary. So each nonterminal is asked once, whatever its number of
occurrences, for the runs across its boundary: where a run crosses a boundary, four words at
one side of it come again one period away, and chains of equal four-word grams give these
distances. Both ends of a candidate follow by binary search over prefix hashes and are then
compared word by word.

*Positions.* A nonterminal's runs are moved to all places it derives. Of intervals with one
period those inside another are dropped, of equal intervals the smallest period stays; what
remains are the maximal runs.

Defined results: null and empty texts have no words, no runs and the hash of the empty string;
repeated rows give equal rows; an empty table gives no row; a null doc_id counts as never
altered; other columns are ignored. A text is handled whole, whatever its length.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalshare.llm.common import mix, slices, spread

SLICE = 2 << 20
LEAST_WORDS, LEAST_PERIODS = 24, 3
GRAM = 4  # a qualifying run repeats at least four words on one side of any boundary
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def word_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word number of every word, each text's first place and one end, the distinct words).
    Words are runs of anything but spaces and the controls 9 to 13."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    codes = coded.indices.to_numpy().astype(np.int64)
    if not len(codes):
        return codes, offsets, coded.dictionary
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes]
    ends = np.concatenate([[0], np.cumsum(real)])
    return codes[real], ends[offsets], coded.dictionary


class Grammar:
    """Nodes (start, mid, stop of one occurrence each) and all occurrences (node, start)."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.start, self.mid, self.stop = [], [], []
        self.node, self.place = [], []
        self.count = 0
        _, symbol = np.unique(text * (words.max() + 1) + words, return_inverse=True)
        self._fold(*self._pairs(symbol.astype(np.int64), text))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.start, self.mid, self.stop = join(self.start), join(self.mid), join(self.stop)
        self.node, self.place = join(self.node), join(self.place)

    def _add(self, first, mid, stop, node, place):
        self.start.append(first)
        self.mid.append(mid)
        self.stop.append(stop)
        self.node.append(node + self.count)
        self.place.append(place)
        self.count += len(first)

    def _pairs(self, symbol, text):
        """Replaces repeated pairs; gives place, size and text of the symbols that remain.

        ``symbol`` and ``size`` belong to the first word of what a symbol derives, ``after`` and
        ``before`` link these words. A pair seen but once never comes again, so a round looks
        only at the pairs still repeated and at those beside what the last round made."""
        n = len(symbol)
        size, head = np.ones(n, np.int64), np.ones(n, bool)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        edge = np.flatnonzero(text[1:] != text[:-1])
        after[edge], before[edge + 1] = -1, -1
        after[-1] = -1
        symbols = int(symbol.max()) + 1
        often = np.bincount(symbol)[symbol] > 1
        active = np.flatnonzero(often & (after >= 0) & often[after])
        ranks = np.full(n + 1, -1)  # the last one stands for "no neighbour"
        while len(active):
            key = symbol[active] * symbols + symbol[after[active]]
            # in a stretch of one symbol only every other pair can be replaced
            first = np.ones(len(active), bool)
            first[1:] = (after[active[:-1]] != active[1:]) | (key[1:] != key[:-1])
            turn = np.arange(len(active))
            even = (turn - np.maximum.accumulate(np.where(first, turn, 0))) % 2 == 0
            names, inverse = np.unique(key, return_inverse=True)
            total = np.bincount(inverse[even], minlength=len(names))
            rank = np.empty(len(names), np.int64)
            rank[np.lexsort((names, total))] = np.arange(len(names))
            rank[total < 2] = -1
            own = rank[inverse]
            ranks[active] = own
            heads = np.flatnonzero(first)
            tails = np.append(heads[1:], len(active)) - 1
            wins = own[heads] > np.maximum(ranks[before[active[heads]]], ranks[after[active[tails]]])
            ranks[active] = -1
            chosen = even & np.repeat(wins, tails - heads + 1)
            left = active[chosen]
            if not len(left):
                break
            right = after[left]
            _, example, number = np.unique(inverse[chosen], return_index=True, return_inverse=True)
            one, two = left[example], right[example]
            self._add(one, two, two + size[two], number, left)
            symbol[left], symbols = symbols + number, symbols + len(example)
            size[left] += size[right]
            head[right] = False
            after[left] = after[right]
            linked = after[left] >= 0
            before[after[left[linked]]] = left[linked]
            mark = np.zeros(n + 1, bool)
            mark[active[own >= 0]] = True
            mark[before[left]] = True
            mark[left] = True
            active = np.flatnonzero(mark[:n] & head & (after >= 0))
            if symbols > 1 << 30:
                _, symbol = np.unique(symbol, return_inverse=True)
                symbols = int(symbol.max()) + 1
        at = np.flatnonzero(head)
        return at, size[at], text[at]

    def _fold(self, at, size, text):
        """Joins neighbours two by two until each text is one node."""
        while len(at) > 1:
            head = np.ones(len(at), bool)
            head[1:] = text[1:] != text[:-1]
            begin = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            odd = (np.arange(len(at)) - begin) % 2 == 1
            right = np.flatnonzero(odd)
            if not len(right):
                break
            left = right - 1
            self._add(at[left], at[right], at[right] + size[right], np.arange(len(left)), at[left])
            size[left] += size[right]
            at, size, text = at[~odd], size[~odd], text[~odd]


class Extents:
    """How far two places of one text agree, by prefix hashes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.full(n, BASE)
        power[0] = 1
        power = np.cumprod(power)
        self.back = np.full(n + 1, INVERSE)
        self.back[0] = 1
        self.back = np.cumprod(self.back)
        value = mix(words.astype(np.uint64) + BASE)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power, dtype=np.uint64)])

    def _hash(self, at, size):
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def forward(self, a, b, limit):
        """Equal words from a and b on, at most ``limit``."""
        return self._search(limit, lambda size: self._hash(a, size) == self._hash(b, size))

    def backward(self, a, b, limit):
        """Equal words before a and b, at most ``limit``."""
        return self._search(limit, lambda size: self._hash(a - size, size) == self._hash(b - size, size))

    @staticmethod
    def _search(limit, equal):
        low, high = np.zeros_like(limit), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = equal(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


class Chains:
    """Places of one text that begin with the same four words, in order."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.n = n = len(words)
        places = np.flatnonzero(text[: n - GRAM + 1] == text[GRAM - 1 :])
        value = text[places].astype(np.uint64)
        for i in range(GRAM):
            value = mix(value * BASE + words[places + i].astype(np.uint64))
        order = np.argsort(value, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = value[order[1:]] != value[order[:-1]]
        group = np.cumsum(fresh)
        self.keys = group * (n + 1) + places[order]
        self.group = np.zeros(n, np.int64)
        self.group[places[order]] = group

    def at_least(self, like: np.ndarray, place: np.ndarray) -> np.ndarray:
        """First place from ``place`` on with the words at ``like``; n if there is none."""
        return self._found(like, np.searchsorted(self.keys, self.group[like] * (self.n + 1) + place), self.n)

    def at_most(self, like: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Last place up to ``place`` with the words at ``like``; -1 if there is none."""
        key = self.group[like] * (self.n + 1) + np.maximum(place, 0)
        found = self._found(like, np.searchsorted(self.keys, key, side="right") - 1, -1)
        return np.where(place < 0, -1, found)

    def _found(self, like, at, missing):
        if not len(self.keys):
            return np.full(len(like), missing)
        good = (at >= 0) & (at < len(self.keys)) & (self.group[like] > 0)
        key = self.keys[np.clip(at, 0, len(self.keys) - 1)]
        good &= key // (self.n + 1) == self.group[like]
        return np.where(good, key % (self.n + 1), missing)


def _crossing(words, text, grammar: Grammar):
    """(node, start, stop, period) of the runs across the boundaries of the nodes.

    A run goes on for one and a half periods at least on one side of the boundary, so only
    there are its distances looked for. Once a run is known that reaches ``far`` words to that
    side, distances from two of its periods up to 2/3 far can only be multiples of its period
    (two periods of one stretch have a common divisor) and are stepped over."""
    chains, extents = Chains(words, text), Extents(words)
    nodes = np.flatnonzero(grammar.stop - grammar.start >= LEAST_WORDS)
    found = [np.zeros((5, 0), np.int64)]
    for right in (True, False):
        like = grammar.mid[nodes] - (0 if right else GRAM)
        fits = (like >= grammar.start[nodes]) & (like + GRAM <= grammar.stop[nodes])
        node, like = nodes[fits], like[fits]
        q, skip_from, skip_to = (np.full(len(node), x) for x in (1, len(words), 0))
        while len(node):
            q = np.where((q >= skip_from) & (q <= skip_to), skip_to + 1, q)
            q = chains.at_least(like, like + q) - like if right else like - chains.at_most(like, like - q)
            start, mid, stop = grammar.start[node], grammar.mid[node], grammar.stop[node]
            inside = LEAST_PERIODS * q <= 2 * (stop - mid if right else mid - start)
            inside &= like + q + GRAM <= stop if right else like - q >= start
            node, like, q, skip_from, skip_to, start, mid, stop = (
                x[inside] for x in (node, like, q, skip_from, skip_to, start, mid, stop)
            )
            if not len(node):
                break
            jump = (q >= skip_from) & (q <= skip_to)
            a = mid if right else mid - q
            first = a - extents.backward(a, a + q, a - start)
            last = a + q + extents.forward(a, a + q, stop - a - q)
            good = ~jump & (last - first >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q))
            found.append(np.stack([node, first, last, q, a])[:, good])
            far = last - mid if right else mid - first
            skip_from, skip_to = np.where(good, 2 * q, skip_from), np.where(good, 2 * far // 3, skip_to)
            q = q + 1
    return _compared(words, grammar, np.concatenate(found, axis=1))


def _compared(words, grammar: Grammar, found):
    """The runs, each compared word by word; where a hash misled, its ends are set anew."""
    node, start, stop, period, seen = found
    size = stop - start - period
    at = spread(start, size)
    wrong = words[at] != words[at + np.repeat(period, size)]
    keep = np.ones(len(node), bool)
    for r in np.unique(np.repeat(np.arange(len(node)), size)[wrong]):
        q, low, high = period[r], grammar.start[node[r]], grammar.stop[node[r]]
        differ = np.flatnonzero(words[low : high - q] != words[low + q : high]) + low
        cut = np.searchsorted(differ, seen[r])
        start[r] = differ[cut - 1] + 1 if cut else low
        stop[r] = (differ[cut] if cut < len(differ) else high - q) + q
        keep[r] = stop[r] - start[r] >= max(LEAST_WORDS, LEAST_PERIODS * q)
    node, start, stop, period = (x[keep] for x in (node, start, stop, period))
    # of equal intervals of a node the smallest period; multiples of it have the same ends
    order = np.lexsort((period, stop, start, node))
    node, start, stop, period = (x[order] for x in (node, start, stop, period))
    fresh = np.ones(len(node), bool)
    fresh[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return node[fresh], start[fresh], stop[fresh], period[fresh]


def runs(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all maximal runs of the texts, by start and period.

    ``text`` gives each word's text, in ascending order; no run spans two texts."""
    empty = np.zeros(0, np.int64)
    if len(words) < LEAST_WORDS:
        return empty, empty, empty
    grammar = Grammar(words, text)
    node, start, stop, period = _crossing(words, text, grammar)
    if not len(node):
        return empty, empty, empty
    # a nonterminal's runs at every place it derives
    order = np.argsort(grammar.node, kind="stable")
    owners, places = grammar.node[order], grammar.place[order]
    low = np.searchsorted(owners, node)
    times = np.searchsorted(owners, node, side="right") - low
    move = places[spread(low, times)] - np.repeat(grammar.start[node], times)
    start, stop, period = (np.repeat(x, times) for x in (start, stop, period))
    start, stop = start + move, stop + move
    # of each period only intervals that no other one holds
    order = np.lexsort((-stop, start, period))
    start, stop, period = start[order], stop[order], period[order]
    reach = np.maximum.accumulate(period * (len(words) + 1) + stop)
    keep = np.ones(len(start), bool)
    keep[1:] = reach[1:] > reach[:-1]
    start, stop, period = start[keep], stop[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def altered(words: np.ndarray, begin: np.ndarray, keys: list) -> np.ndarray:
    """The words after the rule that makes every tenth document's tail periodic."""
    source = np.arange(len(words))
    for i, key in enumerate(keys):
        n = int(begin[i + 1] - begin[i])
        if key is None or not n:
            continue
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            tail = np.arange(n - a)
            source[begin[i] + a : begin[i + 1]] = begin[i] + a + tail % p
    return words[source]


def _digest(batches, alter):
    for batch in batches:
        for first, last in slices(batch.column(1), SLICE):
            part = batch.slice(first, last - first)
            keys = part.column(0).to_pylist()
            words, begin, names = word_lists(part.column(1))
            if alter:
                words = altered(words, begin, keys)
            text = np.repeat(np.arange(len(keys)), np.diff(begin))
            start, stop, period = runs(words, text)
            drop = np.zeros(len(words) + 1, np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, stop, -1)
            kept = np.cumsum(drop[:-1]) == 0
            owner = np.searchsorted(begin, start, side="right") - 1
            cuts = np.searchsorted(owner, np.arange(len(keys) + 1))
            names = np.array(names.cast(pa.binary()).to_pylist() or [b""], object)
            rows = []
            for i, key in enumerate(keys):
                own = slice(begin[i], begin[i + 1])
                collapsed = b" ".join(names[words[own][kept[own]]].tolist())
                at = range(cuts[i], cuts[i + 1])
                listed = [(int(start[r] - begin[i]), int(stop[r] - start[r]), int(period[r])) for r in at]
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()
                best = (None,) * 4
                if listed:
                    s, n, q = max(listed, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]))
                    best = (s, n, q, 1000 * n // q)
                shas = (hashlib.sha256(lines).hexdigest(), hashlib.sha256(collapsed).hexdigest())
                rows.append((key, len(listed), *best, *shas))
            if rows:
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )


def digests(docs: DataFrame, alter: bool = False) -> DataFrame:
    """Per text: its runs (number, hash of their list, the one of greatest exponent) and the
    hash of the text collapsed to the first period of each run. ``alter`` first makes the tail
    of every tenth document periodic, by the crc32 of its doc_id."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(lambda batches: _digest(batches, alter), SCHEMA)


_LIST = "doc_id long, start long, length long, period long"


def list_runs(docs: DataFrame) -> DataFrame:
    """Every maximal run of every text: doc_id, start (word number), length, period."""

    def listed(batches):
        for batch in batches:
            for first, last in slices(batch.column(1), SLICE):
                part = batch.slice(first, last - first)
                words, begin, _ = word_lists(part.column(1))
                text = np.repeat(np.arange(last - first), np.diff(begin))
                start, stop, period = runs(words, text)
                owner = np.searchsorted(begin, start, side="right") - 1
                columns = [part.column(0).take(pa.array(owner))]
                columns += [pa.array(x) for x in (start - begin[owner], stop - start, period)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _LIST.split(", ")])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(listed, _LIST)
