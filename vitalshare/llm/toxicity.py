"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to symbols: insults and threats (each with a weight), targets, negations,
reporting verbs, everything else. A clause runs to the next sentence or clause mark or line
end. Five transducers read it, each a table (state, symbol) -> (state, output):

* insult and threat  mark the attack words,
* target             guesses at the start whether somebody is addressed anywhere in the clause
                     and accepts only if the guess was right,
* negation           marks what lies within a few words of a negation,
* report             marks everything from a reporting verb on.

Their product is built once; its states are tuples of states and its outputs label every attack
as (insult or threat, aimed, denied, reported). All clauses of a slice of texts that hold an
attack run through the product at once, by array look-ups, from each of its start states; the
weights gathered along the one accepted path count. A document's score is a logistic function
of the weights under each label.

Attack words are learned: whole words and word beginnings (inflected stems) whose share among
toxic documents is far above that among the others, with a log-likelihood ratio beyond what
any of all forms would reach by chance; a form counts no more often than it has different
neighbours, as copies of one text are no evidence. A form that stands before a target more
often than behind one is a threat, else an insult. A short list of known words has a prior that
the counts may overrule. At most ``SAMPLED`` labelled documents, chosen by a hash of doc_id and
each text counted once, serve to fit both the words and the logistic function; every whole text
is scored.

Defined results: a text that is null or has no words scores what a text without any match
scores; documents without a label (or a null one) teach nothing, of several labels the largest
holds; without labels of both kinds a fixed function of the known words applies; repeated rows
are scored each; other columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalshare.llm.common import slices, trim, with_text
from vitalshare.sources.writers import stage_table

SAMPLED = 20_000
SLICE = 4 << 20
STEMS = (4, 5, 6, 7, 8)
MIN_WEIGHT = 3.0
SURPLUS = 3.0  # log-likelihood ratio beyond the logarithm of the number of forms
NEAR = 2  # words between which a target tells a threat from an insult
PRIOR = 2.0
NEGATION_SCOPE = 3
THRESHOLD = 0.7

INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash clown "
    "disgusting imbecile cretin bastard bitch asshole dumbass retard filth vermin".split()
)
THREATS = frozenset("kill murder destroy hurt beat strangle shoot stab burn hang".split())
TARGETS = frozenset(
    "you your yours they them he she him her these those people du dich dir ihr euch sie ihnen "
    "tu te toi vous ils elles leur usted ustedes tú vosotros ellos ellas os".split()
)
NEGATIONS = frozenset(
    "not no never none nobody without nicht kein keine nie niemals pas jamais aucun sans nunca "
    "ningún ninguna sin".split()
)
REPORTS = frozenset(
    "said says say claims claimed wrote writes quoted quote called sagte schrieb behauptet dit "
    "écrit affirme dijo dice escribió afirma".split()
)

OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT = range(6)
SYMBOLS = 6
# labels: 8 of insults, 8 of threats; bits: reported, denied, aimed
LABELS = 16
WORD = re.compile(r"[^\W\d_]+")
ENDS = frozenset(".!?;:|")


@dataclass
class Model:
    """Weights of words and stems, and of the labels (the last is the constant)."""

    insults: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, PRIOR))
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, PRIOR))
    weights: np.ndarray = field(
        default_factory=lambda: np.array([1.0, 1.5, 0.2, 0.3, 0.5, 0.7, 0.1, 0.2] * 2 + [-3.0])
    )


def forms(word: str):
    """A word and its beginnings, as features."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


def symbol(word: str, model: Model) -> tuple[int, float]:
    """Symbol and weight of a written word."""
    kind, weight = OTHER, 0.0
    for core in WORD.findall(word.lower()):
        for form in forms(core):
            for symbol_, table in ((INSULT, model.insults), (THREAT, model.threats)):
                if table.get(form, 0.0) > weight:
                    kind, weight = symbol_, table[form]
        if kind == OTHER:
            if core in NEGATIONS:
                kind = NEGATION
            elif core in REPORTS:
                kind = REPORT
            elif core in TARGETS:
                kind = TARGET
    return kind, weight


@dataclass(frozen=True)
class Transducer:
    """``arcs`` maps (state, symbol) to (state, output); no arc, no path. An output is a tuple
    of marks, one for each machine a product is made of."""

    starts: tuple
    finals: frozenset
    arcs: dict

    def __matmul__(self, other: "Transducer") -> "Transducer":
        """The product: both read the same symbols, outputs are put together."""
        starts = tuple((a, b) for a in self.starts for b in other.starts)
        arcs, finals, todo, seen = {}, set(), list(starts), set(starts)
        while todo:
            a, b = state = todo.pop()
            if a in self.finals and b in other.finals:
                finals.add(state)
            for symbol_ in range(SYMBOLS):
                one, two = self.arcs.get((a, symbol_)), other.arcs.get((b, symbol_))
                if one and two:
                    after = (one[0], two[0])
                    arcs[state, symbol_] = (after, one[1] + two[1])
                    if after not in seen:
                        seen.add(after)
                        todo.append(after)
        return Transducer(starts, frozenset(finals), arcs)


def machines() -> list[Transducer]:
    """insult, threat, target, negation, report."""
    everything = range(SYMBOLS)

    def marks(wanted):
        return Transducer((0,), frozenset([0]), {(0, x): (0, (int(x == wanted),)) for x in everything})

    target = {("none", x): ("none", (0,)) for x in everything if x != TARGET}
    target |= {("to come", x): ("seen" if x == TARGET else "to come", (1,)) for x in everything}
    target |= {("seen", x): ("seen", (1,)) for x in everything}
    scope = range(NEGATION_SCOPE + 1)
    negation = {
        (left, x): (NEGATION_SCOPE if x == NEGATION else max(left - 1, 0), (int(left > 0),))
        for left in scope
        for x in everything
    }
    report = {(said, x): (int(said or x == REPORT), (said,)) for said in (0, 1) for x in everything}
    return [
        marks(INSULT),
        marks(THREAT),
        Transducer(("none", "to come"), frozenset(["none", "seen"]), target),
        Transducer((0,), frozenset(scope), negation),
        Transducer((0,), frozenset([0, 1]), report),
    ]


class Grammar:
    """The product of the machines as arrays: ``after`` and ``label`` by (state, symbol).
    State 0 is dead; label -1 is none."""

    def __init__(self):
        product = reduce(Transducer.__matmul__, machines())
        states = {s: i for i, s in enumerate({s: 1 for s in [*product.starts, *(x[0] for x in product.arcs)]}, 1)}
        self.after = np.zeros((len(states) + 1, SYMBOLS), np.int64)
        self.label = np.full((len(states) + 1, SYMBOLS), -1, np.int64)
        for (state, symbol_), (after, (insult, threat, aimed, denied, reported)) in product.arcs.items():
            self.after[states[state], symbol_] = states[after]
            if insult or threat:
                self.label[states[state], symbol_] = 8 * threat + 4 * reported + 2 * denied + aimed
        self.starts = [states[s] for s in product.starts]
        self.final = np.zeros(len(states) + 1, bool)
        self.final[[states[s] for s in product.finals]] = True

    def run(self, kinds: np.ndarray, weights: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Weights by label of clauses ``start``..``stop`` of the symbols ``kinds``."""
        order = np.argsort(start - stop, kind="stable")
        begin, size = start[order], (stop - start)[order]
        out = np.zeros((len(start), LABELS))
        for first in self.starts:
            state = np.full(len(order), first)
            found = np.zeros((len(order), LABELS))
            live = len(order)
            for step in range(int(size[0]) if len(size) else 0):
                live = int(np.searchsorted(-size[:live], -step))  # longer clauses come first
                at, now = begin[:live] + step, state[:live]
                kind = kinds[at]
                label = self.label[now, kind]
                hit = np.flatnonzero(label >= 0)
                found[hit, label[hit]] += weights[at[hit]]
                state[:live] = self.after[now, kind]
            good = self.final[state]
            out[order[good]] += found[good]
        return out


GRAMMAR = Grammar()


def matches(texts: pa.Array, model: Model) -> np.ndarray:
    """Weights by label of each text."""
    lists = pc.ascii_split_whitespace(pc.replace_substring(pc.fill_null(texts, ""), "\n", " ; "))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    found = [symbol(w, model) for w in words]
    ends = np.fromiter((w[-1:] in ENDS for w in words), bool, len(words))
    codes = coded.indices.to_numpy()
    kinds = np.fromiter((x[0] for x in found), np.int64, len(words))[codes]
    out = np.zeros((len(texts), LABELS))
    hits = np.flatnonzero(kinds >= INSULT)
    if len(hits):
        weights = np.fromiter((x[1] for x in found), np.float64, len(words))[codes]
        closed = np.concatenate([[-1], np.flatnonzero(ends[codes]), [len(codes)]])
        owner = np.searchsorted(offsets, hits, side="right") - 1
        after = np.searchsorted(closed, hits)
        start = np.maximum(closed[after - 1] + 1, offsets[owner])
        stop = np.minimum(np.minimum(closed[after] + 1, len(codes)), offsets[owner + 1])
        _, first = np.unique(start, return_index=True)
        np.add.at(out, owner[first], GRAMMAR.run(kinds, weights, start[first], stop[first]))
    return out


def features(found: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(found), np.ones(len(found))])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; attacks never speak for a clean text."""
    keep = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(keep.sum())
        penalty = np.full(len(w), ridge)
        penalty[-1] = 0.01
        for _ in range(50):
            p = logistic(x[:, keep] @ w)
            gradient = x[:, keep].T @ (p - y) + penalty * w
            hessian = (x[:, keep] * (p * (1 - p))[:, None]).T @ x[:, keep] + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        negative = np.flatnonzero(keep[:-1])[w[:-1] < 0]
        if not len(negative):
            full = np.zeros(x.shape[1])
            full[keep] = w
            return full
        keep[negative] = False


def _labelled(docs: DataFrame, labels: DataFrame, training: Column, sampled: int) -> DataFrame:
    """At most about ``sampled`` labelled training texts: text, toxic; each text once."""
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(training)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, sampled / max(known.count(), 1))
    chosen = (F.pmod(F.xxhash64("doc_id"), 1_000_003) / 1_000_003) < share
    own = docs.where("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    joined = own.where(training & chosen).join(known.where(chosen), "doc_id")
    return joined.groupBy(F.md5("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))


def _odds(toxic: float, clean: float, n1: int, n0: int) -> float:
    """Log ratio of a form's shares among toxic and other texts."""
    return float(np.log((toxic + 0.5) / (n1 + 1.0)) - np.log((clean + 0.5) / (n0 + 1.0)))


def _ratio(toxic: int, clean: int, n1: int, n0: int) -> float:
    """Log-likelihood ratio of a form's counts against equal shares."""
    both = toxic + clean
    out = toxic * np.log(toxic / (both * n1 / (n1 + n0))) if toxic else 0.0
    return float(out + (clean * np.log(clean / (both * n0 / (n1 + n0))) if clean else 0.0))


def _surprise(n1: int, n0: int) -> Column:
    """``_ratio`` of the columns toxic and clean; negative where the share is no higher."""
    toxic, clean = F.col("toxic"), F.col("clean")
    both, share = toxic + clean, n1 / (n1 + n0)
    own = toxic * F.log(toxic / (both * share))
    rest = F.when(clean > 0, clean * F.log(clean / (both * (1 - share)))).otherwise(0.0)
    return F.when(toxic > both * share, own + rest).otherwise(-1.0)


def _uses(sample: DataFrame, wanted: frozenset) -> dict:
    """How the forms are used in toxic texts: form -> (different pairs of neighbours, uses that
    are followed by a target, uses that follow one)."""

    def look(batches):
        for batch in batches:
            rows = set()
            for text in batch.column(0).to_pylist():
                words = WORD.findall(text.lower())
                aim = [w in TARGETS for w in words]
                for i, word in enumerate(words):
                    for form in forms(word):
                        if form in wanted:
                            beside = " ".join(words[max(i - 1, 0) : i] + ["_"] + words[i + 1 : i + 2])
                            ahead = any(aim[i + 1 : i + 1 + NEAR])
                            rows.add((form, beside, ahead, any(aim[max(i - NEAR, 0) : i])))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in zip(*rows)], ["form", "beside", "ahead", "behind"]
                )

    if not wanted:
        return {}
    seen = sample.where("toxic = 1").select("text").mapInArrow(
        look, "form string, beside string, ahead boolean, behind boolean"
    )
    held = seen.distinct().groupBy("form").agg(
        F.countDistinct("beside").alias("beside"),
        F.count(F.when(F.col("ahead"), 1)).alias("ahead"),
        F.count(F.when(F.col("behind"), 1)).alias("behind"),
    )
    return {x.form: (x.beside, x.ahead, x.behind) for x in held.collect()}


def learn(docs: DataFrame, labels: DataFrame, training: Column, sampled: int = SAMPLED) -> Model:
    """``training`` is a condition on doc_id."""
    sample = stage_table(_labelled(docs, labels, training, sampled).select("text", "toxic"), "labelled")
    totals = {x.toxic: x["count"] for x in sample.groupBy("toxic").count().collect()}
    n1 = totals.get(1, 0)
    n0 = sum(totals.values()) - n1
    if not n1 or not n0:
        return Model()
    seeds = INSULTS | THREATS

    def count(batches):
        trim()
        for batch in batches:
            for start, stop in slices(batch.column(0), SLICE):
                toxic, clean = Counter(), Counter()
                part = batch.slice(start, stop - start)
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen = {f for w in set(WORD.findall(text.lower())) for f in forms(w)}
                    (toxic if label == 1 else clean).update(seen)
                names = list({*toxic, *clean})
                yield pa.RecordBatch.from_pydict(
                    {"form": names, "toxic": [toxic[x] for x in names], "clean": [clean[x] for x in names]}
                )

    counted = stage_table(
        sample.mapInArrow(count, "form string, toxic long, clean long")
        .groupBy("form")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic > 0"),
        "forms",
    )
    known = counted.where(F.col("form").isin(*seeds)).collect()
    needed = float(np.log(max(counted.count(), 1))) + SURPLUS
    # each of these forms is in several sampled toxic texts, so the sample bounds their number
    likely = {x.form: x for x in counted.where(_surprise(n1, n0) >= needed).collect()}
    used = _uses(sample, frozenset(likely))
    model = Model()
    for x in known:
        table = model.threats if x.form in THREATS else model.insults
        table[x.form] = max(_odds(x.toxic + PRIOR, x.clean, n1, n0), 0.0)
    for form, (neighbours, ahead, behind) in used.items():
        toxic, clean = min(likely[form].toxic, neighbours), likely[form].clean
        weight = _odds(toxic, clean, n1, n0)
        if form not in seeds and weight >= MIN_WEIGHT and _ratio(toxic, clean, n1, n0) >= needed:
            (model.threats if ahead > behind else model.insults)[form] = weight

    def describe(batches):
        trim()
        for batch in batches:
            for start, stop in slices(batch.column(0), SLICE):
                part = batch.slice(start, stop - start)
                found = matches(part.column(0), model)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.list_(pa.float64())), part.column(1)], ["found", "toxic"]
                )

    rows = sample.mapInArrow(describe, "found array<double>, toxic int").collect()
    x = features(np.array([r.found for r in rows]))
    model.weights = fit(x, np.array([float(r.toxic == 1) for r in rows]))
    return model


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` with score and predicted, every whole text."""

    source, place = with_text(docs, keep)

    def task(batches):
        trim()
        for batch in batches:
            texts = batch.column(place)
            for start, stop in slices(texts, SLICE):
                found = matches(texts.slice(start, stop - start), model)
                value = logistic(features(found) @ model.weights)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(start, stop - start).columns[: len(keep)],
                        pa.array(value),
                        pa.array((value >= THRESHOLD).astype(np.int32)),
                    ],
                    [*keep, "score", "predicted"],
                )

    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return source.mapInArrow(task, schema)
