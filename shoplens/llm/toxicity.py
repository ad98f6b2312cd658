"""Toxicity by a weighted finite-state grammar over clauses.

The words that insult are learned: beginnings of words that stand in toxic
sample documents far more often than in clean ones, each with its log odds. A
lexicon transducer turns the words of a clause into tags; transducers for
negation, reported speech, target and threat mark what stands in their scope;
their composition reads a clause once and emits matched events. A document's
score is a logistic function of its events, fitted on sample documents that the
lexicon has not seen and calibrated by that.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import fold, held_out, mix64, worker_cache

SHORTEST, LONGEST = 3, 8
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n|]+")

# Closed-class words of the grammar, by language: en, de, fr, es.
NEGATIONS = frozenset(
    "not never no nobody isn aren wasn weren don doesn didn cannot without "
    "nicht nie niemals kein keine keinen keiner ohne pas jamais aucun aucune ni nunca jamás sin".split())
REPORTS = frozenset(
    "said says say quoted quote wrote writes called claimed reported alleged sagte sagt schrieb zitierte "
    "behauptete dit écrit cité dijo dice escribió citó".split())
TARGETS = frozenset(
    "you your yours u they them he him she her people du dich dir dein deine ihr euch sie tu toi te vous "
    "votre vos tú ti usted ustedes vosotros ellos".split())
THREATS = frozenset(
    "kill hurt destroy beat shoot stab burn punch strangle töten umbringen schlagen verletzen vernichten "
    "tuer frapper détruire brûler matar golpear destruir quemar".split())
#: Insults known without learning; learned stems come on top.
INSULTS = frozenset(
    "idiot idiots moron morons stupid imbecile scum scumbag trash loser losers worthless pathetic disgusting clown "
    "bastard dumbass asshole bitch idioten dumm dummkopf trottel arschloch abschaum ekelhaft imbécile stupide connard "
    "salaud ordure minable estúpido imbécil basura asqueroso cabrón".split())
KNOWN_WEIGHT = 3.0
EVENTS = ("plain", "targeted", "negated", "reported", "threat")
#: What a matched event counts before anything is learned about it; negated and reported ones count less.
PRIOR = np.array([2.0, 2.0, 0.7, 0.9, 1.5])

Symbol = tuple  # (kind, targeted, negated, reported); kinds: other, insult, threat, not, says, target


class Transducer:
    """A deterministic transducer: (state, symbol) to (state, symbol).

    `step` is called for every pair of a state and an input symbol once, when a
    machine is tabulated.
    """

    def __init__(self, states: int, step):
        self.states, self.step = states, step

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: this one's output is the other one's input."""
        def step(state: int, symbol: Symbol):
            a, b = divmod(state, other.states)
            a, symbol = self.step(a, symbol)
            b, symbol = other.step(b, symbol)
            return a * other.states + b, symbol
        return Transducer(self.states * other.states, step)

    def table(self, kinds: list[str]) -> dict:
        return {(state, kind): self.step(state, (kind, False, False, False))
                for state in range(self.states) for kind in kinds}


def _countdown(trigger: str, reach: int, mark: int) -> Transducer:
    """Marks insults and threats at most `reach` words after the trigger."""
    def step(state: int, symbol: Symbol):
        if symbol[0] == trigger:
            return reach, symbol
        if state and symbol[0] in ("insult", "threat"):
            symbol = tuple(True if i == mark else x for i, x in enumerate(symbol))
        return max(0, state - 1), symbol
    return Transducer(reach + 1, step)


def _rest_of_clause(trigger: str, mark: int) -> Transducer:
    """Marks insults and threats anywhere after the trigger."""
    def step(state: int, symbol: Symbol):
        if symbol[0] == trigger:
            return 1, symbol
        if state and symbol[0] in ("insult", "threat"):
            symbol = tuple(True if i == mark else x for i, x in enumerate(symbol))
        return state, symbol
    return Transducer(2, step)


def _threat() -> Transducer:
    """A threatening verb counts when a target follows within three words."""
    def step(state: int, symbol: Symbol):
        if symbol[0] == "threat":
            return 3 if not (symbol[2] or symbol[3]) else 0, symbol
        if symbol[0] == "target" and state:
            return 0, ("threatened", *symbol[1:])
        return max(0, state - 1), symbol
    return Transducer(4, step)


KINDS = ["other", "insult", "threat", "not", "says", "target"]


def grammar() -> dict:
    """The composition of target, negation, reported-speech and threat transducers, as a table."""
    machine = _rest_of_clause("target", 1).then(_countdown("not", 3, 2)).then(
        _rest_of_clause("says", 3)).then(_threat())
    return machine.table(KINDS)


class Lexicon:
    """Transducer of words to tags, with the learned stems and their weights."""

    def __init__(self, stems: dict[str, float]):
        self.stems = {(word + "$")[:LONGEST]: KNOWN_WEIGHT for word in INSULTS} | stems

    def finder(self):
        """Finds texts in which anything of the lexicon may stand; built once per worker."""
        cache, key = worker_cache("toxicity"), ("toxicity", tuple(sorted(self.stems)))
        if key not in cache:
            import ahocorasick
            found = ahocorasick.Automaton()
            for stem in self.stems:
                found.add_word(stem.rstrip("$"), stem)
            for word in THREATS:
                found.add_word(word, word)
            found.make_automaton()
            cache[key] = found
        return cache[key]

    def tag(self, word: str) -> tuple[str, float]:
        marked = word + "$"
        best = max((self.stems.get(marked[:n], 0.0) for n in range(SHORTEST, LONGEST + 1)), default=0.0)
        if best > 0:
            return "insult", best
        if word in THREATS:
            return "threat", 0.0
        if word in NEGATIONS:
            return "not", 0.0
        if word in REPORTS:
            return "says", 0.0
        return ("target", 0.0) if word in TARGETS else ("other", 0.0)

    def touched(self, text: str) -> list[tuple[int, int]]:
        """Clauses with a word that the lexicon knows, as ranges of the text."""
        finder, out, last = self.finder(), [], -1
        for end, stem in finder.iter(text):
            size = len(stem.rstrip("$"))
            start = end - size + 1
            if start <= last or (start and text[start - 1].isalpha()):
                continue
            if stem.endswith("$") and end + 1 < len(text) and text[end + 1].isalpha():
                continue
            a = start
            while a and text[a - 1] not in ".!?;:\n|":
                a -= 1
            b = _CLAUSE.search(text, end + 1)
            last = b.start() if b else len(text)
            out.append((max(a, out[-1][1]) if out else a, last))
        return out


class Model:
    """Lexicon, grammar and the weights of the events."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights, self.arcs = lexicon, weights, grammar()

    def events(self, text: str) -> np.ndarray:
        """How much of each kind of event the text holds, as log(1 + sum of weights)."""
        text = text.lower()
        sums = np.zeros(len(EVENTS))
        for start, stop in self.lexicon.touched(text):
            state = 0
            for word in _WORD.findall(text, start, stop):
                kind, weight = self.lexicon.tag(word)
                state, (kind, targeted, negated, reported) = self.arcs[state, kind]
                if kind == "insult":
                    sums[3 if reported else 2 if negated else 1 if targeted else 0] += weight
                elif kind == "threatened":
                    sums[4] += 2.0
        return np.log1p(sums)

    def score(self, events: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(events @ self.weights[1:] + self.weights[0], -30, 30)))


def _prefixes(text: str) -> set[str]:
    return {word[:n] for w in set(_WORD.findall(text.lower()))
            for word in (w + "$",) for n in range(SHORTEST, min(LONGEST, len(word)) + 1)}


def _apart(sample: DataFrame, hashes: int = 8) -> DataFrame:
    """Ids of the sample with one of each group of near copies, which share a minimum hash.

    Copies of one toxic text would make its every word look toxic.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = [np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % 2 ** 64) for i in range(hashes)]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = _WORD.findall(text.lower())
                keys = np.array([zlib.crc32(" ".join(words[i:i + 3]).encode("utf-8", "surrogatepass"))
                                 for i in range(max(1, len(words) - 2))], np.uint64)
                rows.append([int(mix64(keys * seed).min() >> np.uint64(1)) for seed in seeds])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "marks"])

    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    signed = sample.select("doc_id", "text").mapInArrow(sign, "doc_id long, marks array<long>").collect()
    for row in signed:  # a few numbers per sample document
        for i, mark in enumerate(row.marks):
            parent[root((i, mark))] = root(row.doc_id)
    first: dict = {}
    for row in sorted(signed, key=lambda r: r.doc_id):
        first.setdefault(root(row.doc_id), row.doc_id)
    return sample.sparkSession.createDataFrame([(i,) for i in first.values()], "doc_id long").coalesce(1)


def _lexicon(sample: DataFrame, most: int) -> Lexicon:
    """Beginnings of words that go with the label, by a likelihood-ratio test over the sample."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else clean).update(_prefixes(text))
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()),
                 pa.array([clean[n] for n in names], pa.int64())], ["stem", "toxic", "clean"])

    sample = sample.join(F.broadcast(_apart(sample)), "doc_id")  # ids of a bounded sample
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({})
    share = n_toxic / (n_toxic + n_clean)
    counted = sample.select("text", F.col("toxic").cast("boolean")).mapInArrow(
        count, "stem string, toxic long, clean long").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    tried = counted.agg(F.approx_count_distinct("stem")).first()[0]
    least = max(20.0, 2 * float(np.log(max(1, tried))) + 4)  # so many stems, so high may chance reach
    both = F.col("toxic") + F.col("clean")
    surprise = 2 * (F.col("toxic") * F.log(F.col("toxic") / (both * share))
                    + F.when(F.col("clean") > 0, F.col("clean") * F.log(
                        F.col("clean") / (both * (1 - share)))).otherwise(0))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1) * (n_clean + 1) / (F.col("clean") + 0.5))
    best = counted.where("toxic >= 3").withColumns({"surprise": surprise, "odds": odds}).where(
        (F.col("surprise") >= least) & (F.col("odds") >= 3)).orderBy(
        F.desc("surprise"), "stem").limit(most).collect()  # at most `most` stems
    support = {r.stem: r.toxic for r in best}
    weights = {r.stem: r.odds for r in best}
    longer = Counter()
    for stem, n in support.items():
        if stem[:-1] in support:
            longer[stem[:-1]] = max(longer[stem[:-1]], n)
    kept: dict[str, float] = {}
    for stem in sorted(support, key=lambda s: (len(s), s)):
        if longer[stem] >= 0.8 * support[stem]:
            continue  # a longer beginning says the same more exactly
        if any(kept.get(stem[:n], -9) >= weights[stem] - 0.5 for n in range(SHORTEST, len(stem))):
            continue
        kept[stem] = weights[stem]
    return Lexicon(kept)


def _fit(events: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights, drawn towards PRIOR; the events' own weights never turn negative."""
    prior = np.append(-3.5, PRIOR)
    pull = np.append(0.01, np.full(len(EVENTS), 1.0))
    x = np.column_stack([np.ones(len(events)), events])
    weights = prior.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - labels) + pull * (weights - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        weights = weights - np.linalg.solve(hessian, gradient)
        weights[1:] = np.maximum(weights[1:], 0)
    return weights


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000, stems: int = 4000) -> Model:
    """Lexicon and weights from at most 2 x `sample_docs` labelled documents of each label.

    Documents of the held-out fold and rows without text or label take no part.
    One part of the sample makes the lexicon, the other the weights. Without
    labels the lexicon is empty and the prior weights hold.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)
                          & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").alias("toxic")).withColumn("spare", fold(F.col("doc_id")) == 3)
    spread = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        for spare in (False, True):
            some = usable.where((F.col("toxic") == label) & (F.col("spare") == spare)).orderBy(
                spread, "doc_id").limit(sample_docs)
            chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    # at most 4 x sample_docs ids
    sample = texts.join(F.broadcast(chosen), "doc_id")
    lexicon = _lexicon(sample.where(~F.col("spare")), stems)
    blank = Model(lexicon, np.append(-3.5, PRIOR))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blank.events(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f.tolist() for f in found], pa.list_(pa.float64())),
                 batch.column(1).cast(pa.int32())], ["events", "toxic"])

    rows = sample.where("spare").select("text", F.col("toxic").cast("int")).mapInArrow(
        measure, "events array<double>, toxic int").toArrow()  # a few numbers per sample document
    if not rows.num_rows:
        return blank
    events = np.array(rows.column("events").to_pylist())
    return Model(lexicon, _fit(events, rows.column("toxic").to_numpy().astype(float)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; null counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events = np.array([model.events(t) for t in batch.column(2).to_pylist()]).reshape(-1, len(EVENTS))
            found = model.score(events)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found),
                 pa.array((found >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"),
                       F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000) -> DataFrame:
    """Train on the labelled documents outside the held-out fold and score all documents."""
    return score(docs, train(docs, labels, sample_docs))
