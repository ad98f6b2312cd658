"""Language of a text by interpolated Kneser-Ney models over characters.

One model per language, learned from a bounded sample of documents. The n-grams
of all languages lie in one sorted array of hashes per order, each with its log
probability under every language; an n-gram that no language has backs off to
the next order. A text is scored whole; the language with the lowest cross
entropy per character wins. How far it leads is calibrated on sample documents
kept out of the counts, and so is the cross entropy above which a text counts
as none of the languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import give_back, giving_back, held_out, mix64, portions_of, worker_cache

ORDER = 4
UNKNOWN = "und"


def _portions(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of text; only one is in Python at a time."""
    for batch in batches:
        for start, stop in portions_of([n or 0 for n in pc.binary_length(batch.column(text)).to_pylist()], most):
            give_back()
            yield batch.slice(start, stop - start)


def _letters() -> np.ndarray:
    """For each code point its lower-case letter in 16 bits, 0 for all that is no letter."""
    cache = worker_cache("langid")
    if "letters" not in cache:
        table = np.zeros(0x110000, np.uint16)
        for code in range(0x110000):
            letter = chr(code)
            if letter.isalpha():
                table[code] = max(1, ord(letter.lower()[0]) & 0xFFFF)
        cache["letters"] = table
    return cache["letters"]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts, runs of other characters as one 0, each text after three 0s.

    Also where each text starts (plus the end), and how many letters it has.
    """
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    found = _letters()[codes]
    owner = np.repeat(np.arange(len(texts)), lens)
    keep = found > 0
    letters = np.bincount(owner[keep], minlength=len(texts))
    keep[1:] |= (found[:-1] > 0) & (owner[1:] == owner[:-1])
    found, owner = found[keep], owner[keep]
    sizes = np.bincount(owner, minlength=len(texts)) + ORDER - 1
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    out = np.zeros(int(starts[-1]), np.uint64)
    out[np.arange(len(found)) + (owner + 1) * (ORDER - 1)] = found
    return out, starts, letters


def grams(seq: np.ndarray, order: int) -> np.ndarray:
    """The last `order` symbols at every place, 16 bits each; symbols before the first are 0."""
    key = seq.copy()
    for back in range(1, order):
        key[back:] |= seq[:-back] << np.uint64(16 * back)
    return key


class _Model:
    """Kneser-Ney probabilities of one language from its 4-gram counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        self.tables = {}
        self.alphabet = alphabet
        for order in range(ORDER, 0, -1):
            context = keys >> np.uint64(16)
            names, at = np.unique(context, return_inverse=True)
            totals = np.bincount(at, counts, minlength=len(names))
            kinds = np.bincount(at, minlength=len(names))
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            self.tables[order] = (keys, counts, names, totals, kinds, discount)
            # the next order counts in how many left neighbours its n-gram stands
            mask = np.uint64((1 << 16 * (order - 1)) - 1)
            keys, counts = np.unique(keys & mask, return_counts=True)

    def probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), 1.0 / self.alphabet)
        own, counts, names, totals, kinds, discount = self.tables[order]
        mask = np.uint64((1 << 16 * order) - 1)
        keys = keys & mask
        lower = self.probability(keys, order - 1)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        count = np.where(own[at] == keys, counts[at], 0)
        context = keys >> np.uint64(16)
        at = np.minimum(np.searchsorted(names, context), len(names) - 1)
        known = names[at] == context
        total = np.where(known, totals[at], 1)
        return np.where(known, (np.maximum(count - discount, 0) + discount * kinds[at] * lower) / total, lower)

    def spare(self, contexts: np.ndarray, order: int) -> np.ndarray:
        """What a context of an order leaves to the shorter one; 1 where it is unknown."""
        _, _, names, totals, kinds, discount = self.tables[order]
        at = np.minimum(np.searchsorted(names, contexts), len(names) - 1)
        return np.where(names[at] == contexts, discount * kinds[at] / totals[at], 1.0)


class Scorer:
    """Sorted hash arrays of all languages; bounded by the training sample."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        every = [k for k, _ in counts.values()]
        alphabet = len(np.unique(np.concatenate(every) & np.uint64(0xFFFF))) + 1
        models = [_Model(*counts[name], alphabet) for name in self.languages]
        self.grams, self.contexts = {}, {}
        for order in range(ORDER, 0, -1):
            mask = np.uint64((1 << 16 * order) - 1)
            keys = np.unique(np.concatenate(every) & mask)
            contexts = np.unique(keys >> np.uint64(16))
            self.grams[order] = self._sorted(keys, [np.log(m.probability(keys, order)) for m in models])
            self.contexts[order] = self._sorted(contexts, [np.log(m.spare(contexts, order)) for m in models])
        self.floor = -np.log(alphabet)

    @staticmethod
    def _sorted(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hashes = mix64(keys)
        order = np.argsort(hashes)
        return hashes[order], np.stack(values, 1)[order].astype(np.float32)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray):
        hashes, values = table
        wanted = mix64(keys)
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return hashes[at] == wanted, values[at]

    def logs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each n-gram's last symbol under every language."""
        if order == 0:
            return np.full((len(keys), len(self.languages)), self.floor, np.float32)
        known, out = self._find(self.grams[order], keys)
        rest = np.flatnonzero(~known)
        if len(rest):
            keys = keys[rest]
            seen, spare = self._find(self.contexts[order], keys >> np.uint64(16))
            shorter = keys & np.uint64((1 << 16 * (order - 1)) - 1)
            out[rest] = np.where(seen[:, None], spare, 0) + self.logs(shorter, order - 1)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross entropy per symbol of each text under each language, and its letters."""
        out = np.zeros((len(texts), len(self.languages)))
        letters = np.zeros(len(texts), np.int64)
        for start, stop in portions_of([len(t) for t in texts], 1 << 18):
            seq, starts, letters[start:stop] = symbols(texts[start:stop])
            sums = np.zeros((stop - start, len(self.languages)))
            piece = 1 << 19  # places at a time, so that a very long text needs no more memory
            keys = grams(seq, ORDER)
            owner = np.repeat(np.arange(stop - start), np.diff(starts))
            lead = np.zeros(len(seq), bool)
            lead[(starts[:-1, None] + np.arange(ORDER - 1)).ravel()] = True
            places = np.flatnonzero(~lead)
            for at in range(0, len(places), piece):
                now = places[at:at + piece]
                who = owner[now]
                cuts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                sums[who[cuts]] += np.add.reduceat(self.logs(keys[now]).astype(np.float64), cuts, axis=0)
            out[start:stop] = -sums / np.maximum(1, np.diff(starts) - ORDER + 1)[:, None]
        return out, letters


def _platt(lead: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, with smoothed targets; the slope is positive."""
    good, bad = right.sum(), (~right).sum()
    target = np.where(right, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * lead + shift, -30, 30)))
        weight = p * (1 - p) + 1e-9
        gradient = np.array([((p - target) * lead).sum() + 1e-3 * slope, (p - target).sum() + 1e-3 * shift])
        hessian = np.array([[(weight * lead * lead).sum() + 1e-3, (weight * lead).sum()],
                            [(weight * lead).sum(), weight.sum() + 1e-3]])
        slope, shift = np.array([slope, shift]) - np.linalg.solve(hessian, gradient)
    return max(float(slope), 1e-3), float(shift)


class Classifier:
    """Scorer with its calibration."""

    def __init__(self, scorer: Scorer | None, slope: float, shift: float, limit: float):
        self.scorer, self.slope, self.shift, self.limit = scorer, slope, shift, limit

    def predict(self, texts: list[str]):
        """Language, score, cross entropy and rejection of each text."""
        n = len(texts)
        if self.scorer is None:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        entropy, letters = self.scorer.entropies(texts)
        ordered = np.sort(entropy, axis=1)
        lead = ordered[:, 1] - ordered[:, 0] if entropy.shape[1] > 1 else np.ones(n)
        score = 1 / (1 + np.exp(-np.clip(self.slope * lead + self.shift, -30, 30)))
        best = entropy.argmin(axis=1)
        names = [self.scorer.languages[b] if k else UNKNOWN for b, k in zip(best, letters)]
        rejected = (letters == 0) | (ordered[:, 0] > self.limit)
        return names, np.where(letters > 0, score, 0.0), ordered[:, 0], rejected


def train(docs: DataFrame, sample_docs: int = 500, spare_share: int = 5) -> Classifier:
    """A classifier from at most `sample_docs` documents of each language.

    The sample is chosen by a hash of the ids among documents with text and
    language outside the held-out fold; one in `spare_share` of it calibrates.
    Nothing to learn from gives a classifier that answers `und`.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()
                        & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # First the best of each share of a language, then of those: no task gets a language's rows of all others.
    chosen = usable.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)).alias("share"))
    for keys in (["lang", "share"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id"))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= sample_docs)
    chosen = chosen.select("doc_id", F.col("place") % spare_share == 0)
    chosen = chosen.toDF("doc_id", "spare").dropDuplicates(["doc_id"])
    # at most sample_docs ids per language
    sample = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, 1):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                seq, starts, _ = symbols([t for t, own in zip(texts, langs) if own == name])
                keys = grams(seq, ORDER)
                lead = np.ones(len(seq), bool)
                lead[(starts[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
                keys, counts = np.unique(keys[lead], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)),
                     pa.array(counts)], ["lang", "gram", "n"])

    counted = sample.where(~F.col("spare")).select("lang", "text").mapInArrow(
        giving_back(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = counted.column("lang").to_numpy(zero_copy_only=False) if counted.num_rows else np.zeros(0, object)
    keys = counted.column("gram").to_numpy().view(np.uint64) if counted.num_rows else np.zeros(0, np.uint64)
    totals = counted.column("n").to_numpy() if counted.num_rows else np.zeros(0, np.int64)
    tables = {}
    for name in sorted(set(names.tolist())):
        mine = names == name
        order = np.argsort(keys[mine])
        tables[name] = (keys[mine][order], totals[mine][order])
    if not tables:
        return Classifier(None, 1.0, 0.0, 0.0)
    scorer = Scorer(tables)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, 1):
            entropy, letters = scorer.entropies(batch.column(1).to_pylist())
            ordered = np.sort(entropy, axis=1)
            second = ordered[:, 1] if ordered.shape[1] > 1 else ordered[:, 0] + 1
            best = [scorer.languages[b] for b in entropy.argmin(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(second - ordered[:, 0]), pa.array(ordered[:, 0]),
                 pa.array([a == b for a, b in zip(best, batch.column(0).to_pylist())]),
                 pa.array(letters > 0)], ["lead", "entropy", "right", "letters"])

    spare = sample.where("spare").select("lang", "text").mapInArrow(
        giving_back(measure), "lead double, entropy double, right boolean, letters boolean").where(
            "letters").toArrow()  # at most a share of the sample
    if not spare.num_rows:
        return Classifier(scorer, 1.0, 0.0, np.log(len(scorer.grams[1][0]) + 1))
    lead, entropy, right = (spare.column(c).to_numpy(zero_copy_only=False) for c in ("lead", "entropy", "right"))
    slope, shift = _platt(lead, right.astype(bool))
    return Classifier(scorer, slope, shift, _limit(entropy))


def _limit(entropy: np.ndarray) -> float:
    """The highest cross entropy of a known language.

    Rows far above the 95 % quantile are taken for wrong labels and left out,
    so up to a twentieth of them does not lift the limit.
    """
    middle, high = np.quantile(entropy, [0.5, 0.95], method="lower")
    entropy = entropy[entropy <= high + max(1.0, 10 * (high - middle))]
    spread = float(np.quantile(entropy, 0.99) - np.median(entropy))
    return float(entropy.max()) + max(1.0, 3 * spread)


def predict(docs: DataFrame, model: Classifier) -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    A null text or one without letters is `und` with score 0 and rejected; so is
    every text if nothing was learned. A text whose cross entropy is above the
    calibrated limit keeps its best language but is rejected.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, 2):
            names, score, entropy, rejected = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64()),
                 pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"),
                       F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        giving_back(run), "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_known(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows whose text is not rejected, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, at):
            _, _, _, rejected = model.predict([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(giving_back(run), docs.schema)


def identify(docs: DataFrame, sample_docs: int = 500) -> DataFrame:
    """Train on the documents outside the held-out fold and predict all of them."""
    return predict(docs, train(docs, sample_docs))
