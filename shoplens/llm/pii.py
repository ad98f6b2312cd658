"""Personal data by generated candidates, boosted trees and calibrated thresholds.

Everything runs as DataFrame expressions inside the row. Generators propose
spans with their format and context features: the plain patterns of each kind,
and looser ones. Gradient-boosted trees are trained on all documents, where
a match of a plain pattern is a positive if it passes its kind's check and a
negative if it fails. The trees become one column expression; a threshold,
chosen on documents kept out of the training, selects spans beyond
those the plain patterns and checks already give.

The patterns only repeat character classes, never groups, so that texts of any
length can neither exhaust the matcher's stack nor make it back up: separators
that stand inside a match are first turned into private-use characters.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import in_one_column

KINDS = ["email", "ip", "card", "phone"]
_JOIN, _DOT, _OTHER = "\ue000", "\ue001", "\ue002"
_LOCAL = rf"A-Za-z0-9._%+{_DOT}\-"
EMAIL = (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[A-Za-z0-9\-]++{_DOT})[A-Za-z0-9{_DOT}\-]++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{_JOIN}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_AT = r"(?:\(at\)|\[at\]|\{at\})"
_POINT = r"(?:\.|\(dot\)|\[dot\]|\{dot\})"
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[A-Za-z0-9._%+\-]{{1,64}}+ ?{_AT} ?[A-Za-z0-9\-]{{1,63}}(?: ?{_POINT} ?[A-Za-z0-9\-]{{1,63}}){{1,5}}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z+.\-])(?:\([0-9]{2,4}\) ?|00[0-9]{1,3}[ .\-]|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z])",
}
#: Elements of an array, and code points of a text, that are worked on together.
BLOCK, PIECE = 128, 256
FEATURES = ["email", "ip", "card", "phone", "length", "digits", "others", "luhn", "octets",
            "plus", "joined_before", "joined_after", "keyword"]
KEYWORDS = r"(?i)(tel|phone|fon|fax|mobil|call|mail|contact|card|karte|carte|tarjeta|server|host|\bip\b|téléphone|teléfono)"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column) -> Column:
    """An array in slices of BLOCK elements, an empty one as one empty slice."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK).cast("int")),
                       lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points, each with the 24 before it and one after.

    Taking a part of a string costs its length, so the neighbourhood of a span
    is cut from its piece and never from the whole text. Blanks stand for what
    lies before the start and after the end.
    """
    padded = F.concat(F.lit(" " * 24), text, F.lit(" "))
    large = PIECE * 64

    def parts(n: Column, size: int) -> Column:
        return F.sequence(F.lit(0), F.floor(n / size).cast("int"))

    def small(held: Column, n: Column) -> Column:
        return F.transform(parts(F.least(n, F.lit(large - 1)), PIECE),
                           lambda k: F.substring(held, k * PIECE + 1, F.lit(PIECE + 25)))

    return let(F.struct(padded.alias("text"), F.length(text).alias("n")), lambda v: F.flatten(F.transform(
        parts(v.n, large), lambda j: let(F.substring(v.text, j * large + 1, F.lit(large + 25)),
                                         lambda held: small(held, v.n - j * large)))))


def _hits(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: start and stop in code points, 0-based, and the match."""
    empty = F.expr("cast(array() as array<struct<start: int, stop: int, found: string>>)")
    empties = F.expr("cast(array() as array<array<struct<start: int, stop: int, found: string>>>)")

    def add(held: Column, hit: Column) -> Column:
        start = held.place + hit.gap
        return F.struct((start + F.length(hit.found)).alias("place"), F.array_append(held.hits, F.struct(
            start.alias("start"), (start + F.length(hit.found)).alias("stop"), hit.found.alias("found"))).alias("hits"))

    def add_block(held: Column, block: Column) -> Column:
        return let(F.aggregate(block, F.struct(held.place.alias("place"), empty.alias("hits")), add), lambda done: F.struct(
            done.place.alias("place"), F.array_append(held.blocks, done.hits).alias("blocks")))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"),
                    F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    zipped = let(both, lambda v: F.zip_with(
        F.slice(v.gaps, F.lit(1), F.size(v.found)), v.found,
        lambda gap, found: F.struct(F.length(gap).alias("gap"), found.alias("found"))))
    return F.aggregate(let(zipped, _blocks), F.struct(F.lit(0).alias("place"), empties.alias("blocks")), add_block,
                       lambda held: F.flatten(held.blocks))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits, 19 at most, passes the check sum; false for longer ones."""
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 1, digit).otherwise(twice)
    n = F.length(digits)
    return F.when((n >= 1) & (n <= 19), F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0).otherwise(False)


def _octets(found: Column) -> Column:
    """Whether every number between the points is at most 255."""
    return F.forall(F.split(found, r"\."), lambda part: part.rlike(r"^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})$"))


def _described(hits: Column, kind: str, pieces: Column) -> Column:
    """Hits of a kind with their features and, for the plain patterns, whether they pass."""
    def cut(place: Column, after: int, n: int) -> Column:
        """`n` code points, the first of them 24 before `place` + `after`."""
        return F.substring(F.element_at(pieces, F.floor(place / PIECE).cast("int") + 1),
                           place % PIECE + 1 + after, F.lit(n))

    def one(hit: Column) -> Column:
        found = F.translate(hit.found, _JOIN + _DOT, " .")
        return let(F.struct(hit.start.alias("start"), hit.stop.alias("stop"), found.alias("found"),
                            F.regexp_replace(found, "[^0-9]", "").alias("d")), features)

    def features(hit: Column) -> Column:
        n = F.length(hit.d)
        luhn = _luhn(hit.d) if kind == "card" else F.lit(False)
        octets = _octets(hit.found) if kind == "ip" else F.lit(False)
        before = cut(hit.start, 23, 1)
        valid = {"email": F.lit(True), "ip": octets, "card": (n >= 16) & (n <= 19) & luhn,
                 "phone": (n >= 8) & (n <= 15)}[kind]
        context = cut(hit.start, 0, 24)
        values = [F.lit(kind == k) for k in KINDS] + [
            F.length(hit.found), n, F.length(F.regexp_replace(hit.found, "[0-9A-Za-z]", "")), luhn, octets,
            hit.found.startswith("+"), (hit.start > 0) & before.rlike(r"[\p{L}0-9]"),
            cut(hit.stop, 24, 1).rlike(r"[\p{L}0-9]"), context.rlike(KEYWORDS)]
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), hit.start.alias("start"), hit.stop.alias("stop"),
                        valid.alias("valid"), F.array(*[v.cast("double") for v in values]).alias("x"))

    return F.transform(hits, one)


def _none() -> Column:
    return F.expr("cast(array() as array<struct<kind: int, start: int, stop: int, valid: boolean, x: array<double>>>)")


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with two new columns: `_plain` and `_loose` candidates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.translate(text, _JOIN + _DOT, _OTHER * 2)
    label = r"[A-Za-z0-9\-]"
    dotted = F.regexp_replace(own, rf"(?<={label})\.(?={label})", _DOT)
    joined = F.regexp_replace(own, r"(?<=[0-9])[\x20\-](?=[0-9])", _JOIN)
    has_digit, has_at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    pieces = F.col("_pieces")
    plain = F.concat(
        F.when(has_at, _described(_hits(dotted, EMAIL), "email", pieces)).otherwise(_none()),
        F.when(has_digit, _described(_hits(text, IP), "ip", pieces)).otherwise(_none()),
        F.when(has_digit, _described(_hits(joined, CARD), "card", pieces)).otherwise(_none()),
        F.when(has_digit & F.contains(text, F.lit("+")), _described(
            _hits(text, PHONE), "phone", pieces)).otherwise(_none()))
    loose = F.concat(
        F.when(text.rlike(_AT), _described(_hits(text, LOOSE["email"]), "email", pieces)).otherwise(_none()),
        F.when(has_digit & F.contains(text, F.lit(":")), _described(
            _hits(text, LOOSE["ip"]), "ip", pieces)).otherwise(_none()),
        F.when(has_digit, _described(_hits(text, LOOSE["phone"]), "phone", pieces)).otherwise(_none()))
    held = docs.withColumn("_pieces", F.when(has_digit | has_at | text.rlike(_AT), _pieces(text)))
    return held.withColumns({"_plain": plain, "_loose": loose}).drop("_pieces")


class Trees:
    """Boosted trees as a column expression, and the threshold of their probability."""

    def __init__(self, margin, threshold: float):
        self.margin, self.threshold = margin, threshold

    def selects(self, x: Column) -> Column:
        if self.margin is None:
            return F.lit(False)
        return 1 / (1 + F.exp(-2 * self.margin(x))) >= self.threshold


def _expression(node, x: Column) -> Column:
    """A tree of the learned model as nested conditions."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.element_at(x, split.featureIndex() + 1) <= float(split.threshold()),
                  _expression(node.leftChild(), x)).otherwise(_expression(node.rightChild(), x))


def train(docs: DataFrame, rounds: int = 10, precision: float = 0.98,
          id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from the plain candidates of all documents.

    Candidates with the same features and label are one row with their number as
    its weight. One in four documents, by a hash of the id, only calibrates: the
    threshold is the lowest at which the selected candidates of those documents
    pass their checks with the asked precision (add-one smoothed). If the table
    lacks candidates of either class nothing beyond the plain patterns is ever selected.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_id is not null")
    rows = candidates(own, "_text").select(
        (F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(4)) == 0).alias("spare"), F.explode("_plain").alias("c")).select(
        "spare", F.col("c.valid").cast("double").alias("label"),
        *[F.element_at("c.x", i + 1).alias(n) for i, n in enumerate(FEATURES)])
    rows = rows.groupBy("spare", "label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).cache()
    try:
        sizes = {r.label: r["count"] for r in rows.where("not spare").groupBy("label").count().collect()}
        if not sizes.get(0.0) or not sizes.get(1.0):
            return Trees(None, 1.0)
        model = GBTClassifier(maxIter=rounds, maxDepth=3, seed=7, weightCol="weight").fit(rows.where("not spare"))
        roots, weights = [t._java_obj.rootNode() for t in model.trees], list(model.treeWeights)

        def margin(x: Column) -> Column:
            total = F.lit(0.0)
            for root, weight in zip(roots, weights):
                total = total + F.lit(float(weight)) * _expression(root, x)
            return total

        x = F.array(*[F.col(n) for n in FEATURES])
        found = rows.where("spare").select(
            F.round(1 / (1 + F.exp(-2 * margin(x))), 2).alias("p"), "label", "weight").groupBy("p").agg(
            F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all")).collect()  # at most 101 rows
    finally:
        rows.unpersist()
    good = every = 0.0
    threshold = 0.95
    for row in sorted(found, key=lambda r: -r.p):
        good, every = good + row.good, every + row["all"]
        if (good + 1) / (every + 1) >= precision and row.p >= 0.5:
            threshold = min(threshold, row.p)
    return Trees(margin, threshold)


def find(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The rows with `_base`, the plain spans, and `_spans`, all spans, by kind and start."""
    def span(c: Column) -> Column:
        return F.struct(c.kind.alias("kind"), c.start.alias("start"), c.stop.alias("stop"))

    base = F.transform(F.filter("_plain", lambda c: c.valid), span)
    found = candidates(docs, text_col).withColumn("_base", base)
    more = F.transform(F.filter("_loose", lambda c: trees.selects(c.x) & ~F.exists(
        "_base", lambda b: (b.start < c.stop) & (c.start < b.stop))), span)
    return found.withColumn("_spans", F.array_sort(F.concat("_base", more))).drop("_plain", "_loose")


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.stop.cast("string"))))


def report(docs: DataFrame, trees: Trees | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Counts and digest of the plain spans and the list of all spans of every whole text.

    A null text is an empty one: no spans, the digest of nothing. Without
    `trees` they are trained on the same table.
    """
    trees = trees or train(docs, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda s: s.kind == kind)).cast("long")

    counts = [count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    return find(rows, trees).select(
        "doc_id", *counts, F.sha2(_listed("_base").cast("binary"), 256).alias("base_sha256"),
        _listed("_spans").alias("spans"))


def redact(docs: DataFrame, trees: Trees | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The rows with every span replaced by its kind in brackets; a null text stays null.

    All columns are kept, whatever their names; repeated rows and null ids are
    rows like others, an empty table gives none.
    """
    trees = trees or train(docs, id_col=id_col, text_col=text_col)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = find(in_one_column(docs).withColumn("text", F.col("row")[text_col]), trees, "text")
    text = F.col("text")

    def add_block(held: Column, block: Column) -> Column:
        """The spans of a block, within the part of the text they lie in."""
        end = F.coalesce(F.array_max(F.transform(block, lambda s: s.stop)), held.place)
        part = F.substring(text, held.place + 1, F.greatest(end - held.place, F.lit(0)))

        def add(inner: Column, s: Column) -> Column:
            clear = F.greatest(s.start, inner.place)
            return F.struct(
                F.greatest(s.stop, inner.place).alias("place"), inner["first"].alias("first"), inner.part.alias("part"),
                F.concat(inner.out, F.substring(inner.part, inner.place - inner["first"] + 1,
                                                F.greatest(s.start - inner.place, F.lit(0))),
                         F.when(clear < s.stop, F.element_at(names, s.kind + 1)).otherwise("")).alias("out"))

        return F.aggregate(
            block, F.struct(held.place.alias("place"), held.place.alias("first"), part.alias("part"),
                            F.lit("").alias("out")), add,
            lambda inner: F.struct(inner.place.alias("place"), F.concat(held.out, inner.out).alias("out")))

    by_start = F.array_sort(F.transform("_spans", lambda s: F.struct(s.start, s.stop, s.kind)))
    done = F.aggregate(let(by_start, _blocks), F.struct(F.lit(0).alias("place"), F.lit("").alias("out")), add_block,
                       lambda held: F.concat(held.out, F.substring(text, held.place + 1, F.length(text))))
    return found.withColumn("row", F.col("row").withField(f"`{text_col}`", F.when(
        F.size("_spans") > 0, done).otherwise(text))).select("row.*")
