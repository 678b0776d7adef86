"""Personal data by boosted candidate scoring (operator 3), all in DataFrame, SQL and Spark ML operations.

Base rules find e-mail addresses, IP numbers, card numbers and phone numbers. Beside them generators of high recall
propose overlapping candidates of the same kinds: digit groups, phone layouts, card layouts, dotted quads and written-out
addresses. Boosted trees, trained on candidates whose label is whether a base rule confirms them, score each candidate
by its format, its checksums and what stands around it. On candidates left out of training, the lowest score is sought
per generator above which the confirmed share is at least ``PRECISION``, and never below one half; candidates above it that overlap no base span
are added, of overlapping ones the best. The trees become one SQL expression, so scoring is a projection.

Defined results: a null or empty text has no span; base matches that fail a check use up their characters; without
candidates of both labels nothing is added; equal scores prefer the longer, then the earlier span; repeated rows get a
row each; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import prepare, query, stored, table, text_of

# The base patterns. Possessive forms of them match the same and never backtrack; a match may start inside
# a run of its first class only where the match before it ended.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

# Generators of candidates.
GENERATORS = {
    "number_like": r"[+(]{0,2}[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+",
    "phone_like": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "card_like": r"(?<![0-9])(?:(?:[0-9]{4}[\x20-]){3}[0-9]{1,4}|[0-9]{13,19})(?![0-9])",
    "ip_like": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "email_like": rf"(?<![{LOCAL}])[{LOCAL}]++\x20?(?:@|[(\[]\x20?at\x20?[)\]])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]\x20?dot\x20?[)\]])\x20?[A-Za-z0-9-]++)++",
}
#: Characters before a candidate in which a cue may stand.
CONTEXT = 24
CUE = r"(?i)(?:tel|phone|call|fax|mobile|cell|contact|card|visa|account|mail|host|addr|ip)[^a-z]*$"
#: Different candidates for training the trees, in expectation: the bound of the sample. Share of confirmed ones above a threshold.
SAMPLE, PRECISION = 20_000, 0.95
TREES, DEPTH = 10, 3
#: Rounds in which all spans that are best among their neighbours are taken together; what is left after them is taken one by one.
ROUNDS = 3


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def pieces(items: Column) -> Column:
    """An array as arrays of about the root of its size, so that work that grows with the square of a piece stays small."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))

    def cut(p: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(p.all) - 1) / p.size).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(p.all, i * p.size + 1, p.size))

    return bound(F.struct(items.alias("all"), size.alias("size")), cut)


def sums_before(numbers: Column) -> Column:
    """struct(at, out): the sum of a short array and the sums before each entry."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(numbers, start, lambda acc, n: F.struct((acc.at + n).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")))


def starts(sizes: Column) -> Column:
    """Sums before each entry of an array of any length that is not empty."""

    def shifted(parts: Column) -> Column:
        ahead = sums_before(F.transform(parts, lambda p: p.at)).out
        return F.flatten(F.zip_with(parts, ahead, lambda p, o: F.transform(p.out, lambda x: x + o)))

    return bound(F.transform(pieces(sizes), sums_before), shifted)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of start, end (code points, end exclusive), value, before and after.

    The text is cut by the pattern once; places are running sums of the lengths of gaps and matches.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    def spans(p: Column) -> Column:
        def span(value: Column, i: Column) -> Column:
            gap = p.gaps[i]
            begin = p.at[i] + F.length(gap)
            return F.struct(
                begin.alias("start"), (begin + F.length(value)).alias("end"), value.alias("value"), F.substring(gap, -CONTEXT, CONTEXT).alias("before"),
                F.substring(p.gaps[i + 1], 1, 1).alias("after"),
            )

        return F.transform(p.found, span)

    def placed(p: Column) -> Column:
        at = starts(F.transform(p.found, lambda v, i: F.length(v) + F.length(p.gaps[i])))
        return F.when(F.size(p.found) > 0, bound(F.struct(p.found.alias("found"), p.gaps.alias("gaps"), at.alias("at")), spans)).otherwise(empty)

    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return bound(cut, placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1))
        return acc + F.when(i % 2 == 0, F.translate(d, "123456789", "246813579")).otherwise(d).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def passes_luhn(value: Column) -> Column:
    number = digits(value)
    return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)


def parts_fit(value: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


VALID = {
    "email": lambda v: F.lit(True),
    "ip": parts_fit,
    "card": passes_luhn,
    "phone": lambda v: F.length(digits(v)).between(9, 15),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: What a text must contain before a pattern is tried on it.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def base_spans(text: Column, kind: str) -> Column:
    valid = F.filter(matches(text, PATTERNS[kind]), lambda m: VALID[kind](m.value))
    found = F.transform(valid, lambda m: F.struct(F.lit(kind).alias("kind"), m.start.alias("start"), m.end.alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    has_digit = text.rlike("[0-9]") if kind != "email" else F.lit(True)
    return F.when(has_digit & (text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)), found).otherwise(none)


def features(generator: int, m: Column) -> Column:
    """Format, checksum and context of a candidate."""
    before, number = F.substring(m.before, -1, 1), digits(m.value)

    def flag(c: Column) -> Column:
        return c.cast("double")

    return F.array(
        F.lit(float(generator)), F.length(m.value).cast("double"), F.length(number).cast("double"), F.size(F.split(m.value, "[^0-9]+")).cast("double"),
        flag(m.value.startswith("+")), flag(m.value.contains("(")), F.length(F.regexp_replace(m.value, r"[^.]", "")).cast("double"), flag(m.value.contains("@")),
        flag(passes_luhn(m.value)), flag(parts_fit(m.value)), flag(before.rlike(r"[\w=\"'#/]")), flag(before.rlike(r"[0-9.+-]")), flag(m.after.rlike(r"[\w\"'/]")),
        flag(m.before.rlike(CUE)), F.size(F.array_distinct(F.split(number, ""))).cast("double"),
    )


def candidates(text: Column, name: str) -> Column:
    generator = list(GENERATORS).index(name)
    found = F.transform(
        matches(text, GENERATORS[name]),
        lambda m: F.struct(F.lit(name).alias("kind"), m.start.alias("start"), m.end.alias("end"), features(generator, m).alias("f")),
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int,f:array<double>>>")
    needed = text.rlike("@|at[ )\\]]") if name == "email_like" else text.rlike("[0-9][^A-Za-z]*[0-9]")
    return F.when(needed, found).otherwise(none)


def tree_column(lines: list[str], f: Column) -> Column:
    """A printed regression tree as an expression over the features; ``lines`` is used up."""
    line = lines.pop(0).strip()
    if leaf := re.match(r"Predict: (\S+)", line):
        return F.lit(float(leaf[1]))
    split = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    below = tree_column(lines, f)
    lines.pop(0)  # Else
    return F.when(f[int(split[1])] <= float(split[2]), below).otherwise(tree_column(lines, f))


class Scorer:
    """The trees as an expression and the threshold of each generator."""

    def __init__(self, trees: list[tuple[float, list[str]]], thresholds: dict[str, float]) -> None:
        self.trees, self.thresholds = trees, thresholds

    def score(self, f: Column) -> Column:
        margin = F.lit(0.0)
        for weight, lines in self.trees:
            margin = margin + weight * tree_column(list(lines), f)
        return 1 / (1 + F.exp(-2 * margin))

    def threshold(self, kind: Column) -> Column:
        out = F.lit(2.0)
        for name, least in self.thresholds.items():
            out = F.when(kind == name, least).otherwise(out)
        return out


def train(found: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Scorer | None:
    """Trees and thresholds from ``found`` (base, candidates).

    The trees see a bounded sample of the different candidates, at most half of them; the thresholds count every other row.
    """
    base = F.struct(nearby(F.col("base")).alias("near"), F.xxhash64("base").alias("hash"))

    def labelled(b: Column) -> Column:
        def one(c: Column) -> Column:
            confirmed = met(b.near, c, lambda o: (o.start == c.start) & (o.end == c.end))
            return F.struct(c.kind.alias("kind"), c.f.alias("f"), confirmed.cast("double").alias("label"), F.xxhash64(b.hash, c).alias("h"))

        return F.transform("candidates", one)

    rows = found.select(F.explode(bound(base, labelled)).alias("c")).select("c.*")
    different = rows.agg(F.approx_count_distinct("h")).first()[0]
    if different == 0:
        return None
    learned = F.pmod("h", F.lit(1 << 40)) < int(min(0.5, sample / different) * (1 << 40))
    rows_learned = stored(rows.filter(learned).dropDuplicates(["h"]), "candidates")
    if rows_learned.select("label").distinct().count() < 2:
        return None
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxMemoryInMB=64).fit(rows_learned.select(array_to_vector("f").alias("features"), "label"))
    trees = [(w, t.toDebugString.strip().split("\n")[1:]) for w, t in zip(fitted.treeWeights, fitted.trees)]
    scorer = Scorer(trees, {})
    bins = rows.filter(~learned).groupBy("kind", F.floor(scorer.score(F.col("f")) * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"))
    by_kind: dict[str, list] = {}
    for r in bins.collect():
        by_kind.setdefault(r.kind, []).append(r)
    for kind, found_bins in by_kind.items():
        n = good = 0
        for r in sorted(found_bins, key=lambda r: -r.bin):
            n, good = n + r.n, good + r.good
            if r.bin >= 500 and good >= precision * n:
                scorer.thresholds[kind] = r.bin / 1000
    return scorer


def nearby(spans: Column) -> Column:
    """Spans sorted by start, in pieces with the first start and the last end of each."""

    def piece(part: Column) -> Column:
        return F.struct(F.element_at(part, 1).start.alias("low"), F.array_max(F.transform(part, lambda s: s.end)).alias("high"), part.alias("part"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.alias("span"))))
    return bound(F.filter(pieces(ordered), lambda part: F.size(part) > 0), lambda parts: F.transform(parts, piece))


def met(near: Column, c: Column, test: Callable[[Column], Column]) -> Column:
    """Whether ``test`` holds for a span of ``near`` that overlaps ``c``; pieces that lie elsewhere are skipped."""
    return F.exists(near, lambda k: (k.low < c.end) & (c.start < k.high) & F.exists(k.part, lambda o: (o.start < c.end) & (c.start < o.end) & test(o)))


def one_by_one(spans: Column) -> Column:
    """The spans from the best down, without those that overlap one taken before."""
    down = F.reverse(F.array_sort(F.transform(spans, lambda c: F.struct(rank(c).alias("rank"), c.alias("span")))))

    def take(out: Column, c: Column) -> Column:
        return F.when(F.exists(out, lambda o: (o.start < c.span.end) & (c.span.start < o.end)), out).otherwise(F.concat(out, F.array(c.span)))

    return F.aggregate(down, F.filter(spans, lambda c: F.lit(False)), take)


def chosen(spans: Column) -> Column:
    """Of overlapping spans the best, then of the others that overlap none of those the best, and so on until none is left.

    Long chains in which each span is better than the one before take a round per link; they are ended by ``one_by_one``.
    """
    none = F.filter(spans, lambda c: F.lit(False))

    def step(acc: Column, _: Column) -> Column:
        def pick(left: Column) -> Column:
            best = bound(nearby(left), lambda near: F.filter(left, lambda c: ~met(near, c, lambda o: rank(o.span) > rank(c))))
            return bound(best, lambda won: bound(nearby(won), lambda near: F.struct(
                F.concat(acc.out, won).alias("out"), F.filter(left, lambda c: ~met(near, c, lambda o: F.lit(True))).alias("left"))))

        return F.when(F.size(acc.left) > 0, bound(acc.left, pick)).otherwise(acc)

    start = F.struct(none.alias("out"), spans.alias("left"))
    def rest(acc: Column) -> Column:
        return F.when(F.size(acc.left) > 0, F.concat(acc.out, one_by_one(acc.left))).otherwise(acc.out)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, rest)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, base (array of kind, start, end by kind as listed, then start) and added (likewise, with score)."""
    prepare(docs.sparkSession)
    text = F.col("text")
    base = F.concat(*[base_spans(text, k) for k in BASE])
    found = docs.select("doc_id", text_of().alias("text")).select("doc_id", base.alias("base"), F.concat(*[candidates(text, g) for g in GENERATORS]).alias("candidates"))
    found = stored(found, "spans")
    scorer = train(found)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    if scorer is None:
        return found.select("doc_id", "base", none.alias("added"))
    scored = F.transform("candidates", lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"), scorer.score(c.f).alias("score")))
    sure = F.filter(scored, lambda c: c.score >= scorer.threshold(c.kind))
    free = bound(nearby(F.col("base")), lambda near: F.filter("sure", lambda c: ~met(near, c, lambda o: F.lit(True))))
    out = found.select("doc_id", "base", sure.alias("sure")).select("doc_id", "base", F.when(F.size("sure") > 0, free).otherwise(none).alias("free"))
    return out.select("doc_id", "base", F.when(F.size("free") > 1, F.array_sort(chosen(F.col("free")))).otherwise(F.col("free")).alias("added"))


def rank(c: Column) -> Column:
    return F.struct(c.score, c.end - c.start, -c.start, c.kind)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s.kind)
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    every = F.array_join(F.filter(F.array(joined(F.col("base")), joined(F.col("added"))), lambda s: s != ""), ",")
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), every.alias("spans"))
