"""Jaccard join of shingle sets by universe partition (operator 6).

The 64-bit hash space of shingles is cut into segments. Two sets whose similarity reaches the limit differ in at most H
shingles, H following from their sizes, so of more than H segments some are equal. Sizes fall into bands one step of the
limit wide; a set is signed in the segments of its own band and of the band below, so every partner shares a space with
it. Per band a cost estimate picks one of

* exact segments: H + 1 + z of them. Segments of fewer than ``w`` shingles say little, and a set with at most z of those
  signs only its fuller ones: among z + 1 equal segments one is full. A set with more signs all;
* one-deletion neighbourhoods: H // 2 + 1 segments, of which some differs in one shingle at most; each is signed as it
  is and without each of its shingles.

Sets that share a signature are candidates and are verified exactly. Links are wanted as components, so pairs inside one
component are never formed: first every set is compared with its lead, the candidate that shares most signatures with
others, which joins most near copies of one text. Before that, sets go that have too many shingles of their own to be
linked with any candidate. What a set has apart from its lead then bounds its distance to every
other set of that lead, and only pairs of different components that this bound allows are formed and compared. Equal
sets are one set from the start.

Defined results: texts without words have an empty set and are linked with nothing; a text with fewer words than a
shingle is one shingle of all its words, which never equals a longer one; copies share a component; a component of rows
without any doc_id has a null id; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SQL_LOWERED, discard, located, prepare, query, stored, table, without
from .shingles import ODD, ODD2, begins, mixed, shingle_sets

#: Parts of the hash space, as a power of two, in which shingles apart from a lead are counted.
PART_BITS = 4
#: Cost of a chance partner, a signature costing 1.
PARTNER = 0.05
#: Bits of the bitmaps that leave out rows before a join, as a power of two: 16 MB whatever the corpus holds.
BITS = 27
#: 64-bit words of a bitmap that a task puts together at a time.
PAGE = 8192


def poisson_below(mean: float, w: int) -> float:
    return sum(math.exp(-mean) * mean**j / math.factorial(j) for j in range(w))


@lru_cache(maxsize=None)
def bands(num: int, den: int) -> list[int]:
    """First size of each band, up to sizes that no text reaches."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * den // num + 1)
    return out


@lru_cache(maxsize=None)
def allocation(band: int, num: int, den: int, docs: int) -> tuple[int, int, int, bool] | None:
    """(segments, w, z, deletions) of the cheapest plan for a band; None if only equal sets can be linked.

    The cost of a plan is the signatures of a set plus a twentieth per expected chance partner, most of which
    ``may_link`` rules out unseen: all documents where short segments meet by chance, and one in a hundred that has a tenth of
    its shingles in common with it.
    """
    low, high = bands(num, den)[band], bands(num, den)[band + 1] - 1
    most = (high + high * den // num) * (den - num) // (den + num)
    if most == 0:
        return None
    plans = []
    for w in (1, 2, 3, 4):
        for share in (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75):
            z = math.ceil(share * (most + 1))
            m = most + 1 + z
            mean = low / m
            p = poisson_below(mean, w)
            spread = math.sqrt(m * p * (1 - p)) or 1e-9
            weak = 0.5 * math.erfc((z + 0.5 - m * p) / spread / math.sqrt(2))
            common = m * sum(math.exp(-mean) * mean**j / math.factorial(j) * 0.1**j for j in range(w, w + 12))
            plans.append((m + docs * PARTNER * (weak * weak + 0.01 * min(1.0, common)), (m, w, z, False)))
    m = most // 2 + 1
    mean = low / m
    chance = m * math.exp(-2 * mean) * (1 + 2 * mean)
    common = m * math.exp(-0.9 * mean) * (1 + 0.9 * mean) * 0.1
    plans.append((m + high + docs * PARTNER * (min(1.0, chance) + 0.01 * min(1.0, common)), (m, 0, 0, True)))
    return min(plans)[1]


def identities(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    size = np.diff(at).astype(np.uint64)
    out = []
    for odd in (ODD, ODD2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h, odd), dtype=np.uint64)])
        out.append((((sums[at[1:]] - sums[at[:-1]]) * ODD + size) ^ np.uint64(1 << 63)).view(np.int64))
    return out[0], out[1]


def all_signatures(h: np.ndarray, at: np.ndarray, num: int, den: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set in the spaces of its band and of the band below, set after set, and where those of each set begin.

    The sets of a band are signed together.
    """
    sizes = np.diff(at)
    own = np.searchsorted(bands(num, den), sizes, "right") - 1
    owners, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for band in np.unique(np.concatenate([own, own - 1])):
        plan = allocation(int(band), num, den, docs) if band >= 0 else None
        if plan is None:
            continue
        m, w, z, deletions = plan
        some = np.flatnonzero((own == band) | (own == band + 1))
        local = np.repeat(np.arange(len(some)), sizes[some])
        shingle = h[np.arange(len(local)) + np.repeat(at[some] - begins(sizes[some])[:-1], sizes[some])]
        cell = local * m + (((shingle >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        size = np.bincount(cell, minlength=len(some) * m)
        cuts, parts = begins(size), mixed(shingle, ODD)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])
        total = sums[cuts[1:]] - sums[cuts[:-1]]
        space = (np.arange(m, dtype=np.uint64) + (np.uint64(band) << np.uint64(32))) * ODD2
        every = mixed((total.reshape(-1, m) ^ space) + np.uint64(1), ODD2)
        if deletions:
            owners += [np.repeat(some, m), some[local]]
            out += [every.ravel(), mixed(((total[cell] - parts) ^ space[cell % m]) + np.uint64(1), ODD2)]
        else:
            full = size.reshape(-1, m) >= w
            taken = full | ((~full).sum(axis=1) > z)[:, None]
            owners.append(np.repeat(some, taken.sum(axis=1)))
            out.append(every[taken])
    owner = np.concatenate(owners)
    return np.concatenate(out)[np.argsort(owner, kind="stable")], begins(np.bincount(owner, minlength=len(sizes)))


def signatures(h: np.ndarray, num: int, den: int, docs: int) -> np.ndarray:
    """Signatures of one set."""
    return all_signatures(h, np.array([0, len(h)]), num, den, docs)[0]


def lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


class Join:
    """Parameters of a join: words of a shingle and the similarity num / den."""

    def __init__(self, size: int, num: int, den: int, docs: int, bits: int = BITS) -> None:
        self.size, self.num, self.den, self.docs, self.bits = size, num, den, docs, bits
        self.shared: Broadcast | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "shared": None}  # tasks get a bitmap by itself

    def signed(self, docs: DataFrame) -> DataFrame:
        """Per document _file, _row, doc_id, n, set, check and all its signatures; texts are cut here once."""
        kind = docs.schema["doc_id"].dataType.simpleString()

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, end, h, at in shingle_sets(batch.column(3), self.size):
                    cols = [pa.array(np.diff(at)), *map(pa.array, identities(h, at)), lists(*all_signatures(h, at, self.num, self.den, self.docs))]
                    head = batch.slice(first, end - first).columns[:3]
                    yield pa.RecordBatch.from_arrays([*head, *cols], ["_file", "_row", "doc_id", "n", "set", "check", "sigs"])

        schema = f"_file string, _row bigint, doc_id {kind}, n bigint, set bigint, check bigint, sigs array<bigint>"
        return docs.select("_file", "_row", "doc_id", "text").mapInArrow(sign, schema)

    def bitmap(self, values: DataFrame) -> Broadcast:
        """Bitmap of a column of 64-bit hashes, merged in tasks; its pages, 2^bits / 8 bytes together, pass the driver."""
        words = min(PAGE, 1 << self.bits >> 6)
        v = F.col(values.columns[0]).bitwiseAND((1 << self.bits) - 1)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(63).cast("int"))
        merged = values.groupBy(F.shiftright(v, 6).alias("i")).agg(F.bit_or(bit).alias("w"))

        def page(key: tuple, part: pa.Table) -> pa.Table:
            out = np.zeros(words, np.int64)
            out[part["i"].to_numpy() % words] = part["w"].to_numpy()
            return pa.table({"page": [key[0].as_py()], "bits": pa.array([out.tobytes()], pa.binary())})

        pages = merged.withColumn("page", F.floor(F.col("i") / words)).groupBy("page").applyInArrow(page, "page bigint, bits binary")
        out = np.zeros(1 << self.bits >> 6, np.uint64)
        for r in pages.toLocalIterator():
            out[r.page * words : (r.page + 1) * words] = np.frombuffer(r.bits, np.uint64)
        self.shared = values.sparkSession.sparkContext.broadcast(out)
        return self.shared

    def stored(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` written; the bitmap that they were made with goes."""
        rows = stored(rows, name)
        self.shared.destroy()
        return rows

    def known(self, bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Which of ``values`` the bitmap may hold."""
        p = values & np.uint64((1 << self.bits) - 1)
        return ((bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)

    def members(self, signed: DataFrame, shared: DataFrame) -> DataFrame:
        """``signed`` with those of its signatures that it may share."""
        bitmap = self.bitmap(shared)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sigs = batch.column(6)
                some = self.known(bitmap.value, sigs.flatten().to_numpy().view(np.uint64))
                before = np.concatenate([np.zeros(1, np.int64), np.cumsum(some)])
                at = np.concatenate([np.zeros(1, np.int64), np.cumsum(sigs.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                left = pa.ListArray.from_arrays(pa.array(before[at], pa.int32()), sigs.flatten().filter(pa.array(some)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], left], batch.schema.names)

        return signed.mapInArrow(keep, signed.schema)

    def fetched(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        """``wanted`` (set, n, _file, _row) with the shingles of those rows of ``docs``; only their texts are cut again."""
        row = F.xxhash64("_file", "_row")
        bitmap = self.bitmap(wanted.select(row.alias("id")))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = batch.filter(pa.array(self.known(bitmap.value, batch.column(3).to_numpy().view(np.uint64))))
                for first, end, h, at in shingle_sets(some.column(2), self.size):
                    part = some.slice(first, end - first)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(h, at)], ["_file", "_row", "shingles"])

        rows = docs.select("_file", "_row", "text", row.alias("id")).mapInArrow(cut, "_file string, _row bigint, shingles array<bigint>")
        return rows.join(wanted, ["_file", "_row"]).select("set", "n", "shingles")

    def reach(self, na: Column, nb: Column) -> Column:
        """How many shingles linked sets of these sizes may differ in."""
        return F.floor((na + nb) * (self.den - self.num) / (self.den + self.num))

    def alike(self, na: Column, nb: Column, same: Column | None = None) -> Column:
        """Whether sets with ``same`` common shingles are linked, or may be by their sizes alone."""
        same = F.least(na, nb) if same is None else same
        return self.den * same >= self.num * (na + nb - same)

    def compared(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with sizes na and nb, the number ``same`` of common shingles, and ``apart``, those of one set only."""
        one = pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("sa")), "a")
        both = one.join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("sb")), "b")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for sa, sb in zip(batch.column(2), batch.column(3)):
                    x, y = sa.values.to_numpy(), sb.values.to_numpy()
                    apart = np.setxor1d(x, y, assume_unique=True)
                    rows.append((len(x), len(y), (len(x) + len(y) - len(apart)) // 2, apart))
                cols = list(zip(*rows)) or [[]] * 4
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], ["a", "b", "na", "nb", "same", "apart"])

        return both.select("a", "b", "sa", "sb").mapInArrow(compare, "a bigint, b bigint, na bigint, nb bigint, same bigint, apart array<bigint>")

    def may_link(self, sets: DataFrame) -> DataFrame:
        """``sets`` without those that have more shingles of their own than a linked set may have.

        Counting them in a part of the hash space, two and a half times the share that may differ, is enough to tell.
        """
        parts = min(16, math.ceil(40 * (self.den - self.num) / self.den))
        some = F.filter("shingles", lambda t: F.shiftrightunsigned(t, 60) < parts)
        once = sets.select("set", F.explode(some).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("k"), F.min("set").alias("set")).filter("k = 1")
        own = once.groupBy("set").agg(F.count(F.lit(1)).alias("own"))
        enough = (F.col("n") - F.coalesce("own", F.lit(0))) * self.den >= self.num * F.col("n")
        return sets.join(own, "set", "left").filter(enough).drop("own")

    def leads(self, held: DataFrame) -> DataFrame:
        """set, lead: of the sets that share a signature with a set, the one in the fullest company; the set itself if it is."""
        company = held.groupBy("sig").agg(F.count(F.lit(1)).alias("c"))
        mass = held.join(company, "sig").groupBy("set").agg(F.sum("c").alias("mass"))
        massed = stored(held.join(mass, "set"), "massed")
        first = massed.groupBy("sig").agg(F.max(F.struct("mass", "set")).alias("lead"))
        return massed.join(first, "sig").groupBy("set").agg(F.max("lead").alias("lead")).select("set", F.col("lead.set").alias("lead"))

    def placed(self, led: DataFrame, star: DataFrame, sets: DataFrame) -> DataFrame:
        """set, lead, n, far (shingles apart from the lead), common (those of them that another set of the lead has apart too,
        counted by part of the hash space), open.

        Two sets of one lead differ in far + far' less twice what they have apart in common, which in each part is at most
        the smaller ``common``. A set is open if by that bound some set of its lead may be linked with it.
        """
        parts = range(1 << PART_BITS)
        part = F.shiftrightunsigned("t", 64 - PART_BITS)
        counts = F.array(*[F.sum((part == p).cast("int")) for p in parts])
        tokens = star.select(F.col("b").alias("lead"), F.col("a").alias("set"), F.explode("apart").alias("t"))
        once = tokens.groupBy("lead", "t").agg(F.count(F.lit(1)).alias("k"), F.min("set").alias("set")).filter("k = 1")
        private = once.groupBy("lead", "set").agg(counts.alias("own"))
        apart = F.transform("apart", lambda t: F.shiftrightunsigned(t, 64 - PART_BITS))
        every = F.array(*[(F.size("apart") - F.size(F.array_remove(apart, F.lit(p).cast("long")))) for p in parts])
        away = star.select(F.col("a").alias("set"), F.col("b").alias("lead"), F.col("na").alias("n"), F.size("apart").alias("far"), every.alias("every"))
        away = away.join(private, ["lead", "set"], "left")
        common = F.array(*[(F.col("every")[p] - F.coalesce(F.col("own")[p], F.lit(0))).cast("int") for p in parts])
        away = away.select("set", "lead", "n", "far", common.alias("common"))
        none = F.array(*[F.lit(0) for _ in parts])
        at = led.filter("set = lead").join(sets.select("set", "n"), "set").select("set", "lead", "n", F.lit(0).alias("far"), none.alias("common"))
        rows = stored(away.union(at), "placed")
        most = rows.groupBy("lead").agg(F.max(2 * sum(F.col("common")[p] for p in parts) - F.col("far")).alias("most"))
        partner = F.floor(F.col("n") * self.den / self.num)
        return rows.join(most, "lead").withColumn("open", F.col("far") <= self.reach(F.col("n"), partner) + F.greatest("most", F.lit(0))).drop("most")

    def left_over(self, held: DataFrame, labels: DataFrame, places: DataFrame) -> DataFrame:
        """a, b: pairs of one signature and two components that the bounds do not rule out."""
        rows = stored(held.join(labels, "set").join(places, "set"), "open-signatures")
        differ = F.min("label") != F.max("label")
        other = [F.col(c).alias(f"other_{c}") for c in ("set", "label", "lead", "n", "far", "common")]
        new = (F.col("set") < F.col("other_set")) & (F.col("label") != F.col("other_label")) & self.alike(F.col("n"), F.col("other_n"))
        both = sum(F.least(F.col("common")[p], F.col("other_common")[p]) for p in range(1 << PART_BITS))
        near = F.col("far") + F.col("other_far") - 2 * both <= self.reach(F.col("n"), F.col("other_n"))

        inside = rows.filter("open")
        inside = stored(inside.join(inside.groupBy("sig", "lead").agg(differ.alias("go")).filter("go").drop("go"), ["sig", "lead"]), "open-inside")
        a = inside.join(inside.select("sig", *other).withColumn("lead", F.col("other_lead")), ["sig", "lead"]).filter(new & near)
        across = rows.groupBy("sig").agg((differ & (F.min("lead") != F.max("lead"))).alias("go")).filter("go").drop("go")
        across = stored(rows.join(across, "sig"), "open-across")
        b = across.join(across.select("sig", *other), "sig").filter(new & (F.col("lead") != F.col("other_lead")))
        pairs = [side.select(F.col("set").alias("a"), F.col("other_set").alias("b")) for side in (a, b)]
        return pairs[0].union(pairs[1]).distinct()


def grown(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (set, label) after merging the components that ``links`` (a, b) join; the label is the smallest set.

    Each round hooks every root to its smallest neighbour and follows the hooks to their ends, which at least halves the
    roots that still have a neighbour.
    """
    while True:
        a = links.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").filter("la != lb").select("la", "lb").distinct()
        a = stored(a.union(a.select("lb", "la")), "root-links")
        if a.isEmpty():
            return labels
        hooks = stored(a.groupBy(F.col("la").alias("root")).agg(F.min("lb").alias("low")).select("root", F.least("root", "low").alias("up")), "hooks")
        while True:
            further = hooks.select(F.col("root").alias("up"), F.col("up").alias("top"))
            jumped = stored(hooks.join(further, "up", "left").select("root", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved")), "hooks")
            hooks = jumped.select("root", "up")
            if jumped.filter("moved").isEmpty():
                break
        labels = stored(labels.join(hooks.toDF("label", "up"), "label", "left").select("set", F.coalesce("up", "label").alias("label")), "labels")


def told_apart(signed: DataFrame) -> DataFrame:
    """``signed`` with another ``set`` for those of one hash that are different sets by ``check``."""
    twins = signed.groupBy("set").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low != high").select("set")
    twins = stored(twins, "twin-sets")
    if twins.isEmpty():
        return signed
    known = twins.withColumn("twin", F.lit(True))
    out = signed.join(known, "set", "left").withColumn("set", F.when(F.col("twin"), F.xxhash64("set", "check")).otherwise(F.col("set")))
    apart = stored(out.select(*signed.columns), "signed")
    discard(signed)
    return told_apart(apart)


def _components(docs: DataFrame, size: int, num: int, den: int, bits: int) -> DataFrame:
    """Per row of located ``docs``: _file, _row, doc_id, n, set, check and label (null where no set is near)."""
    prepare(docs.sparkSession)
    join = Join(size, num, den, docs.count(), bits)
    signed = told_apart(stored(join.signed(docs), "signed"))
    shared = signed.select("set", F.explode("sigs").alias("sig")).groupBy("sig").agg(F.min("set").alias("low"), F.max("set").alias("high")).filter("low != high")
    shared = stored(shared, "shared-signatures")
    rows = join.stored(join.members(signed, shared.select("sig")), "members")
    discard(signed)
    # Chance hits of the bitmap fall out here: only signatures of several sets are kept.
    signed = rows.select("set", F.explode("sigs").alias("sig")).distinct()
    met = stored(signed.join(shared.select("sig"), "sig"), "met-signatures")
    # One row per set before the join: copies of a text would meet in one task.
    own = rows.groupBy("set").agg(F.min(F.struct("_file", "_row", "n")).alias("at")).select("set", "at.n", "at._file", "at._row")
    wanted = stored(own.join(met.select("set").distinct(), "set", "left_semi"), "near-sets")
    every = join.stored(join.fetched(docs, wanted), "all-sets")
    sets = stored(join.may_link(every), "sets")
    discard(every, wanted, shared)
    held = met.join(sets.select("set"), "set")
    several = held.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("sig")
    held = stored(held.join(several, "sig"), "held-signatures")
    discard(met)
    labels = stored(held.select("set").distinct().select("set", F.col("set").alias("label")), "labels")
    linked = join.alike(F.col("na"), F.col("nb"), F.col("same"))
    led = stored(join.leads(held), "leads")
    star = stored(join.compared(led.filter("set != lead").select(F.col("set").alias("a"), F.col("lead").alias("b")), sets), "star")
    labels = grown(labels, star.filter(linked).select("a", "b"))
    left = join.left_over(held, labels, join.placed(led, star, sets))
    known = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = stored(left.join(known, ["a", "b"], "left_anti"), "left-over")
    labels = grown(labels, stored(join.compared(left, sets).filter(linked).select("a", "b"), "links"))
    return rows.drop("sigs").join(labels, "set", "left")


def components(docs: DataFrame, size: int = 3, num: int = 9, den: int = 10, bits: int = BITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): _file, _row, doc_id, n_shingles and component_id, for shingles of ``size`` words and similarity num / den."""
    return _named(_components(located(docs), size, num, den, bits))


def _named(rows: DataFrame) -> DataFrame:
    group = F.coalesce("label", "set")
    rows = rows.withColumns({"group": group, "apart": F.when(F.col("label").isNull(), F.col("check"))})
    of_set = rows.groupBy("group", "apart").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("doc_id", "_file", "_row")).alias("first"))
    ids = of_set.select(F.col("group"), F.coalesce("apart", F.lit(0)).alias("apart"), "component_id", "first")
    named = rows.withColumn("apart", F.coalesce("apart", F.lit(0))).join(ids, ["group", "apart"])
    alone = F.col("n") == 0
    own = F.struct("doc_id", "_file", "_row")
    return named.select(
        "_file", "_row", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | own.eqNullSafe(F.col("first"))).alias("first"),
    )


def drop_near_copies(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with the first row of each component, columns as they were."""
    docs = located(docs)
    return without(docs, _named(_components(docs, size, num, den, BITS)).filter("not first"))


@query(
    "op6_ngram_join",
    r"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
    c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
    both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    r(doc_id, other) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, y FROM r JOIN both_ways ON other = x)
    SELECT t.doc_id, coalesce(any_value(c.n), 0)::BIGINT AS n_shingles, min(other) AS component_id
    FROM t JOIN r ON r.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id GROUP BY t.doc_id
    """.replace("{LOWERED}", SQL_LOWERED),
)
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
