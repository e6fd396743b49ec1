"""SimHash near-dedup of texts of a given shingle similarity.

The narrow operator of :mod:`corpusmill.llm.simhash` links 64-bit fingerprints
of at most two differing bits, which only texts of a similarity of about 0.97
have. For texts that share four fifths of their shingles, this one takes a
wide SimHash of the set of shingles. Two texts of Jaccard similarity J have
sets at an angle of arccos(2J / (1 + J)), and differ in that share of pi of
their bits.

Candidates come from the same deletion-variant index: the bits are cut into
segments, and of every segment the whole and the variants with one bit deleted
are indexed. A bit that two similar texts differ in is one that few shingles
decide in either, so only the ``SOFT`` least decided bits of a segment are
deleted. Texts that share a variant are compared over all bits. Far fewer
differing bits than the similarity implies make a link; all others up to far
more are settled by the exact Jaccard similarity of the two texts.

The number of texts sets the index (:func:`plan_for`): a segment has 4 bits
more than their logarithm, so the unlike texts that one meets by chance stay
as few at any size, and as many segments are cut as give a lone pair at the
similarity asked for a chance of ``RECALL`` to share a variant, by the bit
model. Classes close over chains of links, which finds more. The bit model
needs many shingles: two texts of few (below 10 at a similarity of 0.8) are
linked exactly, by the sets that are left when one shingle is taken away.

Only distinct fingerprints are indexed, in passes of ``PASS_ROWS`` rows a
fingerprint, so that disk is bounded. Texts that are known to be of one class
are not compared again. First, in ``ROUNDS`` rounds, each fingerprint meets
the ``LEADS`` that it shares most variants with, among the best connected
holder of each variant. Then all members of all classes that share a variant
are compared, block by block in Arrow batches: classes are passed over only
where sizes, or the triangle inequality over their roots, leave no pair of
members within the bound. A variant that many share (found by a sample of
fingerprints) is salted, and its classes are dealt out in blocks, so it is
never gathered in a task.

Defined results: texts without words have no shingle and form classes of their
own; fewer words than a shingle make one shingle of all; repeated rows come
back once each; a null identifier is the least of its class only if it has no
other; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .simhash import bit_sums

#: Words of 64 bits at least, bits of a segment at least, and bits of it that are deleted in turn.
WORDS, LEAST_WIDTH, SOFT = 12, 16, 6
#: Chance of a lone pair at the similarity asked for to share a variant, by the bit model.
RECALL = 0.97
#: Rows of the index that a fingerprint has in one pass.
PASS_ROWS = 112
#: Fingerprints sampled to find variants that many share; of them, so many make one hot. Its salts.
SAMPLED, SHARED, SALTS = 2_000, 8, 64
#: Classes of one variant up to which all of them are paired within one row.
CROWD = 512
#: Members, and shingles of them, that a row has when classes are compared.
BLOCK, BLOCK_SHINGLES = 256, 1 << 17
#: Shingles that two blocks are compared by at a time.
CHUNK = 1 << 13
#: Rounds in which each fingerprint meets so many leads, before variants are searched by class.
ROUNDS, LEADS = 2, 2
#: Standard deviations of the bit count under and over its mean within which the exact similarity decides.
UNDER, OVER = 4.0, 4.0
#: Texts of fewer shingles are never linked by their bits alone.
SURE_SIZE = 64
#: Rows of a join's smaller side (some 200 bytes each) up to which it is broadcast.
BROADCAST_TEXTS = 100_000
#: Size classes of a doubling; sizes ride in so many bits of an index row.
SIZE_STEPS, SIZE_BITS = 9, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """An index: ``segments`` of ``width`` bits, a chance of ``found`` for each to show a pair at the similarity."""

    similarity: float
    width: int
    segments: int
    found: float

    @property
    def words(self) -> int:
        return max(WORDS, -(-self.width * self.segments // 64))

    @property
    def bits(self) -> tuple[int, int]:
        """(most bits of a sure link, most bits of a possible one)."""
        n, share = 64 * self.words, share_of_bits(self.similarity)
        deviation = math.sqrt(n * share * (1 - share))
        return math.floor(n * share - UNDER * deviation), math.ceil(n * share + OVER * deviation)

    @property
    def steps(self) -> int:
        """Most size classes between two texts of the similarity."""
        return math.floor(SIZE_STEPS * math.log2(1 / self.similarity) + 1e-9) + 1

    @property
    def passes(self) -> list[tuple[int, int]]:
        each = max(1, PASS_ROWS // (SOFT + 1))
        return [(i, min(i + each, self.segments)) for i in range(0, self.segments, each)]


def share_of_bits(similarity: float) -> float:
    """Share of the bits in which two sets of a Jaccard similarity differ."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


@lru_cache(maxsize=64)
def plan_of_width(width: int, similarity: float) -> Plan:
    """Segments needed; the chance that a differing bit is soft on both sides is drawn with a fixed seed."""
    p, cosine = share_of_bits(similarity), 2 * similarity / (1 + similarity)
    rng = np.random.default_rng(0)
    x = rng.standard_normal(400_000)
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * rng.standard_normal(len(x))
    differ = (x > 0) != (y > 0)
    found = (1 - p) ** width
    if differ.any() and not differ.all():
        same = rng.integers(0, (~differ).sum(), (10_000, width - 1))
        one = rng.integers(0, differ.sum(), 10_000)
        soft = [(np.abs(z[~differ])[same] < np.abs(z[differ])[one][:, None]).sum(1) < SOFT for z in (x, y)]
        found += width * p * (1 - p) ** (width - 1) * float((soft[0] & soft[1]).mean())
    return Plan(similarity, width, math.ceil(math.log(1 - RECALL) / math.log(1 - min(found, 1 - 1e-9))), found)


def plan_for(n: int, similarity: float) -> Plan:
    """The index for ``n`` texts."""
    return plan_of_width(min(48, max(LEAST_WIDTH, round(math.log2(max(n, 1))) + 4)), similarity)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, width: int) -> set[int]:
    """Unsigned 64-bit hashes of the distinct shingles; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return set()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return {digest(joined, 42)}
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[:-width].tolist()]
    return {digest(joined[a:b], 42) for a, b in zip(first, (ends[width - 1 :] - 1).tolist())}


def wide_simhash(hashes: set[int], plan: Plan) -> tuple[list[int], list[int]]:
    """Words of the SimHash and of the marks of soft bits, as signed longs, of a set that is not empty."""
    base = np.fromiter(hashes, np.uint64, len(hashes))
    with np.errstate(over="ignore"):
        wide = np.stack([_mixed(base + np.uint64(k) * _STEP) for k in range(plan.words)], axis=1)
    lead = 2 * bit_sums(wide) - len(base)
    margins = np.abs(lead[: plan.width * plan.segments]).reshape(plan.segments, plan.width)
    # ties go to the lower bit, so that equal margins have equal marks
    least = np.argsort(margins, axis=1, kind="stable")[:, :SOFT]
    marks = np.zeros(64 * plan.words, np.uint8)
    marks[(least + plan.width * np.arange(plan.segments)[:, None]).ravel()] = 1
    return tuple(np.packbits(x, bitorder="little").view("<i8").tolist() for x in (lead > 0, marks))


def short_size(similarity: float) -> int:
    """Most shingles of sets that can't be as similar as asked for if one has two that the other lacks."""
    return min(SURE_SIZE, math.ceil(2 / max(1 - similarity, 1e-9) - 1e-9) - 1)


def fingerprint_udf(plan: Plan, width: int, short: int = 0):
    """Words, soft marks, the number of shingles and up to ``short`` shingles themselves, ascending; null without words."""

    def one(text: str | None) -> list[int] | None:
        hashes = shingle_hashes(text, width)
        if not hashes:
            return None
        few = np.sort(np.fromiter(hashes, np.uint64).view(np.int64)).tolist() if len(hashes) <= short else []
        words, marks = wide_simhash(hashes, plan)
        return [*words, *marks, len(hashes), *few]

    @F.pandas_udf("array<bigint>")
    def fingerprint(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([one(t) for t in texts], dtype=object)

    return fingerprint


def differing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def segment(words: Column, number: int, width: int) -> Column:
    """The bits of one segment as a long."""
    at, shift = divmod(number * width, 64)
    part = F.shiftrightunsigned(words[at], shift)
    if shift + width > 64:
        part = part.bitwiseOR(F.shiftleft(words[at + 1], 64 - shift))
    return part.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def bit_at(value: Column, j: Column) -> Column:
    return F.call_function("shiftright", value, j).bitwiseAND(F.lit(1).cast("long"))


def index_rows(fps: DataFrame, plan: Plan, lo: int, hi: int) -> DataFrame:
    """``(k, x)`` of segments ``lo`` to ``hi`` - 1 of ``fps(f, words, marks, size)``.

    ``k`` is a segment's number, the deleted bit (``width``: none) and the rest;
    ``x`` is f, the size class and the deleted bit's value, see :func:`unpacked`.
    """
    w = plan.width
    parts = [F.struct(F.lit(i).alias("s"), segment(F.col("words"), i, w).alias("seg"), segment(F.col("marks"), i, w).alias("mark")) for i in range(lo, hi)]
    size = F.least(F.lit((1 << SIZE_BITS) - 1), F.floor(F.log2("size") * SIZE_STEPS)).cast("long")
    rows = fps.select("f", size.alias("size"), F.inline(F.array(*parts)))
    deleted = F.filter(F.sequence(F.lit(0), F.lit(w - 1)), lambda j: bit_at(F.col("mark"), j) == 1)
    rows = rows.select("f", "size", "s", "seg", F.explode(F.concat(F.array(F.lit(w)), deleted)).alias("j"))
    rest = F.when(F.col("j") == w, F.col("seg")).otherwise(F.col("seg").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j")))))
    bit = F.when(F.col("j") == w, F.lit(0).cast("long")).otherwise(bit_at(F.col("seg"), F.col("j")))
    k = F.shiftleft((F.col("s") * (w + 1) + F.col("j")).cast("long"), w).bitwiseOR(rest)
    return rows.select(k.alias("k"), (F.shiftleft("f", SIZE_BITS + 1) + F.col("size") * 2 + bit).alias("x"))


def unpacked(rows: DataFrame, plan: Plan) -> DataFrame:
    """Index rows with f, size (its class), bit and whole (nothing deleted) of their own."""
    whole = F.pmod(F.shiftright("k", plan.width), F.lit(plan.width + 1)) == plan.width
    size = F.shiftright("x", 1).bitwiseAND(F.lit((1 << SIZE_BITS) - 1)).cast("int")
    bit = F.col("x").bitwiseAND(F.lit(1)).cast("int")
    return rows.withColumns({"f": F.shiftright("x", SIZE_BITS + 1), "size": size, "bit": bit, "whole": whole}).drop("x")


def holders(fps: DataFrame, plan: Plan, n: int) -> DataFrame:
    """``(f, size, rate, held)`` of those of ``n`` fingerprints that share a variant; written.

    ``held`` has (k, salt, bit, whole) of the shared variants, ``rate`` how often
    all of them are held. Whoever has equal segments shares the whole one, so of
    a deletion only what differs in the deleted bit is kept. ``salt`` is 0 but
    for hot variants, which are counted salt by salt.
    """
    some = fps.where(common.hashed_under(F.xxhash64("f"), SAMPLED / max(n, 1)))
    done = []
    for lo, hi in plan.passes:
        hot = index_rows(some, plan, lo, hi).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED).select(F.col("k").alias("hot"))
        rows = index_rows(fps, plan, lo, hi)
        # a sample of so many rows can't have more keys than that: bounded at any size of input
        rows = rows.join(F.broadcast(hot), F.col("k") == F.col("hot"), "left")
        rows = rows.select("k", "x", F.when(F.col("hot").isNotNull(), 1 + F.pmod(F.xxhash64("x"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt"))
        every, last = Window.partitionBy("k", "salt"), F.col("x").bitwiseAND(F.lit(1))
        rows = rows.select("*", F.count(F.lit(1)).over(every).alias("n"), F.min(last).over(every).alias("b0"), F.max(last).over(every).alias("b1"))
        rows = unpacked(rows, plan).where((F.col("salt") > 0) | (F.col("n") > 1) & (F.col("whole") | (F.col("b0") != F.col("b1"))))
        done.append(common.cut(rows.select("k", "salt", "f", "size", "bit", "whole", "n")))
        common.release(fps.sparkSession)
    out = done[0]
    for other in done[1:]:
        out = out.unionAll(other)
    # no more variants than a fingerprint has: a row of bounded size
    held = F.collect_list(F.struct("k", "salt", "bit", "whole")).alias("held")
    return common.cut(out.groupBy("f").agg(F.max("size").alias("size"), F.sum("n").alias("rate"), held))


def compared(pairs: DataFrame, fps: DataFrame, *kept: str) -> DataFrame:
    """``(a, b, d, least, most)`` and what is kept: differing bits of each pair, shingles of its smaller and its larger text."""
    left = fps.select(F.col("f").alias("a"), F.col("words").alias("wa"), F.col("size").alias("na"))
    right = fps.select(F.col("f").alias("b"), F.col("words").alias("wb"), F.col("size").alias("nb"))
    found = pairs.join(left, "a").join(right, "b")
    return found.select("a", "b", differing(F.col("wa"), F.col("wb")).alias("d"), F.least("na", "nb").alias("least"), F.greatest("na", "nb").alias("most"), *kept)


def short_links(sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links that tie all pairs of ``sets(f, few)`` of the similarity asked for; exact.

    Of such a pair, neither set has two shingles that the other lacks: the
    shared ones are a whole set, or a set without one shingle, on both sides.
    """
    without = F.transform("few", lambda x: F.array_remove("few", x))
    rows = sets.select("f", F.explode(F.concat(F.array("few"), without)).alias("core"), F.size("few").alias("size"))
    rows = rows.select("f", F.xxhash64("core").alias("k"), F.size("core").alias("c"), (F.size("core") == F.col("size")).alias("whole")).where("c > 0")
    ends = rows.groupBy("k", "c").agg(F.min(F.when(F.col("whole"), F.col("f"))).alias("all"), F.min("f").alias("least"))
    wide = F.col("c") >= F.lit(similarity) * (F.col("c") + 2) - 1e-9
    narrow = F.col("c") >= F.lit(similarity) * (F.col("c") + 1) - 1e-9
    ends = ends.select("k", "c", F.when(wide, F.col("least")).when(narrow, F.col("all")).alias("a")).where("a is not null")
    return rows.join(ends, ["k", "c"]).where(F.col("f") != F.col("a")).select("a", F.col("f").alias("b")).distinct()


def of_two_classes(found: DataFrame, roots: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``(f, size, rate, root, k, salt, bit, whole)`` of :func:`holders`, without the variants of which all holders are of one class.

    ``facts(r, ...)`` of the roots come along.
    """
    named = found.join(roots, found.f == roots.node, "left").select("f", "size", "rate", F.coalesce("root", "f").alias("root"), "held")
    more = []
    if facts is not None:
        more = [c for c in facts.columns if c != "r"]
        named = common.cut(named).join(facts, F.col("root") == F.col("r"))
    named = named.select("f", "size", "rate", "root", *more, F.inline("held"))
    every = Window.partitionBy("k", "salt")
    named = named.withColumn("lo", F.min("root").over(every)).withColumn("hi", F.max("root").over(every))
    # the salts of a hot variant don't see each other
    return named.where((F.col("salt") > 0) | (F.col("lo") != F.col("hi"))).drop("lo", "hi")


def lead_pairs(named: DataFrame, plan: Plan) -> DataFrame:
    """``(a, b)``: each b with the ``LEADS`` that it shares most variants with, of other classes.

    The lead of a variant is the holder that shares most over all variants: in
    a family of edited copies, the text that most of them are copies of.
    """
    lead = F.max(F.struct("rate", "f", "root", "size", "bit")).over(Window.partitionBy("k", "salt"))
    led = named.withColumn("lead", lead)
    apart_ = (F.col("lead.root") != F.col("root")) & (F.col("whole") | (F.col("lead.bit") != F.col("bit"))) & (F.abs(F.col("lead.size") - F.col("size")) <= plan.steps)
    led = led.where(apart_).groupBy(F.col("lead.f").alias("a"), F.col("f").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    best = led.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("c"), "a"))).where(F.col("r") <= LEADS)
    return best.select("a", "b")


def class_pairs(named: DataFrame, plan: Plan) -> DataFrame:
    """``(a, b, d)``, a < b: roots of which two members may be similar by a variant of ``named``, each pair once.

    ``named`` (:func:`of_two_classes`) has ``words`` and ``wide``, the root's words and the
    most bits that a member of its class differs in from it. Roots are compared
    where they meet: pairs that the triangle inequality rules out are never made.
    The classes of a crowded variant are dealt to blocks, and each two blocks meet in a row of their own.
    """
    ends = [F.min("size").alias("least"), F.max("size").alias("most"), F.min("bit").alias("b0"), F.max("bit").alias("b1")]
    spots = named.groupBy("k", "whole", "root").agg(*ends, F.min("words").alias("words"), F.min("wide").alias("wide"))
    spots = common.cut(spots)
    crowds = common.cut(spots.groupBy("k").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > CROWD))
    n = crowds.count()
    if n:
        spots = spots.join(common.small_or_not(crowds, n, BROADCAST_TEXTS), "k", "left").withColumn("n", F.ceil(F.coalesce("held", F.lit(1)) / F.lit(CROWD)).cast("int"))
    else:
        spots = spots.withColumn("n", F.lit(1))
    spots = spots.withColumn("own", F.pmod(F.xxhash64("root"), F.col("n")).cast("int"))
    spots = spots.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    one = F.struct("root", "own", "least", "most", "b0", "b1", "words", "wide")
    met = spots.groupBy("k", "whole", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.array_sort(F.collect_list(one)).alias("m")).where(F.size("m") > 1)

    def may_meet(x: Column, y: Column) -> Column:
        blocks = (F.col("lo") == F.col("hi")) | (x["own"] != y["own"])
        bits = F.col("whole") | (x["b0"] != y["b1"]) | (x["b1"] != y["b0"])
        return blocks & bits & (x["least"] - y["most"] <= plan.steps) & (y["least"] - x["most"] <= plan.steps)

    def later(x: Column, i: Column) -> Column:
        rest = F.filter(F.slice(F.col("m"), i + 2, F.size("m")), lambda y: may_meet(x, y))
        pairs = F.transform(rest, lambda y: F.struct(x["root"].alias("a"), y["root"].alias("b"), differing(x["words"], y["words"]).alias("d"), (x["wide"] + y["wide"]).alias("wide")))
        return F.filter(pairs, lambda p: p["d"] <= plan.bits[1] + p["wide"])

    return met.select(F.inline(F.flatten(F.transform("m", later)))).select("a", "b", "d").distinct()


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many numbers each of ``xs`` has in common with each of ``ys``; all are arrays of distinct numbers."""
    flat = [np.concatenate(sets) for sets in (xs, ys)]
    both = np.intersect1d(*flat)
    places = []
    for sets, values in zip((xs, ys), flat):
        at = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        hit = both[at] == values if len(both) else np.zeros(len(values), bool)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit]
        order = np.argsort(at[hit], kind="stable")
        places.append((owner[order], at[hit][order]))
    out = np.zeros((len(xs), len(ys)), np.int64)
    for lo in range(0, len(both), CHUNK):
        tables = []
        for sets, (owner, at) in zip((xs, ys), places):
            i, j = np.searchsorted(at, (lo, lo + CHUNK))
            table = np.zeros((len(sets), min(CHUNK, len(both) - lo)), np.float32)
            table[owner[i:j], at[i:j] - lo] = 1
            tables.append(table)
        out += (tables[0] @ tables[1].T).astype(np.int64)
    return out


def similar_roots(a: tuple, b: tuple, roots: np.ndarray, plan: Plan) -> np.ndarray:
    """Those of ``roots``, which texts ``b`` have, of which a text is similar to one of ``a``.

    ``a`` and ``b`` are words, sizes, numbers of shingles and shingles of texts, one after the other.
    """
    (wa, na, sa), (wb, nb, sb) = ((x[0].reshape(len(x[1]), -1), x[1].astype(np.int64), np.split(x[3], np.cumsum(x[2])[:-1])) for x in (a, b))
    sure, possible = plan.bits
    d = np.zeros((len(na), len(nb)), np.int32)
    for i in range(plan.words):
        d += np.bitwise_count((wa[:, i, None] ^ wb[None, :, i]).view(np.uint64))
    least = np.minimum(na[:, None], nb)
    near = (least >= plan.similarity * np.maximum(na[:, None], nb) - 1e-9) & (d <= possible)
    done = np.unique(roots[(near & (d <= sure) & (least >= SURE_SIZE)).any(0)])
    near &= ~np.isin(roots, done)
    rows, columns = near.any(1).nonzero()[0], near.any(0).nonzero()[0]
    if not len(rows):
        return done
    shared = shared_counts([sa[i] for i in rows], [sb[j] for j in columns])
    alike = shared >= plan.similarity * (na[rows, None] + nb[columns] - shared) - 1e-9
    return np.union1d(done, roots[columns[(near[np.ix_(rows, columns)] & alike).any(0)]])


def linked_udf(plan: Plan):
    """:func:`similar_roots` of two blocks."""

    @F.pandas_udf("array<bigint>")
    def linked(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for rows in parts:
            yield pd.Series([similar_roots(r[:4], r[4:8], r[8], plan) for r in zip(*rows)], dtype=object)

    return linked


def class_links(found: DataFrame, roots: DataFrame, fps: DataFrame, plan: Plan, sets_of) -> DataFrame:
    """``(a, b)``: roots of two classes of which two members are similar, of all classes that share a variant.

    All members of two such classes are compared. They lie in blocks, with their
    words and shingles. Of the classes that a larger one meets, the blocks are
    put together to packs of a block's size, and each pack meets each block in
    a row of its own, dealt by class and block: two large classes are spread
    over tasks, and the many small ones that a large class meets don't each
    take its blocks along.
    """
    members = roots.where(F.col("node") != F.col("root"))
    own = compared(members.select(F.col("node").alias("a"), F.col("root").alias("b")), fps)
    wide = common.cut(own.groupBy(F.col("b").alias("r")).agg(F.max("d").alias("wide"), F.count(F.lit(1)).alias("n")))
    words = fps.select(F.col("f").alias("r"), "words").join(wide, "r", "left").fillna(0, ["wide", "n"])
    named = of_two_classes(found, roots, words.select("r", "words", "wide"))
    near = common.cut(class_pairs(named, plan))
    common.release(fps.sparkSession)
    if near.isEmpty():
        return near.select("a", "b")
    sizes = wide.select("r", "n")
    near = near.join(sizes.select(F.col("r").alias("a"), F.col("n").alias("na")), "a", "left").join(sizes.select(F.col("r").alias("b"), F.col("n").alias("nb")), "b", "left").fillna(0, ["na", "nb"])
    swap = F.col("na") < F.col("nb")
    near = common.cut(near.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("ra"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("rb")))
    some = common.cut(near.select(F.col("ra").alias("root")).unionAll(near.select(F.col("rb").alias("root"))).distinct())
    inside = members.join(some, "root", "left_semi").select("root", F.col("node").alias("f")).unionByName(some.select("root", F.col("root").alias("f")))
    inside = common.cut(inside.join(fps.select("f", "words", "size"), "f"))
    dealt = inside.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("size") / F.lit(BLOCK_SHINGLES))).alias("blocks"))
    dealt = common.cut(dealt)
    held = inside.join(dealt, "root").join(sets_of(inside.select("f")), "f")
    blocks = held.groupBy("root", F.pmod(F.xxhash64("f"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("words", "size", "s")).alias("m"))
    lengths = F.transform("m.s", lambda s: F.size(s))
    blocks = common.cut(blocks.select("root", "block", F.flatten("m.words").alias("words"), F.col("m.size").alias("sizes"), lengths.alias("lengths"), F.flatten("m.s").alias("s")))
    weight = F.greatest(F.size("sizes") / F.lit(BLOCK), F.size("s") / F.lit(BLOCK_SHINGLES))
    parts = near.join(blocks.select(F.col("root").alias("rb"), "block", weight.alias("weight")), "rb")
    packs = parts.groupBy("ra").agg(F.ceil(F.sum("weight")).alias("packs")).join(dealt.select(F.col("root").alias("ra"), "blocks"), "ra")
    # a block that is full enough is a pack of its own
    pack = F.when(F.col("weight") > 0.5, F.xxhash64("rb", "block")).otherwise(F.pmod(F.xxhash64("rb", "block"), F.col("packs")))
    parts = common.cut(parts.join(packs, "ra").select("ra", "rb", "block", "blocks", pack.alias("pack")))
    one = F.struct(F.array_repeat("root", F.size("sizes")).alias("roots"), "words", "sizes", "lengths", "s")
    packed = parts.join(blocks.withColumnRenamed("root", "rb"), ["rb", "block"]).withColumnRenamed("rb", "root")
    packed = packed.groupBy("ra", "blocks", "pack").agg(F.collect_list(one).alias("m"))
    columns = ["words", "sizes", "lengths", "s"]
    packed = packed.select("ra", "blocks", F.flatten("m.roots").alias("roots"), *[F.flatten(f"m.{c}").alias(f"{c}_b") for c in columns])
    packed = common.cut(packed).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = packed.join(blocks.withColumnRenamed("root", "ra"), ["ra", "block"])
    linked = linked_udf(plan)(*columns, *[f"{c}_b" for c in columns], "roots")
    return both.select(F.col("ra").alias("a"), F.explode(linked).alias("b")).distinct()


def tied(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, root)`` of the classes ``roots`` and the further ``links(a, b)``, written."""
    links = common.cut(apart(roots, links))
    if links.isEmpty():
        return roots
    # classes of classes: the links tie the roots that are there; written, so that a large class is a skewed join that Spark splits
    upper = common.cut(common.connected_components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
    up = upper.select(F.col("node").alias("u"), F.col("root").alias("top"))
    lower = roots.join(up, roots.root == up.u, "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = upper.join(roots.select(F.col("node").alias("n")), F.col("node") == F.col("n"), "left_anti")
    return common.cut(lower.unionAll(alone))


def apart(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, ra, rb)``: the pairs of two classes, with their roots."""
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    named = pairs.join(ra, "a", "left").join(rb, "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    return named.where(F.col("ra") != F.col("rb"))


def shingle_sets(wanted: DataFrame, fps: DataFrame, df: DataFrame, id_col: str, text_col: str, plan: Plan, width: int) -> DataFrame:
    """``(f, s)``: the shingles of the texts of ``wanted(f)``, whose texts alone are read again; written."""
    asked = common.cut(wanted.distinct().join(fps.select("f", "words", "rep"), "f"))

    @F.pandas_udf("array<bigint>")
    def shingles(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([np.fromiter(shingle_hashes(t, width), np.uint64).view(np.int64) for t in texts], dtype=object)

    text = df[text_col].cast("string")
    few = common.small_or_not(asked, asked.count(), BROADCAST_TEXTS)
    rows = df.select(df[id_col].alias("i"), text.alias("t")).join(few, F.col("i").eqNullSafe(F.col("rep")))
    # cut before Python reads them: else the whole of df would be fingerprinted again
    rows = common.cut(rows.select("f", "words", "t"))
    # rows that repeat an identifier with another text have another fingerprint
    rows = rows.withColumn("w", F.slice(fingerprint_udf(plan, width)("t"), 1, plan.words)).where(F.col("w") == F.col("words"))
    rows = common.cut(rows.select("f", "t"))
    return common.cut(rows.groupBy("f").agg(F.min("t").alias("t")).select("f", shingles("t").alias("s")))


def settled(doubt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of ``doubt(a, b)`` whose ``sets(f, s)`` have the Jaccard similarity asked for."""
    left, right = sets.select(F.col("f").alias("a"), F.col("s").alias("sa")), sets.select(F.col("f").alias("b"), F.col("s").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    both = doubt.join(left, "a").join(right, "b")
    return both.where(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("a", "b")


def near_dedup_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id (the least identifier of its class): one row per input row."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity is over 0 and at most 1")
    common.ready_for_python(df.sparkSession)
    plan = plan_for(df.count(), similarity)
    shown = fingerprint_udf(plan, width, short_size(similarity))(df[text_col].cast("string"))
    prints = common.cut(df.select(df[id_col].alias("doc_id"), shown.alias("w")))
    n = plan.words
    prints = prints.select("doc_id", F.slice("w", 1, n).alias("words"), F.slice("w", n + 1, n).alias("marks"), F.get("w", F.lit(2 * n)).alias("size"), F.slice("w", 2 * n + 2, SURE_SIZE).alias("few"))
    known = prints.where("words is not null")
    fps = known.groupBy("words").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.min("marks").alias("marks"))
    # small ascending numbers, fixed by the write, take less room in the index than hashes
    fps = common.cut(fps.withColumn("f", F.monotonically_increasing_id()))
    short = short_links(known.where(F.size("few") > 0).select("words", "few").distinct().join(fps.select("words", "f"), "words"), similarity)
    known = known.select("doc_id", "words")
    sure, possible = plan.bits
    roots = tied(fps.select(F.col("f").alias("node"), F.col("f").alias("root")).limit(0), short)

    def sets_of(wanted: DataFrame) -> DataFrame:
        return shingle_sets(wanted, fps, df, id_col, text_col, plan, width)

    found = holders(fps, plan, fps.count())
    for _ in range(ROUNDS):
        pairs = lead_pairs(of_two_classes(found, roots), plan)
        near = compared(pairs, fps).where((F.col("d") <= possible) & (F.col("least") >= F.lit(similarity) * F.col("most") - 1e-9))
        near = common.cut(near.select("a", "b", ((F.col("d") <= sure) & (F.col("least") >= SURE_SIZE)).alias("sure")))
        common.release(df.sparkSession)
        links, doubt = near.where("sure").select("a", "b"), near.where("not sure").select("a", "b")
        if not doubt.isEmpty():
            sets = sets_of(doubt.select(F.col("a").alias("f")).unionAll(doubt.select(F.col("b").alias("f"))))
            links = links.unionAll(settled(doubt, sets, similarity))
        before, roots = roots, tied(roots, links)
        if roots is before:
            break
    roots = tied(roots, class_links(found, roots, fps, plan, sets_of))
    common.release(df.sparkSession)
    named = common.cut(fps.join(roots, fps.f == roots.node, "left").select("words", "rep", "n", F.coalesce("root", "f").alias("root")))
    least = common.cut(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members")))
    classes = common.join_hot(named.select("words", "n", "root"), least, "root", "members", "component_id")
    classes = common.cut(classes.select("words", "n", "component_id"))
    found = common.join_hot(known, classes, "words", "n", "component_id")
    alone = prints.where("words is null").select("doc_id", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "component_id").unionAll(alone)
