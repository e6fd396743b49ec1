import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import compare
from corpusmill import llm
from corpusmill.llm import common, exact_dedup, mixing

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    got, want = compare(spark, sf, llm.queries()[name], llm.oracle_sql()[name])
    assert got == want and got


def test_names():
    assert [n.split("_")[0] for n in llm.queries()] == [f"op{i}" for i in range(1, 11)]


def copies(n=400):
    """One text that is a third of all rows, others repeated or unique, nulls and repeated rows."""
    rows = [(i, "the hot text " * 40) for i in range(n // 3)]
    rows += [(n + i, f"text {i % 50}" + "x" * (i % 7)) for i in range(n // 2)]
    rows += [(9000, None), (9001, ""), (9002, None), (None, "the hot text " * 40), (None, "only null"), (7, "the hot text " * 40), (9003, "é" * 40_000)]
    return rows


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_exact_dedup_against_brute_force(spark, keep, buckets):
    rows = copies()
    # columns with names that the operator uses inside come back untouched
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("b")).withColumn("p", F.lit(1)).withColumn("t", F.lit("x"))
    found = exact_dedup.exact_dedup(df, keep=keep, carry=True, buckets=buckets).collect()
    assert len(found) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    kept = {}
    for r in found:
        text = r.row.text or ""
        ids = [x for x in groups[text] if x is not None]
        assert r.keep_id == ((min if keep == "smallest" else max)(ids) if ids else None)
        assert r.group_size == len(groups[text]) and r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.row.bucket, r.row.p, r.row.t) == ("b", 1, "x")
        kept[text] = kept.get(text, 0) + r.kept
    assert set(kept.values()) == {1} and set(kept) == set(groups)


def test_exact_dedup_of_nothing_and_normalised(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(empty).count() == 0
    df = spark.createDataFrame([(1, "A"), (2, "a")], "doc_id long, text string")
    assert {r.group_size for r in exact_dedup.exact_dedup(df, normalise=F.lower).collect()} == {2}
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(df, keep="some")


def test_hot_group_is_cut_over_buckets(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    base = df.select(F.hex(F.encode("text", "UTF-8")).alias("p"), F.xxhash64("text").alias("h"), F.col("doc_id").alias("i"))
    bounds = common.splitters(base, 2000, 8, F.xxhash64("h", "i"))
    spread = base.groupBy(common.bucket_of(bounds, [F.col("p"), F.col("h"), F.col("i")], ["string", "bigint", "bigint"]).alias("b")).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 2000 * 0.35
    assert exact_dedup.exact_dedup(df, buckets=8).where("kept").collect()[0].doc_id == 0


def water_fill(sizes, weights, budget, cap):
    targets, left, open_ = {}, budget * sum(sizes.values()), dict(sizes)
    while open_:
        unit = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if unit * weights[s] > cap * sizes[s]]
        if not over:
            return targets | {s: unit * weights[s] for s in open_}
        for s in over:
            targets[s] = cap * sizes[s]
            left -= targets[s]
            del open_[s]
    return targets


def test_mix_against_brute_force(spark):
    rows = [(i, "w " * (i % 37), ["big", "mid", None, "small", "b"][0 if i % 3 else i % 5]) for i in range(1500)] + [(9999, None, "none"), (5, "a b", "big"), (None, "x y z", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("u", F.lit(1)).withColumn("size", F.lit("s"))
    found = mixing.mix(df, carry=True).collect()
    assert len(found) == len(rows) and found == mixing.mix(df, carry=True).collect() or sorted(map(str, found)) == sorted(map(str, mixing.mix(df, carry=True).collect()))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    targets = water_fill(sizes, weights, 1.5, 2)
    taken, longest = {}, 37
    for r in found:
        s = r.row.source
        assert r.source_size == sizes[s] and r.size == len((r.row.text or "").split()) and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        assert r.target == pytest.approx(targets[s])
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= longest for s in sizes)
    assert (found[0].row.u, found[0].row.size) == (1, "s")


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " \n", None)], DOCS)).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
