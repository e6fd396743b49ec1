import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import common, fingerprints, simhash, simhash_similar

DOCS = "doc_id long, text string"


def brute_simhash(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if linked(a, b):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return [find(x) for x in range(n)]


def test_simhash_and_classes_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "One", "one", "A b", "é É", "a b c"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        for _ in range(4):
            changed = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                changed[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(changed))
    ids = list(range(100, 100 + len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), DOCS).withColumn("fp", F.lit("x")).withColumn("k", F.lit(1))
    found = {r.doc_id: r for r in simhash.near_dedup(df).collect()}
    prints = [brute_simhash(t) for t in texts]
    want = classes(len(texts), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert [found[i].fp % (1 << 64) for i in ids] == prints
    assert [found[i].component_id - 100 for i in ids] == want
    assert len(set(want)) < len(set(prints))


def test_crowded_variants_are_exact(spark):
    """A ball of fingerprints around one point: far more in a variant than are compared in pairs."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(40), rng.choice([1, 2, 3, 4, 5]))) for _ in range(250)} | {rng.getrandbits(64) for _ in range(50)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    for most in (1, 2):
        links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), most)
        roots = {r.node: r.root for r in common.connected_components(links).collect()}
        want = classes(len(signed), lambda a, b: bin((signed[a] ^ signed[b]) & (2**64 - 1)).count("1") <= most)
        assert [roots.get(v, v) for v in signed] == [signed[w] for w in want]
    with pytest.raises(ValueError):
        simhash.fingerprint_links(links, 3)


def test_bit_sums():
    import numpy as np

    rows = np.random.default_rng(0).integers(0, 2**64, (1000, 2), dtype=np.uint64)
    want = [sum(int(x) >> j & 1 for x in rows[:, w]) for w in range(2) for j in range(64)]
    assert simhash.bit_sums(rows).tolist() == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert common.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_similar_texts(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    texts = [None, "", "one two", "one two", "one  TWO"]
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(3):
            changed = base[:]
            for _ in range(rng.choice([1, 1, 2, 4, 12])):
                changed[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(changed))
    # one large group of near copies of one text
    base = [rng.choice(words) for _ in range(200)]
    for _ in range(120):
        changed = base[:]
        changed[rng.randrange(200)] = rng.choice(words)
        texts.append(" ".join(changed))
    df = spark.createDataFrame([*enumerate(texts), (None, texts[6]), (6, texts[6])], DOCS)
    found = simhash_similar.near_dedup_similar(df).collect()
    assert len(found) == len(texts) + 2
    got = {r.doc_id: r.component_id for r in found}
    assert got[0] == 0 and got[1] == 1 and got[2] == got[3] == got[4] == 2 and got[None] == got[6]
    sets = [simhash_similar.shingle_hashes(t, 5) for t in texts]

    def similarity(a, b):
        return len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))

    want = classes(len(texts), lambda a, b: a > 4 and similarity(a, b) >= 0.8)
    pairs = [(a, b) for a in range(5, len(texts)) for b in range(a + 1, len(texts))]
    close = [(a, b) for a, b in pairs if similarity(a, b) >= 0.8]
    assert sum(got[a] == got[b] for a, b in close) >= 0.97 * len(close)
    # what is put together is together by exact similarity too, but for sure links a little under it
    loose = classes(len(texts), lambda a, b: a > 4 and similarity(a, b) >= 0.7)
    assert all(loose[a] == loose[b] for a, b in pairs if got[a] == got[b])
    assert len(set(want)) < len(texts)
    assert simhash_similar.near_dedup_similar(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash.near_dedup(spark.createDataFrame([], DOCS)).count() == 0


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def similar_classes(spark, texts, width=5):
    """(class of each text, its shingles)."""
    found = simhash_similar.near_dedup_similar(spark.createDataFrame(list(enumerate(texts)), DOCS), width=width).collect()
    got = {r.doc_id: r.component_id for r in found}
    return [got[i] for i in range(len(texts))], [simhash_similar.shingle_hashes(t, width) for t in texts]


def edited(rng, base, edits, tag):
    out = base[:]
    for n, i in enumerate(rng.sample(range(len(base)), edits)):
        out[i] = f"{tag}x{n}"
    return out


def test_similar_hubs_and_chains(spark):
    """Copies of which only few pairs are similar, in groups whose members share variants of several classes."""
    rng = random.Random(8)
    texts = []
    for g in range(6):  # spokes are similar to the hub only, which comes last
        base = [f"h{g}w{i}" for i in range(400)]
        texts += [" ".join(edited(rng, base, 7, f"g{g}s{v}")) for v in range(60)] + [" ".join(base)]
    for g in range(6):  # each similar to the one before
        link = [f"c{g}w{i}" for i in range(400)]
        for v in range(40):
            link = edited(rng, link, 6, f"g{g}c{v}")
            texts.append(" ".join(link))
    got, sets = similar_classes(spark, texts)
    n = len(texts)
    close = [(a, b) for a in range(n) for b in range(a + 1, n) if jaccard(sets[a], sets[b]) >= 0.8]
    assert sum(got[a] == got[b] for a, b in close) >= 0.98 * len(close)
    want = classes(n, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert all(want[a] == want[b] for a in range(n) for b in range(a + 1, n) if got[a] == got[b])


def test_all_candidates_of_two_classes_are_compared(spark):
    """Two classes are tied exactly if they share a variant and any two of their members are similar, whatever the classes."""
    rng = random.Random(9)
    plan = simhash_similar.plan_for(160, 0.8)
    bits, size, soft = 64 * plan.words, plan.width, simhash_similar.SOFT
    prints, marks, sizes = [], [], []
    for _ in range(4):
        centre = rng.getrandbits(bits)
        for _ in range(40):
            prints.append(centre ^ sum(1 << b for b in rng.sample(range(bits), rng.randint(20, 130))))
            marks.append(sum(1 << s * size + j for s in range(plan.segments) for j in rng.sample(range(size), soft)))
            sizes.append(rng.choice([100, 101, 115, 140, 300]))

    def longs(p):
        return [(w - (1 << 64)) if (w := p >> 64 * i & (2**64 - 1)) >> 63 else w for i in range(plan.words)]

    rows = [(i, longs(p), longs(m), s) for i, (p, m, s) in enumerate(zip(prints, marks, sizes))]
    fps = spark.createDataFrame(rows, "f long, words array<long>, marks array<long>, size long")

    def share(a, b):
        for s in range(0, plan.segments * size, size):
            x, both = ((prints[a] ^ prints[b]) >> s) & ((1 << size) - 1), (marks[a] & marks[b]) >> s
            if x == 0 or x.bit_count() == 1 and x & both:
                return True
        return False

    n = len(prints)
    root = [i - i % 10 if i % 4 else i for i in range(n)]
    roots = spark.createDataFrame([(i, r) for i, r in enumerate(root)], "node long, root long")
    # by bits alone: the sets are equal within a centre, and disjoint between two
    sets = spark.createDataFrame([(i, list(range(1000 * (i // 40), 1000 * (i // 40) + sizes[i]))) for i in range(n)], "f long, s array<long>")

    def similar(a, b):
        both = min(sizes[a], sizes[b]) if a // 40 == b // 40 else 0
        alike = both >= 0.8 * (sizes[a] + sizes[b] - both)
        d = (prints[a] ^ prints[b]).bit_count()
        return min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]) and d <= plan.bits[1] and (alike or d <= plan.bits[0])

    met = {(min(root[a], root[b]), max(root[a], root[b])) for a in range(n) for b in range(a + 1, n) if root[a] != root[b] and share(a, b)}
    linked = {(min(root[a], root[b]), max(root[a], root[b])) for a in range(n) for b in range(a + 1, n) if root[a] != root[b] and similar(a, b)}
    # all variants of the sample are hot for some, none for others
    for least, block in ((2, 64), (8, 3), (1000, 1)):
        kept = simhash_similar.SHARED, simhash_similar.BLOCK
        simhash_similar.SHARED, simhash_similar.BLOCK = least, block
        try:
            found = simhash_similar.class_links(simhash_similar.holders(fps, plan, n), roots, fps, plan, lambda wanted: sets)
            found = {(min(r), max(r)) for r in map(tuple, found.collect())}
        finally:
            simhash_similar.SHARED, simhash_similar.BLOCK = kept
        # size classes are coarser than sizes, so a variant may bring classes together whose holders of it differ in size
        assert len(linked & met) > 50 and found <= linked
        assert {p for p in linked & met if any(share(a, b) and similar(a, b) for a in range(n) for b in range(a + 1, n) if (min(root[a], root[b]), max(root[a], root[b])) == p)} <= found


def test_large_unlike_classes_meet_in_blocks(spark):
    """Two classes of 1,500 and 1,000 texts, all alike in their bits: only the shingles of 1.5 million pairs tell them apart."""
    rng = random.Random(4)
    plan = simhash_similar.plan_for(2500, 0.8)
    centre = [rng.getrandbits(63) for _ in range(plan.words)]
    apart = (plan.bits[0] + plan.bits[1]) // 2
    other = [centre[i] ^ sum(1 << b for b in range(apart * (i + 1) // plan.words - apart * i // plan.words)) for i in range(plan.words)]

    def text(f):
        words = list(centre if f < 1500 else other)
        for b in range(11):
            words[b % plan.words] ^= (f >> b & 1) << 62
        base = list(range(400)) if f < 1500 else list(range(70, 470))
        return f, words, 400, [1000 + 3 * f + i if i < 3 else x for i, x in enumerate(base)]

    rows = [text(f) for f in range(2500)]
    of = spark.createDataFrame(rows, "f long, words array<long>, size long, s array<long>")
    fps, sets = common.cut(of.select("f", "words", "size")), common.cut(of.select("f", "s"))
    roots = common.cut(spark.createDataFrame([(f, 0 if f < 1500 else 1500) for f in range(2500)], "node long, root long"))
    one = "f long, size int, rate long, held array<struct<k: long, salt: int, bit: int, whole: boolean>>"
    found = common.cut(spark.createDataFrame([(0, 77, 2, [(1, 0, 0, True)]), (1500, 77, 2, [(1, 0, 0, True)])], one))
    begun = time.monotonic()
    assert simhash_similar.class_links(found, roots, fps, plan, lambda wanted: sets).collect() == []
    # far more than it takes, far less than expressions over each pair
    assert time.monotonic() - begun < 40
    # a single text of the one that is like one of the other
    last = dict((r[0], r[3]) for r in rows)[2499]
    sets = common.cut(sets.where("f != 700").unionAll(spark.createDataFrame([(700, last)], "f long, s array<long>")))
    assert [tuple(r) for r in simhash_similar.class_links(found, roots, fps, plan, lambda wanted: sets).collect()] == [(0, 1500)]


def test_shared_counts():
    rng = random.Random(6)
    sets = [[rng.sample(range(-40, 90), rng.randint(0, 60)) for _ in range(n)] for n in (7, 5)]
    arrays = [[np.array(x, np.int64) for x in some] for some in sets]
    kept = simhash_similar.CHUNK
    try:
        for simhash_similar.CHUNK in (3, 64, kept):
            got = simhash_similar.shared_counts(*arrays)
            assert got.tolist() == [[len(set(x) & set(y)) for y in sets[1]] for x in sets[0]]
    finally:
        simhash_similar.CHUNK = kept
    assert simhash_similar.shared_counts([np.array([1])], [np.array([2]), np.array([], np.int64)]).tolist() == [[0, 0]]


def test_index_plan_follows_the_number_of_texts():
    plans = [simhash_similar.plan_for(n, 0.8) for n in (0, 10**3, 10**5, 10**7, 10**10)]
    assert [p.width for p in plans] == [16, 16, 21, 27, 37]
    for p in plans:
        assert 1 - (1 - p.found) ** p.segments >= simhash_similar.RECALL
        assert p.words * 64 >= p.width * p.segments and p.bits[0] < p.bits[1]
        assert p.passes[0][0] == 0 and p.passes[-1][1] == p.segments and all(a[1] == b[0] for a, b in zip(p.passes, p.passes[1:]))
    assert simhash_similar.plan_for(1000, 1.0).segments == 1


def test_similar_recall_at_the_threshold(spark):
    """Lone pairs just over 0.8 are found as often as the index promises."""
    rng = random.Random(10)
    texts = []
    for g in range(400):
        base = [f"p{g}w{i}" for i in range(454)]
        texts += [" ".join(base), " ".join(edited(rng, base, 10, f"e{g}"))]
    got, sets = similar_classes(spark, texts)
    near = [i for i in range(0, len(texts), 2) if 0.8 <= jaccard(sets[i], sets[i + 1]) < 0.83]
    assert len(near) > 150
    assert sum(got[i] == got[i + 1] for i in near) >= 0.95 * len(near)


def test_short_similar_texts_are_exact(spark):
    rng = random.Random(11)
    texts = []
    for g in range(12):
        base = [f"t{g}w{i}" for i in range(rng.randint(1, 10))]
        texts += [" ".join(base), " ".join([*base, "end"]), " ".join(["start", *base]), " ".join([*base, "other"]), " ".join(base[1:])]
    got, sets = similar_classes(spark, texts, width=1)
    keep = [i for i in range(len(texts)) if 0 < len(sets[i]) <= simhash_similar.short_size(0.8)]
    assert simhash_similar.short_size(0.8) == 9
    want = classes(len(keep), lambda a, b: jaccard(sets[keep[a]], sets[keep[b]]) >= 0.8)
    loose = classes(len(texts), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    for a in range(len(keep)):
        for b in range(a + 1, len(keep)):
            assert got[keep[a]] == got[keep[b]] or want[a] != want[b]
    assert all(loose[a] == loose[b] for a in range(len(texts)) for b in range(a + 1, len(texts)) if got[a] == got[b])


def test_texts_under_the_similarity_are_not_linked(spark):
    """Templated texts of 0.73 to 0.799: none may be put together."""
    rng = random.Random(12)
    texts = []
    for g in range(500):
        base = [f"u{g}w{i}" for i in range(454)]
        texts += [" ".join(base), " ".join(edited(rng, base, 12, f"e{g}"))]
    got, sets = similar_classes(spark, texts)
    under = [i for i in range(0, len(texts), 2) if jaccard(sets[i], sets[i + 1]) < 0.8]
    assert sum(jaccard(sets[i], sets[i + 1]) > 0.73 for i in under) > 300
    assert all(got[i] != got[i + 1] for i in under)


def test_imatch(spark, tmp_path):
    rng = random.Random(5)
    words = [f"term{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(120)]
    texts += [texts[3], texts[3].upper(), " ".join(reversed(texts[3].split())), None, "", "...", "the", "longer " * 5000]
    spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, t string, sig string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = fingerprints.op1_imatch_fingerprints(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    import hashlib

    for i, r in enumerate(rows):
        text, nxt = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    # equal term sets have equal fingerprints, others do not
    assert rows[3].fingerprint == rows[120].fingerprint == rows[121].fingerprint == rows[122].fingerprint
    assert rows[120].near_next == 1.0
    assert len({r.fingerprint for r in rows}) == len(texts) - 4  # three copies of one, null and empty
    half = [r for r in rows[:120]]
    assert sum(r.near_edited for r in half) > 3 * sum(r.near_next for r in half[:3] + half[4:])


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute_signature(text, lexicon):
    """Term hashes and digests by hand: XXH64 of the text, and of arrays element by element."""
    import re

    terms = sorted({t for t in re.split("[^a-z0-9]+", text.lower()) if t})
    every = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in terms]
    kept = [h for h in every if h in lexicon] or every or [signed(xxhash.xxh64_intdigest(text.encode(), 42))]

    def digest(hashes):
        h = 42
        for x in hashes:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), h)
        return h & 0xFFFFFFFF if hashes else 0

    parts = [digest(kept)] + [digest([h for h in kept if h >> 2 * i & 3]) for i in range(fingerprints.DENSE)]
    at = 2 * fingerprints.DENSE
    for bits, n in fingerprints.SPARSE:
        parts += [digest([h for h in kept if h >> at & (1 << bits) - 1 == i]) for i in range(n)]
        at += bits
    return parts


def brute_likeness(a, b):
    met = [x == y for x, y in zip(a, b) if x or y]
    return 1.0 if a == b else sum(met) / len(met)


def test_imatch_values_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) + rng.choice([".", "", " THE END"]) for _ in range(150)]
    texts += ["", None, "...", "zz unseen terms", texts[4], texts[4].upper()]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = fingerprints.op1_imatch_fingerprints(spark, str(tmp_path)).orderBy("doc_id").collect()
    import re

    held = [{t for t in re.split("[^a-z0-9]+", (t or "").lower()) if t} for t in texts]
    counts = {w: sum(w in h for h in held) for w in set().union(*held)}
    n = len(texts)
    lexicon = {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w, c in counts.items() if fingerprints.LOW * n <= c <= fingerprints.HIGH * n}
    assert 0 < len(lexicon) < len(counts)
    show = lambda parts: "".join(f"{p:08x}" for p in parts)
    for i, r in enumerate(rows):
        text, after = texts[i] or "", texts[(i + 1) % n] or ""
        own, nxt, edit = (brute_signature(t, lexicon) for t in (text, after, text[: len(text) - len(text) // 2] + after[: len(text) // 2]))
        assert (r.fingerprint, r.edited_fingerprint) == (show(own), show(edit))
        assert r.near_edited == pytest.approx(brute_likeness(own, edit)) and r.near_next == pytest.approx(brute_likeness(own, nxt))


def test_simhash_of_odd_rows(spark):
    """Null identifiers, repeated rows, a very long text, clashing columns; variants that all share."""
    long_text = " ".join(f"w{i % 977}" for i in range(400_000))
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, long_text), (8, long_text + " end"), (None, None), (7, "  ")]
    df = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("x")).withColumn("rep", F.lit(0))
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_dedup(df).collect()), key=str)
    assert got == sorted(((i, brute_simhash(t), {"a b c d": 4, None: 7, "  ": 7}.get(t, 8)) for i, t in rows), key=str)
    only = spark.createDataFrame([(None, "x y z")], DOCS)
    assert [(r.doc_id, r.component_id) for r in simhash.near_dedup(only).collect()] == [(None, None)]


def test_imatch_lexicon_is_the_band(spark):
    df = spark.createDataFrame([(i, "all " + ("half " if i % 2 else "") + f"own{i}") for i in range(100)], "doc_id long, t string")
    want = spark.sql("select xxhash64('half') h").first().h
    assert fingerprints.lexicon(df, "t", 0.02, 0.9) == [want]
    assert fingerprints.lexicon(df.limit(0), "t") == []


def test_imatch_edges(spark, tmp_path):
    schema = "doc_id long, text string"
    for name, rows in (("none", []), ("one", [(5, "a b c d")]), ("null", [(None, "x"), (1, "y"), (1, "y"), (None, None)])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = fingerprints.op1_imatch_fingerprints(spark, str(tmp_path / name)).collect()
        assert len(got) == len(rows)
    import hashlib

    one = fingerprints.op1_imatch_fingerprints(spark, str(tmp_path / "one")).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest() and one.near_next == 1.0


def test_next_rows_over_ranges(spark):
    df = spark.range(0, 3000, 3).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("t"))
    rows = fingerprints.with_next(df, ["t"], buckets=9).collect()
    assert {r.doc_id: int(r.next_t) for r in rows} == {i: (i + 3) % 3000 for i in range(0, 3000, 3)}
