import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, html_text, language_id, quality, token_counts, url_filter

DOCS = "doc_id long, text string"


def reference_encoding():
    import tiktoken

    path, pattern = bpe.public_files()
    return tiktoken.Encoding("reference", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def odd_texts(n, seed):
    rng = random.Random(seed)
    later = [int(x.split("-")[0], 16) for x in (bpe.LATER_LETTERS + bpe.LATER_NUMBERS + bpe.NEW_LETTERS + bpe.NEW_NUMBERS).split()]
    kinds = [lambda: rng.randint(1, 127), lambda: rng.randint(97, 122), lambda: 32, lambda: rng.choice([9, 10, 0x85, 0xA0, 0x2028, 0x3000, 0x1C, 39]), lambda: rng.randint(0x80, 0xD7FF), lambda: rng.randint(0xE000, 0x10FFFF), lambda: rng.choice(later)]
    return ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_codec_equals_the_library():
    enc, codec = reference_encoding(), bpe.Codec(*bpe.public_files())
    texts = odd_texts(4000, 1) + ["a" * 3000, "ab" * 500, " " * 900 + "x", "\n" * 300, "".join(random.Random(2).choice("aeth") for _ in range(20_000))]
    for t in texts:
        ids = codec.encode(t)
        assert ids == ",".join(map(str, enc.encode_ordinary(t)))
        assert codec.decode(ids) == t.encode()
    assert codec.encode(None) == codec.encode("") == "" and codec.decode("") == codec.decode(None) == b""


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    enc, codec = reference_encoding(), bpe.Codec(*bpe.public_files())
    text = " ".join(f"word{i % 37}x{i % 11}" for i in range(600))
    assert codec.encode(text) == ",".join(map(str, enc.encode_ordinary(text)))
    assert len(codec.young) <= 10 and len(codec.old) <= 10


def test_words_are_folded_by_ids():
    """Once the table of pairs is made, a fold looks no bytes up; it merges as the library does."""
    enc, codec = reference_encoding(), bpe.Codec(*bpe.public_files())
    rng = random.Random(3)
    pieces = [p for p in codec.ranks if p.isalpha()]
    words = [b"".join(rng.choice(pieces) for _ in range(rng.randint(2, 4)))[: bpe.CACHED_WORD].decode() for _ in range(2000)]
    words = [w for w in words if w.encode() not in codec.ranks] + ["é" * 9 + "中文" * 3 + "ßäö", "aaaaaaaaab" * 6]
    codec.ranks = {}
    assert all(codec.fold(w.encode()) == tuple(enc.encode_ordinary(w)) for w in words)


def test_native_and_arrow_styles_agree(spark):
    texts = [*odd_texts(150, 3), None, "", "Überfall it's 12 345!", "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("m", F.lit("clash"))
    enc = reference_encoding()
    arrow = {r.doc_id: r for r in bpe.encode_documents(df, *bpe.public_files()).collect()}
    native = {r.doc_id: r for r in bpe.encode_documents_native(df, bpe.public_vocabulary()).collect()}
    for i, t in enumerate(texts):
        assert arrow[i].ids == native[i].ids == ",".join(map(str, enc.encode_ordinary(t or "")))
        assert bytes(arrow[i].decoded) == bytes(native[i].decoded) == (t or "").encode()
    rows = {r.doc_id: r for r in bpe.digests(bpe.encode_documents(df, *bpe.public_files())).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids) and rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), *bpe.public_files()).count() == 0


def test_encoding_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y", "z")], DOCS + ", ids string, bpe string, _bpe string").withColumn("decoded", F.lit("d"))
    r = bpe.encode_documents(df, *bpe.public_files()).first()
    assert (r.bpe, r._bpe, bytes(r.decoded)) == ("y", "z", b"a b") and r.ids != "x"


def test_perfect_hash():
    for n in (0, 1, 2, 3, 500, 20_000):
        h = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
        moved, slots = bpe.perfect_hash(h)
        assert len(set(slots.tolist())) == n and (not n or slots.max() < bpe.slots_for(n)) and len(moved) == max(1, n) // 3 + 1


def test_language_accuracy_on_held_out(spark, sf):
    rows = language_id.op2_language_id(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    import zlib

    assert len(rows) == len(docs) and rows.score.between(0, 1).all()
    assert all(rows.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows.index)
    held = rows[rows.held_out]
    assert (held.lang_pred == docs.lang[held.index]).mean() >= 0.97


def test_language_edges(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the and of with which", "en"), ("der die das und nicht", "de"), ("le la les des une", "fr")] * 5)]
    model = language_id.fit(spark.createDataFrame([*train, (99, None, "en"), (100, "x", None)], "doc_id long, text string, lang string"))
    assert [model.predict(t)[0] for t in (None, "", "123 ... ²", "\n")] == ["und"] * 4
    assert model.predict("und das nicht die der")[0] == "de" and model.predict("the which of and")[0] == "en" and model.predict("les une des la")[0] == "fr"
    df = spark.createDataFrame([(1, "the and", 5), (1, "the and", 5), (None, None, 1), (2, "die und " * 30_000, 1)], "doc_id long, text string, score long")
    got = sorted((r.doc_id or 0, r.prediction.lang_pred) for r in language_id.predict(df, model).collect())
    assert got == [(0, "und"), (1, "en"), (1, "en"), (2, "de")]
    none = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none.predict("some text") == ("und", 0.0)
    one = language_id.fit(spark.createDataFrame([(1, "abc", "xx")], "doc_id long, text string, lang string"))
    assert one.predict("some text") == ("xx", 1.0)
    assert not language_id.has_letter("²³ ½ _") and language_id.has_letter("1 é")


def test_language_features_and_machines_against_brute_force():
    """N-grams counted one by one; the machine's objective against many plain gradient steps."""
    text = "Der Hund, die Katze é 12"
    data = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in b" " + text.lower().encode() + b" ")
    counts = np.zeros(language_id.DIM)
    for i in range(len(data)):
        code = 0
        for n in range(1, 5):
            if i + n > len(data):
                break
            code = data[i] if n == 1 else ((code << 8) & 0xFFFFFFFF) ^ data[i + n - 1] if n < 4 else ((code * 16777619) & 0xFFFFFFFF) ^ data[i + n - 1]
            counts[((code * 2654435761) & 0xFFFFFFFF) >> 21] += 1
    counts[((32 * 2654435761) & 0xFFFFFFFF) >> 21] = 0
    want = np.sqrt(counts) / np.linalg.norm(np.sqrt(counts))
    assert np.allclose(language_id.features(text), want, atol=1e-6)

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0.2, 1, -1).astype(np.float32)

    def objective(w, b, c=8.0):
        weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        return (w @ w + b * b) / (2 * c) + (weight * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()

    w, b = language_id.linear_svm(x, y)
    v = np.zeros(9)
    xb = np.hstack([x, np.ones((60, 1))])
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    for _ in range(20_000):
        v -= 0.05 * (v / 8.0 - 2 * (xb.T @ (weight * y * np.maximum(0, 1 - y * (xb @ v)))))
    assert objective(w, b) <= objective(v[:8], v[8]) + 1e-3


def test_language_votes_against_brute_force():
    """The family of the largest margin, then the language of most pairwise wins."""
    rng = np.random.default_rng(6)
    texts = {"en": "the of and with which that", "de": "der die das und nicht ein", "nl": "de het een niet van ook", "fr": "le la les des une est", "es": "el los las una por que", "xx": "zq zx qz vq"}
    rows = [(" ".join(rng.choice(words.split(), 12)), lang) for lang, words in texts.items() for _ in range(30)]
    model = language_id.Model(np.stack([language_id.features(t) for t, _ in rows]), [lang for _, lang in rows])
    assert len(model.families) == 3 and len(model.pairs) == 4
    for text, _ in rows[::7]:
        m = model.w @ language_id.features(text) + model.b
        inside = model.members[int(np.argmax(m[:3]))]
        wins = {i: sum((a if z >= 0 else b) == i for (a, b), z in zip(model.pairs, m[3:]) if a in inside) for i in inside}
        assert wins[model.langs.index(model.predict(text)[0])] == max(wins.values())
    assert np.mean([model.predict(t)[0] == lang for t, lang in rows]) > 0.95


def test_language_of_many_languages_and_of_nothing(spark):
    """No language is left out however many there are; an empty table; a column named like the result."""
    words = {f"l{i:03d}": " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}x" for c in "abcdef") for i in range(60)}
    rows = [(i * 10 + k, w, lang) for i, (lang, w) in enumerate(words.items()) for k in range(3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_train=16)
    assert model.langs == sorted(words)
    df = spark.createDataFrame([(1, "a")], DOCS).withColumn("prediction", F.lit("old"))
    assert language_id.predict(df, model).first().prediction.lang_pred in words
    assert language_id.predict(df.limit(0), model).count() == 0


def brute_marginals(field, odds):
    """All label sequences of one chain."""
    import itertools

    n = len(odds)
    total, good = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(o * k for o, k in zip(odds, y)) + sum(field.t[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    return good / total


def test_marginals_against_brute_force():
    field = quality.Field()
    rng = np.random.default_rng(0)
    field.t = rng.normal(size=(2, 2))
    sizes = np.array([3, 1, 6, 2])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    odds = rng.normal(size=sizes.sum())
    p, pairs = field.marginals(odds, begin, sizes)
    want = np.concatenate([brute_marginals(field, odds[b : b + s]) for b, s in zip(begin, sizes)])
    assert np.allclose(p, want)
    assert np.isclose(pairs.sum(), (sizes - 1).sum())


def test_gradient_raises_the_likelihood():
    good = ["A plain line of words that says a thing.\nAnd another one follows it here."] * 20
    bad = ["$$$ ### %%% &&&\nBUY!! NOW!! BUY!! NOW!!"] * 20
    field = quality.train(good + bad, np.array([1] * 20 + [0] * 20))
    s = field.score([good[0], bad[0], None, "", "\n \n", good[0] * 3000])
    assert s[0] > 0.8 and s[1] < 0.2 and s[2] == s[3] == s[4] and 0 <= s[2] <= 1 and s[5] > 0.8
    assert quality.train(["a"], np.array([1])).score(["x"])[0] == 0.5
    assert quality.lines_of("a\n\n \nb") == [b"a", b"b"]


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op10_quality_classifier(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    held = rows[rows.held_out].join(labels, how="inner")
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    assert (held.predicted == held.quality).mean() >= 0.93
    assert held.predicted[held.quality == 1].mean() >= 0.97


def test_documents_of_mixed_lines():
    """Bad documents of which half the lines are as in good ones."""
    rng = random.Random(3)
    line = lambda: "A plain line of words that says " + rng.choice(["this", "that", "more"]) + " and goes on."
    junk = lambda: rng.choice(["$$$ ### BUY NOW %%%", "|| >> || << || 1234 5678", "=== *** === *** ==="])
    good = ["\n".join(line() for _ in range(rng.randint(3, 9))) for _ in range(120)]
    bad = ["\n".join(rng.sample([line() for _ in range(4)] + [junk() for _ in range(4)], 8)) for _ in range(120)]
    field = quality.train(good + bad, np.array([1] * 120 + [0] * 120))
    s = field.score(good + bad)
    assert (s[:120] >= 0.5).mean() > 0.95 and (s[120:] < 0.5).mean() > 0.95


def test_quality_reads_whole_training_texts(spark):
    """What tells the labels apart lies beyond the first 200 lines; labels other than 0 and 1 are ignored; clashing columns."""
    body = "\n".join(f"line {i} of words" for i in range(250))
    rows = [(i, body + ("\n" + "$$ ## %% && ** !!" * 40 if i % 2 else "\nand a last line of words"), "s") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS + ", score string").withColumn("r", F.lit(1)).withColumn("y", F.lit(2))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(50)] + [(50, 7)], "doc_id long, quality int")
    field = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, field).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 0) for i in range(60))


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "")], DOCS)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    field = quality.fit(docs, labels)
    assert [r.score for r in quality.score(docs, field).collect()] == [0.5] * 4
    assert quality.score(docs.limit(0), field).count() == 0
    assert quality.fit(docs, labels.limit(0)).fitted is False


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("a &amp; b &nosuch; &#233;", "a & b &nosuch; é"), ("1 < 2 > 0", "1 < 2 > 0"),
        ("<p>one<p>two", "one\n\ntwo"), ("<p>a<br>b</p>c", "a\nb\n\nc"), ("a<div>b</div>c", "a\nb\nc"), ("<b>x</b> <i>y</i>", "x y"),
        ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol start=3><li>a<ul><li>n</ul><li>b</ol>", "3. a\n   - n\n4. b"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"), ("<table><caption>C</caption><tr><th colspan=2>h<tr><td>x<td>y</table>", "C\nh\nx  y"),
        ("<pre>\n a  b\n c</pre>z", " a  b\n c\n\nz"), ("<script>if(a<b){}</script>x<style>p{}</style>", "x"), ("<title>t</title><p>x", "x"),
        ("<p hidden>no</p><p style='display:none'>no</p><p style=\"visibility: hidden\">no</p><p aria-hidden=true>seen</p>yes", "seen\n\nyes"),
        ("<!-- c -->x<!-- open", "x"), ("x</nosuch>y</p>z", "xy\n\nz"), ("<img alt='pic'><input type=submit value=Go>", "picGo"), ("<p>unclosed <b attr='x", "unclosed"),
        ("<html><head><title>t</title><body><h1>H</h1>b", "H\n\nb"), ("<div>" * 5000 + "deep", "deep"), ("<option>a<option>b", "a\nb"),
        ("<p title=don't>hello</p><p>world</p>", "hello\n\nworld"), ("a<br><br>b<br>c", "a\n\nb\nc"), ("<p>a<br></p><p>b</p>", "a\n\nb"),
        ("<table><tr><td colspan='²'>a<td>b<tr><td>ccc<td>d</table>", "a    b\nccc  d"), ("<table><tr><td colspan=" + "9" * 5000 + ">a<td>b</table>", "a  b"),
        ("<table><tr><td colspan=2>a wide cell<td>x<tr><td>a<td>b<td>c</table>", "a wide cell  x\na  b         c"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c<td>d</table>", "A  b\n   c  d"), ("<textarea>x &amp; y\nz</textarea><select><option>1<option>2</select>", "x & y\nz\n1\n2"),
        ("<ol start='²'><li>a<li value=9>b<li>c</ol>", "1. a\n9. b\n10. c"), ("<ol start=" + "9" * 5000 + "><li>a</ol>", "1000000000. a"),
        ("a<!-->b<!--->c<!-- d --!>e</3>f", "abcef"), ("<object>o</object> <math><mi>x</mi></math> <svg><title>n</title><text>t</text></svg>", "o x t"),
        ("<a href=\"x\"class='y' b>z", "z"), ("<input value=v> <input type=hidden value=w><input type=checkbox value=c>", "v"),
        ("<table>" * 5000 + "x", "x"), ("<p>a<button>" + "<div>" * 50_000 + "b", "a\nb"), ("<b>x</b>" * 50_000, "x" * 50_000), ("<" * 50_000, "<" * 50_000),
    ],
)
def test_rendering(page, text):
    assert html_text.render(page) == text


def test_rendering_keeps_all_visible_words(spark, sf):
    """Against the standard parser: the same words in the same order on real pages."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title")
            self.out.append(" ")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title")
            self.out.append(" ")

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    rows = html_text.op5_html_extraction(spark, sf).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas().set_index("page_id")
    assert len(rows) == len(pages)
    for i, r in rows.iterrows():
        want = Words()
        want.feed(pages.html[i])
        bare = lambda words: [w for w in words if w != "-"]
        assert bare(r.text.split()) == bare("".join(want.out).split())
        assert r.n_chars == len(r.text) and r.n_lines == (len(r.text.split("\n")) if r.text else 0)


def test_extract_tables(spark):
    """Nulls, empty and repeated rows, extra columns, one of them named like the result; an empty table."""
    rows = [(1, "<p>a", "x"), (1, "<p>a", "x"), (None, None, None), (2, "", "y"), (3, "<table>" * 500 + "<td colspan='²'>b" + "<i>" * 100_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, rendered string").withColumn("text", F.lit(1))
    got = html_text.extract(df)
    assert sorted(got.columns) == ["html", "page_id", "rendered", "text"]
    assert sorted(((r.page_id, r.rendered) for r in got.collect()), key=str) == [(1, "a"), (1, "a"), (2, ""), (3, "b"), (None, "")]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("gap", [" ", "\n", "\r\n \t"])
def test_token_counts_of_long_white_space(spark, gap):
    path, pattern = bpe.public_files()
    text = "a" + gap * 1_000_000 + "b"
    assert token_counts.length_of(text, path, pattern) == bpe.codec(path, pattern).encode(text).count(",") + 1
    short = "a" + gap * 20_000 + "b" + gap
    assert token_counts.length_of(short, path, pattern) == len(reference_encoding().encode_ordinary(short)) == bpe.codec(path, pattern).encode(short).count(",") + 1


def test_token_counts_query(spark, tmp_path):
    """The registered query against counts, on rows with nulls, repeats and a long run, and on none."""
    texts = [None, "", "a", "a b", "a b", "x" + " " * 200_000 + "y", *["w " * (i % 7) for i in range(60)]]
    for name, rows in (("some", [(i % 40, t, "s") for i, t in enumerate(texts)]), ("none", [])):
        spark.createDataFrame(rows, DOCS + ", n_tokens string").write.parquet(str(tmp_path / name / "documents.parquet"))
        got = {r.n_tokens: r for r in token_counts.op7_token_counts(spark, str(tmp_path / name)).collect()}
        codec = bpe.codec(*bpe.public_files())
        sizes = [codec.encode(t).count(",") + 1 if t else 0 for _, t, _ in rows]
        assert sorted(got) == sorted(set(sizes))
        for n, r in got.items():
            assert (r.documents, r.tokens) == (sizes.count(n), n * sizes.count(n))
            assert r.truncated_total == sum(min(n, s) for s in sizes) and r.tokens_longer == sum(s for s in sizes if s > n)


def test_token_histogram_against_brute_force(spark):
    enc = reference_encoding()
    texts = [None, "", "a", "a b c", "a b c", "x " * 3000, *[f"word {i} " * (i % 23) for i in range(200)]]
    path, pattern = bpe.public_files()
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = token_counts.suffix_sums(token_counts.histogram(df, token_counts.encoded_length(F.col("text"), path, pattern))).collect()
    sizes = [len(enc.encode_ordinary(t or "")) for t in texts]
    assert sorted(r.n_tokens for r in rows) == sorted(set(sizes))
    for r in rows:
        longer = [n for n in sizes if n > r.n_tokens]
        assert (r.documents, r.documents_longer, r.tokens_longer) == (sizes.count(r.n_tokens), len(longer), sum(longer))
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in sizes) and r.share_within == pytest.approx(1 - len(longer) / len(sizes))
    limits = [0, 1, 5, 999, 10**6]
    answers = token_counts.suffix_sums(token_counts.histogram(df, token_counts.encoded_length(F.col("text"), path, pattern)))
    got = {r.context_limit: r.truncated_total for r in token_counts.at_limits(answers, limits).collect()}
    assert got == {k: sum(min(n, k) for n in sizes) for k in limits}
    assert token_counts.suffix_sums(token_counts.histogram(df.limit(0), F.lit(1))).count() == 0


def test_token_query(spark, sf):
    rows = token_counts.op7_token_counts(spark, sf).toPandas()
    assert rows.documents.sum() == spark.read.parquet(f"{sf}/documents.parquet").count()


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(r), r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls_against_brute_force(spark, sf):
    odd = [None, "", "no scheme", "http://", "HTTP://A.B.ORG", "x://Org/", "x://borg/", "http://é.ORG/fr/?q#f", "http://a.com/fr/x", "http://com/de/", "http://example.org/en/15", "http://sub.example.org/es/", "http://a.org?x=/y", "http://h/a://b", "http://a.com\n/fr/"]
    rows = [(i, u) for i, u in enumerate(odd)] + [(1, odd[4]), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = url_filter.judge(df).collect()
    assert len(got) == len(rows)
    assert sorted(((r.page_id is None, r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(((i is None, i, *brute_url(u)[:3]) for i, u in rows), key=str)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in url_filter.op8_url_filter(spark, sf).collect():
        host, path, rule, verdict = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_templates(spark):
    bad = [("http://h.x/ads/" + str(i), 1) for i in range(12)] + [("http://h.x/ads/999", None)]
    good = [("http://h.x/news/" + str(i), 0) for i in range(12)] + [("http://h.x/news/999", None), ("http://h.x/other/1", None), ("http://other.x/ads/1", None)]
    users = [(f"http://h.x/u/name{chr(97 + i % 26)}{chr(97 + i // 26)}/spam", 1) for i in range(60)] + [("http://h.x/u/somebody/spam", None)]
    rows = [(i, u, b) for i, (u, b) in enumerate(bad + good + users)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, rules=(), bad_col="bad").collect()}
    by_url = {u: got[i] for i, u, _ in rows}
    assert by_url["http://h.x/ads/999"] == "block" and by_url["http://h.x/u/somebody/spam"] == "block"
    assert all(by_url[u] == "allow" for u in ("http://h.x/news/999", "http://h.x/other/1", "http://other.x/ads/1"))


def brute_kind(s):
    import re

    if re.fullmatch(r"[0-9]+", s):
        return "{n}"
    if m := re.fullmatch(r"[0-9]+(\.[A-Za-z0-9]{1,5})", s):
        return "{n}" + m[1]
    if re.fullmatch(r"(?=.*[0-9])[0-9a-fA-F-]{8,}", s):
        return "{x}"
    return "{s}-{n}" if re.fullmatch(r"[A-Za-z_-]+[-_][0-9]+", s) else s


def brute_differ(b, n, other_b, other_n):
    if not n or not other_n:
        return False
    rate = (b + other_b) / (n + other_n)
    return abs(b / n - other_b / other_n) > url_filter.Z * (rate * (1 - rate) * (1 / n + 1 / other_n)) ** 0.5


def brute_walk(items, done=(), nodes=()):
    """{segs: (template, nodes)} of items {segs: (what is left, n, labelled, bad)}."""
    out = {k: (done, nodes) for k, v in items.items() if not v[0]}
    live = {k: v for k, v in items.items() if v[0]}
    if not live:
        return out
    run = 0
    while all(len(v[0]) > run for v in live.values()) and len({v[0][run] for v in live.values()}) == 1:
        run += 1
    if run:
        some = next(iter(live.values()))[0][:run]
        done = done + some
        live = {k: (v[0][run:], *v[1:]) for k, v in live.items()}
        out |= {k: (done, nodes) for k, v in live.items() if not v[0]}
        live = {k: v for k, v in live.items() if v[0]}
    kids = {}
    for left, *sums in live.values():
        kids[left[0]] = [a + b for a, b in zip(kids.get(left[0], [0, 0, 0]), sums)]
    literal = [c for c in kids if not c.startswith("{")]
    wide = len(literal) > url_filter.MANY and sum(kids[c][0] == 1 for c in literal) >= url_filter.NEW * sum(kids[c][0] for c in literal)
    label = {c: "*" if wide and c in literal else c for c in kids}
    sums = {}
    for c, x in label.items():
        sums[x] = [a + b for a, b in zip(sums.get(x, [0, 0]), kids[c][1:])]
    all_l, all_b = (sum(v[i] for v in sums.values()) for i in (0, 1))
    side = {}
    for x, (n, b) in sums.items():
        if n:
            side[x] = "~" if not brute_differ(b, n, all_b - b, all_l - n) else "~+" if b * (all_l - n) > (all_b - b) * n else "~-"
    merged = {}
    for x, s in side.items():
        pool_l, pool_b = (sum(sums[y][i] for y in side if side[y] == s) for i in (0, 1))
        if not brute_differ(sums[x][1], sums[x][0], pool_b - sums[x][1], pool_l - sums[x][0]):
            merged.setdefault(s, []).append(x)
    named = {x: x for x in sums} | {x: s for s, xs in merged.items() if len(xs) > 1 for x in xs}
    for name in set(named.values()):
        inside = {k: (v[0][1:], *v[1:]) for k, v in live.items() if named[label[v[0][0]]] == name}
        n, b = (sum(v[i] for v in inside.values()) for i in (2, 3))
        out |= brute_walk(inside, (*done, name), (*nodes, (n, b)))
    return out


def brute_rejected(urls):
    """{(host, segs): (template, purity)} of urls [(url, bad or None)], those that are rejected."""
    counts = {}
    for url, bad in urls:
        host, path, *_ = brute_url(url)
        key = host, tuple(brute_kind(s) for s in path.split("/") if s)
        c = counts.setdefault(key, [0, 0, 0])
        c[0] += 1
        if bad in (0, 1):
            c[1] += 1
            c[2] += bad

    def smooth(p, n, b):
        return (b + url_filter.K * (0.5 + url_filter.TRUST * (p - 0.5))) / (n + url_filter.K)

    out = {}
    for host in {h for h, _ in counts}:
        p = smooth(0.5, sum(c[1] for c in counts.values()), sum(c[2] for c in counts.values()))
        parts = host.split(".")
        for i in range(len(parts) - 1, -1, -1):
            domain = ".".join(parts[i:])
            inside = [c for (h, _), c in counts.items() if h == domain or h.endswith("." + domain)]
            p = smooth(p, sum(c[1] for c in inside), sum(c[2] for c in inside))
        found = brute_walk({s: (s, *c) for (h, s), c in counts.items() if h == host})
        own = {}
        for s, (template, nodes) in found.items():
            n, b = own.get(template, (0, 0))
            own[template] = n + counts[host, s][1], b + counts[host, s][2]
        for s, (template, nodes) in found.items():
            q = p
            for n, b in (*nodes, own[template]):
                q = smooth(q, n, b)
            if q >= url_filter.REJECT:
                out[host, s] = "/".join(template), q
    return out


def test_url_tree_against_brute_force(spark):
    rng = random.Random(20)
    rate = {f"h{i}.d{i % 3}.x": rng.choice([0.02, 0.4, 0.98]) for i in range(8)}
    urls = []
    for host, p in rate.items():
        tops = {t: rng.choice([p, p, 0.01, 0.99]) for t in ("ads", "news", "en", "de", "shop", "2020")}
        for _ in range(rng.choice([3, 60, 250])):
            top = rng.choice(list(tops))
            segs = [top, *rng.choice([[], [str(rng.randint(1, 999))], [f"user{rng.randint(1, 10**6)}a", "posts"], ["a", "b", "c", "d", "e", "f", "g", rng.choice("hi"), f"{rng.randint(1, 9)}.html"], [f"item-{rng.randint(1, 9)}"]])]
            bad = rng.choice([None, int(rng.random() < tops[top]), int(rng.random() < tops[top]), int(rng.random() < tops[top]), 7 if rng.random() < 0.1 else None])
            urls.append((f"http://{host}/" + "/".join(segs), bad))
    # deep paths, a hot one, a host bad everywhere with unlabelled branches, no host
    urls += [("http://deep.y/" + "s/" * 300 + x, b) for x, b in (("a/1", 1), ("a/x", 1), ("b", 0), ("c", None))]
    # a level of many names seen once, branches of like and of unlike shares
    urls += [(f"http://wide.y/u/{chr(97 + i // 6)}{chr(97 + i % 6)}q/spam", 1 if i % 4 else None) for i in range(40)]
    urls += [(f"http://like.y/{top}/1", b) for top, b in (("a", 1), ("b", 1), ("c", 0)) for _ in range(30)]
    urls += [("http://hot.y/", 0)] * 900 + [("http://all.bad.z/x/1", 1)] * 40 + [("http://all.bad.z/never/seen", None), (None, None), (None, 1), ("none", None)]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(urls)], "page_id long, url string, bad int")
    want = brute_rejected(urls)
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(df, rules=(), bad_col="bad").collect()}
    assert len(verdicts) == len(urls)
    for i, (u, _) in enumerate(urls):
        host, path, *_ = brute_url(u)
        assert verdicts[i] == ("block" if (host, tuple(brute_kind(s) for s in path.split("/") if s)) in want else "allow"), u
    # the trees themselves
    label = F.when(F.col("bad").isin(0, 1), F.col("bad"))
    host, path = url_filter.split_url(F.col("url"))
    counts = df.groupBy(host.alias("host"), url_filter.typed_segments(path).alias("segs")).agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).alias("bad"))
    got = {(r.host, tuple(r.segs)): (r.template, r.purity) for r in url_filter.rejected_paths(counts).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    named = {t for t, _ in want.values()}
    assert any("*" in t for t in named) and any("~" in t for t in named) and ("all.bad.z", ("never", "seen")) in want
    assert 5 < sum(v == "block" for v in verdicts.values()) < len(urls) - 5


def test_url_query_against_brute_force(spark):
    """On the tables, where only rules label urls: verdicts as by brute force."""
    sf = "/root/testdata/sf0.01"
    rows = url_filter.op8_url_filter(spark, sf).collect()
    urls = [(r.url, r.page_id) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    ruled = [brute_url(u)[3] for u, _ in urls]
    want = brute_rejected([(u, None if v is None else int(v == "block")) for (u, _), v in zip(urls, ruled)])
    expected = {}
    for (u, i), v in zip(urls, ruled):
        host, path, *_ = brute_url(u)
        expected[i] = v or ("block" if (host, tuple(brute_kind(s) for s in path.split("/") if s)) in want else "allow")
    assert {r.page_id: r.verdict for r in rows} == expected


def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from corpusmill.llm import common, exact_dedup, mixing, simhash_similar

    sf = "/root/testdata/sf0.001"
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    docs = common.table(spark, sf, "documents")
    good = pipeline.keep_good(spark, docs, sf)
    scores = quality.score(docs, quality.fitted_on(spark, docs, sf)).toPandas().set_index("doc_id").score
    assert {r.doc_id for r in good.collect()} == set(scores[scores >= quality.THRESHOLD].index) and good.columns == docs.columns
    single = pipeline.drop_copies(spark, good, sf)
    texts = {}
    for r in good.collect():
        texts[r.text] = max(r.doc_id, texts.get(r.text, -1))
    assert {r.doc_id for r in single.collect()} == set(texts.values()) and single.columns == docs.columns
    near = pipeline.drop_near_copies(spark, single, sf)
    found = simhash_similar.near_dedup_similar(single).collect()
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in found if r.doc_id == r.component_id}
    mixed = pipeline.mix_sources(spark, near, sf)
    taken = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in taken.items() for _ in range(n)) and mixed.columns == docs.columns
    last = pipeline.run(spark, sf).toPandas()
    enc = reference_encoding()
    want = pd.DataFrame([(r.doc_id, len(enc.encode_ordinary(r.text))) for r in mixed.collect()], columns=["doc_id", "n"])
    assert sorted(zip(last.doc_id, last.n_tokens)) == sorted(zip(want.doc_id, want.n))
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf).columns == docs.columns and stage(spark, empty, sf).count() == 0
    assert exact_dedup is not None


def test_near_copies_of_repeated_and_null_identifiers(spark):
    import corpus_pipeline as pipeline

    one, two, three = (" ".join(f"{p}{i}" for i in range(200)) for p in "abc")
    # 5 is a copy of 1 in one row and the only text of its class in another; 7 is repeated within a class; null copies 9
    rows = [(1, one), (5, one + " end"), (5, two), (7, three), (7, three + " end"), (9, "x y z"), (None, "x y  z")]
    kept = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = sorted((r.doc_id or 0, r.text[0]) for r in kept.collect())
    assert got == [(1, "a"), (5, "b"), (7, "c"), (9, "x")]


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, fp int, score string"
    rows = [(1, None, None, None, None, "r", 1), (1, None, None, None, None, "r", 1), (None, "", "en", "s", 0, None, None), (2, "word " * 60_000, "en", "s", 1, "x", 2), (3, "a b c d e f", "en", None, 1, "x", 2), (4, "a b c d e f", "en", None, 1, "x", 2)]
    rows = [(*r, "kept as it is") for r in rows]
    spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.createDataFrame(rows, schema)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        assert all(r.score == "kept as it is" and r.row in ("r", "x", None) for r in out.collect())
    assert pipeline.encode(spark, df, str(tmp_path)).count() == len(rows)
