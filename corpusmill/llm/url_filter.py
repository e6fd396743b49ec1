"""URL filtering by rules and, beyond them, a path-template tree for each host.

Rules are text of a host and a path prefix with a verdict; a rule fits its
host and all subdomains, and the longest fitting rule decides. Other urls are
judged by the template of their path.

Segments are typed first (numbers, identifiers, file names with numbers). Then
the tree is walked from the root, branching by branching: the literal children
of a (host, prefix) become one wildcard if they are many and the next visit
would likely be to a child not seen before (the share of children visited
once, by Good and Turing, is at least ``NEW``). Labelled siblings are merged
if a two-proportion z test tells them neither from the rest of their siblings
nor, among those that differ from the rest in one direction, from each other's
pool; what lies below merged branches is one subtree from there on.

Purity, the share of bad labelled urls, is smoothed from the top: a node has
(bad + K * prior) / (labelled + K), its prior being the purity of the node
above it, brought nearer to one half by ``TRUST``. Above a host's root are its
parent domains, and all hosts. A template is rejected if its purity is at least
``REJECT``; so unlabelled templates are rejected only on hosts that are bad
nearly everywhere.

Only distinct typed paths, pre-aggregated in each task, are walked, a host that
holds a third of all urls costs what these do. Walking stops where a prefix has
one path left, runs that all paths share are passed at once, and the decisions
of a round go to the paths by a broadcast if they are counted to be few, else
by an equi-join. Rejected paths go to the urls by :func:`common.join_hot`, so
one url that holds a third of the rows is no large group.

Defined results: null urls and urls without ``://`` have an empty host and
path and no rule, and share the template of that empty host; paths may have
any number of segments; rows repeated are judged alike; labels other than 0
and 1 are null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Literal children that make a level variable: more than so many, with this chance of a new one.
MANY, NEW = 20, 0.1
#: z of the merge test; weight of the prior and trust in it; the purity that rejects.
Z, K, TRUST, REJECT = 2.58, 2.0, 0.8, 0.8
#: Decisions of a round (about 100 bytes each) up to which they are broadcast.
BROADCAST_TEMPLATES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host and path prefix, verdict) of the registered query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null and for urls without ``://``."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def typed_segments(path: Column) -> Column:
    """Segments with variable kinds named."""

    def kind(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^\d+$"), F.lit("{n}"))
            .when(s.rlike(r"^\d+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}."), F.regexp_extract(s, r"\.([A-Za-z0-9]+)$", 1)))
            .when(s.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), F.lit("{x}"))
            .when(s.rlike(r"^[A-Za-z_-]+[-_]\d+$"), F.lit("{s}-{n}"))
            .otherwise(s)
        )

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), kind)


def differ(bad: Column, labelled: Column, other_bad: Column, other_labelled: Column) -> Column:
    """Whether a two-proportion z test tells two shares apart; false if either has no label."""
    rate = F.try_divide(bad + other_bad, labelled + other_labelled)
    spread = F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1), labelled) + F.try_divide(F.lit(1), other_labelled)))
    far = F.abs(F.try_divide(bad, labelled) - F.try_divide(other_bad, other_labelled)) > Z * spread
    return F.coalesce(far, F.lit(False))


def branches(live: DataFrame) -> DataFrame:
    """``(host, done, child, label, labelled, bad)``: what each child of each node is called, and the counts of that branch."""
    literal = ~F.col("child").startswith("{")
    kids = live.groupBy("host", "done", F.get("left", F.lit(0)).alias("child")).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    node = Window.partitionBy("host", "done")
    count = lambda what, over: F.sum(F.when(what, 1).otherwise(0)).over(over)
    kids = kids.withColumns({"kids": count(literal, node), "once": count(literal & (F.col("n") == 1), node), "visits": F.sum(F.when(literal, F.col("n"))).over(node)})
    wide = literal & (F.col("kids") > MANY) & (F.col("once") >= NEW * F.col("visits"))
    kids = kids.select("host", "done", "child", "labelled", "bad", F.when(wide, F.lit("*")).otherwise(F.col("child")).alias("label"))
    # a wildcard is one sibling from here on
    one = Window.partitionBy("host", "done", "label")
    kids = kids.withColumns({"l": F.sum("labelled").over(one), "b": F.sum("bad").over(one), "all_l": F.sum("labelled").over(node), "all_b": F.sum("bad").over(node)})
    other_l, other_b = F.col("all_l") - F.col("l"), F.col("all_b") - F.col("b")
    side = F.when(~differ(F.col("b"), F.col("l"), other_b, other_l), F.lit("~")).when(F.col("b") * other_l > other_b * F.col("l"), F.lit("~+")).otherwise(F.lit("~-"))
    kids = kids.withColumn("side", F.when(F.col("l") > 0, side))
    alike = Window.partitionBy("host", "done", "side")
    pool_l, pool_b = F.sum("labelled").over(alike), F.sum("bad").over(alike)
    kids = kids.withColumns({"pool_l": pool_l, "pool_b": pool_b})
    apart = F.col("side").isNull() | differ(F.col("b"), F.col("l"), F.col("pool_b") - F.col("b"), F.col("pool_l") - F.col("l"))
    kids = kids.withColumn("named", F.when(apart, F.col("label")).otherwise(F.col("side")))
    # a merged branch of a single sibling keeps its name
    named = Window.partitionBy("host", "done", "named")
    kids = kids.withColumn("single", F.min("label").over(named) == F.max("label").over(named))
    kids = kids.withColumn("label", F.when(F.col("single"), F.col("label")).otherwise(F.col("named")))
    last = Window.partitionBy("host", "done", "label")
    return kids.select("host", "done", "child", "label", F.sum("labelled").over(last).alias("l"), F.sum("bad").over(last).alias("b"))


def shared_runs(live: DataFrame) -> DataFrame:
    """``(host, done, run)``: how many segments all that is left of a node's paths have in common; all of a single path's."""
    ends = live.groupBy("host", "done").agg(F.min("left").alias("lo"), F.max("left").alias("hi"))
    same = F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return ends.select("host", "done", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int").alias("run"))


def walk(counts: DataFrame) -> DataFrame:
    """``counts`` (host, segs, n, labelled, bad) with ``template`` and ``nodes``, the (l, b) of the branches it lies in, from the root on."""
    none = F.array().cast("array<struct<l:bigint,b:bigint>>")
    tree = counts.select("*", F.array().cast("array<string>").alias("done"), F.col("segs").alias("left"), none.alias("nodes"))
    ended = []
    while True:
        tree = common.cut(tree)
        ended.append(tree.where(F.size("left") == 0))
        live = tree.where(F.size("left") > 0)
        if live.isEmpty():
            break
        # paths that end at a node hold back the run of none: it is passed by those that go on
        runs = common.cut(shared_runs(live))
        runs = common.small_or_not(runs, runs.count(), BROADCAST_TEMPLATES)
        live = live.join(runs, ["host", "done"])
        live = live.withColumns({"done": F.concat("done", F.slice("left", F.lit(1), F.col("run"))), "left": F.slice("left", F.col("run") + 1, F.size("left"))}).drop("run")
        live = common.cut(live.select(*tree.columns))
        ended.append(live.where(F.size("left") == 0))
        live = live.where(F.size("left") > 0)
        found = common.cut(branches(live))
        found = common.small_or_not(found.withColumnRenamed("child", "c"), found.count(), BROADCAST_TEMPLATES)
        live = live.withColumn("c", F.get("left", F.lit(0))).join(found, ["host", "done", "c"])
        moved = {"done": F.concat("done", F.array("label")), "left": F.slice("left", F.lit(2), F.size("left")), "nodes": F.concat("nodes", F.array(F.struct("l", "b")))}
        tree = live.withColumns(moved).select(*tree.columns)
    out = ended[0]
    for other in ended[1:]:
        out = out.unionAll(other)
    return out.withColumn("template", F.array_join("done", "/")).drop("done", "left")


def smoothed(nodes: Column, prior: Column) -> Column:
    """Purity at the end of ``nodes`` (l, b), from the first on."""
    return F.aggregate(nodes, prior, lambda p, x: (x["b"] + F.lit(K) * (0.5 + F.lit(TRUST) * (p - 0.5))) / (x["l"] + F.lit(K)))


def host_purity(counts: DataFrame) -> DataFrame:
    """``(host, purity)`` by the labels of the host and, above it, of its parent domains and of all hosts."""
    hosts = common.cut(counts.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")))
    parts = F.split("host", r"\.")
    # the host itself, its parents, and "." for all
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("domain"), i.alias("at")))
    rows = common.cut(hosts.select("host", "l", "b", F.inline(F.concat(above, F.array(F.struct(F.lit(".").alias("domain"), (F.size(parts) + 1).alias("at")))))))
    domains = common.cut(rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.struct(F.sum("l").alias("l"), F.sum("b").alias("b")).alias("sums")))
    met = common.join_hot(rows, domains, "domain", "n", "sums")
    each = met.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("order"), F.col("sums.l").alias("l"), F.col("sums.b").alias("b")))).alias("nodes"))
    return each.select("host", smoothed(F.col("nodes"), F.lit(0.5)).alias("purity"))


def rejected_paths(counts: DataFrame) -> DataFrame:
    """The rows of ``counts`` with a rejected template, which is named, and its purity."""
    tree = common.cut(walk(counts))
    own = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.first("nodes").alias("nodes"))
    own = own.join(host_purity(counts), "host")
    purity = smoothed(F.concat("nodes", F.array(F.struct("l", "b"))), F.col("purity"))
    bad = own.select("host", "template", purity.alias("purity")).where(F.col("purity") >= REJECT)
    return common.cut(tree.join(bad, ["host", "template"]).select(*counts.columns, "template", "purity"))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, bad_col: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template: one row per row of ``df``.

    The tree learns from the 0/1 column ``bad_col`` (null: unlabelled), or,
    without one, from the urls that a rule blocks or allows.
    """
    host, path = split_url(df[url_col].cast("string"))
    bad = df[bad_col].cast("int") if bad_col else F.lit(None).cast("int")
    urls = df.select(df[id_col].alias("page_id"), host.alias("host"), path.alias("path"), F.when(bad.isin(0, 1), bad).alias("given"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), typed_segments(F.col("path")).alias("segs"), "given")
    label = F.col("given") if bad_col else F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int"))
    unruled = F.count_if(F.col("ruled").isNull()).alias("unruled")
    counts = common.cut(urls.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).alias("bad"), unruled))
    # neither hosts nor segments hold a "/"
    key = F.concat_ws("/", "host", "segs").alias("key")
    rejected = rejected_paths(counts).select(key, "unruled", F.lit("block").alias("verdict"))
    # the few paths that many urls have are named too if they are allowed, so that they are joined as hot
    total = counts.agg(F.coalesce(F.sum("unruled"), F.lit(0))).first()[0]
    frequent = counts.where(F.col("unruled") > max(common.LEAST_HOT, common.HOT_SHARE * total)).select(key, "unruled", F.lit("allow").alias("verdict"))
    known = common.cut(rejected.unionAll(frequent.join(rejected.select("key"), "key", "left_anti")))
    out = urls.select("page_id", "host", "path", "rule", "ruled", F.concat(F.lit("/"), F.array_join("segs", "/")).alias("template"), key)
    judged = common.join_hot(out.where("ruled is null"), known, "key", "unruled", "verdict", keep_all=True)
    ruled = out.where("ruled is not null").withColumn("verdict", F.col("ruled"))
    return judged.unionAll(ruled).select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "template")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLE_SQL: dict[str, str] = {}
