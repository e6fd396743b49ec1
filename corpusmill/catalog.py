"""Queries by name and the DuckDB SQL that each is compared with.

The SQL is written on its own terms: it evaluates forms on whole texts, sorts
where the queries bucket, and numbers rows with plain windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import charclass as C
from .functions.forms import FORMS
from .operators import frequency, gate, inventory, ledger, lexicon, structure, tracker
from .plans import fixed_tables as T
from .plans import views
from .sources import csvs, docx
from .sources.folders import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.token_counts(views.units(spark, sf_dir))


def _words(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    return frequency.word_table(frequency.token_counts(views.units(spark, sf_dir), by_word=form == "raw"), form)


# ---- SQL pieces -----------------------------------------------------------------------------

WS = f"[{C.SPACE}]"
q = C.sql_text


def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda x: x <> '')"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def sql_form(text: str, form: str) -> str:
    n1 = f"regexp_replace({text}, '[{C.ANNOTATION}]', '', 'g')"
    n2 = f"regexp_replace({n1}, '[{C.VOWELS}]', '', 'g')"
    n4 = f"regexp_replace(regexp_replace({n2}, '{C.ELONGATION}', '', 'g'), '[{C.ZERO_WIDTH}]', '', 'g')"
    n5 = sql_strip(f"regexp_replace(translate({n4}, {q(C.LETTERS_FROM)}, {q(C.LETTERS_TO)}), '{WS}+', ' ', 'g')")
    return {"raw": text, "no_marks": n1, "no_tashkeel": n2, "normalized": n5}[form]


UNITS = f"u AS (SELECT CAST(substr(source, 4) AS BIGINT) AS g, source AS gn, doc_id AS n, translate(coalesce(text, ''), {q(views.VIEW_FROM)}, {q(views.VIEW_TO)}) AS t FROM documents)"


def sql_word_table(form: str) -> str:
    return f"""{UNITS}, k AS (SELECT g, n, unnest({sql_tokens(sql_form('t', form))}) AS word FROM u),
m AS (SELECT word, count(*) AS c, min(g * 4294967296 + n) AS o, count(DISTINCT g) AS d FROM k GROUP BY word),
words AS (SELECT word, CAST(c AS BIGINT) AS "count", (o // 4294967296) || ':' || (o % 4294967296) AS first_occurrence,
  CAST(d AS BIGINT) AS number_of_distinct_surahs, CAST(length(word) AS BIGINT) AS character_length FROM m)"""


def sql_histogram(form: str) -> str:
    return f"""{sql_word_table(form)}, hist AS (
SELECT s AS slot, CASE WHEN s = 100 THEN '100+' ELSE CAST(s AS VARCHAR) END AS occurrences,
  CAST(count(w.word) AS BIGINT) AS distinct_word_types, CAST(coalesce(sum(w."count"), 0) AS BIGINT) AS tokens_accounted
FROM range(1, 101) r(s) LEFT JOIN words w ON least(w."count", 100) = s GROUP BY s)"""


# ---- frequency ------------------------------------------------------------------------------


def _register_forms() -> None:
    for form in FORMS:

        def words(spark, sf_dir, form=form):
            return _words(spark, sf_dir, form)

        query(f"word_frequency_{form}", f"WITH {sql_word_table(form)} SELECT * FROM words")(words)
        query(f"top200_{form}", f'WITH {sql_word_table(form)} SELECT * FROM words ORDER BY "count" DESC, word LIMIT 200')(lambda s, d, form=form: frequency.top(_words(s, d, form), 200))
        query(f"hapax_{form}", f'WITH {sql_word_table(form)} SELECT * FROM words WHERE "count" = 1')(lambda s, d, form=form: frequency.hapax(_words(s, d, form)))
        query(f"hist_{form}", f"WITH {sql_histogram(form)} SELECT occurrences, distinct_word_types, tokens_accounted FROM hist")(lambda s, d, form=form: frequency.histogram(_words(s, d, form)).drop("slot"))
    for form in ("normalized", "raw"):
        for kind, sign in (("longest", "DESC"), ("shortest", "ASC")):
            sql = f'WITH {sql_word_table(form)} SELECT * FROM words ORDER BY character_length {sign}, "count" DESC, word LIMIT 10'
            query(f"{kind}_{form}", sql)(lambda s, d, form=form, kind=kind: frequency.by_length(_words(s, d, form), 10, kind == "longest"))


_register_forms()


@query("top20_normalized", f'WITH {sql_word_table("normalized")} SELECT * FROM words ORDER BY "count" DESC, word LIMIT 20')
def top20(spark, sf_dir):
    return frequency.top(_words(spark, sf_dir, "normalized"), 20)


@query(
    "hist_rollup",
    f"""WITH {sql_histogram("normalized")}
SELECT CASE WHEN slot <= 10 THEN CAST(slot AS VARCHAR) WHEN slot < 100 THEN '11-99' ELSE '100+' END AS band,
  CAST(sum(distinct_word_types) AS BIGINT) AS distinct_word_types, CAST(sum(tokens_accounted) AS BIGINT) AS tokens_accounted,
  CAST(sum(distinct_word_types) AS DOUBLE) / (SELECT count(*) FROM words) AS type_share,
  CAST(sum(tokens_accounted) AS DOUBLE) / (SELECT sum("count") FROM words) AS token_share
FROM hist GROUP BY 1""",
)
def hist_rollup(spark, sf_dir):
    return frequency.histogram_rollup(_words(spark, sf_dir, "normalized"))


FORM_ROWS = " UNION ALL ".join(f"SELECT '{f}' AS form, g, gn, n, t, {sql_form('t', f)} AS ft FROM u" for f in FORMS)
FORM_TOKENS = f"{UNITS}, f AS ({FORM_ROWS}), k AS (SELECT form, g, unnest({sql_tokens('ft')}) AS word FROM f)"


@query(
    "form_totals",
    f"""WITH {FORM_TOKENS}, c AS (SELECT form, word, count(*) AS n FROM k GROUP BY form, word)
SELECT form, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, count(*) FILTER (WHERE n = 1) AS hapax,
  CAST(count(*) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS type_token_ratio FROM c GROUP BY form""",
)
def form_totals(spark, sf_dir):
    return frequency.form_totals(_counts(spark, sf_dir))


@query(
    "form_effect",
    f"""WITH {UNITS}, f AS ({FORM_ROWS})
SELECT form, CAST(sum(length(ft)) + count(*) - 1 AS BIGINT) AS chars, CAST(sum(length(t)) - sum(length(ft)) AS BIGINT) AS chars_removed_vs_raw,
  bool_and(ft = t) AS identical_to_raw FROM f GROUP BY form""",
)
def form_effect(spark, sf_dir):
    return frequency.form_effect(views.units(spark, sf_dir))


_STATS = ", ".join(
    f"CAST(coalesce(max(w) FILTER (WHERE form = '{f}'), 0) AS BIGINT) AS words_{f}, CAST(coalesce(max(d) FILTER (WHERE form = '{f}'), 0) AS BIGINT) AS unique_{f}, "
    f"coalesce(CAST(max(d) FILTER (WHERE form = '{f}') AS DOUBLE) / max(w) FILTER (WHERE form = '{f}'), 0.0) AS density_{f}"
    for f in FORMS
)
SQL_STATS = f"""{FORM_TOKENS}, c AS (SELECT form, g, count(*) AS w, count(DISTINCT word) AS d FROM k GROUP BY form, g),
stats AS (SELECT gr.g AS surah_number, gr.gn AS surah_name, gr.m AS ayah_count, {_STATS}
FROM (SELECT g, gn, count(*) AS m FROM u GROUP BY g, gn) gr LEFT JOIN c ON c.g = gr.g GROUP BY ALL)"""


@query("group_stats_wide", f"WITH {SQL_STATS} SELECT * FROM stats")
def group_stats(spark, sf_dir):
    units = views.units(spark, sf_dir)
    return frequency.group_statistics(units, frequency.token_counts(units))


@query(
    "group_stats_rounded",
    f"WITH {SQL_STATS} SELECT * REPLACE ({', '.join(f'round_even(density_{f}, 6) AS density_{f}' for f in FORMS)}) FROM stats",
)
def group_stats_rounded(spark, sf_dir):
    return frequency.rounded_densities(group_stats(spark, sf_dir))


@query(
    "top5_groups",
    f"WITH {SQL_STATS} SELECT surah_number, surah_name, ayah_count, words_normalized, unique_normalized, density_normalized FROM stats ORDER BY words_normalized DESC, surah_number LIMIT 5",
)
def top5_groups(spark, sf_dir):
    return frequency.top_groups(group_stats(spark, sf_dir))


# ---- code points ----------------------------------------------------------------------------

SQL_POINTS = f"""{UNITS}, c AS (SELECT unnest(string_split(t, '')) AS ch FROM u),
p AS (SELECT ch, CAST(unicode(ch) AS BIGINT) AS d, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch),
points AS (SELECT format('U+{{:04X}}', d) AS codepoint, d AS "decimal",
  CASE WHEN d = 10 THEN '\\n' WHEN d = 9 THEN '\\t' WHEN d = 32 THEN '(space)'
       WHEN d < 32 OR d BETWEEN 8203 AND 8207 OR d IN (65279, 160, 173) THEN '(invisible)' ELSE ch END AS "char", n AS "count" FROM p)"""


@query("codepoint_counts", f"WITH {SQL_POINTS} SELECT * FROM points")
def codepoint_counts(spark, sf_dir):
    return inventory.codepoint_counts(views.units(spark, sf_dir))


@query("codepoint_inventory")
def codepoint_inventory(spark, sf_dir):
    return inventory.codepoint_inventory(views.units(spark, sf_dir))


@query(
    "watched_codepoints",
    f"""WITH {SQL_POINTS} SELECT format('U+{{:04X}}', CAST(w AS BIGINT)) AS codepoint, coalesce("count", 0) AS "count"
FROM (SELECT unnest([{", ".join(map(str, T.WATCHED_CODEPOINTS))}]) AS w) LEFT JOIN points ON "decimal" = w""",
)
def watched_codepoints(spark, sf_dir):
    return inventory.watched(inventory.codepoint_counts(views.units(spark, sf_dir)), T.WATCHED_CODEPOINTS)


# ---- ledger ---------------------------------------------------------------------------------

SQL_LEDGER = f"""{UNITS}, l AS (SELECT g, gn, n, {sql_tokens("t")} AS toks FROM u),
k AS MATERIALIZED (SELECT g, gn, n, unnest(toks) AS word, unnest(range(1, len(toks) + 1)) AS pos FROM l),
a AS MATERIALIZED (SELECT word, count(*) AS c, count(DISTINCT g) AS d FROM k GROUP BY word),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY word ORDER BY g, n, pos) = 1),
ledger AS MATERIALIZED (SELECT s.word, g AS group_no, gn AS group_name, row_number() OVER (PARTITION BY g ORDER BY n, pos) AS no_in_group,
  count(*) OVER (PARTITION BY g) AS group_total, row_number() OVER (ORDER BY g, n, pos) AS global_no, 'No' AS done, c AS "count",
  g || ':' || n AS first_ref, d AS distinct_groups, row_number() OVER (ORDER BY c DESC, s.word) AS rank
  FROM s JOIN a ON a.word = s.word)"""


@query("ledger", f"WITH {SQL_LEDGER} SELECT * FROM ledger")
def word_ledger(spark, sf_dir):
    units = views.units(spark, sf_dir)
    return ledger.ledger(units, frequency.token_counts(units, by_word=True))


@query(
    "ledger_refs12",
    f"""WITH {SQL_LEDGER}, o AS (SELECT word, g, n, pos, row_number() OVER (PARTITION BY word ORDER BY g, n, pos) AS r FROM k)
SELECT o.word, string_agg(g || ':' || n, ' · ' ORDER BY r) FILTER (WHERE r <= 12) || CASE WHEN count(*) > 12 THEN ' … (+' || (count(*) - 12) || ')' ELSE '' END AS refs
FROM o GROUP BY o.word""",
)
def ledger_refs(spark, sf_dir):
    return ledger.all_references(views.units(spark, sf_dir))


@query(
    "new_words_per_group",
    f"""WITH {SQL_LEDGER}, gr AS (SELECT DISTINCT g, gn FROM u), c AS (SELECT group_no, count(*) AS w FROM ledger GROUP BY group_no)
SELECT g AS group_no, gn AS group_name, coalesce(w, 0) AS new_words, CAST(sum(coalesce(w, 0)) OVER (ORDER BY g) AS BIGINT) AS cumulative,
  CAST(100 * sum(coalesce(w, 0)) OVER (ORDER BY g) AS DOUBLE) / CAST(sum(coalesce(w, 0)) OVER () AS DOUBLE) AS percent FROM gr LEFT JOIN c ON g = group_no""",
)
def new_words(spark, sf_dir):
    return ledger.new_words(views.units(spark, sf_dir))


# ---- structure ------------------------------------------------------------------------------

SQL_LINES = f"""x AS (SELECT doc_id AS doc, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
lines AS (SELECT doc, i AS line_no, {sql_strip('''CASE WHEN i = 0 AND doc % 10 <> 9 THEN 'سورة ' || left(x, 20) WHEN i = 1 AND doc % 3 = 0 THEN '  بِسْمِ ' || left(x, 30)
  WHEN i = 2 AND doc % 6 = 0 THEN 'بِسْمِ ' || left(x, 25) WHEN i = 4 AND doc % 2 = 0 THEN 'سورة ' || left(x, 70) ELSE x END''')} AS line FROM x),
b AS (SELECT *, {sql_form("line", "no_tashkeel")} AS bare, regexp_matches(line, '[{C.DIGIT}]') AS dig, length(line) AS len FROM lines),
h AS (SELECT *, starts_with(bare, 'سورة') AND len < 60 AND NOT dig AS head, NOT dig AND len <= 45 AND starts_with(bare, 'بسم') AS form FROM b),
kinds AS (SELECT doc, line_no, line, CASE WHEN line = '' THEN 'blank' WHEN head THEN 'header'
  WHEN sum(CAST(head AS INT)) OVER (PARTITION BY doc ORDER BY line_no) = 0 THEN 'unclassified' WHEN form THEN 'formula' ELSE 'body' END AS kind,
  CAST(sum(CAST(head AS INT)) OVER (PARTITION BY doc ORDER BY line_no) AS BIGINT) AS block_no FROM h)"""
SQL_BLOCKS = f"""{SQL_LINES}, bl AS (SELECT doc, block_no, max(line) FILTER (WHERE kind = 'header') AS header_raw, arg_max(line, line_no) FILTER (WHERE kind = 'formula') AS formula,
  coalesce(string_agg(line, ' ' ORDER BY line_no) FILTER (WHERE kind = 'body'), '') AS body FROM kinds WHERE kind IN ('header', 'formula', 'body') GROUP BY doc, block_no),
blocks AS (SELECT doc, block_no, {sql_strip("substr(CASE WHEN ends_with(header_raw, 'القرآن الكريم :') THEN " + sql_strip("left(header_raw, length(header_raw) - 15)") + " ELSE header_raw END, 5)")} AS name, header_raw, formula, body FROM bl)"""


def _classified(spark, sf_dir):
    return structure.classify(views.lines(spark, sf_dir))


@query("classify_lines", f"WITH {SQL_LINES} SELECT * FROM kinds")
def classify_lines(spark, sf_dir):
    return _classified(spark, sf_dir)


@query("line_kinds", f"WITH {SQL_LINES} SELECT kind, count(*) AS n FROM kinds GROUP BY kind")
def line_kinds(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("unclassified_lines", f"WITH {SQL_LINES} SELECT doc, line_no, left(line, 80) AS shown FROM kinds WHERE kind = 'unclassified'")
def unclassified_lines(spark, sf_dir):
    return structure.unclassified(_classified(spark, sf_dir))


@query("blocks", f"WITH {SQL_BLOCKS} SELECT * FROM blocks")
def blocks(spark, sf_dir):
    return structure.blocks(_classified(spark, sf_dir))


@query("structural_elements", f"WITH {SQL_BLOCKS} SELECT doc, block_no, name, header_raw, formula IS NOT NULL AS basmalah_present, coalesce(formula, '') AS basmalah_text_raw FROM blocks")
def structural_elements(spark, sf_dir):
    return structure.structural(blocks(spark, sf_dir))


@query(
    "basmalah_census",
    f"""WITH {SQL_BLOCKS} SELECT doc_id AS doc, doc_id NOT IN (1, 9) AS anomalous FROM documents
WHERE doc_id NOT IN (SELECT doc FROM blocks WHERE formula IS NOT NULL)""",
)
def basmalah_census(spark, sf_dir):
    groups = views.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    return structure.formula_census(structural_elements(spark, sf_dir), "doc", groups, T.WITHOUT_FORMULA + T.FORMULA_IS_UNIT)


SQL_SEGMENTS = rf"""bo AS (SELECT doc_id AS doc, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
bd AS (SELECT doc, len(x) AS n_expected, array_to_string(list_transform(x, lambda s, i: CASE WHEN doc % 5 = 0 AND i = len(x) THEN s ELSE s || ' (' || i || ')' END), ' ') AS body FROM bo),
sp AS (SELECT doc, n_expected, regexp_split_to_array(body, '\([{C.DECIMAL}]+\)') AS p, regexp_extract_all(body, '\(([{C.DECIMAL}]+)\)', 1) AS m FROM bd),
ex AS (SELECT doc, n_expected, unnest(p) AS part, unnest(range(len(p))) AS seq, m FROM sp),
seg AS (SELECT doc, n_expected, seq, {sql_strip("part")} AS text, m[seq + 1] IS NULL AS inferred,
  CASE WHEN m[seq + 1] IS NULL THEN coalesce(TRY_CAST(m[len(m)] AS BIGINT), 0) + 1 ELSE TRY_CAST(m[seq + 1] AS BIGINT) END AS unit_no FROM ex),
segments AS (SELECT * FROM seg WHERE NOT inferred OR text <> '')"""


@query("segment_markers", f"WITH {SQL_SEGMENTS} SELECT doc, unit_no, text, seq, inferred FROM segments")
def segment_markers(spark, sf_dir):
    return structure.segment(views.bodies(spark, sf_dir), ["doc"])


@query(
    "trailing_audit",
    f"""WITH {SQL_SEGMENTS} SELECT doc, 'TRAILING_REMAINDER_AS_FINAL_AYAH' AS rule, unit_no AS inferred_ayah_number, CAST(n_expected AS BIGINT) AS expected_final_ayah,
  unit_no = n_expected AS boundary_matches, text AS text_raw FROM segments WHERE inferred""",
)
def trailing_audit(spark, sf_dir):
    bodies = views.bodies(spark, sf_dir)
    return structure.trailing_audit(structure.segment(bodies, ["doc"]), bodies.select("doc", "n_expected"), ["doc"])


# ---- lexicon and definitions ----------------------------------------------------------------


def sql_values(rows: tuple[tuple, ...], name: str, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(q(x) if isinstance(x, str) else str(x) for x in r) + ')' for r in rows)})"


SQL_FLAGS = f"""{UNITS}, {sql_values(views.LEXICON, "lex", "sk, rule, dec")}, {sql_values(views.GATE, "gt", "sk, sf, rule, dec, note")},
rw AS (SELECT g, gn, n, {sql_tokens("t")} AS r, {sql_tokens(sql_form("t", "no_tashkeel"))} AS b FROM u),
tk AS (SELECT g, gn, n, unnest(r) AS token_raw, unnest(b) AS token_no_tashkeel, unnest(range(len(r))) AS pos FROM rw WHERE len(r) = len(b)),
fl AS (SELECT tk.*, k.sk IS NOT NULL AS in_gate, gt.sf IS NOT NULL AS passed,
  CASE WHEN k.sk IS NOT NULL THEN gt.rule ELSE lex.rule END AS rule, CASE WHEN k.sk IS NOT NULL THEN gt.dec ELSE lex.dec END AS dec,
  CASE WHEN k.sk IS NOT NULL THEN gt.note ELSE '' END AS note
  FROM tk LEFT JOIN (SELECT DISTINCT sk FROM gt) k ON k.sk = token_no_tashkeel LEFT JOIN gt ON gt.sk = token_no_tashkeel AND gt.sf = token_raw
  LEFT JOIN lex ON lex.sk = token_no_tashkeel WHERE k.sk IS NOT NULL OR lex.sk IS NOT NULL),
review AS (SELECT g AS surah_number, gn AS surah_name, n AS ayah_number, g || ':' || n AS reference, token_raw, token_no_tashkeel, rule, dec AS suggested_decomposition,
  CAST(len(string_split(dec, '+')) - 1 AS BIGINT) AS implied_extra_tokens_if_split, note AS ambiguity_note, 'NONE — flagged for operator review only' AS action_taken, pos
  FROM fl WHERE NOT (in_gate AND NOT passed)),
rejected AS (SELECT token_no_tashkeel, count(*) AS "count", min(g * 4294967296 + n) AS first_ord FROM fl WHERE in_gate AND NOT passed GROUP BY 1)"""


def _flags(spark, sf_dir):
    return lexicon.flag_tokens(views.units(spark, sf_dir), lexicon.lexicon_table(spark, views.LEXICON), lexicon.gate_table(spark, views.GATE))


@query("fused_review", f"WITH {SQL_FLAGS} SELECT * FROM review")
def fused_review(spark, sf_dir):
    return lexicon.fused_review(_flags(spark, sf_dir))


@query("gate_rejected", f"WITH {SQL_FLAGS} SELECT * FROM rejected")
def gate_rejected(spark, sf_dir):
    return lexicon.gate_rejected(_flags(spark, sf_dir))


SQL_OPENINGS = f"""ok AS (SELECT g, n, {sql_tokens(sql_form("t", "no_tashkeel"))} AS w FROM u),
wanted AS (SELECT g AS surah, CASE WHEN n % 5 = 4 THEN -1 - n ELSE n END AS ayah, CASE WHEN n % 7 = 0 THEN 'zz' ELSE array_to_string(w[1:1 + n % 3], '') END AS letters FROM ok),
oj AS (SELECT surah, ayah, letters, w, list_transform(range(1, least(len(w), 6) + 1), lambda i: array_to_string(w[1:i], '')) AS accs FROM wanted LEFT JOIN ok ON g = surah AND n = ayah),
oh AS (SELECT *, list_position(list_transform(accs, lambda a: a = letters OR length(a) > length(letters)), true) AS hit FROM oj),
os AS (SELECT surah, ayah, letters, w, CASE WHEN w IS NULL THEN NULL WHEN hit IS NULL OR hit = 0 THEN len(w) WHEN accs[hit] = letters THEN hit ELSE -1 END AS sp FROM oh),
openings AS (SELECT surah, ayah, letters, CASE WHEN sp IS NULL THEN 'AYAH NOT FOUND' WHEN sp = 1 THEN 'already a single token' WHEN sp > 1 THEN 'written as ' || sp || ' separate tokens'
  ELSE 'NOT MATCHED at ayah start' END AS status, CAST(sp AS BIGINT) AS tokens_spanned, coalesce(array_to_string(w[1:3], ' '), '') AS surface FROM os)"""


def _openings(spark, sf_dir):
    units = views.units(spark, sf_dir)
    return lexicon.opening_letters(units, views.opening_words(units), small=False)


@query("prefix_merge", f"WITH {UNITS}, {SQL_OPENINGS} SELECT * FROM openings")
def prefix_merge(spark, sf_dir):
    return _openings(spark, sf_dir)


@query(
    "definitions_abcd",
    f"""WITH {SQL_FLAGS}, {SQL_OPENINGS}, {SQL_BLOCKS},
v AS (SELECT sum(len({sql_tokens("t")})) AS verse FROM u),
st AS (SELECT coalesce(sum(len({sql_tokens("formula")})), 0) AS formula, count(formula) AS formulas, sum(len({sql_tokens("header_raw")})) AS header, count(*) AS headers FROM blocks),
mg AS (SELECT coalesce(sum(tokens_spanned - 1) FILTER (WHERE tokens_spanned > 1), 0) AS merged, count(*) AS examined FROM openings),
rv AS (SELECT count(*) AS flagged, count(DISTINCT token_no_tashkeel) AS types, coalesce(sum(implied_extra_tokens_if_split), 0) AS extra FROM review),
rj AS (SELECT coalesce(sum("count"), 0) AS suppressed FROM rejected)
SELECT d AS definition, c AS component, CAST(x AS BIGINT) AS value FROM (
  SELECT unnest(['A','A','A','A','B','C','C','C','D','D','D','D','D','D','context','context']) AS d,
  unnest(['total','ayah_tokens','standalone_basmalah_tokens','standalone_basmalah_count','total','total','tokens_removed_by_muqattaat_merge','muqattaat_occurrences_examined','total','fused_occurrences_flagged',
   'distinct_fused_types','homographs_suppressed_by_vocalization_gate','hypothetical_total_if_all_split','hypothetical_extra_tokens','surah_header_tokens_excluded','surah_header_lines']) AS c,
  unnest([verse + formula, verse, formula, formulas, verse, verse - merged, merged, examined, verse, flagged, types, suppressed, verse + extra, extra, header, headers]) AS x
  FROM v, st, mg, rv, rj)""",
)
def definitions_abcd(spark, sf_dir):
    return lexicon.definitions(views.units(spark, sf_dir), structural_elements(spark, sf_dir), _openings(spark, sf_dir), _flags(spark, sf_dir))


@query(
    "review_rows",
    f"""WITH {SQL_FLAGS}, {SQL_SEGMENTS}, {SQL_BLOCKS}
SELECT 1 AS producer, reference, rule, token_raw, token_no_tashkeel, suggested_decomposition, action_taken FROM review
UNION ALL SELECT 2, doc || ':' || unit_no, 'TRAILING_REMAINDER_AS_FINAL_AYAH', text, {sql_form("text", "no_tashkeel")}, {q(T.TRAILING_DECOMPOSITION)}, {q(T.TRAILING_ACTION)} FROM segments WHERE inferred
UNION ALL SELECT 3, doc_id || ':0', 'BASMALAH_ABSENT_FROM_SOURCE', '', '', 'n/a', {q(T.ABSENT_ACTION)} FROM documents
WHERE doc_id NOT IN (1, 9) AND doc_id NOT IN (SELECT doc FROM blocks WHERE formula IS NOT NULL)""",
)
def review_rows(spark, sf_dir):
    return lexicon.review_rows(fused_review(spark, sf_dir), trailing_audit(spark, sf_dir), basmalah_census(spark, sf_dir), "doc")


# ---- gates ----------------------------------------------------------------------------------

_EXPECTED = tuple((g, 45 if g % 4 else 50) for g in range(22))
_SPOTS = ((0, 50, "first"), (1, 7, "second"))


@query(
    "gate_failures",
    f"""WITH u AS (SELECT CAST(substr(source, 4) AS BIGINT) AS g, doc_id AS n, coalesce(text, '') AS t FROM documents), {sql_values(_EXPECTED, "e", "g, x")}, {sql_values(_SPOTS, "sp", "g, x, label")},
c AS (SELECT g, count(*) AS n, min(n) AS lo, max(n) AS hi, count(DISTINCT n) AS d FROM u GROUP BY g),
w AS (SELECT e.g, coalesce(c.n, 0) AS n, e.x FROM e LEFT JOIN c ON c.g = e.g WHERE coalesce(c.n, 0) <> e.x),
leak AS (SELECT g, n, t FROM u WHERE regexp_matches(t, '[{C.DECIMAL}()A-Za-z]'))
SELECT 'group count' AS "check", '' AS "key", CAST(count(DISTINCT g) AS VARCHAR) AS detail FROM u HAVING count(DISTINCT g) <> 114
UNION ALL SELECT 'unit count', '', CAST(count(*) AS VARCHAR) FROM u HAVING count(*) <> 6236
UNION ALL SELECT 'group units', CAST(g AS VARCHAR), n || ' != ' || x FROM w
UNION ALL SELECT 'last units', g || ':' || n, left(t, 120) FROM (SELECT u.* FROM u JOIN w ON w.g = u.g QUALIFY row_number() OVER (PARTITION BY u.g ORDER BY u.n DESC, t DESC) <= 3)
UNION ALL SELECT 'unit sequence', CAST(g AS VARCHAR), n || ' ' || lo || ' ' || hi || ' ' || d FROM c WHERE lo <> 1 OR hi <> n OR d <> n
UNION ALL SELECT * FROM (SELECT 'markup leak', g || ':' || n, left(t, 100) FROM leak ORDER BY g, n LIMIT 5)
UNION ALL SELECT 'markup units', '', CAST(count(*) AS VARCHAR) FROM leak HAVING count(*) > 0
UNION ALL SELECT 'empty units', '', CAST(count(*) AS VARCHAR) FROM u WHERE t = '' HAVING count(*) > 0
UNION ALL SELECT 'spot check', label, CAST(coalesce(c.n, 0) AS VARCHAR) FROM sp LEFT JOIN c ON c.g = sp.g WHERE coalesce(c.n, 0) <> sp.x""",
)
def gate_failures(spark, sf_dir):
    expected = spark.createDataFrame(list(_EXPECTED), "group_no bigint, n_expected bigint")
    return gate.failures(views.units(spark, sf_dir, view=False), expected, 114, 6236, _SPOTS)


@query("seq_gaps", "SELECT s AS gap FROM range(1, (SELECT count(*) FROM labels) + 1) r(s) WHERE s NOT IN (SELECT doc_id FROM labels) ORDER BY s LIMIT 5")
def seq_gaps(spark, sf_dir):
    return gate.sequence_gaps(views.load(spark, sf_dir, "labels"), "doc_id")


@query(
    "turn_sequences",
    """WITH o AS (SELECT conv_id, turn + 1 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
SELECT count(DISTINCT conv_id) FILTER (WHERE n <> r) AS out_of_order, count(DISTINCT conv_id) AS groups FROM o""",
)
def turn_sequences(spark, sf_dir):
    turns = views.load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_no"), (F.col("turn") + 1).alias("unit_no"), "turn")
    off = gate.ordered_sequence_violations(turns, "turn").agg(F.count(F.lit(1)).alias("out_of_order"))
    groups = turns.agg(F.count_distinct("group_no").alias("groups"))
    return off.withColumn("k", F.lit(1)).join(F.broadcast(groups.withColumn("k", F.lit(1))), "k").drop("k")


@query(
    "duplicate_keys",
    """WITH c AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicated_keys, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_of_duplicated_keys FROM c""",
)
def duplicate_keys(spark, sf_dir):
    return gate.duplicate_rows(views.load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- tracker --------------------------------------------------------------------------------

#: A tracker with faults: words dropped, added and repeated, counts, numbers and references changed, done values of all kinds.
SQL_TRACKER = f"""{SQL_LEDGER}, t0 AS (SELECT *, length(word) AS len FROM ledger WHERE length(word) % 17 <> 0),
t1 AS (SELECT word, global_no, "count", first_ref, group_name AS surah, len FROM t0
  UNION ALL SELECT word || 'ZZ', global_no + 10000000, "count", first_ref, group_name, len FROM t0 WHERE len % 19 = 0
  UNION ALL SELECT word, global_no, "count", first_ref, group_name, len FROM t0 WHERE len % 23 = 0),
tracker AS MATERIALIZED (SELECT word, CASE WHEN len % 11 = 0 THEN global_no + 5000000 ELSE global_no END AS global_no,
  CASE global_no % 5 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'نعم' WHEN 2 THEN 'maybe' WHEN 3 THEN NULL ELSE 'No' END AS done,
  CASE WHEN len % 13 = 0 THEN "count" + 1 ELSE "count" END AS "count", CASE WHEN len % 7 = 0 THEN '999:' || first_ref ELSE first_ref END AS first_ref, surah FROM t1),
vocab AS MATERIALIZED (SELECT word AS vw, c AS vc FROM a), refs AS MATERIALIZED (SELECT DISTINCT g || ':' || n AS ref FROM u)"""


T_ROWS = "array<struct<word:string,global_no:bigint>>"


def _tracker(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracker, vocabulary, units); the first two are columns of the ledger's numbered rows, which are written."""
    units = views.units(spark, sf_dir)
    numbered = ledger.numbered(frequency.token_counts(units, by_word=True))
    base = ledger.in_groups(numbered, units).withColumn("len", F.length("word")).where("len % 17 <> 0")
    itself = F.struct("word", "global_no")
    added = F.struct(F.concat("word", F.lit("ZZ")).alias("word"), (F.col("global_no") + 10_000_000).alias("global_no"))
    each = F.concat(F.array(itself), *[F.when(F.col("len") % n == 0, F.array(x)).otherwise(F.array().cast(T_ROWS)) for n, x in ((19, added), (23, itself))])
    rows = base.select(F.inline(each), "count", "first_ref", F.col("group_name").alias("surah"), "len")
    no = F.col("global_no") % 5
    out = rows.select(
        "word",
        F.when(F.col("len") % 11 == 0, F.col("global_no") + 5_000_000).otherwise(F.col("global_no")).alias("global_no"),
        F.when(no == 0, " Yes ").when(no == 1, "نعم").when(no == 2, "maybe").when(no == 3, F.lit(None)).otherwise("No").alias("done"),
        F.when(F.col("len") % 13 == 0, F.col("count") + 1).otherwise(F.col("count")).alias("count"),
        F.when(F.col("len") % 7 == 0, F.concat(F.lit("999:"), "first_ref")).otherwise(F.col("first_ref")).alias("first_ref"),
        "surah",
    )
    return out, numbered.select(F.col("word").alias("vocab_word"), F.col("count").alias("vocab_count")), units


_DONE = f"lower({sql_strip(chr(99) + 'oalesce(done, ' + chr(39) * 2 + ')')})"
_ALLOWED = ", ".join(map(q, T.DONE_ALLOWED))
_YES = ", ".join(map(q, T.DONE_YES))


@query(
    "tracker_checks",
    f"""WITH {SQL_TRACKER}, sm AS (SELECT count(*) AS n, min(global_no) AS lo, max(global_no) AS hi, count(DISTINCT global_no) AS d, sum("count") AS c FROM tracker),
o AS (SELECT '1' AS check_no, 'number of rows' AS label, n = 17576 AS ok, n AS observed FROM sm
UNION ALL SELECT '2', 'no word twice', count(*) = count(DISTINCT word), count(*) - count(DISTINCT word) FROM tracker
UNION ALL SELECT '3', 'numbers 1..N', lo = 1 AND hi = n AND d = n, d FROM sm
UNION ALL SELECT '4', 'every word is in the corpus', count(*) = 0, count(*) FROM (SELECT word FROM tracker EXCEPT SELECT vw FROM vocab)
UNION ALL SELECT '5', 'every word of the corpus is there', count(*) = 0, count(*) FROM (SELECT vw FROM vocab EXCEPT SELECT word FROM tracker)
UNION ALL SELECT '6', 'sum of counts', c = 77794, c FROM sm
UNION ALL SELECT '6b', 'counts word by word', count(*) = 0, count(*) FROM tracker LEFT JOIN vocab ON vw = word WHERE "count" IS DISTINCT FROM vc
UNION ALL SELECT '7', 'references exist', count(*) = 0, count(*) FROM tracker WHERE first_ref NOT IN (SELECT ref FROM refs)
UNION ALL SELECT '8', 'done values are legal', count(*) = 0, count(*) FROM (SELECT DISTINCT {_DONE} AS v FROM tracker) WHERE v NOT IN ({_ALLOWED}))
SELECT check_no, label, ok, CAST(observed AS BIGINT) AS observed FROM o""",
)
def tracker_checks(spark, sf_dir):
    t, vocab, units = _tracker(spark, sf_dir)
    return tracker.checks(t, units, vocab, 17_576, 77_794)


@query("tracker_extra", f"WITH {SQL_TRACKER} SELECT word FROM tracker EXCEPT SELECT vw FROM vocab")
def tracker_extra(spark, sf_dir):
    t, vocab, _ = _tracker(spark, sf_dir)
    return tracker.extra_words(t, vocab)


@query("tracker_missing", f"WITH {SQL_TRACKER} SELECT vw AS word FROM vocab EXCEPT SELECT word FROM tracker")
def tracker_missing(spark, sf_dir):
    t, vocab, _ = _tracker(spark, sf_dir)
    return tracker.missing_words(t, vocab)


@query("tracker_mismatch", f'WITH {SQL_TRACKER} SELECT word, global_no, "count", vc AS vocab_count FROM tracker LEFT JOIN vocab ON vw = word WHERE "count" IS DISTINCT FROM vc')
def tracker_mismatch(spark, sf_dir):
    t, vocab, _ = _tracker(spark, sf_dir)
    return tracker.mismatches(t, vocab)


@query("tracker_bad_refs", f"WITH {SQL_TRACKER} SELECT word, global_no, first_ref FROM tracker WHERE first_ref NOT IN (SELECT ref FROM refs)")
def tracker_bad_refs(spark, sf_dir):
    t, _, units = _tracker(spark, sf_dir)
    return tracker.bad_references(t, units)


@query("tracker_duplicates", f"WITH {SQL_TRACKER} SELECT word, count(*) AS n FROM tracker GROUP BY word HAVING count(*) > 1")
def tracker_duplicates(spark, sf_dir):
    return tracker.duplicates(_tracker(spark, sf_dir)[0])


@query("tracker_bad_done", f"WITH {SQL_TRACKER} SELECT DISTINCT {_DONE} AS value FROM tracker WHERE {_DONE} NOT IN ({_ALLOWED})")
def tracker_bad_done(spark, sf_dir):
    return tracker.bad_done(_tracker(spark, sf_dir)[0])


@query(
    "tracker_progress",
    f"""WITH {SQL_TRACKER}, p AS (SELECT count(*) FILTER (WHERE {_DONE} IN ({_YES})) AS d, count(*) AS n FROM tracker)
SELECT d AS done, n - d AS pending, CAST(100 * d AS DOUBLE) / n AS percent FROM p""",
)
def tracker_progress(spark, sf_dir):
    return tracker.progress(_tracker(spark, sf_dir)[0])


@query("tracker_next3", f"WITH {SQL_TRACKER} SELECT global_no, word, first_ref, surah FROM tracker WHERE {_DONE} NOT IN ({_YES}) ORDER BY global_no, word LIMIT 3")
def tracker_next3(spark, sf_dir):
    return tracker.next_pending(_tracker(spark, sf_dir)[0])


# ---- sources and sinks ----------------------------------------------------------------------


@query("partitioned_export", f"WITH {SQL_LEDGER} SELECT * FROM ledger")
def partitioned_export(spark, sf_dir):
    """The ledger written as a folder for each group and read again."""
    path = shared_folder(spark, "ledger")
    csvs.write_partitioned(word_ledger(spark, sf_dir), path, "group_no", "no_in_group")
    return csvs.read_csv(spark, path, "word string, group_name string, no_in_group bigint, group_total bigint, global_no bigint, done string, `count` bigint, first_ref string, distinct_groups bigint, rank bigint, group_no bigint")


@query("docx_roundtrip", "SELECT CAST(conv_id AS VARCHAR) AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) - 1 AS line_no, coalesce(text, '') AS line FROM conversations")
def docx_roundtrip(spark, sf_dir):
    """Each conversation's turns put into an office file and read again as paragraphs."""
    path = shared_folder(spark, "docx")
    turns = views.load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("line_no"), F.coalesce("text", F.lit("")).alias("line"))
    docx.write_docx(turns, path)
    return docx.read_written(spark, path)
