import pytest

from conftest import compare
from corpusmill import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    got, want = compare(spark, sf, catalog.queries()[name], SQL[name])
    assert got == want
    if name not in ("gate_rejected", "seq_gaps", "tracker_duplicates", "tracker_extra"):
        assert got


def test_names_and_kinds():
    assert set(SQL) <= set(catalog.queries())
    assert {"codepoint_inventory"} == set(catalog.queries()) - set(SQL)


def test_forms_act_above_the_first_aggregate(spark, sf):
    """No filter takes a form below the aggregate to every occurrence, and one exchange by word serves both aggregates after it."""
    plan = catalog.queries()["word_frequency_normalized"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    form = [i for i, x in enumerate(lines) if "translate(" in x and "regexp_replace" in x]
    first = max(i for i, x in enumerate(lines) if "Aggregate" in x)
    assert form and max(form) < first
    physical = catalog.queries()["word_frequency_normalized"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert physical.count("RepartitionByExpression") + physical.count("REPARTITION_BY_COL") == 1


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_export_comes_back(spark, sf):
    want = catalog.queries()["ledger"](spark, sf)
    back = catalog.queries()["partitioned_export"](spark, sf)
    assert sorted(map(tuple, back.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_office_files_come_back(spark, sf):
    back = catalog.queries()["docx_roundtrip"](spark, sf)
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert sorted(r.line for r in back.collect()) == sorted(r.text or "" for r in turns)


def test_unicode_facts(spark, sf):
    rows = {r.decimal: r for r in catalog.queries()["codepoint_inventory"](spark, sf).collect()}
    assert (rows[10].unicode_name, rows[10].char, rows[10].category) == ("<no Unicode name assigned>", "\\n", "Cc")
    assert (rows[32].unicode_name, rows[32].char) == ("SPACE", "(space)")
    assert rows[0x200C].char == "(invisible)" and rows[0x64B].unicode_name == "ARABIC FATHATAN"
