"""Quality rules and source mixing on hard rows; every SQL text of the subpackage against its query."""

import pytest
from pyspark.sql import functions as F

from screenloom.llm import mixing, quality_rules
from screenloom.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same, connect

SCHEMA = "doc_id long, text string, source string, host string, key string, n_words int, row string, size int"
CLEAN = " ".join(f"w{i}" for i in range(80))


def table(spark, rows):
    return spark.createDataFrame([(*r, "h", "k", 1, "r", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_matches(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connect(sf), ORACLES[name])


def test_a_bad_host_loses_its_clean_documents(spark):
    """Most of a host fails, so its clean page goes too; a host of one failure is shrunk and keeps the rest."""
    rows = [(i, CLEAN, "good") for i in range(100)] + [(200 + i, "too short", "bad") for i in range(60)] + [(300, CLEAN, "bad")]
    rows += [(400, "short", "sparse"), (401, CLEAN, "sparse"), (402, CLEAN, None), (403, CLEAN, None)]
    docs = table(spark, rows)
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert got[300].kept is False and got[300].base_failed is False
    assert got[401].kept and got[402].kept and all(got[i].kept for i in range(100)) and not got[400].kept
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_hosts_alike_are_shrunk_to_the_corpus(spark):
    """Rates that differ no more than chance: every host gets the corpus rate, so a small unlucky host stays."""
    rows = [(10 * h + i, "short" if i < (3 if h == 0 else 1) else CLEAN, f"h{h}") for h in range(40) for i in range(4)]
    judged = quality_rules.base_rules(table(spark, rows))
    rates = {r.host: r.rate_base for r in quality_rules.host_verdicts(judged).collect()}
    assert max(rates.values()) < 0.5 and abs(rates["h0"] - rates["h1"]) < 0.2


def test_rules_on_hard_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "", "a"), (3, " \n\t", "a"), (None, CLEAN, "a"), (4, "long word " * 40000, "a"), (5, CLEAN, "a"), (5, CLEAN, "a")]
    got = quality_rules.apply_rules(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[4].n_words == 80000 and by[4].n_repeat_words == 80000 and by[4].base_failed
    assert by[5].n_repeat_words == 0 and not by[5].base_failed
    assert quality_rules.apply_rules(table(spark, [])).count() == 0
    assert quality_rules.kept_documents(table(spark, [])).count() == 0


def test_mix_on_hard_rows(spark):
    rows = [(None, f"no id {i} " * 3, None) for i in range(40)] + [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "w " * 500, "z")]
    first, again = (sorted(map(tuple, mixing.mix(table(spark, rows)).collect()), key=repr) for _ in range(2))
    assert first == again and len(first) == len(rows)
    sources = {}
    for _, size, source, source_size, target, taken in first:
        assert 0 <= taken <= 3 * size
        got = sources.setdefault(source, [0, 0, source_size, target])
        got[0], got[1] = got[0] + size, got[1] + taken
    assert all(size == whole and abs(taken - target) <= 1 for size, taken, whole, target in sources.values())
    assert sources["y"] == [0, 0, 0, 0.0]
    assert mixing.mix(table(spark, [])).count() == 0


def test_rows_without_an_id_spread_over_key_ranges(spark):
    from pyspark.sql import functions as F

    rows = table(spark, [(None, f"text {i}", "s") for i in range(200)])
    assert rows.select(F.substring(mixing.random_key(F.col("doc_id"), F.col("text"), "mix"), 1, 3)).distinct().count() > 150


def test_one_id_or_none_is_many_ranges(spark):
    """A third of all rows under one id, a third without: they spread over the key ranges by their texts; copies are one row with a count."""
    rows = [(1 if i % 3 == 0 else None if i % 3 == 1 else i, f"text number {i} " * (1 + i % 4), "a") for i in range(900)]
    docs = table(spark, rows)
    key = mixing.random_key(F.col("doc_id"), F.col("text"), "mix")
    assert docs.select(F.substring(key, 1, mixing.RANGE_DIGITS)).distinct().count() > 700
    copies = table(spark, [(1, "a b c", "x")] * 500 + [(i, "d e f g", "x") for i in range(2, 102)] + [(200, "one two", "y")])
    mixed = mixing.mix(copies).collect()
    assert len(mixed) == 601 and all(0 <= r.taken <= 3 * r.size for r in mixed)
    assert abs(sum(r.taken for r in mixed if r.source == "x") - mixed[0].target) < 8 or mixed[0].source != "x"
    assert sum(0 < r.taken % r.size for r in mixed if r.source == "x") <= 1
