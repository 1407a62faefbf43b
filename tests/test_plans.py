"""What tasks hold at a time, as the plans show it: wide rows are sorted, shuffled and multiplied no more than needed."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from coinstrata.operators import tokens as K
from coinstrata.operators.ledger import first_per
from coinstrata.plans import ft, nft
from coinstrata.sources.star import StarLedger

from .test_tokens import ledger, out, spend


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("Initial Plan")[-1]


@pytest.fixture
def small(spark):
    return ledger(spark, [out("t1", 0, 10), out("t2", 0, 5), out("t2", 1, 9)], [spend("t1", 0, "t2", 10)], [out("m", 0, 3)], [spend("t2", 0, "m", 5)])


@pytest.fixture
def no_broadcast(spark):
    key, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def test_first_rows_are_not_sorted_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, n int, v string")
    first = first_per(rows, ["k"], [F.col("n")])
    assert sorted(map(tuple, first.collect())) == [(1, 1, "a"), (2, 5, "c")]
    assert plan(first).count("Sort [") == 1


def test_lineage_does_not_multiply_outputs_by_inputs(spark, small):
    """A transaction that consumes m rows and makes n outputs gives n rows to its join, not m times n."""
    many = 30
    outputs = [out("x", v, 1) for v in range(many)] + [out(f"p{i}", 0, 1) for i in range(many)]
    t = ledger(spark, outputs, [spend(f"p{i}", 0, "x", 1) for i in range(many)])
    checked = K.validate_lineage(t.outputs, t.spends, K.genesis_rows(t.outputs), K.genesis_outputs(t.outputs, t.spends))
    assert checked.count() == 2 * many
    assert "any_value" not in plan(checked) and "SortAggregate" not in plan(checked)


def test_a_repeated_outpoint_is_one_row_of_lineage(spark):
    t = ledger(spark, [out("x", 0, 1), out("x", 0, 1), out("x", 1, 1)], [])
    checked = K.validate_lineage(t.outputs, t.spends, K.genesis_rows(t.outputs), K.genesis_outputs(t.outputs, t.spends))
    assert sorted((r.tx_id, r.vout) for r in checked.collect()) == [("x", 0), ("x", 1)]


def test_address_history_joins_nothing(small):
    got = ft.ft_address_history(small, None, size=5)
    assert "Join" not in plan(got)
    # events by transaction, then only the pages' transactions by address
    assert plan(got).count("Exchange") == 2


def test_unique_outputs_are_sorted_once_for_window_and_join(small, no_broadcast):
    got = ft.ft_unique_utxos(small)
    # the rows, and the spends that they are held against
    assert plan(got).count("Sort [") == 2


def test_nft_info_does_not_sort_in_the_tasks_that_make_its_rows(spark):
    columns = "tx_id string, vout int, code_hash string, genesis string, sensible_id string, token_index decimal(20,0), token_supply decimal(20,0), meta_tx_id string, meta_vout bigint, height bigint"
    rows = [(f"t{i}", 0, "c", "g", "c/g", Decimal(i % 2), Decimal(9), f"m{i}", 0, 100 - i) for i in range(50)]
    late = [("u", 0, "c", "g", "c/g", Decimal(k), Decimal(9), "late", 0, -1) for k in (1, 2)]
    got = nft.nft_info(spark.createDataFrame(rows, columns), spark.createDataFrame(late, columns))
    assert sorted((int(r.token_index), r.meta_tx_id) for r in got.collect()) == [(0, "m48"), (1, "m49"), (2, "late")]
    # from the bottom of the plan up: rows are dealt out, and only then sorted
    steps = [x for x in re.findall(r"(Sort |Exchange |Union)", plan(got))[::-1]]
    assert steps[steps.index("Union") + 1 :][:2] == ["Exchange ", "Sort "]


def test_tx_ids_are_not_sorted_with_the_lines(spark):
    got = StarLedger(spark, "/root/testdata/sf0.001").lines
    below = plan(got.select("tx_id", "height")).split("Window ")[1]
    assert "tx_id" not in below
