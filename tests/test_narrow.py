"""What queries read decides what is computed: lookup sizes, validation without lookups, narrow stored tables."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from eventlake.operators.lookup import estimated_bytes
from eventlake.plans.process import needed
from eventlake.operators.validate import violations
from suite import inputs, q_core, q_lake

SF = "/root/testdata/sf0.001"


def test_lookup_tables_have_the_size_of_their_rows(spark):
    for name, key in inputs.KEYS.items():
        rows = inputs.loaded(spark, SF, name)
        assert rows.groupBy(key).count().filter("count > 1").isEmpty()
        assert all(f"dimension_{name}" in f for f in rows.inputFiles())
    # all assets fall on few addresses: the derivation is estimated by the table behind it, the stored table by its rows
    many = inputs.dimension(spark, "/root/testdata/sf0.1", "assets")
    stored = inputs.loaded(spark, "/root/testdata/sf0.1", "assets")
    assert estimated_bytes(stored) < estimated_bytes(many)


def test_validation_needs_no_lookups(spark):
    read = needed(["violations"])
    assert not read & {"enrich_risk_score", "enrich_ioc_match", "dst_asset_critical"}
    assert "enrich_risk_score" in needed(["violations", "enrich_risk_score"])
    # the rule stays where the score is there
    now = F.lit(int(datetime(2024, 1, 31, tzinfo=timezone.utc).timestamp()) * 1_000_000_000)
    assert "enrich_risk_score" in str(violations(now))
    assert "enrich_risk_score" not in str(violations(now, ("enrich_risk_score",)))


def test_dead_letters_and_board_make_no_table_of_all_columns(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(inputs, "event_rows", lambda *_: (_ for _ in ()).throw(AssertionError("all columns")))
    monkeypatch.setattr(inputs, "stored", lambda s, d, name, build: made.setdefault(name, build()))
    q_core.dlq_rows(spark, SF)
    q_lake.board(spark, SF)
    assert made["dead_letters"].columns == ["event_id", "raw_ref", "reason", "parser_id", "occurred_at", "resolved"]
    assert len(made["board_events"].columns) == 11
