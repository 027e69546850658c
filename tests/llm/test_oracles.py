import pytest

from clustrum.llm.queries import oracle_sql, queries
from tests.checks import agree, connect


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_sql(spark, sf, name):
    agree(queries()[name](spark, sf), oracle_sql()[name], connect(sf))


@pytest.mark.parametrize("name", ["op4_license_scan", "op5_jaccard_join", "op6_source_mixing", "op11_repeated_bytes", "op12_periodic_runs", "op13_merkle_manifest"])
def test_messy_table_agrees_with_sql(spark, messy, tmp_path, name):
    rows = messy.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars")
    (tmp_path / "t").mkdir()
    rows.coalesce(1).write.parquet(str(tmp_path / "t" / "documents.parquet"))
    agree(queries()[name](spark, str(tmp_path / "t")), oracle_sql()[name], connect(str(tmp_path / "t")))
