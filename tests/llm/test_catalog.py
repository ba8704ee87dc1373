import pytest
from oracle import compare

from millrace.llm import catalog

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    compare(catalog.queries()[name](spark, ROOT), catalog.oracle_sql()[name], ROOT)


def test_eleven_queries():
    assert {n.split("_")[0] for n in catalog.queries()} == {"pipeline", "media", *(f"op{k}" for k in range(1, 11))}


def test_clips_of_the_documents_are_all_decoded(spark):
    got = catalog.media_clips(spark, ROOT)
    assert got.filter("status <> 'ok'").count() == 0
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{ROOT}/documents.parquet").count()
