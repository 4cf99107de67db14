"""Every query of the catalog against its SQL; those without SQL must run."""

import pytest
from compare import compare

from matrel import catalog

NAMES = sorted(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert compare(df, sql, sf) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["knn_exhaustive", "graph_energy", "label_transfer", "knn_label_equal", "knn_enrichment"])
def test_neighbours_with_null_vectors(spark, tmp_path, name):
    """A pair without distance comes last, as in the SQL."""
    rows = [(i, None if i in (3, 27) else [float((i * 37 + t * t * (i % 7)) % 101) for t in range(64)], i % 4 if i != 8 else None) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert compare(catalog.queries()[name](spark, str(tmp_path)), catalog.oracle_sql()[name], str(tmp_path)) is None
