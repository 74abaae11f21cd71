"""Every query of the subpackage runs on empty tables."""

import pytest

import corpus_pipeline
from gridloom.llm import catalog

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("empty")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{top}/{name}.parquet")
    return str(top)


@pytest.mark.parametrize("name", [*catalog.QUERIES, "pipeline"])
def test_empty(spark, folder, name):
    query = corpus_pipeline.run if name == "pipeline" else catalog.QUERIES[name]
    assert query(spark, folder).count() == 0
