"""Every operator over odd and empty tables, and with further columns of clashing names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kgweave.llm.queries import QUERIES

NAMES = sorted(QUERIES)
#: Names that the operators use inside, or give their results.
CLASH = """size shard slot k h g nth node comp skey target taken times again score spans part rule_id row key bucket mix_key mix_bucket text_md5 source_size
    doc clean base more wide all email ip pii_text pii_base pii_email region tree path sig set_key kept component_id held_out predicted toxic terms last which
    copies kd_node kd_tie kd_row gkey media rgb feature start length offset sequence_id value n order crc""".split()


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    table = "pages" if "html" in name else "documents"
    n = spark.read.parquet(f"{odd}/{table}.parquet").count()
    if name.startswith("op9_"):
        assert sum(r["start"] == 0 for r in rows) == n
    else:
        assert len(rows) == n


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages(spark, kind, request):
    sf_dir = request.getfixturevalue(kind)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        else:
            assert (out.count() > 0) == (kind == "odd")


@pytest.fixture(scope="module")
def clashing(spark, plain, tmp_path_factory):
    """The plain tables, and the same with further columns: one of each clashing name, holding an address."""
    bare, more = (str(tmp_path_factory.mktemp(k)) for k in ("bare", "more"))
    for table in ("documents", "labels", "pages"):
        rows = spark.read.parquet(f"{plain}/{table}.parquet").orderBy("page_id" if table == "pages" else "doc_id")
        rows = rows.limit(80).coalesce(1)
        rows.write.parquet(f"{bare}/{table}.parquet")
        rows.withColumns({c: F.lit("other@host.com") for c in CLASH if c not in rows.columns}).write.parquet(f"{more}/{table}.parquet")
    return bare, more


def as_bag(rows, columns):
    return Counter(repr([r[c] for c in columns]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_clashing_names_change_nothing(spark, clashing, name):
    bare, more = (QUERIES[name](spark, d) for d in clashing)
    assert bare.columns == more.columns
    assert as_bag(bare.collect(), bare.columns) == as_bag(more.collect(), bare.columns)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_pass_clashing_columns_through(spark, clashing, name, stage):
    bare, more = (stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d) for d in clashing)
    if name != "pack":
        assert set(more.columns) >= set(CLASH)
        assert all(r[c] == "other@host.com" for r in more.collect() for c in CLASH)
    assert as_bag(bare.collect(), bare.columns) == as_bag(more.collect(), bare.columns)
    if name == "pii":
        assert any("[EMAIL]" in (r["text"] or "") for r in bare.collect()) and not any("@host.example.com" in (r["text"] or "") for r in more.collect())
