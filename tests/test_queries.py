"""Every query of the Markdown operators against its SQL twin, and the two forms against each other."""

import pandas as pd
import pytest

from markloom import queries as Q
from markloom.operators import documents as D

from .conftest import SMALL


def plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    clean = lambda x: None if x is None or isinstance(x, float) and pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    return sorted((tuple(clean(x) for x in row) for row in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    assert plain(Q.QUERIES[name](spark, SMALL).toPandas()) == plain(duck.execute(Q.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_without_sql_runs(spark, name):
    assert Q.QUERIES[name](spark, SMALL).count() > 0


def test_nulls_empty_sources_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "# a", "z")], "doc_id long, source string, tag string")
    assert {r.doc_id: (r.html, r.tag) for r in D.to_html(df, "gfm").collect()} == {1: ("", "x"), 2: ("", "y"), 3: ("<h1>a</h1>\n", "z")}
    assert [r.doc_id for r in D.chunks_by_heading(df).collect()] == [3]
    assert D.to_html(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        D.to_html(df.withColumnRenamed("tag", "html"))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_read_markdown_tree(spark, tmp_path):
    from markloom.sources.documents import read_markdown

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# é")
    (tmp_path / "a" / "y.txt").write_text("no")
    (row,) = D.to_html(read_markdown(spark, str(tmp_path)), "gfm").collect()
    assert row.html == "<h1>é</h1>\n"
