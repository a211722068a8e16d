"""What keeps queries within bounds on large tables: no join is broadcast that grows with the documents,
and the rows of one row group are dealt to all cores before a Python kernel."""

import random

import pytest

from markloom import queries as Q
from markloom.operators import documents as D
from markloom.operators import relational as R

MIDDLE = "/root/testdata/sf0.1"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j3_section_members", "j4_ancestors", "j5_unwrapped_links", "g1_statistics_relational"])
def test_events_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(Q.QUERIES[name](spark, MIDDLE))


def test_section_members_of_any_levels(spark):
    draw = random.Random(1)
    docs = [(i, "".join(f"{'#' * draw.randint(1, 6)} h{k % 3}\n\nx{k}\n\n> # inner\n\n" if draw.random() < 0.8 else "y\n\n" for k in range(draw.randint(0, 9)))) for i in range(40)]
    events = D.parse_events(spark.createDataFrame([*docs, (None, "# a\n\nb")], "doc_id long, source string"))
    parts = R.sections(R.headings(events))
    held = [(e.doc_id, e.seq, p.id) for p in parts.collect() for e in events.collect() if e.doc_id == p.doc_id is not None and e.seq > p.end_seq and (p.section_end is None or e.seq < p.section_end)]
    assert sorted((r.doc_id, r.seq, r.section_id) for r in R.section_members(events, parts).collect()) == sorted(held)
    assert R.section_members(events, parts).columns == [*events.columns, "section_id"]


def test_sections_like_the_kernel(spark):
    draw = random.Random(2)
    docs = [(i, "\n\n".join(f"{'#' * draw.randint(1, 6)} h{draw.randint(0, 4)}\n\nx" for _ in range(draw.randint(1, 12)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, source string")
    found = R.sections(R.headings(D.parse_events(df, columns=R.HEADINGS)))
    rows = {(r.doc_id, r.seq // 6): (r.heading, r.level, r.id, r.breadcrumb) for r in found.collect()}
    assert rows == {(r.doc_id, r.pos): (r.heading, r.level, r.id, r.breadcrumb) for r in D.chunks_by_heading(df).collect()}
    assert "unboundedfollowing" not in plan(found) and "collect_list(struct(level" not in plan(found)


@pytest.mark.parametrize(
    "name",
    [
        "w1a_boundaries",
        "g1_statistics",
        "w3_top_level_blocks",
        "g1_statistics_relational",
        "src5_frontmatter",
        "x5_footnotes",
        "g9_truncated_counts",
        "w1_chunks_by_heading",
        "g2_light_statistics",
        "x3_code_blocks",
        "snk3_plain_text",
        "f7_highlight",
        "g8_section_counts",
        "w1c_breadcrumb",
        "f3_heading_ids",
        "g3_counted_text",
        "t1_table_functions",
        "snk2_to_markdown",
        "snk7_tidy_edges",
        "s2_hybrid_chunks",
    ],
)
def test_rows_are_dealt_before_the_kernel(spark, name):
    found = plan(Q.QUERIES[name](spark, MIDDLE))
    assert found.count("RoundRobinPartitioning") == found.count("FileScan") > 0


def test_spread_by_size(spark, tmp_path):
    spark.range(60000).selectExpr("id", "uuid() AS text").coalesce(1).write.parquet(str(tmp_path / "big"))
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "small"))
    sizes = Q.spread(spark.read.parquet(str(tmp_path / "big"))).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 2 * 60000 / len(sizes)
    assert "Exchange" not in plan(Q.spread(spark.read.parquet(str(tmp_path / "small"))))


def test_columns_of_events(spark):
    df = spark.createDataFrame([(1, "# é\n\n- [l](u)"), (2, "")], "doc_id long, source string")
    whole, names = D.parse_events(df), ["seq", "kind", "byte_start", "classes"]
    some = D.parse_events(df, columns=names[::-1])
    assert some.columns == ["doc_id", "seq", "kind", "classes", "byte_start"]
    assert some.collect() == whole.select(some.columns).collect() != []
    with pytest.raises(ValueError):
        D.parse_events(df, columns=["nosuch"])


def test_hybrid_chunks_are_sections_and_windows(spark):
    df = spark.createDataFrame([(1, "# a\n\n# b\n\nx\n\n# c\n\n" + "\n\n".join(c * 40 for c in "pqr")), (2, ""), (3, "é" * 60), (4, "é" * 61)], "doc_id long, source string")
    parts = D.chunks_by_heading(df).selectExpr("doc_id", "heading", "content AS source")
    small = parts.where("length(source) <= 60").selectExpr("doc_id", "heading", "0 AS index", "source AS content")
    large = D.chunks_by_size(parts.where("length(source) > 60"), chars=60).select("doc_id", "heading", "index", "content")
    found = D.hybrid_chunks(df, chars=60)
    assert sorted(map(tuple, found.drop("pos").collect()), key=str) == sorted(map(tuple, small.unionByName(large).collect()), key=str)
    assert plan(found).count("MapInArrow") == 1
