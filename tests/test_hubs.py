"""Queries over all targets, those that many pages share included."""

from memoria.plans import catalog


def test_hubs_join_pages(spark, tmp_path):
    """25 pages share a target; pages 25 and 26 are reached through page 24's other target, page 27 by none."""
    links = {i: ["/hub"] for i in range(25)} | {24: ["/hub", "/side"], 25: ["/side"], 26: ["/side"], 27: ["/own"]}
    rows = [(i, f"http://p/{i}", "".join(f'<a href="{x}">' for x in found)) for i, found in links.items()]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path))

    assert {r.page_id: r.label for r in run("label_propagation_all").collect()} == dict.fromkeys(range(27), 0) | {27: 27}
    assert [tuple(r) for r in run("community_sizes_all").collect()] == [(0, 27)]
    assert {tuple(r) for r in run("khop2_targets").collect()} == {(0, "/hub", 1), (0, "/side", 2)}
