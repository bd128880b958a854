"""Template trees with many children and long paths."""

from __future__ import annotations

from gridloom.llm import urls


def judged(spark, rows):
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(rows) if b is not None], "page_id long, bad boolean")
    return {rows[r.page_id][0]: r for r in urls.judge(pages, labels).collect()}


def test_a_child_that_differs_keeps_its_branch_among_many(spark):
    rows = [(f"http://h.net/spam/{k}", True) for k in range(500)] + [(f"http://h.net/site{k}/{m}", False) for k in range(60) for m in range(5)]
    got = judged(spark, rows)
    assert got["http://h.net/spam/7"].template == "/spam/<n>" and got["http://h.net/spam/7"].verdict == "block"
    assert got["http://h.net/site3/1"].template == "/*/<n>" and got["http://h.net/site3/1"].verdict == "allow"


def test_branches_below_the_fourth_segment(spark):
    rows = []
    for k in range(60):
        rows += [(f"http://h.net/a/b/c/d/spam/{k}", True), (f"http://h.net/a/b/c/d/news/{k}", False)]
        rows += [(f"http://g.net/a/b/c/d/e{k}/f/g/bad/{k}", True), (f"http://g.net/a/b/c/d/e{k}/f/g/fine/{k}", False)]
        rows += [(f"http://f.net/1/2/3/4/x{k}", True), (f"http://f.net/1/2/3/4/x{k}/more", False), (f"http://e.net/a/b/c/d/y{k}", None)]
    got = judged(spark, rows)
    assert all((got[u].verdict == "block") == bad for u, bad in rows if bad is not None)
    assert got["http://h.net/a/b/c/d/spam/1"].template == "/a/b/c/d/spam/**"
    assert got["http://g.net/a/b/c/d/e5/f/g/bad/5"].template == "/a/b/c/d/*/f/g/bad/**"
    assert got["http://f.net/1/2/3/4/x1"].template != got["http://f.net/1/2/3/4/x1/more"].template
    assert got["http://e.net/a/b/c/d/y1"].template == "/a/b/c/d/**"
