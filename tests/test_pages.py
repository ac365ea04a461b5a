"""Pages are parsed in pieces: the same parts however small the pieces are."""

from plumbline.functions import rowwise


def test_pieces_like_whole_batches(spark, monkeypatch):
    html = [None, "", "<title>A</title><h1>B &amp; C</h1>", "<meta name=description content='é'>" + "x" * 5000, "<script type='application/ld+json'>[{\"a\": 1}, 2]</script><p>t</p>"]
    pages = spark.createDataFrame([(i, html[i % 5]) for i in range(200)], "page_id long, html string").repartition(1)
    for size in (1, 700, rowwise.PIECE):
        monkeypatch.setattr(rowwise, "PIECE", size)
        got = {r.page_id: r.asDict() for r in rowwise.html_extract(pages, "page_id", "html").collect()}
        assert got == {i: {"page_id": i, **rowwise.page_parts(html[i % 5])} for i in range(200)}
