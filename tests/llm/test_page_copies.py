"""Templates are judged by different pages."""

from tessera.llm import html_text


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.op3_site_templates(pages).collect()}


def test_copies_of_a_page_without_article_keep_their_text(spark):
    menu = "<div><span>Home</span><span>Shop</span></div>"
    story = "".join(f"<p>Paragraph {k} of the one story that is mirrored.</p>" for k in range(4))
    rows = [(i, f"http://h.example/a?utm={i}", f"<body>{menu}<div>{story}</div></body>") for i in range(8)]
    rows += [(i, f"http://h.example/{i}", f"<body>{menu}<div><p>Text number {i} of this page, long enough to stand.</p></div></body>") for i in range(8, 16)]
    got = texts(spark, rows)
    assert all(got[i] == "\n".join(f"Paragraph {k} of the one story that is mirrored." for k in range(4)) for i in range(8))
    assert all(got[i] == f"Text number {i} of this page, long enough to stand." for i in range(8, 16))


def test_a_section_menu_goes_on_small_and_large_hosts(spark, monkeypatch):
    menu = "<div><span>Section one</span><span>Section two</span></div>"
    for others in (0, 60):
        rows = [(i, f"http://h.example/{i}", f"<body>{menu if i < 8 else ''}<div><p>Text number {i} of this page, long enough to stand.</p></div></body>") for i in range(8 + others)]
        for most in (1_000_000, 0):
            monkeypatch.setattr(html_text, "BROADCAST_HASHES", most)
            assert texts(spark, rows) == {i: f"Text number {i} of this page, long enough to stand." for i in range(8 + others)}
