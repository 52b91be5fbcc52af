from lodestack.llm import html_extract


def test_self_closing_raw_elements_are_empty():
    page = '<article><p>one</p><svg class="icon"/><p>two</p><iframe src="x" /><p>three</p><script>no()</script><p>four</p></article>'
    assert html_extract.main_text(page, {}) == "one\ntwo\nthree\nfour"
    assert html_extract.main_text("<article><p>a</p><script src=http://x/y/>no()</script><p>b</p></article>", {}) == "a\nb"
