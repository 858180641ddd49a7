"""Features of blocks with much text and inline elements."""

import pytest

from krigstone.llm import html_extract


@pytest.mark.parametrize(("end", "ends"), [("The end.", "True"), ("no end", "False"), ("The end. <b> </b>", "True"), ("The end<b>,</b> ", "False")])
def test_a_block_is_judged_by_its_end(end, ends):
    middle = "".join(f"Sentence {i}. <a href=x>link</a>, and " for i in range(200)), "".join(f"and {i}, <b>so on.</b> " for i in range(200))
    for text in middle:
        page = html_extract.Page(f"<p>{text}{end}</p>")
        assert f"ends:{ends}" in html_extract.features(page)[page.tags.index("p")]
