"""op8: layout words that mark no furniture, and articles in several elements of one path."""

import pytest

from depthlane.llm import htmltext

STORY = "<h1>A title</h1><p>" + "The story goes on here. " * 20 + "</p>"
TEXT = "A title\n\n" + ("The story goes on here. " * 20).strip()


@pytest.mark.parametrize("name", ["has-sidebar", "with-comments", "no-banner", "elementor-widget-theme-post-content", "sidebar", "widget", "content-sidebar-wrap"])
def test_wrappers_keep_their_article(name):
    side = "<div class='sidebar-left'><p>side</p></div><div class='cookie-notice'><p>" + "cookies " * 200 + "</p></div>"
    for body in (f"<div class='{name}'><div class=text>{STORY}</div></div>", f"<div id='{name}'><article>{STORY}</article></div>", f"<div class='{name}'><main>{STORY}</main></div>"):
        assert htmltext.extract(f"<body>{body}{side}</body>") == TEXT


def test_parts_of_an_article_stay():
    parts = "<h2 id='related-work'>Related work</h2><p>Prior art.</p><section id='social-history'><p>History.</p></section><div class='section-header'><h3 id=comments>Part</h3></div><p>More.</p>"
    furniture = "<div class='related-posts'><p>other post</p></div><ul class='social-share'><li>share</ul><div class='comment-list'><p>a remark</p></div><div class='ad-slot-3'>buy</div><div id=comments>x</div><div class=site-header>y</div>"
    assert htmltext.extract(f"<body><article>{STORY}{parts}{furniture}</article></body>") == TEXT + "\n\nRelated work\n\nPrior art.\n\nHistory.\n\nPart\n\nMore."


def test_long_comments_and_notices_still_go():
    for name in ("comments", "cookie-notice", "newsletter", "comment-list"):
        assert htmltext.extract(f"<body><div class=text><p>Short.</p></div><div class='{name}'><p>{'remark ' * 200}</p></div></body>") == "Short."


def test_all_siblings_on_the_path_stay_in_order():
    page = "<body><div class=text>" + "".join(f"<div class=section><p>Part {k} {'words ' * n}</p></div>" for k, n in enumerate((3, 90, 5))) + "</div></body>"
    expected = "\n\n".join(f"Part {k} {'words ' * n}".strip() for k, n in enumerate((3, 90, 5)))
    assert htmltext.extract(page, "body/div.text/div.section") == htmltext.extract(page) == htmltext.extract(page, "body/div.other") == expected
