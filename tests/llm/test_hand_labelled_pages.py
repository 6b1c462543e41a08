"""Pages written and labelled by hand: the labeller against what a reader would keep."""

import pytest

from lumenvault.llm import html_blocks

S1 = "The harbour was built in the spring of the year before the war, and it has been dredged twice since then."
S2 = "Fishermen say that the new wall keeps the swell out, but that the tide leaves more sand at the mouth than it used to."
S3 = "A survey is planned for the autumn. Until its results are known, boats of more than two metres draught are asked to wait for high water."
S4 = "Das Wasser steht in diesem Jahr höher als sonst, und die Bauern rechnen mit einer späten Ernte."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/shop">Shop</a></li></ul></nav>'
FOOT = "<footer><p>© 2021 The Harbour Times. All rights reserved.</p></footer>"
PAGES = {
    "plain article": (f"<html><head><title>T</title></head><body>{NAV}<article><h1>The harbour</h1><p>{S1}</p><p>{S2}</p></article>{FOOT}</body></html>", ["The harbour", S1, S2]),
    "tag in a script": (f"<body>{NAV}<article><p>{S1}</p><script>if(a<b){{f('</p>')}}</script><p>{S2}</p></article>{FOOT}", [S1, S2]),
    "comment sign in a script": (f"<body><article><p>{S1}</p><script>var s='<!--';</script><p>{S2}</p></article>", [S1, S2]),
    "style in the article": (f"<body><article><style>p > a {{ color: red }}</style><p>{S1}</p></article>", [S1]),
    "formula": (f"<body>{NAV}<article><p>{S1}</p><p>Then <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is the height of the wall above the lowest tide.</p></article>", [S1, "Then a+b is the height of the wall above the lowest tide."]),
    "references": ("<body><article><p>Fish &amp; chips cost 4&nbsp;&euro; &#8212; or &#x201C;five&#x201D; on the pier, as the people of the town like to say.</p></article>", ["Fish & chips cost 4 € — or “five” on the pier, as the people of the town like to say."]),
    "no end tags": (f"<body>{NAV}<article><h1>Tides</h1><p>{S1}<p>{S2}<p>{S3}</article>{FOOT}", ["Tides", S1, S2, S3]),
    "aside in the article": (f'<body><article><p>{S1}</p><aside class="related"><h3>More</h3><ul><li><a href="/a">Old boats</a></li><li><a href="/b">New nets</a></li></ul></aside><p>{S2}</p></article>', [S1, S2]),
    "advert in the article": (f'<body><article><p>{S1}</p><div class="ad-banner">Buy two nets and get the third one free at Smith and Sons.</div><p>{S2}</p></article>', [S1, S2]),
    "comments below": (f'<body><article><h1>Sand</h1><p>{S1}</p></article><section class="comments"><h2>3 comments</h2><div class="comment"><p>I was there in May and the sand was already a metre high, nobody cared.</p></div></section>', ["Sand", S1]),
    "comments by id": (f'<body><main><p>{S1}</p><p>{S3}</p></main><div id="comments"><div class="comment"><p>Well written, thank you for this piece!</p></div></div>{FOOT}', [S1, S3]),
    "cookie notice": (f'<body><div class="cookie-notice"><p>We use cookies to make this site work for you. By going on you agree to them.</p></div><main><h1>Wall</h1><p>{S2}</p></main>', ["Wall", S2]),
    "search form": (f'<body><form action="/search"><label>Search the archive</label><input name="q"><button>Go</button></form><article><p>{S3}</p></article>', [S3]),
    "sidebar before": (f'<body><div class="sidebar"><h3>Popular</h3><ul><li><a href="/1">Ten boats</a></li><li><a href="/2">The cook</a></li></ul></div><article><p>{S1}</p><p>{S2}</p></article>', [S1, S2]),
    "content by class": (f'<body><div class="wrapper">{NAV}<div class="post-content"><h1>Nets</h1><p>{S1}</p><p>{S3}</p></div><div class="footer">Imprint and contact</div></div>', ["Nets", S1, S3]),
    "content by id": (f'<body><div id="header"><a href="/">The Times</a></div><div id="content"><p>{S1}</p><p>{S2}</p></div><div id="footer">Printed in the town</div>', [S1, S2]),
    "lists and tables": (f"<body>{NAV}<article><p>{S1}</p><ul><li>two boats with nets</li><li>one boat without</li></ul><table><tr><th>Year</th><th>Sand</th></tr><tr><td>1990</td><td>2 m</td></tr></table><p>{S2}</p></article>{FOOT}", [S1, "two boats with nets", "one boat without", "Year", "Sand", "1990", "2 m", S2]),
    "quotation": (f"<body><article><p>{S1}</p><blockquote><p>{S4}</p></blockquote></article>{FOOT}", [S1, S4]),
    "inline marks": (f"<body><article><p>The <b>harbour</b> and the <em>wall</em> stand on <a href='/rock'>the same rock</a>, as every child of the town knows.</p><p>{S2}</p></article>", ["The harbour and the wall stand on the same rock, as every child of the town knows.", S2]),
    "line breaks": (f"<body><article><p>{S1}<br>{S2}<br/>\n\t{S3}</p></article>", [f"{S1} {S2} {S3}"]),
    "upper case tags": (f"<BODY><NAV><A HREF='/'>Home</A></NAV><ARTICLE><H1>Rock</H1><P>{S1}</P></ARTICLE><FOOTER>All rights reserved</FOOTER></BODY>", ["Rock", S1]),
    "header with a title": (f"<body><header><h2>The Harbour Times</h2><p>News from the coast</p></header><main><article><h1>Fog</h1><p>{S3}</p></article></main>{FOOT}", ["Fog", S3]),
    "share links": (f'<body><article><h1>Swell</h1><p>{S2}</p><div class="share"><ul><li><a href="/f">Share</a></li><li><a href="/t">Send</a></li></ul></div></article>', ["Swell", S2]),
    "only furniture": (f"<body>{NAV}{FOOT}</body>", []),
    "nothing": ("", []),
    "only a script": ("<script>open", []),
}


CODE = "for boat in boats:\n    boat.wait(tide)\n    boat.sail()"
C1 = "for boat in boats: boat.wait(tide) boat.sail()"
#: Layouts that the tables' pages don't have: old tables, classes that say nothing, code, definitions, furniture told by its words alone.
MORE = {
    "code": (f"<body>{NAV}<article><h1>Boats</h1><p>{S1}</p><pre>{CODE}</pre><p>{S2}</p></article>{FOOT}", ["Boats", S1, C1, S2]),
    "a sentence as code": (f"<body><article><p>{S1}</p><pre>{S3}</pre></article>", [S1, S3]),
    "table layout": (f'<body><table><tr><td class="left"><a href="/">Home</a> <a href="/a">About</a></td><td><p>{S1}</p><p>{S2}</p></td></tr></table>', [S1, S2]),
    "table layout with rows": (f"<body><table><tr><td>The Harbour Times</td></tr><tr><td><h1>Sand</h1><p>{S1}</p><p>{S3}</p></td></tr><tr><td>© 2021 All rights reserved</td></tr></table>", ["Sand", S1, S3]),
    "bottom line": (f'<body><div class="content"><p>{S1}</p><p>{S2}</p></div><div class="bottom">© 2021 The Harbour Times. All rights reserved.</div>', [S1, S2]),
    "meaningless classes": (f'<body><div class="a1">Sign in</div><div class="b2"><h1>Fog</h1><p>{S2}</p><p>{S3}</p></div><div class="c3">Accept all to continue browsing</div>', ["Fog", S2, S3]),
    "no classes": (f"<body><div><a href='/'>Home</a> <a href='/n'>News</a> <a href='/c'>Contact</a></div><div><p>{S1}</p><p>{S2}</p><p>{S3}</p></div><div>Privacy policy Terms of use</div>", [S1, S2, S3]),
    "definitions": (f"<body>{NAV}<article><p>{S1}</p><dl><dt>Spring tide</dt><dd>The highest tide of the month, a day or two after full moon.</dd><dt>Neap tide</dt><dd>The lowest one, a week later.</dd></dl></article>", [S1, "Spring tide", "The highest tide of the month, a day or two after full moon.", "Neap tide", "The lowest one, a week later."]),
    "nested boxes": (f'<body>{NAV}<main><div class="row"><div class="col">{S1}</div><div class="col">{S2}</div></div></main>{FOOT}', [S1, S2]),
    "details": (f"<body><article><p>{S1}</p><details><summary>More about the sand</summary><p>{S3}</p></details></article>{FOOT}", [S1, "More about the sand", S3]),
    "address": (f"<body>{NAV}<article><p>{S2}</p><address>Written at the old harbour office by the editor of the paper.</address></article>", [S2, "Written at the old harbour office by the editor of the paper."]),
    "sections": (f"<body><article><section><h2>First</h2><p>{S1}</p></section><section><h2>Second</h2><p>{S2}</p></section></article>{FOOT}", ["First", S1, "Second", S2]),
    "two articles": (f"<body>{NAV}<main><article><h2>One</h2><p>{S1}</p></article><article><h2>Two</h2><p>{S3}</p></article></main>{FOOT}", ["One", S1, "Two", S3]),
    "newsletter inside": (f'<body><article><p>{S1}</p><div class="newsletter"><p>Subscribe now and read the paper every morning.</p></div><p>{S2}</p></article>', [S1, S2]),
    "related by words": (f"<body><main><h1>Wall</h1><p>{S1}</p><p>{S3}</p></main><div><h3>Related stories</h3><ul><li><a href='/1'>Old boats</a></li><li><a href='/2'>New nets</a></li></ul></div>", ["Wall", S1, S3]),
    "breadcrumbs": (f'<body><div class="breadcrumbs"><a href="/">Home</a> <a href="/s">Sea</a></div><div class="entry"><h1>Sea</h1><p>{S2}</p></div>', ["Sea", S2]),
    "headings only": (f"<body>{NAV}<article><h1>Tide tables</h1><h2>Spring</h2><p>{S1}</p><h2>Autumn</h2><p>{S3}</p></article>{FOOT}", ["Tide tables", "Spring", S1, "Autumn", S3]),
    "figure": (f"<body><article><p>{S1}</p><figure><img src='a.png'><figcaption>The wall at low tide, seen from the east.</figcaption></figure><p>{S2}</p></article>", [S1, "The wall at low tide, seen from the east.", S2]),
    "ordered list": (f"<body>{NAV}<article><p>{S3}</p><ol><li>Wait for high water.</li><li>Keep to the middle of the channel.</li></ol></article>", [S3, "Wait for high water.", "Keep to the middle of the channel."]),
    "German": (f'<body>{NAV}<div class="post-content"><h1>Ernte</h1><p>{S4}</p><p>{S4}</p></div><div class="footer">Impressum</div>', ["Ernte", S4, S4]),
    "long furniture": (f'<body><div class="cookie-consent"><p>We and our partners store cookies on your device to show you adverts and to count visits. You can accept all or manage cookies at any time.</p></div><article><h1>Nets</h1><p>{S1}</p></article>', ["Nets", S1]),
    "comments without names": (f'<body><article><p>{S1}</p><p>{S2}</p></article><div id="respond"><h3>Leave a reply</h3><p>Your address will not be shown.</p></div>', [S1, S2]),
    "single paragraph": (f"<body><p>{S1}</p></body>", [S1]),
    "paragraphs alone": (f"<html><body><h1>Plain</h1><p>{S1}</p><p>{S2}</p><p>{S3}</p></body></html>", ["Plain", S1, S2, S3]),
    "short lines": (f"<body>{NAV}<article><h1>Haiku</h1><p>Grey sea.</p><p>Grey wall.</p><p>A gull.</p><p>{S1}</p></article>{FOOT}", ["Haiku", "Grey sea.", "Grey wall.", "A gull.", S1]),
    "pager": (f'<body><div id="content"><p>{S1}</p><p>{S2}</p><div class="pagination"><a href="/2">Next page</a></div></div>', [S1, S2]),
    "sidebar after": (f'<body><div class="content"><h1>Rock</h1><p>{S2}</p><p>{S3}</p></div><div class="sidebar"><h3>Most read</h3><p>Ten boats that never came back.</p></div>', ["Rock", S2, S3]),
    "table in the text": (f"<body>{NAV}<article><p>{S1}</p><table><tr><th>Month</th><th>Tide</th></tr><tr><td>May</td><td>4 m</td></tr><tr><td>June</td><td>5 m</td></tr></table></article>", [S1, "Month", "Tide", "May", "4 m", "June", "5 m"]),
    "login form": (f"<body><form><label>Your name</label><input><p>Log in to read on.</p></form><main><p>{S1}</p><p>{S3}</p></main>", [S1, S3]),
    "skip link": (f'<body><a href="#m">Skip to content</a>{NAV}<main id="m"><h1>Gulls</h1><p>{S2}</p></main>{FOOT}', ["Gulls", S2]),
    "advert by its word": (f"<body><article><p>{S1}</p><p>{S2}</p></article><div>Advertisement</div>", [S1, S2]),
    "quotation alone": (f"<body>{NAV}<main><blockquote>{S4}</blockquote><p>{S1}</p></main>", [S4, S1]),
    "deep boxes": (f'<body><div class="outer"><div class="wrap"><div class="inner"><h1>Mole</h1><p>{S1}</p><p>{S2}</p></div></div></div>{FOOT}', ["Mole", S1, S2]),
    "menu after": (f'<body><div class="story"><h1>Pier</h1><p>{S3}</p><p>{S1}</p></div><div class="menu"><ul><li><a href="/">Home</a></li></ul></div>', ["Pier", S3, S1]),
}


def test_other_layouts(model):
    """Of the blocks of all pages told as text 95 in 100 are, and of those that are text 95 in 100 are told."""
    told = right = there = 0
    for page, wanted in [*PAGES.values(), *MORE.values()]:
        blocks = html_blocks.blocks_of(page)
        found, left = [b.text for b, y in zip(blocks, model.label([blocks])[0]) if y], list(wanted)
        for text in found:
            if text in left:
                left.remove(text)
                right += 1
        told, there = told + len(found), there + len(wanted)
    assert len(PAGES) + len(MORE) >= 60 and there > 150
    assert right >= 0.95 * told and right >= 0.95 * there, (right, told, there)


@pytest.fixture(scope="module")
def model(spark):
    return html_blocks.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


@pytest.mark.parametrize("name", PAGES)
def test_page(model, name):
    page, wanted = PAGES[name]
    blocks = html_blocks.blocks_of(page)
    assert [b.text for b, y in zip(blocks, model.label([blocks])[0]) if y] == wanted


@pytest.mark.parametrize(
    "page,wanted",
    [
        ("<p>a<!-->b<!--->c<!-- x --!>d</p>", ["abcd"]),
        ("<p>x</p><TEXTAREA><p>y</TEXTAREA ><p>z</p>", ["x", "z"]),
        ("<p>x</p><style>p>a{}</styles></style><p>z</p>", ["x", "z"]),
        ("<p>x < y and y > z</p>", ["x < y and y > z"]),
        ("x<!-- open <p>y</p>", ["x"]),
    ],
)
def test_blocks(page, wanted):
    assert [b.text for b in html_blocks.blocks_of(page)] == wanted
