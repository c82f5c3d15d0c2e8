"""Articles of usual forms are kept whole: siblings, headlines, inline names, and pages without an article element."""

import random
import re

import pytest

from briefwerk.llm.html import Page

LONG = "A sentence that goes on for a while, with commas, and with words, as articles have them."
MORE = "".join(f"<p>{LONG} Number {k}.</p>" for k in range(4))
SAID = "\n".join(f"{LONG} Number {k}." for k in range(4))


@pytest.mark.parametrize(
    "html, text",
    [
        # names of inline elements
        (f'<article><h1>Code</h1>{MORE}<pre><code><span class="hljs-comment"># a <span class="ad">note</span></span> x = 1</code></pre></article>',
         f"Code\n{SAID}\n# a note x = 1"),
        # but what isn't shown goes, with what it holds
        (f'<article>{MORE}<p>Seen <span hidden>not <span>at</span> all</span>too.</p></article>', f"{SAID}\nSeen too."),
        (f'<body><div class="post"><div class="entry-header"><h1>Title</h1></div><div class="entry-content">{MORE}</div></div></body>', f"Title\n{SAID}"),
        (f'<body><div id="main"><h1>Title</h1><p>The lead, in a line.</p><div class="text">{MORE}</div></div><div class="footer">Imprint</div></body>',
         f"Title\nThe lead, in a line.\n{SAID}"),
        (f'<body><div id="x"><div class="part">{MORE}</div><div class="part">{MORE}</div></div></body>', f"{SAID}\n{SAID}"),
        (f"<body><article><h2>One</h2>{MORE}</article><article><h2>Two</h2><p>{LONG}</p></article></body>", f"One\n{SAID}\nTwo\n{LONG}"),
        (f'<article><h1 class="widget-title">Title</h1>{MORE}<div class="social-security"><p>{LONG}</p></div></article>', f"Title\n{SAID}\n{LONG}"),
        (f'<article>{MORE}<div class="share-buttons">Share this.</div><div class="related-reading"><a href="/a">One more</a></div></article>', SAID),
        (f'<body><div class="menu"><a href="/">Home</a></div><div class="c">{MORE}</div><p><a href="/x">Next one, please.</a></p></body>', SAID),
    ],
)
def test_usual_forms_are_kept_whole(html, text):
    assert Page(html).text() == text


def page(rng):
    """A page without an article element, and the words of its article."""
    said = [f"word{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
    parts, at = [], 0
    while at < len(said):
        n = rng.randrange(12, 40)
        parts.append(", ".join(said[at : at + n]) + ".")
        at += n
    body = "".join(f"<p>{p}</p>" for p in parts)
    form = rng.randrange(4)
    if form == 0:
        inner = f'<div class="content">{body}</div>'
    elif form == 1:
        inner = f'<div class="story"><h1>{parts[0]}</h1><div class="text">{"".join(f"<p>{p}</p>" for p in parts[1:])}</div></div>'
    elif form == 2:
        half = max(1, len(parts) // 2)
        halves = [f'<div class="col">{"".join(f"<p>{p}</p>" for p in some)}</div>' for some in (parts[:half], parts[half:]) if some]
        inner = f'<div class="cols">{"".join(halves)}</div>'
    else:
        inner = f'<section id="main">{"<br><br>".join(parts)}</section>'
    menu = '<div class="nav"><a href="/">Home</a> <a href="/b">Blog</a></div>'
    side = '<div class="sidebar"><p>Most read, this week, in all sections of ours.</p></div>'
    return f'<html><body>{menu}{inner}{side}<div class="footer">All rights, reserved, since 1999</div></body></html>', said


def test_recall_of_words_on_pages_without_an_article_element():
    rng = random.Random(3)
    found = wanted = extra = 0
    for _ in range(300):
        html, said = page(rng)
        text = Page(html).text()
        got = re.findall(r"word\d+", text)
        wanted += len(said)
        found += len(set(said) & set(got)) * len(said) / len(set(said))
        extra += len(re.findall(r"Home|Blog|Most read|rights", text))
    assert found / wanted >= 0.98 and extra == 0
