"""Main text of pages: hand pages, and pages without article marks against a plain statement of the windows."""

import random

import numpy as np
import pytest

from sentrylane.llm import html_text

P = "The quick brown fox jumps over the lazy dog again and again until it is tired of jumping over that dog."
MENU = "<ul><li><a href=1>Home</a><li><a href=2>About us</a><li><a href=3>More</a></ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<h1>Title</h1><div class=ad>Buy now</div><p>{P}</p>", f"Title\n{P}"),
        (f"<p>{P}</p><div class=ad>x</div><p>Short but real.</p><div class='ad'>y</div><p>{P}</p>", f"{P}\nShort but real.\n{P}"),
        (f"<p>{P}</p><aside>x</aside><p>The end.</p>", f"{P}\nThe end."),
        (f"<p>{P}</p><p><a href=u>One link.</a></p><p>End</p>", f"{P}\nOne link.\nEnd"),
        (f"<p><a href=u>{P}</a></p>", P),
        (f"<article><p>{P}</p></article><p>between</p><article><p>Short.</p></article>", f"{P}\nShort."),
        (f'<div class="page-header"><h1>Real title</h1></div><p>{P}</p>', f"Real title\n{P}"),
        (f'<div class="with-sidebar">{P}</div>', P),
        (f'<body class="comments-open has-ads"><div class="no-sidebar"><p>{P}</div>', P),
        (f'<article><div class="post no-comments"><p>{P}</p></div></article>', P),
        (f"<a name=x><p>{P}</p><p>More.</p>", f"{P}\nMore."),
        (f"{MENU}<p>{P}</p><p>tail</p>{MENU}", f"{P}\ntail"),
        (f"<p>{P}</p>{MENU}<p>{P}</p>", f"{P}\nHome\nAbout us\nMore\n{P}"),
        (f'<div class="sidebar-left">a</div><div id="mainNav">b</div><div class="comments-area">c</div><div class="side-bar">d</div><p>{P}</p>', P),
        (f"<p>{P}</p><footer>f</footer>{MENU}<p>stray</p>", P),
        (MENU, ""),
        ("<p>tiny</p><p>page</p>", "tiny\npage"),
    ],
)
def test_hand_pages(page, text):
    assert html_text.main_text(page) == text


def _plain_region(lengths):
    """Lines from the first stretch of non-empty windows that reaches the limit to the end of the last."""
    n = len(lengths)
    window = [sum(lengths[i : i + html_text.WINDOW]) for i in range(n)]
    stretches, i = [], 0
    while i < n:
        if window[i]:
            j = i
            while j < n and window[j]:
                j += 1
            stretches.append((i, j, max(window[i:j])))
            i = j
        i += 1
    most = max([p for *_, p in stretches], default=0)
    text = [s for s in stretches if s[2] >= min(html_text.SURGE, most)]
    if not text:
        return []
    inside = [i for i in range(text[0][0], text[-1][1]) if lengths[i]]
    return list(range(inside[0], inside[-1] + 1)) if inside else []


def test_regions_by_brute_force():
    rng = random.Random(2)
    for _ in range(3000):
        lengths = [rng.choice([0, 0, 0, 0, 5, 40, 90, 300]) if rng.random() < 0.7 else 0 for _ in range(rng.randint(0, 25))]
        start, end = html_text.region(np.array(lengths, np.int64))
        assert list(range(start, end)) == _plain_region(lengths), lengths


def test_pages_without_article_marks(spark):
    """What the generator calls text comes back, between menus, furniture and stray short lines."""
    rng = random.Random(4)
    rows, wanted = [], {}
    for i in range(200):
        furniture = lambda: rng.choice([f"<nav>{MENU}</nav>", "<div class='cookie-notice'>We use cookies</div>", "<aside><p>Other news of the day and week</p></aside>", "<form><input></form>", "<script>var a='<p>no</p>'</script>"])  # noqa: E731, B023
        body = [rng.choice([P, P + " " + P, "Short line.", "Über &amp; aus."]) for _ in range(rng.randint(1, 8))] + [P]
        rng.shuffle(body)
        inner = "".join(f"<{t}>{x}</{t}>" + (furniture() if rng.random() < 0.3 else "") for x in body for t in [rng.choice(["p", "div", "h2"])])
        rows.append((i, f"u{i}", f"<html><body class='has-sidebar'>{MENU}{furniture()}<div class='content'>{inner}</div>{MENU}{furniture()}</body></html>"))
        wanted[i] = "\n".join(x.replace("&amp;", "&") for x in body)
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == wanted
    assert all(r.n_chars == len(r.text) for r in got)
