import math
import re
from collections import Counter

import numpy as np
import pytest

from binfold.llm import html_text

DIR = "/root/testdata/sf0.01"


def brute_chosen(page):
    """Ratio, Gaussian mean and two clusters, line by line, as the method says; numbers of lines in the upper cluster."""
    lines = page.lines
    usable = [i for i, x in enumerate(lines) if not x[3]]
    ratio = [0.0 if off else math.log(1 + (len(t) - link) / (1 + tags)) + html_text.MARKED * marked for t, tags, link, off, marked, _ in lines]
    reach = int(3 * html_text.SIGMA) + 1
    smooth = []
    for i in range(len(lines)):
        near = [(math.exp(-0.5 * ((j - i) / html_text.SIGMA) ** 2), ratio[j]) for j in range(max(0, i - reach), min(len(lines), i + reach + 1))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    values = sorted(smooth[i] for i in usable)
    best, cut = -1.0, -math.inf
    for k in range(1, len(values)):
        low, high = values[:k], values[k:]
        between = k * (len(values) - k) * (sum(low) / k - sum(high) / (len(values) - k)) ** 2
        if between > best * (1 + 1e-12) and values[0] != values[-1]:
            best, cut = between, values[k]
    return [i for i in usable if smooth[i] >= cut - 1e-12 and 2 * lines[i][2] <= len(lines[i][0])], smooth


def real_pages(spark, n=250):
    return [r["html"] for r in spark.read.parquet(f"{DIR}/pages.parquet").orderBy("page_id").limit(n).collect()]


def unmarked(html):
    return re.sub(r"<(/?)(article|main)\b", r"<\1div", html)


def blocks_of(html):
    import html as lib

    inside = html.split("<article>")[1].split("</article>")[0]
    found = [" ".join(lib.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
    return [b for b in found if b]


def test_upper_cluster_is_kept_and_decides(spark):
    """On every page the kept lines hold the upper cluster of their region, on marked and on unmarked pages."""
    for html in real_pages(spark, 120):
        for page_html in (html, unmarked(html)):
            page = html_text._parsed(page_html)
            chosen, _ = brute_chosen(page)
            kept = set(html_text.content_lines(page))
            share = sum(len(page.lines[i][0]) for i in chosen if i in kept) / sum(len(page.lines[i][0]) for i in chosen)
            assert share >= html_text.COVERS


def test_smoothing_and_threshold_equal_the_formulas():
    rng = np.random.default_rng(2)
    page = html_text._parsed("".join(f"<{t}>{'w ' * int(n)}</{t}>" for t, n in zip(rng.choice(["p", "div", "li", "h2"], 60), rng.integers(1, 90, 60))))
    _, smooth = brute_chosen(page)
    ratio = np.log1p([len(t) / (1 + tags) for t, tags, *_ in page.lines])
    assert np.allclose(html_text.smoothed(ratio), smooth)


@pytest.mark.parametrize("change", [lambda h: h, unmarked, lambda h: unmarked(h).replace('class="ad"', 'class="x1"')])
def test_blocks_without_marks(spark, change):
    """Recall and precision of blocks on the table's pages, whatever elements mark the article."""
    hit = want = found = 0
    for html in real_pages(spark):
        wanted = Counter(x for b in blocks_of(html) for x in [re.sub(r"\s+", " ", b)])
        got = Counter(re.sub(r"\s+", " ", x) for x in html_text.main_text(change(html)).split("\n\n"))
        hit += sum((wanted & got).values())
        want += sum(wanted.values())
        found += sum(got.values())
    assert hit / want >= 0.95 and hit / found >= 0.95


def test_short_paragraphs_stay_between_long_ones():
    long = [f"a long paragraph of an article number {i} " * 8 for i in range(4)]
    short = ["Yes.", "No.", "Why?", "Well.", "So it was.", "Then."]
    order = [*long[:2], *short, *long[2:], "The end."]
    body = "".join(f"<p>{x}</p>" for x in order)
    side = "<div><a href=a>Home</a> <a href=b>News</a></div>"
    for page in (f"{side}<div><h1>Title</h1>{body}</div>{side}", f"{side}<section><h1>Title</h1>{''.join(f'<div>{x}</div>' for x in order)}</section><div>Made by us</div>", f"<article><h1>Title</h1>{body}</article>"):
        assert html_text.main_text(page).split("\n\n") == ["Title", *[x.strip() for x in order]]


def test_lists_of_links_and_strange_ends_go():
    long = "".join(f"<p>{'words of the story ' * 12}{i}</p>" for i in range(5))
    links = "<ul>" + "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(5)) + "</ul>"
    got = html_text.main_text(f"<div><div><h1>T</h1>{long}{links}<p>End.</p></div><div><p>Share it</p></div></div>").split("\n\n")
    assert got[0] == "T" and got[-1] == "End." and len(got) == 7 and not any("Link" in x for x in got)


def test_a_title_before_the_region_belongs_to_it():
    long = "".join(f"<p>{'words of the story ' * 12}{i}</p>" for i in range(4))
    got = html_text.main_text(f"<div>Menu of things</div><div class=top><h1>The title</h1></div><div class=body>{long}</div>").split("\n\n")
    assert got[0] == "The title" and len(got) == 5


def test_words_of_a_subject_are_no_hints():
    long = "".join(f"<p>{'words of the story ' * 9}{i}</p>" for i in range(4))
    got = html_text.main_text(f'<article>{long}<div class="related-work"><p>Others did this too.</p></div></article>')
    assert got.endswith("Others did this too.")
    for name in ("related-links", "share-buttons", "search-box", "ad-work", "related", "comment-list", "header-ad", "cookie-notice-text"):
        assert "Others" not in html_text.main_text(f'<article>{long}<div class="{name}"><p>Others did this too.</p></div></article>'), name
