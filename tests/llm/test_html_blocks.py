"""Blocks, their classification and the query on odd pages."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barline.llm import html_blocks
from barline.llm.html_blocks import blocks, classify, extract, features, grow, labelled, op11_html_extraction

LONG = "A paragraph of running text that says little of importance and still goes on for rather more than twenty words, as they do. "
TREE = grow(*labelled())


def main_text(page):
    found = blocks(page)
    described = np.array([b[1:] for b in found], np.int64).reshape(-1, 5)
    good = classify(TREE, features(described, np.zeros(len(found), int)))
    return [b[0] for b, g in zip(found, good) if g]


def test_the_tree_fits_its_table():
    x, y = labelled()
    assert (classify(TREE, x) == y).mean() > 0.98
    used = set()

    def walk(tree):
        if not isinstance(tree, bool):
            used.add(html_blocks.FEATURES[tree[0]])
            walk(tree[2]), walk(tree[3])

    walk(TREE)
    assert {"words", "links", "links before", "links after", "furniture"} <= used


def test_grow_is_the_best_split_by_hand():
    x = np.array([[1.0, 5], [2, 5], [3, 6], [4, 6]])
    assert grow(x, np.array([False, True, True, True])) == (0, 1.5, False, True)
    assert grow(x, np.array([False, False, True, True]))[:2] == (0, 2.5)
    assert grow(x[:, :0], np.array([True, False, False, False])) is False


def test_an_article_without_its_surroundings():
    page = f"""<!doctype html><html><head><title>No</title><style>p{{}}</style><script>var a = "</p><p>no</p>";</script></head>
      <body class="has-sidebar"><header><h1>Site name</h1><p>{LONG}</p></header>
      <nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav>
      <article><header><h1>The   title</h1></header><p>{LONG}<p>Be.<p>One &amp; two&nbsp;&lt;three&gt; caf&eacute;<br>four<button>Share</button> five</p>
      <ul><li>First item<li>Second item</ul><div class="ad-slot">{LONG}</div><aside>{LONG}</aside><!-- <p>no</p> -->
      <div role="alert">{LONG}</div><p hidden>{LONG}</p><form><p>{LONG}</p><select><option>no</option></select></form>
      <section id="comments"><article class="comment"><p>{LONG}</p></article></section><p>End.</p><footer>Filed under</footer></article>
      <div class="cookie-notice"><p>{LONG}</p></div><footer>&copy; 2024 Example</footer></body></html>"""
    assert main_text(page) == ["The title", LONG.strip(), "Be.", "One & two <three> café four five", "First item", "Second item", "End."]


@pytest.mark.parametrize("page, kept", [
    (f"<div><a href=/>Home</a> <a href=/n>News</a></div><h1>A title here</h1><p>{LONG}</p><p>Be.</p><p>{LONG}</p>"
     "<ul><li><a href=/1>One more</a><li><a href=/2>Another</a></ul><div>Copyright Example</div>", ["A title here", LONG.strip(), "Be.", LONG.strip()]),
    (f"<main><h2>Head</h2><p>{LONG}</p></main><div>{LONG}</div>", ["Head", LONG.strip()]),
    ("<ul>" + "".join(f"<li><a href=/{k}>entry {k}</a>" for k in range(30)) + "</ul>", []),
    (f"<article><p title='a>b' data-x=\"</p>\">{LONG}</p><p>1 < 2 and AT&T &#233;&#xe9;</p>", [LONG.strip(), "1 < 2 and AT&T éé"]),
    (f"<article><p>{LONG}<p>kept<!-- never closed <p>lost", [LONG.strip(), "kept"]),
    (f"<article><p>{LONG}</p><script>never closed <p>lost", [LONG.strip()]),
    ("<article><table><tr><th>a</th><td>b</td></tr><tr><td>c<td>d</table></article>", ["a b", "c d"]),
    ("<article><p>one</div></p></span><p>two</article>", ["one", "two"]),
    ("", []), ("<p></p><div> \n </div>", []), ("<", []),
])
def test_other_pages(page, kept):
    assert main_text(page) == kept


def test_hard_pages_stay_linear():
    for page in ("<a " * 100_000, "<div>" * 50_000 + "x" + "</p>" * 50_000, "<!-- " * 100_000, "<p class=\"" * 50_000, "</div" * 50_000, "<title>" * 50_000):
        blocks(page)


def test_query_on_odd_pages(spark, tmp_path):
    good = f"<article><h1>Title</h1><p>{LONG * 4000}</p></article>"
    pages = [None, "", " ", "no markup at all on this page", good, good, "<nav>menu</nav>", "\x00<p>x퟿</p>"]
    columns = {
        "page_id": pa.array([*range(7), None], pa.int64()), "url": pa.array([None, *"abcdefg"], pa.string()), "html": pa.array(pages, pa.string()),
        "text": pa.array(["x"] * 8, pa.string()), "n_chars": pa.array(["x"] * 8, pa.string()),
    }
    pq.write_table(pa.table(columns), tmp_path / "pages.parquet")
    rows = {r.page_id: r for r in op11_html_extraction(spark, str(tmp_path)).collect()}
    assert len(rows) == 8 and [rows[k].text for k in (0, 1, 2, 6)] == [""] * 4
    assert rows[4].text == rows[5].text == "Title\n" + (LONG * 4000).strip() and rows[4].n_chars == len(rows[4].text)
    assert rows[0].url is None and rows[1].url == "a" and rows[3].text == "no markup at all on this page"
    wide = extract(spark.read.parquet(f"{tmp_path}/pages.parquet"))
    assert wide.columns == ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"] and wide.where("page_id = 4").first().n_kept == 2
    pq.write_table(pa.table(columns).slice(0, 0), tmp_path / "pages.parquet")
    assert op11_html_extraction(spark, str(tmp_path)).count() == 0
