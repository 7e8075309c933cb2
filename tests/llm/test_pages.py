"""HTML extraction: small pages by hand, differencing, and ranges that don't matter."""

import random

import pytest

from tessellane.llm import pages


def text(page):
    return "\n\n".join(pages.blocks(page)[0])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>A  b</h1><p>c<br>d<p>e &lt;x&gt; &#233;&nbsp;z</article>tail", "A b\n\nc d\n\ne <x> é z"),
        ("<nav>menu</nav><article><p>x</p><nav>in</nav><div class='ad box'>buy</div></article><footer>f</footer>", "x"),
        ('<script>var t="</p>";</script><article><p>a<script>if (a<b) x="</article>"</script>b</p></article>', "ab"),
        ("<main><p>m</p><aside>s</aside></main><p>o</p>", "m"),
        ("<article><p><b>Head.<br><p>next</p></article><footer>&copy; h</footer>", "Head.\n\nnext"),
        ("<article><p>1 < 2 &am and a<3</p></article>", "1 < 2 &am and a<3"),
        ("<article><p>one</p><!-- <p>no</p> --><p>two</article", "one\n\ntwo"),
        ("<article>a<section id=comments><p>c</p></section>b</article>", "a\n\nb"),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x\n\ny\n\n1\n\n2"),
        ("<body><header>h</header><form>q</form><div id='cookie-notice'>c</div><p>p</p></body>", "p"),
        ("<article class='comment'>c</article><article>a</article>", "a"),
        ("<ARTICLE><P TITLE='a>b'>x</P></ARTICLE>", "x"),
        ("<title>t</title><div>d</div>", "d"),
        ("<article>a <i>b</i><b>c</b> d</article>", "a bc d"),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


def brute_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_shared_lines():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(12))] for _ in range(2))
        got = pages.shared_lines(a, b)
        assert got == sorted(set(got)) and len(got) == brute_lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def div(*lines):
    return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"


def test_differencing(spark):
    made = [
        (1, "http://h.org/a/1", div("Site", "Slogan", "own one", "own two", "Bottom")),
        (2, "http://h.org/a/2?x", div("Site", "Slogan", "other", "more", "Bottom")),
        (3, "http://h.org/z/9", div("Site", "Slogan", "far", "away", "Bottom")),
        (4, "http://lone.org/", div("Site", "x")),
        (5, "http://copy.org/a", div("p", "q")), (6, "http://copy.org/a#top", div("p", "q")),
        (7, None, div("n")), (8, "http://h.org/e", None), (9, "x", ""), (4, "http://lone.org/", div("Site", "x")),
    ]
    df = spark.createDataFrame([(*r, 1) for r in made], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in pages.main_text(df).collect())
    want = {1: "own one\n\nown two", 2: "other\n\nmore", 3: None, 4: "Site\n\nx", 5: "p\n\nq", 6: "p\n\nq", 7: "n", 8: "", 9: ""}
    assert [r[0] for r in got] == [1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
    assert all(want[i] is None or (t, n) == (want[i], len(want[i])) for i, t, n in got)
    assert pages.main_text(df.limit(0)).count() == 0


def test_ranges_dont_matter(spark):
    rng = random.Random(2)
    made = [(i, f"http://h{rng.randrange(3)}.org/{rng.randrange(60)}/{i % 7}", div("Top", f"line {rng.randrange(9)}", f"text {i}", *["Foot"] * rng.randrange(2))) for i in range(160)]
    df = spark.createDataFrame(made, "page_id long, url string, html string")
    out = []
    for parts in ("1", "3", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out.append(sorted(map(tuple, pages.main_text(df).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1] == out[2] and len(out[0]) == 160
    line = sorted(made, key=lambda r: (r[1].split("/")[2], "/" + r[1].split("/", 3)[3], str(r[0])))
    for k, (i, url, page) in enumerate(line):
        host, path = url.split("/")[2], "/" + url.split("/", 3)[3]
        near = [x for x in (line[k - 1] if k else None, line[k + 1] if k + 1 < len(line) else None) if x and x[1].split("/")[2] == host]
        mine = pages.blocks(page)[0]
        if near:
            other = pages.blocks(max(near, key=lambda x: pages._common(path, "/" + x[1].split("/", 3)[3]))[2])[0]
            if brute_lcs(mine, other) <= pages.COPY_SHARE * len(mine):
                shared = pages.shared_lines(mine, other)
                mine = [x for j, x in enumerate(mine) if j not in shared]
        assert next(r[2] for r in out[0] if r[0] == i) == "\n\n".join(mine)


@pytest.mark.parametrize(
    ("attributes", "want"),
    [
        ("class='ad'", ""), ("HIDDEN", ""), ("id=menu", ""), ("class='story' data-x='y'", "x"), ("title='the hidden class=ad'", "x"),
        (f"style='{'margin:0;' * 100}' class='ad box'", ""), (f'data-x=\'{{"k": "{"v " * 400}"}}\' role="navigation"', ""), (f"onclick='f(\"{'hidden ' * 90}\")'", "x"), (f"src='data:{'QUJD' * 300}' hidden", ""),
    ],
)
def test_all_attributes_count(attributes, want):
    assert text(f"<article><div {attributes}>x</div></article>") == want


def test_heavy_boilerplate_is_no_copy(spark):
    menu = [f"Menu item {k}" for k in range(25)]
    own = lambda k: [f"Paragraph {j} of article {k}, which says something of its own about subject {j * k}, in {k} words or so." for j in range(8)]
    story = [f"Paragraph {j} of the mirrored story, which stands on both pages, word by word, as long as any." for j in range(30)]
    made = [(k, f"http://heavy.org/n/{k}", div(*menu, *own(k))) for k in (1, 2, 3)]
    made += [(4, "http://edit.org/s/1", div("Top line", *story, *own(4)[:1])), (5, "http://edit.org/s/1b", div("Top line", *story, *own(5)[:1])), (6, "http://edit.org/s/9", div("Top line", *own(6)))]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "\n\n".join(own(k)) for k in (1, 2, 3))
    assert got[4] == "\n\n".join(["Top line", *story, *own(4)[:1]])  # its only neighbour is an edited copy
    assert got[5] == "\n\n".join([*story, *own(5)[:1]]) and got[6] == "\n\n".join(own(6))


@pytest.mark.parametrize("kept", ['<section id="search-results">Kept.</section>', '<p class="ad-hoc">Kept.</p>', '<div class="related-work">Kept.</div>', '<div id="alert-fatigue">Kept.</div>', '<div class="shared note">Kept.</div>'])
def test_names_that_only_hold_a_word(kept):
    assert pages.blocks(f"<article>{kept}</article>") == (["Kept."], True)


@pytest.mark.parametrize("gone", ['<div class="ad-slot x">No.</div>', '<div id="comments">No.</div>', '<div class="share-buttons">No.</div>', '<ul class="x main-nav">No.</ul>', '<div class="post-comments-2">No.</div>'])
def test_names_of_other_parts(gone):
    assert pages.blocks(f"<article>Kept.{gone}</article>") == (["Kept."], True)


def test_teasers_mark_no_main_text():
    assert pages.blocks('<p>Main.</p><article class="teaser">Other.</article>') == (["Main.", "Other."], False)
    assert pages.blocks('<article class="post">Main.</article><article class="card teaser">Other.</article>') == (["Main."], True)


def composed(rng):
    """A page of known main text: blocks of an article between, around and inside boilerplate."""
    import html as entities

    words = lambda n: " ".join(rng.choice(["alpha", "b&c", "<x>", "d'e", "é", "漢字", "f;", "&amp;"]) for _ in range(n))
    loose = lambda t: "".join(c if c != " " else rng.choice([" ", "\n", "  ", "\t ", "<b> </b>"]) for c in t)

    def shown(text):
        cut = entities.escape(text, quote=rng.random() < 0.5)
        return loose(cut) if rng.random() < 0.5 else cut

    def other():
        body = rng.choice([f"<p>{words(3).replace('<x>', '')}", "<ul><li>a<li>b</ul>", "<a href='/x'>more</a>"])
        return rng.choice([
            f"<nav>{body}</nav>", f"<div class='x{'y' * 600} ad'>{body}</div>", f"<div style='{'s' * 700}' class=\"cookie-notice\">{body}</div>", f"<aside>{body}</aside>", f"<form>{body}</form>",
            "<script>if (a < b) { '<p>' }</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", f"<section id=comments>{body}</section>", f"<footer>{body}</footer>",
        ])

    main, truth = "", []
    for _ in range(rng.randrange(1, 7)):
        text = words(rng.randrange(1, 9))
        tag = rng.choice(["p", "h2", "blockquote", "pre", "div"])
        main += (other() if rng.random() < 0.4 else "") + f"<{tag}>{shown(text)}" + ("" if tag == "p" and rng.random() < 0.5 else f"</{tag}>")
        truth.append(text)
    return f"<html><body>{other()}<header>{other()}</header><article>{main}</article>{other()}</body></html>", truth


def test_composed_pages_come_back():
    rng = random.Random(21)
    for _ in range(400):
        page, truth = composed(rng)
        assert pages.blocks(page) == (truth, True), page
