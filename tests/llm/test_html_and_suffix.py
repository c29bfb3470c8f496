import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from tessera.llm import html_extract as X
from tessera.llm import suffix_dedup as D

PAGES = {
    "<body><nav><a href=/>Home</a></nav><article><h1>T &amp; t</h1><p><b>One  two\n three<br>four<p>five</article><footer>c</footer>": "T & t One two three four five",
    "<article><p>a</p><aside>side</aside><div class='comments'><p>nice</p></div><script>x<p></script><p>b &copy;</p></article>": "a b ©",
    "<body><div id=sidebar>links here, more links.</div><div class=content><h2>Head</h2><p>A long paragraph, with marks. And more of it, quite long.</p><p>Second one, also long. It goes on, and on.</p></div><div class='cookie-notice'>We use cookies, OK.</div>": "Head A long paragraph, with marks. And more of it, quite long. Second one, also long. It goes on, and on.",
    "<article><p>main</p></article><article class=comment><p>a reader says much, and more.</p></article>": "main",
    "plain": "plain", "": "", "<p>cut off <a href='": "cut off", "<p hidden>no</p><p>yes, that is it.</p>": "yes, that is it.",
}


STORY = "The story is long, and it goes on. " * 8
PAGES |= {
    '<article><div class="meta-analysis"><p>body text here</p></div></article>': "body text here",
    '<article><section class="search-algorithms"><p>body, and more.</p></section></article>': "body, and more.",
    "<article><p>Long text, is here. And more.</p><figure><img><figcaption>The caption.</figcaption></figure><p>so <math><mi>x</mi></math> is</p></article>": "Long text, is here. And more. The caption. so x is",
    f"<body><article class=teaser><p>Short card, one line.</p></article><div><h2>Story</h2><p>{STORY}</p><p>{STORY}</p></div></body>": f"Story {STORY}{STORY}".strip(),
    f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><h1>Title</h1><div class=t><p>{STORY}</p></div></div><div>Buy now!</div></body>": f"Title {STORY}".strip(),
    f"<div id=sidebar><p>{STORY}</p></div>": STORY.strip(),
    f"<div id=sidebar><p>{STORY}</p></div><article><p>{STORY}</p></article>": STORY.strip(),
    f"<div class=comments><p>{STORY}</p></div>": "", "<div class=ad>Buy now, it is cheap.</div><footer>(c)</footer>": "",
    f"<body><h1>T</h1><p>{STORY}</p><ul><li>a point</li></ul><p>{STORY}</p><div><a>one</a></div></body>": f"T {STORY}a point {STORY}".strip(),
}


@pytest.mark.parametrize("html", PAGES)
def test_extract(html):
    assert X.extract(html) == PAGES[html]


def test_the_ratios_decide(monkeypatch):
    """Without ratios no path is content, and with text alone or marks alone a page without an article reads differently."""
    page = f"<body><div class=a>{'word ' * 15}</div><div class=b><p>{STORY}</p></div></body>"
    assert X.extract(page) == STORY.strip()
    monkeypatch.setattr(X, "PUNCTUATION", X.re.compile("(?!)"))
    assert X.extract(page) != STORY.strip()
    monkeypatch.setattr(X, "SHARE", 1e9)
    assert not any(X.extract(h) for h in PAGES)


def test_named_blocks_do_not_change_the_article(spark):
    """Blocks of prose under telling names, before, in and behind the article, with and without an article element."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").limit(100).collect()]
    names = "sidebar cookie-banner newsletter-signup comments comment-list advert ad-slot ad promo breadcrumb site-footer social-share related-posts notice menu top-nav widget user-comments sponsored".split()
    rng = random.Random(1)
    for _ in range(600):
        page = rng.choice(pages)
        block = f'<{(tag := rng.choice(["div", "section"]))} {rng.choice(["class", "id"])}="{rng.choice(names)}">' + "<p>In in oredble ea, the and. Nicht aulich sch erüver.</p>" * rng.randrange(1, 6) + f"</{tag}>"
        put = rng.choice([lambda p: p.replace("<article>", block + "<article>"), lambda p: p.replace("</article>", block + "</article>"), lambda p: p.replace("<article>", "<div class=content>").replace("</article>", "</div>" + block)])  # noqa: B023
        assert X.extract(put(page)) == X.extract(page) != ""


PROSE = "The quick study found that results, in most cases, held over years; the team wrote about it at length. " * 3
NAMED = [
    '<h2 id="related-work">Work</h2>', '<h2 id="search">Search</h2>', '<h3 class="side-effects">Effects</h3>', f'<section id="legal"><h2>Law</h2><p>{PROSE}</p></section>', f'<p class="meta-analysis">{PROSE}</p>', f'<p id="share">{PROSE}</p>',
    '<div class="article-header"><h2>Head</h2></div>',
]
FURNITURE = [
    f'<div class="advert"><p>{PROSE}</p></div>', '<div class="share">Share this: <a href=x>X</a></div>', '<div class="related"><h3>Related</h3><ul><li><a href=x>Another article about it</a></li></ul></div>', f'<div class="newsletter-signup"><p>{PROSE}</p></div>',
    '<p class="meta">By someone</p>', '<section id="tags">one two</section>', f'<div class="social-share"><p>{PROSE}</p></div>',
]


def article(*parts):
    return f"<html><body><nav>menu</nav><article><h1>T</h1><p>{PROSE}</p>{''.join(parts)}<p>{PROSE}</p></article><footer>f</footer></body></html>"


@pytest.mark.parametrize("part", NAMED)
def test_a_name_never_drops_a_part_of_the_article(part):
    assert " ".join(X.re.sub("<[^>]*>", " ", part).split()) in X.extract(article(part))


@pytest.mark.parametrize("part", FURNITURE)
def test_furniture_in_the_article_goes(part):
    assert X.extract(article(part)) == X.extract(article())


def pair_of_candidates(rng):
    """Two candidates under one name, of like length in all: prose, and a list of short labels."""
    n = rng.randrange(2, 5)
    prose = "".join(f"<p>{PROSE}</p>" for _ in range(n))
    labels = "".join(f"<span>{rng.choice(['Red item', 'Blue item', 'Size 12', 'Next'])} {i}</span><br>" for i in range(len(prose) // 12))
    both = [f"<div class=box>{prose}</div>", f"<div class=box><div>{labels}</div></div>"]
    rng.shuffle(both)
    return f"<body>{''.join(both)}</body>", " ".join([PROSE.strip()] * n)


def test_constant_ratios_change_what_is_found(monkeypatch):
    """Ablation: the ratios choose among equal names, and each of text and punctuation and smoothing has its part."""
    rng = random.Random(8)
    pages = [pair_of_candidates(rng) for _ in range(40)]
    assert all(X.extract(h) == want for h, want in pages)
    full = [X.extract(h) for h, _ in pages] + [X.extract(h) for h in PAGES] + [X.extract(article(x)) for x in NAMED]
    prior = lambda page, sums: {page.paths[e]: 100 * page.priors[e] * (4 if page.inside[e] else 1) for e, _, _ in page.blocks}
    monkeypatch.setattr(X, "fused_ratios", prior)
    flat = [X.extract(h) for h, _ in pages] + [X.extract(h) for h in PAGES] + [X.extract(article(x)) for x in NAMED]
    assert sum(a != b for a, b in zip(full, flat, strict=True)) >= 0.5 * len(full)


def plain_choice(page):
    """Sums, smoothing, fusing and the threshold, written out path by path."""
    order = list(dict.fromkeys(page.paths[e] for e, _, _ in page.blocks))
    of = {p: [(e, t, link) for e, t, link in page.blocks if page.paths[e] == p] for p in order}
    ratio = {p: sum(len(t) - link for _, t, link in b) / len(b) for p, b in of.items()}
    marks = {p: sum(len(X.PUNCTUATION.findall(t)) for _, t, _ in b) / len(b) for p, b in of.items()}

    def smooth(v):
        out = {}
        for i, p in enumerate(order):
            near = [v[q] for q in order[max(0, i - 1) : i + 2]]
            out[p] = v[p] / 2 + sum(near) / len(near) / 2
        return out

    ratio, marks, fused = smooth(ratio), smooth(marks), {}
    for p, b in of.items():
        e = b[-1][0]
        fused[p] = ratio[p] * (1 + marks[p]) * (1 - sum(link for *_, link in b) / sum(len(t) for _, t, _ in b)) * page.priors[e] * (4 if page.inside[e] else 1)
    return fused, {p for p, v in fused.items() if v >= max(1, 0.25 * max(fused.values()))}


def test_ratios_and_choice_against_brute_force(spark):
    rng = random.Random(5)
    pages = [pair_of_candidates(rng)[0] for _ in range(20)] + [article(rng.choice(NAMED), rng.choice(FURNITURE)) for _ in range(60)] + list(PAGES)
    pages += [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").limit(100).collect()]
    for html in pages:
        page = X.read(html or "")
        if page.blocks:
            want, content = plain_choice(page)
            got = X.fused_ratios(page, X.path_sums(page))
            assert got == pytest.approx(want) and {p for p, v in got.items() if v >= max(X.LEAST, X.SHARE * max(got.values()))} == content


def test_path_sums_against_brute_force():
    rng = random.Random(3)
    tags = ["div", "p", "a", "ul", "li", "b", "section", "article"]

    def tree(depth):
        tag, name = rng.choice(tags), rng.choice(["", " class=x", " id=y"])
        return (tag, name, ["".join(rng.choice("ab,. ") for _ in range(rng.randrange(8))) if rng.random() < 0.5 or not depth else tree(depth - 1) for _ in range(rng.randrange(4))])

    def html(t):
        return t if isinstance(t, str) else f"<{t[0]}{t[1]}>{''.join(map(html, t[2]))}</{t[0]}>"

    for _ in range(300):
        page = X.read(html(("body", "", [tree(4) for _ in range(4)])))
        naive = {}
        for element, text, link in page.blocks:
            chain, e = [], element
            while e > 0:
                chain.append(e)
                e = page.parents[e]
            s = naive.setdefault(page.paths[element], [0, 0, 0, 0])
            for i, v in enumerate((len(text), 1, sum(c in ".,;:!?" for c in text), link)):
                s[i] += v
            assert [page.tags[c] for c in chain][-1:] == ["body"]
        assert dict(X.path_sums(page)) == naive
        same = {}
        for e in range(1, len(page.tags)):  # equal tags and names from the root, equal path numbers
            chain, up = [], e
            while up > 0:
                chain.append((page.tags[up]))
                up = page.parents[up]
            assert len(chain) == len(same.setdefault(page.paths[e], chain)) and chain == same[page.paths[e]]


def test_work_does_not_grow_with_depth():
    began = time.perf_counter()
    assert X.extract("<div>" * 20_000 + "<p>x</p>" * 20_000).startswith("x x")
    assert X.extract("<b><div>" * 3000 + "</b>" * 3000 + "x") == "x" and time.perf_counter() - began < 20


def test_pages_rows(spark):
    rows = [(1, "u", None, "clash", 9), (2, None, "<p>x y</p>", "clash", 9), (2, None, "<p>x y</p>", "clash", 9), (None, "u", "<p>" + "long, text. " * 20_000, "clash", 9)]
    got = X.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")).collect()
    assert [(r.page_id, r.text[:5], r.n_chars) for r in got] == [(1, "", 0), (2, "x y", 3), (2, "x y", 3), (None, "long,", 12 * 20_000 - 1)]
    assert X.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def brute(texts, least):
    count = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("limit, seed", [(6000, 0), (2, 1), (4, 2)])
def test_repeats_against_brute_force(spark, limit, seed):
    rng = random.Random(seed)
    junk = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [junk(n) for n in (60, 64, 90, 200, 400)]
    texts = [junk(rng.randrange(80)) + "".join(rng.choice(shared) + junk(rng.randrange(30)) for _ in range(rng.randrange(4))) for _ in range(60)]
    texts += [texts[3], texts[3], "z" * 300, "ab" * 200, "", None, shared[0], shared[0][:-1], "q" + shared[1] + "q"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in D.remove_repeats(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n_bytes int"), 64, 16, limit).collect()}
    assert got == dict(enumerate(brute([(t or "").encode() for t in texts], 64)))


def test_tree_finds_maximal_repeats():
    # suffixes of "xab.." and "yab..", "abc": depth 2 shared by three with different left bytes, depth 3 by two
    got = sorted(D.interval_tree([0, 2, 3], [120, 121, 122], 2))
    assert got == [(0, 2, 2), (1, 2, 3)]
    assert list(D.interval_tree([0, 2], [120, 120], 2)) == []  # one left byte: part of a longer repeat
    assert list(D.interval_tree([0, 2], [-1, -2], 2)) == [(0, 1, 2)]


def test_repeats_of_nothing(spark):
    assert D.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    r = D.remove_repeats(spark.createDataFrame([(1, "short"), (1, "short")], "doc_id bigint, text string")).collect()
    assert [(x.n_removed, x.n_spans, x.kept_sha256) for x in r] == [(0, 0, hashlib.sha256(b"short").hexdigest())] * 2


def test_owners_past_the_width_of_places(monkeypatch):
    rng = random.Random(8)
    junk = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    shared = junk(90)
    texts = [junk(5000) + shared + junk(2000), junk(10), b"", junk(100) + shared, b"ab" * 1500]
    wide = D.owned_runs(texts, 64, 16)
    monkeypatch.setattr(D, "_POSITION", np.uint64(1023))
    monkeypatch.setattr(D, "PIECE", 700, raising=False)
    whose, first, last, owner, name, context = D.owned_runs(texts, 64, 16)
    for k, t in enumerate(texts):
        h = D.names(np.frombuffer(t, np.uint8), 16) & ~np.uint64(1023) if len(t) >= 64 else []
        want = [s + int(np.argmin(h[s : s + 49])) for s in range(max(0, len(t) - 63))]
        got = [o for a, b, o in zip(first[whose == k], last[whose == k], owner[whose == k], strict=True) for _ in range(a, b + 1)]
        assert got == want
    assert all((x == y).all() for x, y in zip(wide[:3], (whose, first, last), strict=True))
    assert set(name[(whose == 0) & (last >= 5000) & (first <= 5026)]) & set(name[whose == 3])
    monkeypatch.setattr(D, "PIECE", 900)
    assert all((x == y).all() for x, y in zip(D.owned_runs(texts, 64, 16), (whose, first, last, owner, name, context), strict=True))


def test_query_on_planted_passages(spark, tmp_path):
    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choice("abcdeéghiß") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    long, short = [prose(n) for n in (100, 130, 200)], [" ".join(w[:4] for w in prose(n).split()) for n in (51, 55, 60)]
    assert all(len(p.encode()) >= 400 for p in long) and all(len(p.split()) > 50 and len(p.encode()) < 400 for p in short)
    texts = {("clean", i): prose(rng.randrange(20, 400)) for i in range(20)}
    texts |= {("long", i): f"{prose(rng.randrange(20, 400))} {long[i % 3]} {prose(rng.randrange(20, 200))}" for i in range(9)}
    texts |= {("short", i): f"{prose(rng.randrange(20, 400))} {short[i % 3]} {prose(rng.randrange(20, 200))}" for i in range(9)}
    rows = [(i, t) for i, t in enumerate(texts.values())]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in D.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    want = brute([t.encode() for t in texts.values()], 400)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i, _ in rows] == [(*w[:3], hashlib.sha256(w[3]).hexdigest()) for w in want]
    # Passages of 400 bytes are all found; shorter ones, whatever their words, and other texts stay whole.
    assert [got[i].has_repeats for i in range(len(rows))] == [kind == "long" for kind, _ in texts]
    assert [got[i].n_bytes for i, _ in rows] == [len(t.encode()) for t in texts.values()]
