"""HTML extraction, license scans and URL filters on hand-made pages, texts and addresses."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veloquent.llm import html_extract as H
from veloquent.llm import url_filter as U
from veloquent.llm.html_extract import extract_text, main_text
from veloquent.llm.license_scan import BASE_PHRASES, SIGNATURES, resolve, scan, scan_licenses, signatures
from veloquent.llm.url_filter import RULES, judge_urls, parts, rule_of

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, really, many of them, for all sorts of things.</p></div>
<div id=wrap><div class="sidebar"><p>Side text, with commas, many, of, them, and long enough to score by itself.</p></div>
<article><h1>A &amp; B</h1><p>First   paragraph,
with <b>bold</b> &lt;tags&gt; and a <a href="/x">link</a>.<p>Second one<br>breaks.</p><div class="ad">Buy</div><form><label>Mail</label><input></form>
<p>Short.</p><ul><li>One</li><li>Two</ul></article>
<section class="comments"><p>Nice text, I liked it, and I have much more to say, really, on and on and on.</p></section></div>
<aside>See also</aside><footer>&copy; me</footer></body></html>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE) == "A & B\nFirst paragraph, with bold <tags> and a link.\nSecond one breaks.\nShort.\nOne\nTwo"


def test_container_without_an_article_element():
    long = "This paragraph is long enough, has commas, and reads like prose that people write. " * 3
    page = f"<body><div class=menu><a href=1>a</a></div><div class=x><p>{long}</p><p>{long}</p><p>Tiny</p></div><div class=links><a href=2>{long}</a></div></body>"
    assert main_text(page).split("\n")[-1] == "Tiny" and main_text(page).count("prose") == 6


LONG = "Long text, with commas, that reads like prose. " * 20


def test_parts_of_an_article_stay_however_short():
    three = f"<body><div><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>A short one.</p></section><section><h2>Three</h2><p>{LONG}</p></section></div></body>"
    assert main_text(three) == "\n".join(["One", LONG.strip(), "Two", "A short one.", "Three", LONG.strip()])
    post = f"<body><div class=post><div><p>{LONG}</p></div><div><p>Closing words.</p></div><div><a href=1>More links than words here</a> x</div></div></body>"
    assert main_text(post) == f"{LONG.strip()}\nClosing words."
    named = f"<body><article><h1>T</h1></article><footer>Some <b>footer</b> that outweighs the article by far, with commas, and words.</footer></body>"
    assert main_text(named) == "T"


def test_equal_scores_and_equal_prose_give_one_text():
    equal = "<body>" + "".join(f"<div class=sidebar><p>{LONG}</p></div>" for _ in range(6)) + "</body>"
    twins = "<body><div><section>" + f"<p>{LONG}</p></section><section><p>{LONG}</p></section></div><div><section><p>{LONG}</p></section><section><p>{LONG}</p></section></div></body>"
    for page in (equal, twins):
        assert len({main_text(page) for _ in range(500)}) == 1


def plain_score(node):
    """Points by the plain rule, from every scored block of the tree, one ancestor at a time."""
    total = 0.0
    stack = [(p, 1) for p in node.parts if not isinstance(p, str) and not p.chrome]
    while stack:
        child, depth = stack.pop()
        text = H._own_text(child).strip() if child.tag in H.SCORED else ""
        if text:
            total += (1 + text.count(",") + min(len(text) / 100, 30)) * (1 - H._density(child)) * [1, 0.5, 0.3, 0.18][depth - 1]
        if depth < 4:
            stack += [(p, depth + 1) for p in child.parts if not isinstance(p, str) and not p.chrome]
    return total


def test_scores_against_the_plain_rule():
    rng = random.Random(8)

    def tree(depth):
        kind = rng.choice(["div", "section", "p", "ul", "article", "td"]) if depth else "body"
        inner = "".join(tree(depth + 1) for _ in range(rng.randint(0, 3))) if depth < 5 and kind != "p" else ""
        return f"<{kind}>{'word, ' * rng.randint(0, 40)}<a href=1>{'x' * rng.randint(0, 20)}</a>{inner}</{kind}>"

    for _ in range(60):
        root = H.parse(tree(0))
        H._weigh(root)
        order = H._measure(root)
        best = H._score(order)
        for node in order:
            assert node.score == pytest.approx(plain_score(node))
        if best and best.tag not in ("article", "main"):
            value = lambda n: n.score * (1 - H._density(n)) * (1.5 if n.tag in ("article", "main") else 1)
            assert value(best) == pytest.approx(max(map(value, order)))


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- never ends", "<script>x", "</p></div>", "<nav>only</nav>", "&am", "<p>" * 3000 + "deep" + "<div>" * 3000, "<b><i></b></i>text", "\x00<p>\x00"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(main_text(page), str)


def test_cut_off_references_and_tags():
    assert main_text("<article><p>A &amp B &am") == "A & B &am"
    assert main_text("<article><p>text</artic") == "text"


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", None), (1, "u", PAGE, "x"), (None, "u", "<p>a</p>", "x")]
    got = extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    assert len(out) == 5 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def places(text):
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    found = []
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return words, found


TEXTS = [None, "", "MIT License", "mit license mit license cc by cc-by CC BY 4.0", "The GNU General Public License, GNU\nGeneral Public\tLicense v3", "Apache License 2.0; apache licensed", "übercc by xcc by", "ccby cc by", "plain prose without anything", "Licensed under CC BY-NC-SA 4.0.", "x " * 5000 + "apache license"]


@pytest.mark.parametrize("text", TEXTS)
def test_base_places(text):
    words, found = places(text)
    n, n_base, first, last, base, _ = scan(text)
    assert (n, n_base, base) == (len(words), len(found), {x for _, x in found})
    assert (first, last) == ((min(found)[0], max(found)[0]) if found else (None, None))


def test_signatures_and_suppression():
    assert len(signatures()) > 200
    assert [d[2] for d in scan("under the Apache License, Version 2.0")[5]] == ["apache-2.0"]
    assert [d[2] for d in scan("GNU Lesser General Public License version 2.1")[5]] == ["lgpl-2.1"]
    assert [d[2] for d in scan("CC BY-NC 4.0 and MIT License")[5]] == ["cc-by-nc-4.0", "mit"]
    rules = signatures()
    low, high = rules[-1], rules[0]
    assert resolve([(0, 30, low), (5, 10, high)]) == [(5, 10, high)]
    assert resolve([(0, 30, low), (40, 50, low)]) == [(0, 30, low), (40, 50, low)]
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that: neither the name of the holder nor ..."
    assert [d[2] for d in scan(bsd)[5]] == ["bsd-3-clause"]


def test_license_table(spark):
    rows = [(i, t, "l", "s", 0) for i, t in enumerate(TEXTS)] + [(None, "mit license", None, None, 1)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string, labels string, score string, n_words int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert {r["doc_id"]: r["labels"] for r in got}[2] == "mit"


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


URLS = [None, "", "no scheme", "http://a.net/x", "http://a.net", "http://A.Example.NET/en/1?q#f", "http://example.net/enx", "https://www.example.com/de/", "http://notexample.com/de/", "http://x.org/fr/1", "http://net/", "http://a.b://c/d", "x://h?p=/a", "x://h#/fr/", "http://u:p@h.org:80/fr/é\nz"]


def test_rules(spark):
    host, path = parts(F.col("u"))
    got = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", host.alias("h"), path.alias("p")).withColumn("r", rule_of(F.col("h"), F.col("p"))).collect()
    assert [(r["h"], r["p"], r["r"]) for r in got] == [plain_rule(r["u"]) for r in got]


def test_verdicts(spark):
    urls = [f"http://bad{i}.net/buy/{i}" for i in range(200)] + [f"http://good.org/fr/text-{i}" for i in range(200)] + [f"http://other.info/fr/text-{i}" for i in range(20)]
    rows = [(i, u, "v") for i, u in enumerate(urls)] + [(None, None, "v"), (1, urls[1], "v")]
    got = judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, verdict string")).collect()
    assert len(got) == len(rows) and all(r["verdict"] == RULES[r["rule"]] for r in got if r["rule"])
    assert sum(r["verdict"] == "allow" for r in got if r["host"] == "other.info") >= 18
    one = judge_urls(spark.createDataFrame([(1, "http://q.info/"), (2, "http://x.net/")], "page_id bigint, url string")).collect()
    assert {r["page_id"]: r["verdict"] for r in one} == {1: "allow", 2: "block"}
    assert judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def counted(rows, order=U.ORDER):
    """The model of rows (url, kind) from all their n-grams."""
    out = []
    for kind in (0, 1):
        keys, n = np.unique(U._grams([u for u, k in rows if k == kind], order)[0].ravel(), return_counts=True)
        out.append((keys, n.astype(float)))
    return U.UrlModel.build(out, order)


@pytest.mark.parametrize("n, scored", [(30, U.SCORED), (3000, 2000)])
def test_model_is_a_distribution_and_holds_every_gram(spark, monkeypatch, n, scored):
    monkeypatch.setattr(U, "SCORED", scored)
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefgh/-.0123") for _ in range(rng.randint(1, 30)))
    rows = [(f"http://{word()}", k % 2) for k in range(n)] + [("zz", 1)] * 3 + [("ab", 0)] * 3
    model = counted(rows)
    for kind in (0, 1):
        for before in ("http://", "a", "http://abc", "never-seen-%%"):
            keys = U._grams([before + "x"], model.order)[0][:, -2]
            every = np.stack([(keys & ~np.int64(255)) | b for b in range(256)], axis=1)
            p = model.probabilities(every, kind)
            assert (p > 0).all() and abs(p.sum() - 1) < 1e-9
    counts = U.count_grams(spark.createDataFrame(rows, "url string, kind int"))
    held = {(r.what, r.key): (r.n0, r.n1) for r in counts.collect()}
    for what, tables in enumerate((model.grams, model.contexts)):
        for kind in (0, 1):
            assert {k: v[kind] for (w, k), v in held.items() if w == what and v[kind]} == dict(zip(*(x.tolist() for x in tables[kind])))
    others = [u for u, _ in rows] + ["ab", "zz", "", None, "never/seen", "http://" + "x" * 5000]
    got = {r.url: r.ratio for r in U.ratios(spark.createDataFrame([(u,) for u in others], "url string"), counts).collect()}
    want = dict(zip(others, model.ratio(others).tolist()))
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-12 for u in want)
    assert got["ab"] < got["zz"]


P = "<p>" + "This is a real paragraph of the article, with commas, and enough words to count. " * 3 + "</p>"
ARTICLE = P[3:-4].strip()
ODD_PAGES = {
    f'<body><div class="layout has-sidebar">{P}<div class="sidebar"><a href=x>Link</a></div></div>': ARTICLE,
    f'<body><div id="content-with-comments">{P}<div class="comments"><p>{"I disagree with you, friend. " * 20}</p></div></div>': ARTICLE,
    f"<body><form id=f>{P}<input></form>": ARTICLE,
    f'<body><article><h2 class="section-header">Head</h2><p class="notice-of-article">{ARTICLE}</p><section id="related-work">{P}</section></article>': f"Head\n{ARTICLE}\n{ARTICLE}",
    f'<body><div class="x"">{P}</div>': ARTICLE,
    f"<body><p data=O'Brien>First, one.</p>{P}<p>It's last, here.</p>": f"First, one.\n{ARTICLE}\nIt's last, here.",
    f"<!--><body><div>{P}</div>": ARTICLE,
    f"<body><main><article><p>Short one here, yes.</p></article><article>{P * 4}</article></main>": "\n".join(["Short one here, yes.", *[ARTICLE] * 4]),
    f'<body><div class="post">{P}</div><div id="comments">{P * 30}</div>': ARTICLE,
    f'<body><div class="cookie-consent"><p>{"We use cookies, ok. " * 20}</p></div>': "",
    "<body><nav><a href=1>One</a><a href=2>Two</a></nav>": "",
}


@pytest.mark.parametrize("page", ODD_PAGES)
def test_odd_pages(page):
    assert main_text(page) == ODD_PAGES[page]


def test_deep_and_stray_tags_take_time_in_proportion():
    took = []
    for n in (10_000, 40_000):
        began = time.process_time()
        assert main_text("<div>" * n + "</b></span></zz>" * n + P) == ARTICLE
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_halves_of_a_notice_may_lie_far_apart():
    notice = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    far = notice + "clause " * 5000 + "neither the name of the holder"
    assert [d[2] for d in scan(far)[5]] == ["bsd-3-clause"]
    assert [d[2] for d in scan(notice + notice + "neither the name of")[5]] == ["bsd-2-clause", "bsd-3-clause"]
    assert len(SIGNATURES) > 200
    for s in signatures():  # every alternative holds its gate
        for words in re.sub(r"\(\?:([^()]*)\)\?", "", s.pattern.pattern).split("|"):
            assert s.keyword in s.pattern.pattern


def test_license_scan_of_an_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
