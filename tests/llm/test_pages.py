"""URL rules and main text of pages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cueweave.llm import html_text, url_rules

RULES = url_rules.RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def by_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://badexample.org/en/1", "http://x.com/fr/a", "http://x.com/de/a",
    "http://com/de/", "ftp://a?b/c", "http://u:p@h.net:80/p#x?y", "http://a.net/http://b.org/", "x://y://z.org/", "http://org/\n/a", "http://ÄX.org/",
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")


def test_hosts_paths_and_curated_rules(spark):
    none = spark.createDataFrame([], "url string, blocked boolean")
    rows = {r.page_id: r for r in url_rules.judge(pages(spark, URLS + URLS), none, RULES).collect()}
    assert len(rows) == 2 * len(URLS)
    for i, url in enumerate(URLS + URLS):
        rule = by_rule(*parts(url))
        assert (rows[i].host, rows[i].path) == parts(url), url
        assert (rows[i].rule, rows[i].verdict) == (rule or (None, "allow")), url


def exhaustive(rows, support, confidence, lift, least):
    """Kept rules by trying every set of tokens: {(tokens, verdict): confidence}."""
    from itertools import combinations

    n = len(rows)
    share = {v: sum(b == (v == "block") for _, b in rows) / n for v in ("block", "allow")}
    sets = {frozenset(c) for tokens, _ in rows for k in range(1, len(tokens) + 1) for c in combinations(sorted(tokens), k)}
    found = {}
    for s in sets:
        has = [b for tokens, b in rows if s <= tokens]
        for v in share:
            good = sum(b == (v == "block") for b in has)
            if not has or good < max(support * n, least):
                continue
            c = good / len(has)
            error = 1 - share[v]
            surer = ((1 - c) * len(has) + url_rules.PRIOR * error) * lift <= (len(has) + url_rules.PRIOR) * error
            if c >= confidence and (c / share[v] >= lift or surer):
                found[s, v] = c
    kept = {k: c for k, c in found.items() if not any(s < k[0] and v == k[1] and d >= c for (s, v), d in found.items())}
    return kept


def test_mining_equals_trying_every_set(spark):
    """Up to tokens that stand in the same URLs: each mined rule is an exhaustive one with all tokens of its items."""
    rng = random.Random(5)
    rows = []
    for _ in range(160):
        bad = rng.random() < 0.3
        tokens = {rng.choice("ab"), rng.choice("cd"), rng.choice("efg") if rng.random() < 0.7 else "h"}
        tokens |= {"x", "twin"} if bad and rng.random() < 0.8 or rng.random() < 0.05 else set()
        rows.append((tokens, bad))
    for least in (1, 6):
        table = spark.createDataFrame([(sorted(t), b) for t, b in rows], "tokens array<string>, blocked boolean")
        got = {(frozenset(r.antecedent) - {"x"}, r.verdict): round(r.confidence, 9) for r in url_rules.mine(table, 0.01, 0.7, 1.2, least).collect()}
        want = exhaustive([(t - {"x"}, b) for t, b in rows], 0.01, 0.7, 1.2, least)
        assert got == {k: round(c, 9) for k, c in want.items()} and got


def test_url_rows_survive(spark):
    """Clashing columns, repeated rows, a very long URL, labels without verdict."""
    urls = ["http://a.net/" + "x/" * 20_000, "http://a.net/y", "http://a.net/y", None]
    table = pages(spark, urls).select("*", *[F.lit(n).alias(n) for n in ("host", "path", "rule", "verdict", "tokens", "n", "best")])
    labels = spark.createDataFrame([("http://a.net/y", None), (None, True), ("http://a.net/y", True)], "url string, blocked boolean")
    got = url_rules.judge(table, labels, RULES).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"}


def test_mined_rules(spark):
    rng = random.Random(1)
    labelled = []
    for i in range(400):
        bad = i % 4 == 0
        labelled.append((f"http://{rng.choice(['m', 'www'])}.{'win' if bad else 'site'}{rng.randrange(5)}.net/{'bonus' if bad else 'news'}/{i}", bad))
    labels = spark.createDataFrame(labelled, "url string, blocked boolean")
    asked = ["http://m.fresh.net/bonus/1", "http://m.fresh.net/news/1", "http://other.net/x", "http://m.fresh.net/bonus/1"]
    got = sorted(url_rules.judge(pages(spark, asked), labels, []).collect(), key=lambda r: r.page_id)
    assert [r.verdict for r in got] == ["block", "allow", "allow", "block"] and got[0].mined == ["path=bonus"]


@pytest.mark.parametrize("allowed", [50, 2, 0])
def test_rules_for_a_frequent_label(spark, allowed):
    labelled = [(f"http://m.site.net/bonus/{i}", True) for i in range(200)] + [(f"http://m.site.net/news/{i}", False) for i in range(allowed)]
    labels = spark.createDataFrame(labelled, "url string, blocked boolean")
    asked = ["http://x.org/bonus/1", "http://x.org/news/1", "http://x.org/a"]
    got = sorted(url_rules.judge(pages(spark, asked), labels, []).collect(), key=lambda r: r.page_id)
    assert [r.verdict for r in got] == ["block", "allow", "allow"] and got[0].mined == ["path=bonus"]


def test_a_frequent_label_needs_more_than_its_share(spark):
    rows = [(["a", "b"], False)] * 60 + [(["a", "c"], False)] * 20 + [(["a", "d"], True)] * 20
    known = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    assert {tuple(r.antecedent) for r in url_rules.mine(known, 0.01, 0.8, 1.5).filter("verdict = 'allow'").collect()} == {("b",), ("c",)}


def test_general_rules_cover_special_ones(spark):
    rows = [(["a", "b", "c"], True)] * 30 + [(["a", "d"], True)] * 30 + [(["e"], False)] * 60
    known = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    kept = {tuple(r.antecedent) for r in url_rules.mine(known, 0.01, 0.8, 1.5).filter("verdict = 'block'").collect()}
    assert ("a",) in kept and ("a", "b") not in kept


PAGE = (
    '<html><body class="header-fixed"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><main><article><h1>T &amp; x</h1>'
    "<p>One <i>two</i>three<p>a<b>b<ul><li>x<li>y</ul><form><p>f</form><div class=\"ad-box\">buy</div><p>end &nbsp; z</article>"
    '<section class="comments"><article class=comment>c1</article></section></main><aside>s</aside><footer>f</footer><script>var t="</p>";</script>'
)


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE, "T & x One twothree ab x y end z"), (None, ""), ("", ""), ("<", "<"), ("<p", ""), ("plain", "plain"), ("<div>a<p>b</div>c", "a b c"), ("<!-- x", ""),
        ("<script>a", ""), ("<p>&lt;b&gt; &#233; &am</p><p", "<b> é &am"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<title>t</title>x<br>y", "x y"),
        ("<div>" * 3000 + "deep", "deep"), ('<p title="a > b">q</p>', "q"), ("a<nav><a>m</a></nav>b", "ab"), ("<article>1</article><article>two</article>", "two"),
    ],
)
def test_text_of_a_page(page, text):
    root = html_text.parse(page or "")
    html_text.subtree_hashes(root)
    assert html_text.main_text(root, set()) == text


def site(spark):
    rows = []
    for i in range(40):
        menu = "<div><a href=/a>home</a> <a href=/b>about us</a></div>"
        end = "<div>All rights kept by the house</div>"
        rows.append((i, f"http://{'hot' if i % 3 else 'cold'}.net/{i}", f"<body>{menu}<div>Text number {i} is here</div><p>shared words</p>{end}</body>"))
    for i in range(30):
        rows.append((100 + i, "http://copies.net/x", "<body><div>the same page each time</div></body>"))
    rows += [(200, None, None), (200, None, None), (201, "http://hot.net/", "<article><p>shared words</p><p>own words</p></article>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_template_goes_copies_and_articles_stay(spark):
    got = {r.page_id: r.text for r in html_text.extract(site(spark).withColumns({"host": F.lit(1), "template": F.lit(2), "salt": F.lit(3)})).collect()}
    assert all(got[i] == f"Text number {i} is here" for i in range(40))
    assert all(got[100 + i] == "the same page each time" for i in range(30))
    assert got[200] == "" and got[201] == "shared words own words"
    assert html_text.extract(site(spark)).count() == site(spark).count()
    assert html_text.extract(site(spark).limit(0)).count() == 0


def test_no_page_no_rule(spark):
    none = spark.createDataFrame([], "url string, blocked boolean")
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string"), none, RULES).count() == 0
