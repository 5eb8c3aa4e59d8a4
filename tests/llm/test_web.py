import math
import random
import re
from collections import Counter
from itertools import combinations

import pyarrow.parquet as pq
import pytest

from twinsieve.llm import tagpath, urlrules

URLS = [
    ("https://blog.example.org/es/1", "blog.example.org", "/es/1", "example.org/es/", "block"),
    ("http://EXAMPLE.org/en/123?x=/es/", "example.org", "/en/123", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/2#f", "notexample.org", "/es/2", "org/", "allow"),
    ("http://a.b.com/fr/x", "a.b.com", "/fr/x", "com/fr/", "allow"),
    ("http://com/de/", "com", "/de/", "com/de/", "block"),
    ("http://xcom/de/", "xcom", "/de/", None, None),
    ("http://ÄB.Net?q=://", "Äb.net", "", None, None),
    (None, "", "", None, None),
    ("no scheme/org/", "", "", None, None),
    ("", "", "", None, None),
    ("http://org", "org", "", None, None),
    ("http://a.org/\nes", "a.org", "/\nes", "org/", "allow"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in urlrules.judged(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert urlrules.judged(df.limit(0)).count() == 0


def test_mined_rules_and_inverted_index(spark):
    good = [(f"http://site{i % 40}.example.net/news/{i}", "allow") for i in range(300)]
    bad = [(f"http://s{i % 30}.example.net/casino/win/{i}", "block") for i in range(200)]
    mixed = [(f"http://m{i}.example.net/win/{i}", "allow") for i in range(250)]
    labelled = spark.createDataFrame([*good, *bad, *mixed, (None, "block"), ("http://x.example/", None), ("http://y.example/", "maybe")], "url string, verdict string")
    rules = urlrules.mine(labelled)
    assert all(c >= 0.8 and s >= 0.005 and 1 <= len(t) <= 3 for t, _, c, s in rules)
    kept = {(t, v) for t, v, _, _ in rules}
    assert (("p:casino",), "block") in kept and not any(t == ("p:win",) for t, _ in kept)
    rows = spark.createDataFrame([(1, "http://new.example.net/casino/win/9"), (2, "http://new.example.net/news/9"), (3, "http://other.test/"), (3, "http://other.test/")], "page_id long, url string")
    got = sorted((r.page_id, r.verdict) for r in urlrules.judged(rows, labelled).collect())
    assert got == [(1, "block"), (2, "allow"), (3, "allow"), (3, "allow")]
    brute = {}
    for page, url in ((1, "http://new.example.net/casino/win/9"), (2, "http://new.example.net/news/9")):
        hits = [(c, len(t), s, v, t) for t, v, c, s in rules if set(t) <= set(urlrules.url_tokens(url))]
        brute[page] = max(hits)[3] if hits else "allow"
    assert brute == {1: "block", 2: "allow"}


def brute_rules(rows, p):
    known = [(set(urlrules.url_tokens(u)), v) for u, v in rows if v in ("allow", "block")]
    count = Counter()
    for own, v in known:
        for size in (1, 2, 3):
            for c in combinations(sorted(own), size):
                count[c, v] += 1
    kept = {}
    for (c, v), n in count.items():
        every = count[c, "allow"] + count[c, "block"]
        if n >= p.min_support * len(known) and n / every >= p.min_confidence:
            kept[frozenset(c), v] = (n / every, n / len(known))
    shorter = lambda c: [c - {t} for t in c] if len(c) > 1 else []
    return {(c, v): x for (c, v), x in kept.items() if all(kept.get((s, v), (0,))[0] < x[0] for s in shorter(c))}


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        path = "/".join(rng.choice(["news", "casino", "win", "blog", "shop", "tag", "en", "de"]) for _ in range(rng.randint(1, 5)))
        host = f"{rng.choice(['www', 'm', 'blog'])}.{rng.choice(['alpha', 'beta', 'gamma'])}.{rng.choice(['net', 'org'])}"
        rows.append((f"http://{host}/{path}?{rng.choice(['id', 'page', 'ref'])}=1", "block" if "casino" in path and rng.random() < 0.9 or "beta" in host and "win" in path else rng.choice(["allow", "allow", "block", "maybe"])))
    p = urlrules.Mining(min_support=0.03)
    got = {(frozenset(t), v): (c, s) for t, v, c, s in urlrules.mine(spark.createDataFrame(rows, "url string, verdict string"), p)}
    want = brute_rules(rows, p)
    assert len(got) > 5 and set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    # URLs with more tokens than a basket: rules that are found still have their whole counts
    many = [("http://h.example.net/" + "/".join([f"w{chr(97 + k)}x" for k in range(12)] + (["rare"] if i % 4 == 0 else [])), "block" if i % 4 == 0 else "allow") for i in range(60)]
    want = brute_rules(many, p)
    for t, v, c, s in urlrules.mine(spark.createDataFrame(many, "url string, verdict string"), urlrules.Mining(min_support=0.03, tokens=6)):
        assert want[frozenset(t), v] == pytest.approx((c, s))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site name, menu.</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, so there.</div><article><h1>Head &amp; more</h1><p><b>First&nbsp;line.
 goes on<br><p>Second, with <i>words</i>.</p><div class="ad">Buy now!</div><form><input value="x"><button>Go</button></form><section class="comments"><p>Nice post!</p></section></article>
<aside>Related: this, that.</aside><footer>&copy; us</footer></body></html>"""


def test_article():
    assert tagpath.main_text(PAGE) == "Head & more\nFirst line. goes on\nSecond, with words."


def test_without_article_element():
    page = "<html><body><div class=top><a href=x>One</a> <a href=y>Two</a></div><div class=text><h2>Title</h2>" + "".join(f"<p>Paragraph {i}, with some words; and more, so it goes on.</p>" for i in range(6)) + "</div><div class=sidebar>Other things.</div></body></html>"
    lines = tagpath.main_text(page).split("\n")
    assert lines[0] == "Title" and len(lines) == 7


def neutral(page):
    """The page with names taken away: elements that mean something are div, without class, id or role."""
    page = re.sub(r"<(/?)(nav|header|footer|aside|article|main|section)\b[^>]*>", r"<\1div>", page or "")
    return re.sub(r'\s(class|id|role)="[^"]*"', "", page)


def test_ratios_decide_without_names(sf):
    pages = [r["html"] for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()]
    right = made = wanted = changed = 0
    for page in pages:
        want, got = Counter(tagpath.main_text(page).split("\n")), Counter(tagpath.main_text(neutral(page)).split("\n"))
        right, made, wanted = right + (want & got).total(), made + got.total(), wanted + want.total()
        changed += tagpath.main_text(neutral(page), 0.0, 0.0) != tagpath.main_text(neutral(page))
    assert right / made >= 0.95 and right / wanted >= 0.95
    assert changed >= 0.3 * len(pages)  # without thresholds more comes through


def test_scores_equal_plain_ratios():
    found = tagpath.blocks("<body><div>Menu one</div><div><h1>Title</h1><p>Some text, of words.</p><p>More; and more. <a href=x>linked</a></p></div><div class=ad>Buy, now!</div><p></p></body>")
    scores, value = tagpath.path_scores(found)
    paths = [b.path for b in found]

    def mean(of):
        return [sum(of(c) for c in found if c.path == p) / paths.count(p) for p in paths]

    def smooth(x):
        kernel = {k: math.exp(-k * k / 2) for k in range(-2, 3)}
        return [sum(w * x[i + k] for k, w in kernel.items() if 0 <= i + k < len(x)) / sum(w for k, w in kernel.items() if 0 <= i + k < len(x)) for i in range(len(x))]

    text, marks = mean(lambda c: len(c.text) - c.linked), mean(lambda c: sum(x in ".,;:!?" for x in c.text) if 2 * c.linked < len(c.text) else 0)
    want = [a * (1 + b) * (tagpath.WEAKENED if c.weak else 1) for a, b, c in zip(smooth(text), smooth(marks), found)]
    assert scores == pytest.approx(want) and [c.weak for c in found] == [False] * 4 + [True]
    for p in set(paths):
        own = [s for s, q in zip(want, paths) if q == p]
        i = paths.index(p)
        assert value[p] == pytest.approx(math.sqrt(sum(own) / len(own) * text[i] * (1 + marks[i])))


ARTICLE = "".join(f"<p>Paragraph {i}, with some words; and more, so it goes on.</p>" for i in range(9))
AROUND = "<header><a href=/>Home</a></header><nav><a href=/x>One</a> <a href=/y>Two</a></nav>", "<footer>Imprint, rights.</footer>"


@pytest.mark.parametrize("names", ["page has-sidebar", "content-with-comments", "wrapper no-header", "post share", "main-menu-open", "story", "social page", "aspnetForm"])
def test_names_of_a_wrapper_lose_no_article(names):
    tag = "form" if names == "aspnetForm" else "div"
    page = f'<body>{AROUND[0]}<{tag} class="{names}"><h1>Title</h1>{ARTICLE}<div class="sidebar">Read on, and on.</div></{tag}>{AROUND[1]}</body>'
    got = tagpath.main_text(page).split("\n")
    assert got == ["Title", *(f"Paragraph {i}, with some words; and more, so it goes on." for i in range(9))]
    whole = tagpath.main_text(f'<body><{tag} id="{names}">{page[6:-7]}</{tag}></body>')
    assert whole.split("\n") == got


def test_long_comments_are_no_article():
    page = f'<body>{AROUND[0]}<div><h1>Title</h1>{ARTICLE[:180]}</p></div><div class="comment-list">{ARTICLE * 5}</div></body>'
    assert tagpath.main_text(page).split("\n")[:2] == ["Title", "Paragraph 0, with some words; and more, so it goes on."] and "Paragraph 8" not in tagpath.main_text(page)


def test_a_footer_longer_than_the_article_stays_out():
    assert tagpath.main_text("<body><nav><a href=/>x</a></nav><article><h1>A few words.</h1><p><b>A few words.</p></article><footer>&copy; Someone, of somewhere; all the rights, and more of them. And on.</footer></body>") == "A few words.\nA few words."


def test_an_inline_advert_ends_at_its_own_end():
    assert tagpath.main_text("<p>Before <span class=ad>buy <span>this</span> now</span>and after, all of it.</p>") == "Before and after, all of it."
    assert tagpath.main_text("<p>Before <span class=ad>and after") == "Before and after"


def plain_selection(page):
    """main_text() told again: cut, holder and choice from scores, by loops over elements."""
    found = tagpath.blocks(page)
    if not found or all(b.weak for b in found):
        return ""
    scores, value = tagpath.path_scores(found)
    n = len(found)
    mean = sum(scores) / n
    spread = (sum((x - mean) ** 2 for x in scores) / n) ** 0.5
    paths = {b.path for b in found}
    sums = {p: sum(x for x, b in zip(scores, found) if b.path == p) for p in paths}
    strong = {b.path for b in found if not b.weak}
    best = sorted(strong, key=lambda p: (-sums[p], len(p), next(i for i, b in enumerate(found) if b.path == p and not b.weak)))[0]
    of_links = {p for p in paths if 2 * sum(b.linked for b in found if b.path == p) > sum(len(b.text) for b in found if b.path == p)}
    content = {best} | {p for p in paths - of_links if value[p] >= min(value[best], max(0.8 * spread, 0.5 * value[best]))}
    mass = [x if b.path in content else 0.0 for x, b in zip(scores, found)]
    holder = ()
    while True:  # down to the child that still has most of it, while it has more than one block
        inside = {}
        for b, x in zip(found, mass):
            if len(b.at) > len(holder) and b.at[: len(holder)] == holder:
                of = inside.setdefault(b.at[len(holder)], [0.0, 0])
                of[0], of[1] = of[0] + x, of[1] + 1
        down = [c for c, (x, k) in inside.items() if x >= tagpath.HELD * sum(mass) and k > 1]
        if not down:
            break
        holder += (down[0],)
    out = []
    for b in found:
        heading = bool(b.path) and b.path[-1].split(".")[0] in tagpath.HEADINGS
        inside = b.at[: len(holder)] == holder
        if not b.weak and (b.path in content or inside and (heading or len(holder) >= 3 and b.path not in of_links)):
            out.append(b.text)
    return "\n".join(out)


def test_the_selection_equals_a_plain_version(sf):
    pages = [r["html"] for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()]
    rng = random.Random(3)
    made = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 7)):
            tag, name = rng.choice(["div", "section", "nav", "ul", "div"]), rng.choice(["", "", " class=ad", " class='post share'", " id=comments"])
            inner = "".join(rng.choice(["<p>Some text, of a few words; more.</p>", "<h2>Head</h2>", "<p><a href=x>a link of words</a></p>", "<div>short</div>", "<p>One more sentence here. And another, longer one.</p>"]) for _ in range(rng.randint(1, 6)))
            parts.append(f"<{tag}{name}>{inner}</{tag}>")
        made.append("<body><div>" + "".join(parts) + "</div></body>")
    for page in [*pages, *map(neutral, pages), *made]:
        assert tagpath.main_text(page) == plain_selection(page or "")


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("   ", ""), ("plain text only", "plain text only"), ("<p>a<p>b", "a\nb"), ('<div class="', ""), ("<p>1 < 2 &lt; 3", "1 < 2 < 3"), ("<script>x", ""), ("<ul><li>one<li>two</ul>", "one\ntwo")])
def test_odd_pages(page, text):
    assert tagpath.main_text(page) == text


def test_long_page_and_rows(spark):
    long = "<article>" + "<p>Word, word.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", long, "t"), (1, "u", long, "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = tagpath.extracted(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 239_999, 239_999]
    assert tagpath.extracted(df.limit(0)).count() == 0
