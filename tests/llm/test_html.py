"""Main text extraction on whole tables and on awkward pages."""

import html
import random
import re
from collections import Counter

import pyarrow as pa

from weft.llm import html as H


def plain_article(page):
    """The article of a page of the test tables, by its own markup."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>|<br>", article)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts]
    return "\n".join(t for t in texts if t)


def test_whole_table(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in H.main_text(pages).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def site(body, k):
    return (
        f"<html><head><title>T{k}</title></head><body><header><h2>Site</h2></header><div id=menu><a href=/>Home</a></div>"
        f"<div class='wrap'>{body}</div><div>All rights kept by the site.</div><div class='comments'><p>Nice {k}!</p></div>"
        f"<form><p>Mail</p><input></form><footer>foot {k}</footer></body></html>"
    )


def test_template_without_article_elements(spark):
    bodies = [f"<h1>Head {k}</h1><p>First&nbsp;&amp; {'word ' * (5 + k)}\n end</p><ul><li>one {k}<li>two</ul><script>if (a</p>) 1</script><p>Last<b>bold</b> {k}" for k in range(8)]
    rows = [(k, f"https://h.example/{k}", site(b, k)) for k, b in enumerate(bodies)]
    out = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert out[k] == "\n".join([f"Head {k}", f"First & {' '.join(['word'] * (5 + k))} end", f"one {k}", "two", f"Lastbold {k}"])


def test_copies_of_an_article_stay_whole(spark):
    page = "<body><nav>n</nav><article><h1>A</h1><p>Same text</p><div class='ad'>buy</div><aside>s</aside></article><footer>f</footer>"
    rows = [(k, "http://copy.example/x", page) for k in range(9)]
    assert {r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"A\nSame text"}


def text_of(spark, rows):
    return {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def plain(k):
    """A page without article, main or telling names: a list of links, a teaser, the text, a closing line, all of them different from page to page."""
    links = "".join(f"<li><a href=/{k}{i}>go {k} {i}</a>" for i in range(2 + k % 3))
    body = "".join(f"<p>{' '.join(f'w{k}x{i}x{j}' for j in range(30))}</p>" for i in range(2 + k % 4))
    extra = f"<div class='legal'><p>Terms of case {k} apply</p></div><div class='related tags'><p>See case {k + 1} too</p></div>" if k % 2 else ""
    return f"<html><body class='has-sidebar nav-open'><div class=a1><ul>{links}</ul></div><div class=b2>teaser {k}</div><div class='c3 post-header'><h1>Case {k}</h1>{body}{extra}</div><div class=d4>line {k} and the rest</div></body></html>"


def plain_text(k):
    out = [f"Case {k}"] + [" ".join(f"w{k}x{i}x{j}" for j in range(30)) for i in range(2 + k % 4)]
    return "\n".join(out + ([f"Terms of case {k} apply", f"See case {k + 1} too"] if k % 2 else []))


def test_template_alone_finds_the_article(spark):
    rows = [(k, f"https://plain.example/{k}", plain(k)) for k in range(9)]
    assert text_of(spark, rows) == {k: plain_text(k) for k in range(9)}


def test_result_hangs_on_the_vectors(spark, monkeypatch):
    rows = [(k, f"https://plain.example/{k}", plain(k)) for k in range(9)]
    real = H._occurrences

    def blurred(batches):
        for batch in real(batches):
            names = batch.schema.names
            at = names.index("times")
            columns = [pa.array([7] * batch.num_rows, pa.int32()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    monkeypatch.setattr(H, "_occurrences", blurred)
    assert text_of(spark, rows) != {k: plain_text(k) for k in range(9)}


def brute_template(pages):
    """Main slots of a host from whole occurrence vectors, classes as sets, orders compared page by page."""
    paths = H.Paths()
    seen = [H.blocks(p, paths)[1] for p in pages]
    nodes = {t: s[t][0] for s in seen for t in s}
    classes = {}
    for t in nodes:
        vector = tuple(s[t][1] if t in s else 0 for s in seen)
        if sum(v > 0 for v in vector) >= H.SUPPORT * len(pages):
            classes.setdefault(vector, set()).add(t)
    good = set()
    for vector, members in classes.items():
        orders = Counter(tuple(t for t in s if t in members) for s in seen if members & set(s))
        if max(vector) == 1 and max(orders.values()) >= H.ORDERED * sum(orders.values()):
            good |= members
    chars = {t: sum(s[t][2] for s in seen if t in s) for t in good if not nodes[t].dropped and nodes[t].name in H.HOLDERS}
    marked = [t for t in chars if nodes[t].name in ("article", "main")]
    held = [t for t in chars if chars[t] and chars[t] >= H.MAIN_SHARE * max(chars.values())]
    return sorted(marked, key=lambda t: (-chars[t], nodes[t].label)) + [t for t in sorted(held, key=lambda t: (-nodes[t].label.count("/"), -chars[t], nodes[t].label)) if t not in marked]


def test_templates_by_brute_force(spark, sf_small):
    pages = [(r.url.split("/")[2], r.html) for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()]
    pages += [("plain", plain(k)) for k in range(9)] + [("odd", f"<body>{''.join(f'<div class=s{(i + k) % 3}>t{k} {i}</div>' for i in range(3))}</body>") for k in range(6)]
    df = spark.createDataFrame(pages, "host string, html string").selectExpr("*", "xxhash64(html) as page")
    got = {r.host: r.main for r in H.templates(df).collect()}
    want = {}
    for host in {h for h, _ in pages}:
        want[host] = brute_template([p for h, p in pages if h == host])
    assert {h: m for h, m in got.items() if m} == {h: m for h, m in want.items() if m}


def test_names_only_label_slots(spark):
    page = lambda k: f"<body class='nav-open ad'><main class='sidebar'><p>kept {k}</p><div class='ad-box'>buy</div><div class='hidden copyright share'>kept too</div><header>top {k}</header></main><div id='comments-area'>nice</div></body>"
    assert text_of(spark, [(k, "http://n.example", page(k)) for k in range(3)]) == {k: f"kept {k}\nkept too\ntop {k}" for k in range(3)}


def test_nulls_odd_markup_and_empty_table(spark):
    rows = [(1, None, None), (2, "not a url", ""), (None, "http://a.example/", "<p>only"), (4, "http://b.example", "a < b & c"), (5, "http://c.example", "<div><p>x<table><tr><td>1<td>2</table>y"), (5, "http://c.example", "<div><p>x<table><tr><td>1<td>2</table>y"), (6, "http://d.example", "<" * 3000 + "<!-- open"), (7, "http://e.example", "<p title=\"q>t</p><p>" + "long " * 30000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as main", "'z' as page")
    out = {(r.page_id, r.url): r.text for r in H.main_text(df).collect()}
    assert out[1, None] == "" and out[2, "not a url"] == "" and out[None, "http://a.example/"] == "only"
    assert out[4, "http://b.example"] == "a < b & c" and out[5, "http://c.example"] == "x\n1\n2\ny"
    assert len(out[7, "http://e.example"]) > 100_000
    assert H.main_text(df).count() == len(rows) and H.main_text(df.limit(0)).count() == 0


OWN_NAMES = ['id="form-of-government"', 'id="banner-wars"', 'class="side-effects"', 'class="ad-hoc"', 'class="notice-of-works"', 'class="reply-to-critics"', 'id="platform-notice"', 'class="lead sideways"', 'id="Formation"']
LABELS = ['class="site-footer"', 'class="cookie-banner"', 'id="commentList"', 'class="ad-box-2"', 'class="x sidebar"', 'class="post-comments"', 'id="AD"', 'class="main_nav"', 'class="newsletter-signup-form"']


def test_names_with_other_words_label_nothing():
    name = re.compile('"(.*?)"')
    assert not any(H.label_of(w) for n in OWN_NAMES for w in name.search(n)[1].split())
    assert all("slot" in map(H.label_of, name.search(n)[1].split()) for n in LABELS)
    assert H.label_of("site-header") == "header" and H.label_of("post-header") == "" and H.label_of("discussion") == "talk"


def test_article_text_under_telling_words_stays(spark):
    rows, want = [], {}
    for k in range(12):
        parts = "".join(f"<section {n}><h2>part {i} of {k}</h2><p>text {i} {k}</p></section>" for i, n in enumerate(OWN_NAMES))
        junk = "".join(f"<div {n}>junk {i} {k}</div>" for i, n in enumerate(LABELS))
        body = f"<h1>Head {k}</h1>{parts}{junk}<p>end {k}</p>"
        body = f"<article>{body}</article>" if k % 2 else f"<div class=body-text>{body}</div>"
        rows.append((k, f"https://names{k % 2}.example/{k}", f"<body><nav>go</nav>{body}<section class=discussion><article><p>First! {k}</p></article></section></body>"))
        want[k] = "\n".join([f"Head {k}", *(x for i in range(len(OWN_NAMES)) for x in (f"part {i} of {k}", f"text {i} {k}")), f"end {k}"])
    assert text_of(spark, rows) == want


def test_generated_site_with_names_of_any_words(spark):
    rng = random.Random(7)
    words = [*H.SLOT_NAMES, *H.PLACE_NAMES, *H.HEADER_NAMES, *"of the history wars effects hoc works critics data model".split()]
    rows, want = [], {}
    for k in range(10):
        parts, texts = [], [f"Head {k}"]
        for i in range(25):
            name = "-".join(rng.choices(words, k=rng.randrange(1, 4)))
            known = set(name.split("-")) - set(H.PLACE_NAMES)  # the rule, by its definition
            label = bool(known & set(H.SLOT_NAMES)) and known <= {*H.SLOT_NAMES, *H.HEADER_NAMES}
            label |= bool(known & set(H.COMMENT_NAMES)) and known <= {*H.COMMENT_NAMES, *H.COMMENTED_NAMES}
            parts.append(f'<div class="{name}"><p>para {i} on page {k}</p></div>')
            texts += [] if label else [f"para {i} on page {k}"]
        rows.append((k, f"https://site.example/{k}", f"<body><nav>n</nav><article><h1>Head {k}</h1>{''.join(parts)}</article><footer>f</footer></body>"))
        want[k] = "\n".join(texts)
    assert text_of(spark, rows) == want
