import random

from corpusloom.llm.dom import Matching, common_sequence, parse
from corpusloom.llm.html_extract import extract, main_text

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>'
    '<!-- <p>no</p> --><div class="ad">Buy {i}</div><aside>side {i}</aside><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; {i}</h1><p><b>First   <i>para</i>\n{i}<br>line'
    '<p>Second &lt;b&gt; caf&eacute; {i}</p><div class="share">Share this</div><form><p>Mail?</p></form></article><section id="comments"><article><p>Reader {i}</p></article></section><footer>&copy; {i}</footer></body></html>'
)


def page(i):
    return PAGE.replace("{i}", str(i))


def test_article():
    assert main_text(page(3)) == "Title & 3\nFirst para 3 line\nSecond <b> café 3"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("plain &amp; text") == "plain & text"
    assert main_text("<p>a<p>b <script>x</script>c<div>d") == "a\nb c\nd"


def test_what_an_article_holds_stays():
    body = '<h1>T</h1><p>Text</p><ul><li><a href="/a">First source</a><li><a href="/b">Second source</a></ul><nav><ul><li><a href="/">Home</a></ul></nav>'
    for region in ("article", "main"):
        assert main_text(f"<body><ul><li><a>Menu</a></ul><{region}>{body}</{region}></body>") == "T\nText\nFirst source\nSecond source"
    for part in ('<div id="search-algorithms">kept</div>', '<p class="notice-period">kept</p>', "<p><math><mi>kept</mi></math></p>", '<ul><li><a href="/x">kept</a></ul>', '<div class="social-history">kept</div>'):
        assert main_text(f"<article><p>Text</p>{part}</article>") == "Text\nkept"
    for part in ('<div class="ad">no</div>', '<div id="cookie-notice">no</div>', '<div class="site-footer">no</div>', '<div class="relatedPosts">no</div>', '<section id="comment-17">no</section>'):
        assert main_text(f"<article><p>Text</p>{part}</article>") == "Text"
    assert main_text("<article><p>Text</p>" + "<div>" * 5000 + "<nav>no</nav>" + "</div>" * 5000 + "</article>") == "Text"


def test_template_is_what_doesnt_vary(spark):
    body = "<html><body><div class='top'>Welcome to the site of all sites</div><div class='x'><p>{}</p></div><div class='y'>Read more of us every day of the week</div></body></html>"
    rows = [(i, f"https://h.org/{i}", body.format(f"Story number {i} tells of {i} things that happened")) for i in range(8)]
    rows += [(20, "https://one.org/", body.format("alone")), (21, None, page(1)), (22, "u", None), (23, "https://h.org/z", ""), (24, "https://H.org:80/", rows[0][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in extract(df).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "Story number 3 tells of 3 things that happened" and got[24].text == got[0].text
    assert "Welcome" in got[20].text and got[21].text.startswith("Title & 1") and got[22].text == got[23].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert extract(df.where("false")).count() == 0


def test_copies_of_an_article_stay(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", page(1)) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in extract(df).collect()} == {main_text(page(1))}


def sites(rng):
    """Pages of three sites, in neutral elements: an opening line that repeats, a body that varies, a closing line from a small pool."""
    rows, want = [], {}
    for i in range(90):
        story = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        page = f"<html><body><div class=a><p>Read this first, all of you</p></div><div class=b>{''.join(f'<p>{x}</p>' for x in story)}<p>As told on our pages</p></div><div class=c><span>Pool {i % 4}</span></div></body></html>"
        rows.append((i, f"http://s{i % 3}.org/{i}", page))
        want[i] = "\n".join(story)
    return rows, want


def test_varying_slots_of_neutral_pages_whatever_the_partitions(spark):
    rows, want = sites(random.Random(1))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [{r.page_id: r.text for r in extract(df.orderBy("html").repartition(n) if n > 1 else df.coalesce(1)).collect()} for n in (1, 7)]
    assert found[0] == found[1]
    # The closing sentence has no slot of its own where a body has more or fewer paragraphs than the pivot.
    assert all(t.removesuffix("\nAs told on our pages") == want[i] for i, t in found[0].items())
    assert not any("Read this" in t or "Pool" in t for t in found[0].values())


def test_notices_that_repeat_go_and_copies_stay(spark):
    """In an article too, a text that holds its slot on different bodies is template; one that comes with its body isn't."""
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = [words(40) for _ in range(5)]
    rows, want = [], {}
    for i in range(60):
        body = [words(40) for _ in range(5)]
        if i % 2:  # near copies of one text
            body = [list(p) for p in base]
            body[rng.randrange(5)][rng.randrange(40)] = words(1)[0]
        body = [" ".join(p) for p in body]
        rows.append((i, f"http://s.org/{i}", f"<article><div>Our shop closes soon</div>{''.join(f'<p>{p}</p>' for p in body)}</article>"))
        want[i] = "\n".join(body)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def brute_score(a, b):
    """Simple tree matching by trying every pair of first children."""
    if a.symbol != b.symbol:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), brute_score(xs[0], ys[0]) + best(xs[1:], ys[1:]) if xs[0].symbol == ys[0].symbol else 0)

    return 1 + best(a.children, b.children)


def random_tree(rng, depth):
    out, last = [], None
    for _ in range(rng.randint(0, 4)):
        tag = rng.choice([t for t in "uvx" if t != last])  # neighbours differ: runs of one
        last = tag
        out.append(f"<{tag}->{random_tree(rng, depth - 1) if depth else 't'}</{tag}->")
    return "".join(out)


def test_alignment_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        a, b = (parse(random_tree(rng, 2)) for _ in range(2))
        assert Matching().score(a, b) == brute_score(a, b)
    a, b = (parse(x) for x in ("<div><p>a</p><ul><li>1</li></ul></div>", "<div><h1>t</h1><p>b</p><ul><li>1</li><li>2</li></ul></div>"))
    assert Matching().score(a, b) == 7  # root, div, p, its text, ul, li, its text
    assert sorted((x.text, y.text) for x, y in Matching().texts(a, b)) == [("1", "1"), ("a", "b")]


def test_common_sequence():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.choice("pqr") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        for most in (0, 10**6):
            pairs = common_sequence(a, b, most)
            assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
            assert not most or len(pairs) == table[-1][-1]


def heaviest(a, b, weigh):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + weigh(x, y))
    return table[-1][-1]


def test_common_sequence_is_heaviest_whatever_is_held():
    assert common_sequence("zabc", "abcz", 0) == common_sequence("zabc", "abcz", 100) == [(1, 0), (2, 1), (3, 2)]
    rng = random.Random(5)
    for n in [rng.randint(0, 12) for _ in range(40)] + [70] * 5:
        a, b = ([rng.randrange(6) for _ in range(n + rng.randint(0, 3))] for _ in range(2))
        weights = {(x, y): 9 if x == y else rng.randrange(10) for x in range(6) for y in range(6)}
        for weigh in (lambda x, y: int(x == y), lambda x, y: weights[x, y]):
            found = [common_sequence(a, b, most, weigh) for most in (0, 900, 3000, 20_000, 10**8)]
            assert all(f == found[0] for f in found)
            assert sum(weigh(a[i], b[j]) for i, j in found[0]) == heaviest(a, b, weigh) and all(weigh(a[i], b[j]) for i, j in found[0])


def test_long_lists_are_weighed_as_short_ones_are(monkeypatch):
    def pairs(n):
        """Node pairs beyond those of the n elements that both pages have."""
        same = "".join(f"<h{1 + i % 2}>t</h{1 + i % 2}>" for i in range(n))
        a = parse(f"<div><p>one</p><ul><li>two</li></ul></div>{same}")
        b = parse(f"<div>light</div><i>x</i><div><p>1</p><ul><li>2</li></ul></div><b>y</b>{same}<b>z</b>")
        return Matching().score(a, b) - 2 * n, sorted((x.text, y.text) for x, y in Matching().texts(a, b) if x.text != "t")

    assert pairs(10) == pairs(150) == (7, [("one", "1"), ("two", "2")])
    monkeypatch.setattr(Matching, "HELD", 0)
    monkeypatch.setattr(Matching, "REMEMBERED", 1)
    assert pairs(10) == pairs(150) == (7, [("one", "1"), ("two", "2")])


def test_a_list_beyond_the_cells_held():
    """Over 10,000 runs on both sides; the first of the page is the last of the pivot."""
    names = [f"<x{'abcdefghij'[i // 1000]}{'abcdefghij'[i // 100 % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}>" for i in range(10_000)] + ["<y>"]
    closed = [f"{n}t</{n[1:]}" for n in names]
    a, b = parse("<y>t</y><z>t</z>" + "".join(closed[:-1])), parse("".join(closed))
    assert len(a.children) * len(b.children) > 100_000_000
    assert len(Matching().texts(a, b)) == 10_000


def test_notices_go_from_long_pages_as_from_short_ones(spark):
    def site(sections):
        rows, want = [], {}
        for i in range(12):
            story = [(f"Title w{i}x{k}", f"Text v{i}y{k} and u{i}z{k}") for k in range(sections)]
            lead = f"<div>Lead {i}</div><hr>" if i % 2 else ""
            body = "".join(f"<h2>{t}</h2><p>{x}</p>" for t, x in story)
            rows.append((i, f"http://s{sections}.org/{i}", f"<body>{lead}<div><p>Our shop closes soon</p><ul><li>Come and buy</li></ul></div>{body}<hr></body>"))
            want[i] = "\n".join([f"Lead {i}"] * (i % 2) + [t for pair in story for t in pair])
        return rows, want

    (short, want), (long, more) = site(4), site(60)
    rows = short + [(i + 100, *rest) for i, *rest in long]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want | {i + 100: text for i, text in more.items()}


def test_deep_and_broken_pages():
    assert main_text("<div>" * 5000 + "x") == "x"
    assert main_text("<article><p>a</div></b><p>b</article") == "a\nb"
    assert main_text("<script>x") == "" and main_text("<!-- x") == ""
    assert main_text("<article>" + "".join(f"<p>{i}</p><div>{i}</div>" for i in range(500)) + "</article>").count("\n") == 999
