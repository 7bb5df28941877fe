"""Preference formatting and page extraction."""

from dyadlake.llm import chat_format, html_extraction

PAGE = (
    '<html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav class=menu><a>Home</a></nav>'
    '<div class="cookie-notice">We use cookies</div><div id="content"><h2>Head &amp; line</h2><p>{}<br>more</p><div class="ad">Buy</div>'
    '<p>Second &lt;x&gt; &nbsp; y<form><input><label>q</label></form><div class="comments"><p>nice</p></div></div><aside>side</aside><footer>foot</footer></body></html>'
)


def test_pages():
    want = "Head & line\n\n{} more\n\nSecond <x> y"
    assert html_extraction.extract([PAGE.format("One")]) == [want.format("One")]
    many = [PAGE.format(f"Text {i}") for i in range(5)]
    assert html_extraction.extract(many) == [want.format(f"Text {i}") for i in range(5)]
    cut = many[4][: many[4].index("</p><div class=\"ad\"")]
    assert html_extraction.extract([*many[:4], cut])[4] == "Head & line\n\nText 4 more"
    assert html_extraction.extract([None, "", "plain", "<p>a<p>b <i>c</i>d", "<"]) == ["", "", "plain", "a\n\nb cd", "<"]


def test_template_is_one_order_of_valid_classes():
    paths = html_extraction.Paths()
    pages = [html_extraction.tokens(PAGE.format(i), paths) for i in range(3)]
    roles = html_extraction.template(pages)
    at = [[next(i for i, t in enumerate(p) if t.role == r) for r in roles] for p in pages]
    assert len(roles) > 15 and all(x == sorted(x) for x in at)


UNMARKED = (
    "<body><div class=k1>Home and About us here<ul><li>Our own shop of things</ul></div><div class=k2><h2>Title {0}</h2><p>Words {0} of the article, {1}.</p>"
    "<p>Subscribe to our weekly letter now</p><p>It ends {1}.</p></div><div class=k3>All rights are with us</div></body>"
)


def test_repetition_tells_boilerplate_without_marks():
    """A host whose boilerplate has no telling class: only the template knows."""
    got = html_extraction.extract([UNMARKED.format(i, i * 7) for i in range(6)])
    assert got == [f"Title {i}\n\nWords {i} of the article, {i * 7}.\n\nIt ends {i * 7}." for i in range(6)]
    alone = html_extraction.extract([UNMARKED.format(1, 7)])[0]
    assert alone != got[1] and "Words 1 of the article, 7." in alone and "All rights" in alone


def test_two_templates_on_one_host_and_copies():
    pages = [x for i in range(5) for x in (PAGE.format(f"Text {i}"), UNMARKED.format(i, i * 7))]
    got = html_extraction.extract(pages)
    assert all(f"Text {i} more" in got[2 * i] and "cookies" not in got[2 * i] for i in range(5))
    assert all(f"Words {i} of the article, {i * 7}." in got[2 * i + 1] for i in range(5))
    same = ["<article><p>The very same text stands here.</p><p>And a second one as well.</p><p>Part " + str(i) + "</p></article>" for i in range(6)]
    assert html_extraction.extract(same + same)[3] == "The very same text stands here.\n\nAnd a second one as well.\n\nPart 3"


def test_marks_only_break_ties():
    page = (
        '<article><p>Body {} of it.</p><div class="post-social-history"><p>History {} here.</p></div><section id="legal"><p>Legal {} matters.</p></section>'
        '<div class="search-methods"><p>We search {}.</p></div><div class="comment-list"><p>reader {}</p></div><p class="ad">buy {}<p>And <label>prose</label> on.</article>'
    )
    want = "Body {0} of it.\n\nHistory {0} here.\n\nLegal {0} matters.\n\nWe search {0}.\n\nAnd prose on."
    assert html_extraction.extract([page.format(*"a" * 6)]) == [want.format("a")]
    # on every page of the host, what is marked belongs to the template
    many = html_extraction.extract([page.format(*[i] * 6) for i in range(5)])
    assert many[2] == "Body 2 of it.\n\nAnd prose on."
    plain = "<article><p>Body {} only.</p></article>"
    one = html_extraction.extract([page.format(*"a" * 6), *[plain.format(i) for i in range(5)]])
    assert one[0] == want.format("a")


WORDY = [f"Sentence {{}} number {k} tells something of its own here." for k in range(10)]


def revised(wrap, last=10):
    """Four pages of one host; the first two are revisions of one article that differ in a block."""
    texts = [[b.format("alpha") for b in WORDY], [*[b.format("alpha") for b in WORDY[:9]], "A new end of it all."], [b.format("beta") for b in WORDY], [b.format("gamma") for b in WORDY]]
    return ["<body><div>Menu of this very site</div>" + wrap.format("".join(f"<p>{b}</p>" for b in t[:last])) + "<footer>f</footer></body>" for t in texts], ["\n\n".join(t[:last]) for t in texts]


def test_revisions_of_an_article_keep_their_text():
    for wrap in ("<article>{}</article>", "<div class=x>{}</div>"):
        pages, want = revised(wrap)
        assert html_extraction.extract(pages) == want
        assert html_extraction.extract(pages[:3]) == want[:3]
    # what all pages have is the template's all the same
    pages, want = revised("<article><p>Read more of our stories today</p>{}</article>")
    assert html_extraction.extract(pages) == want


def test_no_wrapper_leaves_a_page_empty():
    wraps = ["<form>{}</form>", "<fieldset>{}</fieldset>", "<dialog open>{}</dialog>", '<div class="menu-page">{}</div>', '<div id="share">{}</div>', '<div class="promo post">{}</div>', '<div role="banner">{}</div>', '<form><div class="ad">{}</div></form>']
    body = "<nav>Home and more links</nav><p>{0} stands here as the text of page {0}.</p><p>It goes on {0} for a while and ends.</p>"
    for wrap in wraps:
        pages = ["<body>" + wrap.format(body.format(f"word{i}")) + "</body>" for i in range(5)]
        want = [f"word{i} stands here as the text of page word{i}.\n\nIt goes on word{i} for a while and ends." for i in range(5)]
        assert html_extraction.extract(pages) == want and html_extraction.extract(pages[:1]) == want[:1]
    assert html_extraction.extract(["<body><nav>Only a menu</nav></body>"]) == ["Only a menu"]
    assert html_extraction.extract(["<body><script>x</script></body>"]) == [""]


def test_neither_order_nor_partitions_change_a_text(spark, monkeypatch):
    monkeypatch.setattr(html_extraction, "BATCH", 8)
    monkeypatch.setattr(html_extraction, "DEALT", 40)
    pages = [(i, "https://h.example/" + str(i), f"<body><p>Unique words {i} of page {i} stand here.</p>" + ("<p>This line is on some of them.</p>" if i % 20 < 9 else "") + "</body>") for i in range(120)]
    pages += [(1000 + i, "https://h.example/copy", pages[0][2]) for i in range(30)] + [(None, None, None)]
    schema = "page_id long, url string, html string"
    rows = lambda d: sorted(map(str, html_extraction.main_texts(d).collect()))
    want = rows(spark.createDataFrame(pages, schema).repartition(2))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(spark.createDataFrame(pages[::-1], schema).repartition(5)) == want and len(want) == 151
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_classes_are_those_of_plain_occurrence_vectors():
    """The template's tokens are unions of whole classes of equal vectors, computed plainly."""
    paths = html_extraction.Paths()
    pages = [html_extraction.tokens(PAGE.format(f"Text {i}") if i % 3 else PAGE.format(f"Text {i}").replace("<aside>side</aside>", ""), paths) for i in range(7)]
    vectors = {}
    for i, page in enumerate(pages):
        for t in page:
            if t.role is not None:
                vectors.setdefault(t.role, [0] * 7)[i] += 1
    roles = set(html_extraction.template(pages))
    assert {r: [v.get(i, 0) for i in range(7)] for r, v in html_extraction.occurrences(pages).items()} == vectors
    for v in {tuple(vectors[r]) for r in roles}:
        assert max(v) == 1 and 2 * sum(v) >= 7 and {r for r, x in vectors.items() if tuple(x) == v} <= roles
    assert len({tuple(vectors[r]) for r in roles}) == 2  # of all pages, and of those with the aside


def test_attributes_by_the_states_of_the_standard():
    cases = {
        "<p title=it's>Hello world, don't go</p>": "Hello world, don't go",
        '<p>a <img alt="x> b</p>': "a b",
        "<p>a <b title = 'x > y' data-q=\"<i>\">b</b></p>": "a b",
        "<p a='1'b=\"2\"/c>text</p><p>cut <img src=": "text\n\ncut",
        "<p>2 < 3 &amp; &#x34; > 1</p>": "2 < 3 & 4 > 1",
    }
    for page, want in cases.items():
        assert html_extraction.extract([page]) == [want]


def test_nesting_costs_linear_time():
    import time

    began = time.time()
    assert html_extraction.extract(["<div>" * 50_000 + "text here"]) == ["text here"]
    assert html_extraction.extract(["<div><nav>" * 20_000 + "</nav>" * 20_000 + "<p>out</p>"] * 3)[0] in ("", "out")
    assert time.time() - began < 20


def test_page_table(spark):
    rows = [(1, "http://a.b/x", PAGE.format("P"), "x"), (1, "http://a.b/x", PAGE.format("P"), "x"), (2, None, None, "x"), (None, "bad url", "<article><p>" + "word " * 90000, "x")]
    rows += [(10 + i, "http://a.b/y", PAGE.format(i), "x") for i in range(90)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = html_extraction.main_texts(d).collect()
    assert len(got) == 94 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["text"].startswith("Head & line") for r in got) == 92
    assert html_extraction.main_texts(d.limit(0)).count() == 0


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "pair_id long, turn int, role string, text string, side string")


def test_pairs_share_one_prompt(spark):
    chosen = turns(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (2, 0, "user", "q"), (3, 0, None, None), (3, 1, "assistant", "x")])
    rejected = turns(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "bad!"), (2, 0, "user", "q"), (2, 1, "assistant", "tail"), (3, 0, None, None), (3, 1, "assistant", "x")])
    got = {r["pair_id"]: r for r in chat_format.format_preferences(chat_format.both_sides(chosen, rejected)).collect()}
    one = got[1]
    assert one["n_common"] == 1 and one["prompt"] == "<|user|>\nq<|end|>\n"
    assert one["chosen"] == "<|assistant|>\ngood<|end|>\n<|user|>\nmore<|end|>\n" and one["rejected"] == "<|assistant|>\nbad!<|end|>\n"
    start, size = map(int, one["chosen_mask"].split(":"))
    assert one["chosen"][start : start + size] == "good<|end|>\n" and one["chosen_mask"] == one["rejected_mask"]
    assert got[2]["n_common"] == 1 and got[2]["chosen"] == "" and got[2]["rejected_mask"] == "14:12"
    assert got[3]["n_common"] == 2 and got[3]["chosen"] == got[3]["rejected"] == "" and got[3]["prompt"].startswith("<|unknown|>\n<|end|>\n")
    assert chat_format.format_preferences(chat_format.both_sides(chosen.limit(0), rejected.limit(0))).count() == 0


def test_contrast(spark):
    d = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "r"), (1, 3, "assistant", "last"), (1, 4, "user", "bye"), (2, 0, "user", "only")], "conv_id long, turn int, role string, text string")
    got = chat_format.format_preferences(chat_format.contrast(d)).collect()
    assert len(got) == 1 and "last" in got[0]["chosen"] and "first" in got[0]["rejected"] and got[0]["n_common"] == 3


def test_conversations_with_nulls_ties_and_long_turns(spark):
    long = "word " * 50_000
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a")]  # no id: one pair without id
    rows += [(7, None, "assistant", "only")]  # a null turn stands first
    rows += [(8, 0, "user", "x"), (8, 0, "user", "x"), (8, 1, "assistant", long), (8, 1, "assistant", long)]
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn int, role string, text string, last string, pos int")
    got = {r["pair_id"]: r for r in chat_format.format_preferences(chat_format.contrast(d)).collect()}
    assert set(got) == {None, 7, 8}
    assert got[None]["prompt"].endswith("q<|end|>\n") and "a<|end|>" in got[None]["chosen"] and "q<|end|>" in got[None]["rejected"]
    assert got[7]["prompt"] == "" and got[7]["chosen"] == "<|assistant|>\nonly<|end|>\n"
    assert got[8]["n_common"] == 2 and got[8]["chosen"].count(long) == 2
