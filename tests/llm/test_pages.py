"""Main text: what a host repeats inside articles goes, equal pages do not make a template."""

from tracelake.llm import pages


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return sorted((r.page_id, r.text) for r in pages.main_text(df).collect())


def test_repeats_inside_articles_go(spark):
    body = lambda i: f"<body><article><h1>Story {i}</h1><p>{'More. ' * i}told {i}</p><div>Subscribe to our letter</div><p>the end of {i}</p><p>Follow us</p></article></body>"
    got = extracted(spark, [(i, f"http://h.example/{i}", body(i)) for i in range(6)])
    assert got == [(i, f"Story {i}\n{'More. ' * i}told {i}\nthe end of {i}") for i in range(6)]


def test_equal_pages_are_no_template(spark):
    page = "<body><article><h1>Story</h1><p>told once</p></article></body>"
    assert extracted(spark, [(i, f"http://h.example/{i}", page) for i in range(5)]) == [(i, "Story\ntold once") for i in range(5)]


def test_names_drop_whole_tokens_only(spark):
    kept = ["<div class='has-sidebar'><p>text</p></div>", "<div class='no-sidebar'><article><p>text</p></article></div>", "<article class='post comments-open'><p>text</p></article>", "<p>a <a href=/x>text of a long link</a></p>"]
    kept += [f"<article><h2 id='{x}'>text</h2></article>" for x in ("related-work", "search", "social-history", "notice-period")]
    gone = [f"<p>kept</p><div class='{x}'>text</div>" for x in ("ad", "main-nav", "comment-list", "box sidebar", "siteFooter")] + ["<p>kept</p><article class='comment'>text</article>"]
    got = dict(extracted(spark, [(i, f"http://h{i}.example/", f"<body>{html}</body>") for i, html in enumerate(kept + gone)]))
    assert all("text" in got[i] for i in range(len(kept))), got
    assert all(got[len(kept) + i] == "kept" for i in range(len(gone))), got


def test_links_go_where_their_element_is_template(spark):
    body = lambda i: f"<body><ul><li><a href=/{i}>Section {i} link</a></li></ul><div>" + "".join(f"<p>told {i} {k}</p>" for k in range(i + 1)) + "</div></body>"
    got = extracted(spark, [(i, "http://h.example/", body(i)) for i in range(5)])
    assert got == [(i, "\n".join(f"told {i} {k}" for k in range(i + 1))) for i in range(5)]


def test_broken_markup_loses_no_text():
    assert pages.article('<p>See <a href="x>link here and more</a> tail</p>', set()) == "See link here and more tail"
    assert pages.article("<p>one</p><div/><p>two</p><a href=x/>three</a><p>four <b", set()) == "one\ntwo\nthree\nfour"
    assert pages.article("<p>it's <i title='a > b'>fine</i> & so</p>", set()) == "it's fine & so"
    assert pages.article("a < b and <p>c</p>", set()) == "a < b and\nc"


SITES = {
    # a host's boilerplate without any telling tag or class, around and inside what varies
    "plain.example": lambda i, story: f"<body><div>Site of the plain</div><div><a href=/a>Top {i}</a> <a href=/b>News of {i}</a></div><div><div>{story}</div><div>Write to us</div></div><div>Made by hand</div></body>",
    "table.example": lambda i, story: f"<body><table><tr><td>Home</td><td><table><tr><td>{story}</td></tr></table></td></tr><tr><td>All about tables</td></tr></table></body>",
    "tagged.example": lambda i, story: f"<body><nav><a href=/>x{i}</a></nav><div class=ad>buy {i} now</div><main>{story}<p>Share this story</p></main><footer>&copy; {i}</footer></body>",
}


def sites(n=12):
    rows, truth = [], {}
    for k, (host, page) in enumerate(SITES.items()):
        for i in range(n):
            lines = [f"{host} tells story {i} line {j} with words that are its own {i * j}" for j in range(2 + i % 4)]
            rows.append((100 * k + i, f"http://{host}/{i}", page(i, "".join(f"<p>{x}</p>" for x in lines))))
            truth[100 * k + i] = lines
    return rows, truth


def test_precision_and_recall_on_several_hosts(spark):
    rows, truth = sites()
    got = dict(extracted(spark, rows))
    hit = sum(x in truth[i] for i, t in got.items() for x in t.split("\n"))
    assert hit / sum(len(t.split("\n")) for t in got.values()) >= 0.95 and hit / sum(map(len, truth.values())) >= 0.95
    # it is the template that does it
    bare = {i: pages.article(html, set()).split("\n") for i, _, html in rows}
    assert sum(x not in truth[i] for i, t in bare.items() for x in t) > 3 * len(rows) // 2


def test_classes_equal_brute_force(spark):
    rows, _ = sites()
    rows += [(900 + i, "http://mixed.example/", f"<body><div>a</div><p>{'<b>x</b>' * (i % 2)}</p>{'<i>s</i><u>t</u>' if i % 2 else '<u>t</u><i>s</i>'}<p>own {i}</p></body>") for i in range(8)]
    got = {r.host: set(r.template) for r in pages.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    by_host = {}
    for _, url, html in rows:
        by_host.setdefault(url.split("/")[2], []).append(pages.parse(html))
    for host, all_events in by_host.items():
        seqs = [pages.tokens_of(e) for e in all_events]
        vectors = {t: tuple(s.count(t) for s in seqs) for s in seqs for t in s}
        classes = {}
        for t, v in vectors.items():
            if sum(map(bool, v)) >= max(3, len(seqs) / 2):
                classes.setdefault(v, set()).add(t)
        classes = {v: c for v, c in classes.items() if len(c) > 1}
        root = max((c for v, c in classes.items() if max(v) == 1), key=len)
        want = set()
        for v, c in classes.items():
            looks = set()
            for s in (s for s in seqs if c & set(s)):
                at = [i for i, t in enumerate(s) if t in c]
                turns = [tuple(s[i] for i in at[k : k + len(c)]) for k in range(0, len(at), len(c))]
                gap = {sum(t in root for t in s[: i + 1]) for i in at} if c is not root else {0}
                looks.add((turns[0], len(set(turns)) == 1 and set(turns[0]) == c, gap.pop() if len(gap) == 1 else -1))
            if len(looks) == 1 and (look := looks.pop())[1] and look[2] >= 0:
                want |= c
        assert got.get(host, set()) == want, host


def test_clashing_columns_and_long_pages(spark):
    page = "<body><article>" + "<p>long line of a page</p>" * 30_000 + "</article></body>"
    df = spark.createDataFrame([(1, "http://h.example/", page, "x", 3)], "page_id long, url string, html string, host string, key long")
    assert [r.n_chars for r in pages.main_text(df).collect()] == [30_000 * len("long line of a page") + 29_999]


def words(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_titles_leads_and_recurring_headings_stay(spark):
    inside = lambda i: f"<article><h1>Title {i}</h1><p class=lead>Lead of {i}</p><div class=body><h2>Introduction</h2><p>{words(i, 60 + i)}</p><h2>Conclusion</h2><p>end {i}</p></div></article>"
    outside = lambda i: f"<div class=page><h1>Title {i}</h1><p class=lead>Lead of {i}</p><div class=body><h2>Introduction</h2><p>{words(i, 60 + i)}</p><h2>Conclusion</h2><p>end {i}</p></div></div><div>Hand made, number {i}</div>"
    want = [(i, f"Title {i}\nLead of {i}\nIntroduction\n{words(i, 60 + i)}\nConclusion\nend {i}") for i in range(6)]
    for body in (inside, outside):
        assert extracted(spark, [(i, f"http://h.example/{i}", f"<html><body>{body(i)}</body></html>") for i in range(6)]) == want


def test_places_of_plain_containers_make_the_template(spark):
    """No tag or name tells menu, advert, article and footer apart, and each differs on every page: the method alone decides."""
    body = lambda i: f"<div><ul><li><a href=/a>{words(i, 1)}</a></li><li><a href=/b>more {i}</a></li></ul></div><div>Buy {words(100 + i, 4)}</div><div><h1>Story {i}</h1>" + "".join(f"<p>{words(200 + i + 50 * k, 20 + k)}</p>" for k in range(3 + i % 3)) + f"</div><div>&copy; by {words(900 + i, 3)}</div>"
    rows = [(i, f"http://h.example/{i}", f"<html><body>{body(i)}</body></html>") for i in range(8)]
    want = [(i, "\n".join([f"Story {i}", *(words(200 + i + 50 * k, 20 + k) for k in range(3 + i % 3))])) for i in range(8)]
    assert extracted(spark, rows) == want
    emptied = [(i, pages.article(html, set())) for i, _, html in rows]
    assert all(len(text) > len(w) for (_, text), (_, w) in zip(emptied, want))  # without classes nothing parts the article from the rest
