"""URL filter, chat formatting, page text and licence scans on small tables."""

import math

import pytest

from annospark.llm import chat, html_extract, licenses, url_filter
from annospark.llm.queries import URL_RULES


def test_rules_and_hosts(spark, make_docs):
    urls = ["http://A.Net/x", "https://m.example.net/en/1?q", "http://example.com/de/", "http://x.org/fr/a#b", "http://net",
            "no scheme", None, "http://notexample.com/de/1", "http://example.com?de/", "http://example.net/en/1"]
    docs = make_docs(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(docs, URL_RULES).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block")
    assert got[1] == ("m.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][2] == "example.com/de/" and got[3] == ("x.org", "/fr/a", "org/fr/", "allow")
    assert got[4] == ("net", "", None, got[4][3]) and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None)
    assert got[7][2] is None and got[8][:3] == ("example.com", "", None)
    assert {v[3] for v in got.values()} <= {"allow", "block"} and len(got) == len(urls)
    assert url_filter.judge(docs.limit(0), URL_RULES).count() == 0


def test_model_equals_loop(spark, make_docs):
    good, bad = ["aab", "abab", "abb"], ["zzy", "yz", "bzz"]
    make_docs([])
    ruled = spark.createDataFrame([(u, u in good) for u in good + bad], "url string, accepted boolean")
    asked = spark.createDataFrame([("abz",), ("zzz",), ("q",)], "url string")
    got = {r.url: r.ratio for r in url_filter.log_ratios(asked, url_filter.model(ruled, url_filter.windows(asked))).collect()}

    def log_p(corpus, text):
        marked = [url_filter.START * url_filter.ORDER + u + url_filter.END for u in corpus]
        t = url_filter.START * url_filter.ORDER + text + url_filter.END
        total = 0.0
        for at in range(url_filter.ORDER, len(t)):
            p = 1 / url_filter.ALPHABET
            for k in range(url_filter.ORDER + 1):
                h = t[at - k:at]
                after = [m[j] for m in marked for j in range(url_filter.ORDER, len(m)) if m[j - k:j] == h]
                if after:
                    p = (after.count(t[at]) + len(set(after)) * p) / (len(after) + len(set(after)))
            total += math.log(p)
        return total / (len(t) - url_filter.ORDER)
    for u, r in got.items():
        assert abs(r - (log_p(good, u) - log_p(bad, u))) < 1e-6
    assert got["abz"] > got["zzz"]


def test_separates_spam(spark, make_docs):
    rows = [(k, f"http://shop{k % 7}.net/buy/{k}") for k in range(60)] + \
           [(100 + k, f"http://news{k % 7}.example.net/en/story/{k}") for k in range(60)] + \
           [(300, "http://shop9.com/buy/77"), (301, "http://news9.com/story/8")]
    got = {r.page_id: r.verdict for r in url_filter.judge(make_docs(rows, "page_id long, url string"), URL_RULES).collect()}
    assert got[300] == "block" and got[301] == "allow"


def test_chat_round_trip(spark, make_docs):
    turns = [(1, 0, "user", r"a \### Assistant: </turn>" + "\n"), (1, 1, "assistant", r"\b \l # < \\"), (1, 2, "user", None),
             (2, 0, "system", "s"), (3, 0, "assistant", "x"), (3, 1, "assistant", ""), (3, 1, "assistant", ""),
             (None, None, None, "t"), (4, 1, "we:ird</turn>", "y")]
    df = make_docs(turns, "conv_id long, turn long, role string, text string")
    examples = chat.format_examples(df)
    read = {r.conv_id: r for r in chat.read_examples(examples).collect()}
    for c in (1, 2, 3, 4, None):
        want = [(r or "", t or "") for i, _, r, t in turns if i == c]
        assert [(t.role, t.text) for t in read[c].turns] == want
        assert read[c].trained == [t for r, t in want if r == "assistant"]
    rows = examples.where("conv_id = 3").orderBy("example").collect()
    assert [r.kind for r in rows] == ["reply"] * 3 and rows[1].prompt.startswith(rows[0].prompt + rows[0].target + rows[0].closing)
    assert chat.format_examples(df.limit(0)).count() == 0


def test_page_blocks():
    page = ("<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><p>menu</p></nav>"
            "<article><h1>Ti&amp;tle</h1><p>One <b>bold</b>\n  two<p>Three<br>four<!-- <p>x</p> --><form><p>f</p></form>"
            "<div class='user comments'><p>c</p></div><aside>s</aside><ul><li>a<li>b</ul>tail &#233;</article><footer>f")
    blocks = [t for _, t, noise in html_extract.read_page(page)[0] if not noise]
    assert blocks == ["Ti&tle", "One bold two", "Three four", "a", "b", "tail é"]
    assert html_extract.read_page(None)[0] == html_extract.read_page("")[0] == []


@pytest.mark.parametrize("chars", [html_extract.BROADCAST_CHARS, -1])  # -1: the join by a shuffle
def test_site_tree_drops_repeated_branches(make_docs, monkeypatch, chars):
    monkeypatch.setattr(html_extract, "BROADCAST_CHARS", chars)
    rows = [(k, f"http://h.org/{k}", f"<body><div class=top>Welcome to the site</div><p>Story {k} of its own</p>"
                                     "<div class=low><p>All rights reserved</p></div></body>") for k in range(12)]
    rows += [(50, None, None), (51, "http://other.org", "<div class=top>Only here</div>")]
    got = {r.page_id: r for r in html_extract.extract_main_text(make_docs(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].text == f"Story {k} of its own" and got[k].n_chars == len(got[k].text) for k in range(12))
    assert got[50].text == "" and got[51].text == "Only here"


def test_copies_count_once(make_docs):
    def page(title, text):
        return f"<body><div class=top>Welcome to the site</div><h1>{title}</h1><p>{text}</p></body>"
    rows = [(k, f"http://two.org/{k}", page(f"Title {k % 2}", f"Article {k % 2}")) for k in range(10)]
    rows += [(100 + k, f"http://many.org/{k}", page("Copied", "The same article")) for k in range(1000)]
    rows += [(2000 + k, f"http://many.org/u{k}", page(f"Own {k}", f"Unique {k}")) for k in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(make_docs(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].endswith(f"Title {k % 2}\n\nArticle {k % 2}") for k in range(10))
    assert all(got[100 + k] == "Copied\n\nThe same article" for k in range(1000))
    assert all(got[2000 + k] == f"Own {k}\n\nUnique {k}" for k in range(12))


def test_branches_with_important_styles_stay(make_docs):
    rows = [(k, f"http://h.org/{k}", f"<body>Skip to content<div class=content>By the editors<h2>Head {k}</h2><p>Story {k}</p></div>"
                                     "<div class=low>All rights<p>reserved</p>" + "<h6>rare</h6>" * (k < 3) + "</div></body>")
            for k in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(make_docs(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Head {k}\n\nStory {k}" for k in range(12)}


def test_importance_is_the_mean_entropy(spark, make_docs):
    rows = [(k, "http://h.org", f"<p class=a>{'same' if k % 2 else k}</p>" + "<div><b>x</b></div>" * (k % 3)) for k in range(9)]
    pages = make_docs(rows, "page_id long, host string, html string")
    got = {r.style: r for r in html_extract.importance(pages).collect()}
    a, div = got["/p.a"], got["/div"]
    # four pages share a text, five have their own; no page has children there
    assert a.n_pages == 9 and abs(a.content - (1 - 4 * math.log(4) / math.log(9) / 9)) < 1e-9 and abs(a.presentation) < 1e-9
    # three pages have one such element, three have two, each with the same text
    assert div.n_pages == 6 and abs(div.content) < 1e-9 and abs(div.presentation - math.log(2) / math.log(6)) < 1e-9
    assert abs(a.importance - (1 - (1 - a.presentation / 2) * (1 - a.content))) < 1e-9


def test_licences(spark, make_docs):
    make_docs([])
    files = [("a/LICENSE", "Some words.\nReleased under the MIT License."), ("a/b/c/x.py", "code of the thing"),
             ("a/b/y.py", "# This work is licensed under the GNU General Public License, version 3.\nmore words"),
             ("z/w.py", "no statement, only the words of the day"), (None, "Licensed under CC BY-NC 4.0."), ("a/n.txt", None),
             ("a/b/COPYING", "nothing known in here"), ("a/b/c/x.py", "code of the thing"), ("LICENCE.md", "Licensed under CC BY 4.0."),
             ("q/long.txt", "word " * 20000 + "\nLicensed under the Apache License, Version 2.0.\n" + "word " * 500)]
    files += [(f"z/f{k}", f"the and of this to in work under {k} version public general") for k in range(40)]
    df = spark.createDataFrame(files, "path string, text string").selectExpr("*", "1 AS th", "2 AS license")
    got = licenses.scan(df).collect()
    assert len(got) == len(files)
    by = {r.path: (r.license, r.stated, r.license_path) for r in got}
    assert by["a/LICENSE"] == ("MIT", True, None) and by["a/b/c/x.py"] == ("MIT", False, "a/LICENSE")
    assert by["a/b/y.py"] == ("GPL-3.0", True, None) and by["z/w.py"] == ("CC-BY-4.0", False, "LICENCE.md")
    assert by[None] == ("CC-BY-NC-4.0", True, None) and by["a/n.txt"][0] == "MIT" and by["q/long.txt"][:2] == ("Apache-2.0", True)
    assert by["z/f3"][1] is False
    assert licenses.scan(df.limit(0)).count() == 0


def test_wrapped_headers_and_whole_licences(spark, make_docs):
    import textwrap
    make_docs([])
    by_name = dict(licenses.LICENCE_TEXTS)
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and t.endswith("conditions:"))
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and t.startswith("This program"))
    bsd = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and t.endswith("met:"))

    def header(text, mark, width=60):
        return "\n".join(["/*", f"{mark}name.c - does a thing", *[mark + x for x in textwrap.wrap(text, width)], mark, mark + "Next.", "*/", "code"])
    owner = "Copyright (c) 2020 Some Body\n\n"
    files = [("a/m.c", header(mit, " * ")), ("a/g.py", header(gpl, "# ")), ("a/b.js", header(bsd, "// ", 72)),
             ("m/LICENSE", "MIT License\n\n" + owner + textwrap.fill(by_name["MIT"].split("(c) ")[1], 78)),
             ("b/LICENSE", owner + textwrap.fill(by_name["BSD-2-Clause"], 78)),
             ("n/none.txt", "words\n\n\n" + "\n".join("a line of software and of other things" for _ in range(50))), ("e/x", "")]
    files += [(f"z/f{k}", f"the and of this to in work under {k} version public general software") for k in range(40)]
    df = spark.createDataFrame(files, "path string, text string")
    got = {r.path: (r.license, r.stated) for r in licenses.scan(df).collect()}
    assert [got[p][0] for p in ("a/m.c", "a/g.py", "a/b.js", "m/LICENSE", "b/LICENSE", "n/none.txt")] == \
        ["MIT", "GPL-3.0", "BSD-3-Clause", "MIT", "BSD-2-Clause", None]


def test_kinds_inside_articles():
    page = ("<body><article><header><h1>Title</h1></header><div class='post-header'><h2>Sub</h2></div><p class='notice-board'>Board</p>"
            "<p>Text</p><div class='cookie-banner'>c</div><div id='comment-17'>r</div><footer>f</footer></article>"
            "<div class='site-header'>h</div><header>h</header></body>")
    assert [t for _, t, kind in html_extract.read_page(page)[0] if not kind] == ["Title", "Sub", "Board", "Text"]


def _tree_by_loops(pages):
    """Texts of one host's pages by the style tree, with plain loops."""
    E = html_extract
    read = [E.read_page(p) for p in pages]
    seen, trees = set(), []
    for blocks, children in read:
        blocks = [(s, t) for s, t, kind in blocks if kind != E.NEVER]
        if tuple(t for _, t in blocks) not in seen:
            seen.add(tuple(t for _, t in blocks))
            trees.append((blocks, children))
    styles = {a for blocks, _ in trees for s, _ in blocks for a in E.above(s) or [s]}
    under = lambda s, top: s == top or s.startswith(top + "/")
    has = {s: [k for k, (blocks, _) in enumerate(trees) if any(under(b, s) for b, _ in blocks)] for s in styles}
    entropy = lambda ns, n: -sum(c / sum(ns) * math.log(c / sum(ns)) for c in ns) / math.log(max(n, 2))
    value, weight = {}, {}
    for s in styles:
        n, texts, looks = len(has[s]), {}, {}
        for k in has[s]:
            blocks, children = trees[k]
            look = (tuple(children.get(s, [])), sum(len(t.split()) for b, t in blocks if b == s).bit_length())
            looks[look] = looks.get(look, 0) + 1
            for t in {t for b, t in blocks if b == s}:
                texts[t] = texts.get(t, 0) + 1
        spread = lambda c: math.log(c) / math.log(max(n, 2))
        content = 1 - sum(c * spread(c) for c in texts.values()) / sum(texts.values()) if texts else None
        if texts:
            value[s] = 1 - (1 - entropy(looks.values(), n) / 2) * (1 - content)
        weight[s] = sum(len(t.split()) * c * (1 - spread(c)) for t, c in texts.items())
    branch = {s: sum(w for t, w in weight.items() if under(t, s)) for s in styles}
    whole = sum(weight.values())
    elements = {s: sum(len(trees[k][1].get(s, [])) for k in has[s]) / len(has[s]) for s in styles}
    enough = lambda s: len(has[s]) >= E.LEAST_PAGES
    mains = [s for s in styles if enough(s) and elements[s] < 1.05 and branch[s] > whole / 2 and weight[s] < branch[s] / 2]
    inner = max(mains, key=len, default=None)
    parents = {m.rsplit("/", 1)[0] for m in mains}
    own = {s for s in value if enough(s) and value[s] < E.LEAST_IMPORTANCE}
    all_low = {s for s in own if all(value[t] < E.LEAST_IMPORTANCE for t in value if under(t, s))}
    beside = {s for s in styles if enough(s) and branch[s] < whole * E.LEAST_SHARE and s.rsplit("/", 1)[0] in parents
              and s.rsplit("/", 1)[1].split(".")[0] not in ("h1", "h2", "h3", "h4", "h5", "h6")}
    out = []
    for blocks, _ in read:
        blocks = [(s, t) for s, t, kind in blocks if not kind]
        gone = all_low | (beside if inner and any(under(s, inner) for s, _ in blocks) else set())
        out.append("\n\n".join(t for s, t in blocks if s not in own and not any(under(s, g) for g in gone)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_style_tree_equals_loops(make_docs, seed):
    import random

    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    say = lambda low, high: " ".join(r.choice(words) for _ in range(r.randint(low, high)))

    def page(k):
        menu = "".join(f"<li><a href=/{k}>{say(1, 1)}</a></li>" for _ in range(r.randint(3, 5)))
        body = "".join(f"<p>{say(10, 80)}</p>" for _ in range(r.randint(1, 6)))
        title, lead, low = f"<h1>{say(3, 6)}</h1>", "<p>By the same desk</p>", "<div class=z2>All rights</div>"
        own = f"<div class=z3><h1>{say(2, 4)}</h1>{lead}{body}{low}</div>" if k % 9 else f"<section>{body}</section>"
        return f"<body><ul class=z1>{menu}</ul><div class=z4>{say(4, 9)}</div>{title}{own}<div class=z5><p>{say(3, 6)}</p></div></body>"
    pages = [page(k) for k in range(40)]
    pages += pages[:3] * 5
    got = html_extract.extract_main_text(make_docs([(k, "http://h.org/a", p) for k, p in enumerate(pages)],
                                                   "page_id long, url string, html string")).collect()
    want = _tree_by_loops(pages)
    assert {x.page_id: x.text for x in got} == dict(enumerate(want))
    # menus, adverts and footers of texts of their own are gone without any list, the articles whole
    for p, text in zip(pages, want):
        if "z3" in p:
            kept = [t for s, t, _ in html_extract.read_page(p)[0] if "h1" in s or "/div.z3/p" in s]
            assert text == "\n\n".join(t for t in kept if t != "By the same desk") or text == "\n\n".join(kept)
