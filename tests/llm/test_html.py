import random
import time

import pytest

from cloakframe.llm.html_wrapper import Automaton, Wrapper, align, doubt, extract_text, fold, infer
from tests.llm.test_llm import words


def made(n, seed=8):
    r = random.Random(seed)
    return [tuple(words(r, k) for k in (3, 20, 20, 6)) for _ in range(n)]


def test_hosts_without_article_or_main():
    page = "<html><body><div id=top><a href=/>The Daily</a></div><div class=c7><h1>%s</h1><p>%s</p><p>%s</p></div><div>Imprint and contact</div></body></html>"
    for n in (2, 3, 8):
        pages = [page % m[:3] for m in made(n)]
        w = Wrapper(infer(pages))
        assert [w.text(p) for p in pages] == ["\n".join(m[:3]) for m in made(n)]
        blind = Wrapper(None)  # without the expression the template stays
        assert all("The Daily" in blind.text(p) and "Imprint" in blind.text(p) for p in pages)


def test_names_are_a_prior():
    page = "<article><h1>%s</h1><div class=share-prices><p>%s</p></div><div id=side><p>%s <b>so</b></p></div><div class='share buttons'>%s</div><div class=comments><p>%s</p></div></article>"
    pages = [page % (*m, m[1][::-1]) for m in made(6)]
    w = Wrapper(infer(pages))
    assert [w.text(p) for p in pages] == [f"{m[0]}\n{m[1]}\n{m[2]} so" for m in made(6)]
    assert [doubt(x) for x in ("share-prices", "side", "adText", "post-comments", "sharebox", "navText2 x", "header main")] == ["", "weak", "strong", "strong", "", "strong", "weak"]


def test_nested_groups_bind_in_linear_time():
    row = "<li><a>x</a>%s%s</li>"
    pages = ["<ul>" + "".join(row % ("<i>y</i>" * (i * k % 3), "<b>z</b>" * (i % 2)) for i in range(40 + k)) + "</ul><article><p>t</p></article>" for k in range(12)]
    began = time.time()
    w = Wrapper(infer(pages))
    assert all(w.text(p) == "t" for p in pages)
    assert time.time() - began < 5
    nodes = [("+", (("?", ("a",)), ("?", (("+", (("?", ("a",)), ("?", ("b",)))),)), ("?", ("a",))))]
    machine = Automaton(nodes, [0])
    began = time.time()
    assert machine.bind(["a"] * 3000 + ["c"]) is None and len(machine.bind(["a"] * 3000 + ["b"])) == 3001
    assert time.time() - began < 5


def test_alignment_covers_both_sides():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 14))] for _ in range(2))
        nodes = align(fold(a), fold(b))
        m = Automaton(nodes, list(range(len(nodes))))
        for line in (a, b):
            places = m.bind(line)
            assert places is not None and [m.symbol[p] for p in places] == line and places == sorted(places) or "+" in repr(nodes)


def test_extract_text_of_a_table(spark):
    page = "<body><nav>menu</nav><article><h1>%s</h1><div class=zq>Buy hats</div><p>%s</p></article><script>x</script></body>"
    m = made(8)
    rows = [(i, "http://a.org/x", page % m[i][:2]) for i in range(8)]
    rows += [(8, "http://b.org/1", None), (9, "http://b.org/2", ""), (10, None, "<p>no &amp; url"), (11, "http://a.org/x", "plain"), (7, "http://a.org/x", page % m[7][:2])]
    long = " ".join(["word"] * 50_000)
    rows += [(12, "https://A.org:80/x", page % ("T", long)), (None, "http://a.org/x", page % m[0][:2])]
    t = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = sorted(((r.page_id, r.url, r.text) for r in extract_text(t).collect()), key=str)
    own = {i: f"{m[i][0]}\n{m[i][1]}" for i in range(8)}
    want = [(i, u, own[i] if i is not None and i < 8 else {8: "", 9: "", 10: "no & url", 11: "plain", 12: "T\n" + long, None: own[0]}[i]) for i, u, _ in rows]
    assert got == sorted(want, key=str)
    assert extract_text(t.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["", "<", "<p", "</p></p>", "<!-- x", "<script>alert(1)", "<a b='", "&#xD800; &bogus; x"])
def test_broken_pages(page):
    assert isinstance(Wrapper(infer([page, page + "y"])).text(page), str)
