import random

from framelark.llm import main_text as mt

ARTICLE = ["Title of it", "First & <paragraph> with some more words in it.", "Second paragraph, which has quite a few words as well, and then some.", "Short."]
BODY = "<h1>Title of it</h1><p>First &amp; &lt;paragraph&gt;\n with  some more <b>words</b> in&nbsp;it.<p>Second paragraph, which has quite a few words as well, <a href=x>and</a> then some.</p><p>Short.</p>"
NOISE = '<script>var t="</p>";</script><style>p{}</style><!-- note --><div class="ad">An advert with a lot of text in it, really a lot of text.</div><form><input>Search form text</form>'
AROUND = (
    '<!DOCTYPE html><html><head><title>Other</title></head><body><header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav>'
    '<aside class="sidebar"><p>Sidebar text that goes on and on for a while, to be dropped.</p></aside><div id="cookie-notice">We use cookies, please accept all of them now.</div>{}'
    '<section class="comments"><p>A reader says that this was a long and interesting article to read.</p></section><footer>&copy; site footer</footer></body></html>'
)


def test_marked_and_unmarked():
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<div>{}</div>", '<div role="main">{}</div>'):
        page = AROUND.format(wrap.format(BODY.replace("<p>Short", NOISE + "<p>Short")))
        assert mt.extract(page) == "\n\n".join(ARTICLE), wrap


def test_comments_within_article():
    page = f"<article><header><h1>T</h1></header><p>Text of the article.</p><div class='comment-list'><p>Reader comment</p></div></article>"
    assert mt.extract(page) == "T\n\nText of the article."


def test_all_stretches():
    links = "".join(f"<li><a href=/{i}>Chapter {i}</a></li>" for i in range(4))
    page = AROUND.format(f"<div><h1>Title of it</h1><p>An introduction of some length.</p><ul>{links}</ul><h2><a href=#1>Part one</a></h2><p>The longer part that follows the contents of the article.</p><p>Its end.</p></div>")
    assert mt.extract(page) == "Title of it\n\nAn introduction of some length.\n\nPart one\n\nThe longer part that follows the contents of the article.\n\nIts end."


def test_windows_in_marked_article():
    links = "".join(f"<li><a href=/{i}>Chapter {i}</a></li>" for i in range(4))
    parts = f"<h1>Title</h1><p>{'Many words of the first part. ' * 40}</p><p><a href=x>One link</a></p><p>Joined to it.</p><ul>{links}</ul><p>Short end.</p><ul>{links}</ul>"
    want = ["Title", ("Many words of the first part. " * 40).strip(), "One link", "Joined to it.", "Short end."]
    for wrap in ("<article>{}</article>", "<main>{}</main>", '<div role="main">{}</div>'):
        assert mt.extract(AROUND.format(wrap.format(parts))) == "\n\n".join(want), wrap
    assert mt.extract(f"<p>Text outside.</p><article><ul>{links}</ul></article>") == ""
    for link in ("<a name=top>", "<a href=x>"):  # left unclosed
        assert mt.extract(f"{link}<article><p>{link}One</p><p>Two</p><p>Three</p><p>Four</p></article>").endswith("Two\n\nThree\n\nFour"), link


def test_broken_markup():
    assert mt.extract("<nav><a href=x>menu<article><p>Real text</article><p>after") == "Real text"
    assert mt.extract("<article><p>One</div><p>Two") == "One\n\nTwo"
    assert mt.extract("<p>cut off <a href='x") == "cut off"
    assert mt.extract("<p title=don't>x<b>y</p><script>var a='</p>';") == "xy"
    assert mt.extract("a < b and c > d") == "a < b and c > d"
    assert mt.extract(None) == mt.extract("") == mt.extract("<p> </p>") == ""


def test_frame(odd_pages, no_pages):
    got = mt.main_text(odd_pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = {r.page_id: r for r in got.collect()}
    assert rows[1].text == "T\n\nHello & bye" and rows[3].text == rows[4].text == "" and rows[6].n_chars == len(("long text " * 20000).strip())
    assert got.count() == odd_pages.count() and mt.main_text(no_pages).count() == 0


def brute_stretches(found, marked):
    """Surge and dive by double loops over all windows."""
    stripped = [(i, line) for i, line in enumerate(found) if line.kept]
    total = {}
    for k in range(len(stripped)):
        total[k] = 0
        for j in range(k - 1, k + 2):
            if 0 <= j < len(stripped):
                total[k] += stripped[j][1].weight
    least = 0 if marked else 0.12 * max(total.values(), default=0)
    member = [False] * len(stripped)
    for k, (_, line) in enumerate(stripped):
        if not line.weight or total[k] < least:
            continue
        member[k] = True
        for way in (-1, 1):  # joined text before the surge; up to the dive after it
            j = k + way
            while 0 <= j < len(stripped) and (stripped[j][1].weight if way < 0 else total[j] > 0):
                member[j] = True
                j += way
    made, k = [], 0
    while k < len(stripped):
        if not member[k]:
            k += 1
            continue
        first = k
        while k < len(stripped) and member[k]:
            k += 1
        last = k - 1
        while not stripped[last][1].weight:
            last -= 1
        bound = made[-1][2] if made else 0
        while first > bound and stripped[first - 1][1].heading:
            first -= 1
        made.append((stripped[first][0], stripped[last][0] + 1, last + 1))
    return [m[:2] for m in made]


def test_windows_against_brute_force():
    r = random.Random(8)
    windows = 0
    for _ in range(3000):
        found = [mt.Line("x", r.choice((0, 0, 0, 1, 5, 40, 300)), r.random() < 0.9, r.random() < 0.15) for _ in range(r.randrange(0, 25))]
        marked = r.random() < 0.5
        windows += sum(line.kept for line in found)
        assert mt.stretches(found, marked) == brute_stretches(found, marked), (found, marked)
    assert windows > 20_000


def test_every_page_goes_through_the_windows(monkeypatch, odd_pages):
    seen = []
    keep = mt.stretches
    monkeypatch.setattr(mt, "stretches", lambda found, marked: seen.append(marked) or keep(found, marked))
    pages = [r.html for r in odd_pages.collect()]
    for page in pages:
        mt.extract(page)
    assert len(seen) == len(pages) and True in seen and False in seen
