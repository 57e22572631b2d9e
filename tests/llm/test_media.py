import hashlib
import zlib

from framelark.llm import media


def test_equals_brute(spark, odd_docs):
    rows = odd_docs.collect()
    made = media.document_media(spark, odd_docs).collect()
    want = []
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        image = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest()))
    assert sorted((tuple(r)[:7] for r in made), key=str) == sorted(want, key=str)
    by = {}
    for r in made:
        by.setdefault(r.payload_sha256, set()).add(r.feature)
    assert all(len(v) == 1 for v in by.values())
    assert {(r.position, r.caption, r.n_texts, r.n_media) for r in made if r.doc_id == 5} == {(0, "Figure 1", 0, 2)}
    assert {(r.position, r.n_texts) for r in made if r.doc_id == 13} == {(1, 2)}
    assert all(r.aligned for r in made)


def test_interleaved_order():
    items = media.parse('<p>One <b>two</b></p><figure><img src="sha256:aa"><figcaption>Cap &amp; tion</figcaption></figure>tail<img src=bb alt="x">end')
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [
        (0, "text", "One two", None, None), (1, "media", None, "aa", "Cap & tion"), (2, "text", "tail", None, None), (3, "media", None, "bb", "x"), (4, "text", "end", None, None)]
    assert media.parse(None) == []


def test_unknown_digest_stays(spark, no_docs):
    items = spark.createDataFrame([(1, "zz")], "doc_id long, digest string")
    store = spark.createDataFrame([], media.FEATURES)
    assert media.resolve(items, store).first().payload_bytes is None
    assert media.document_media(spark, no_docs).count() == 0


def test_sequences(spark, odd_pages):
    got = media.sequences(odd_pages, "page_id").collect()
    assert len(got) == odd_pages.count()


def short(page):
    return [(i["kind"], i["text"] or i["digest"], i["caption"]) for i in media.parse(page)]


def test_captions_and_broken_markup():
    image = '<img src="sha256:aa">'
    assert short(f"<figure>{image}<figcaption>Cap</figure><p>After</p>") == [("media", "aa", "Cap"), ("text", "After", None)]
    assert short(f"<p>x</p><figure>{image}<figcaption>Left open") == [("text", "x", None), ("media", "aa", "Left open")]
    assert short(f"<figure><figcaption><p>First</p></figcaption>{image}</figure>tail") == [("media", "aa", "First"), ("text", "tail", None)]
    assert short(f"<script>var a = '<p>no</p>';</script><style>p {{}}</style><p>Yes</p>{image}") == [("text", "Yes", None), ("media", "aa", None)]
    assert short(f"<figure>{image}</figure><p>Between</p><figcaption>Stray</figcaption>") == [("media", "aa", None), ("text", "Between", None), ("text", "Stray", None)]
    assert short(f"<figure>{image}<figcaption>One</figcaption></figure><figure><figcaption>No image</figcaption></figure>") == [("media", "aa", "One"), ("text", "No image", None)]
    assert short(f'<figure>{image}<figcaption>A</figcaption><img src=bb><figcaption>B</figcaption></figure>') == [("media", "aa", "A"), ("media", "bb", "B")]


def test_pages_of_any_text(odd_texts):
    for text in [t for _, t in odd_texts] + ["<b>&amp; a < b\n\n \x1f\n&#x80; </p>", "Figure 1\nFigure 2", "\u2028x\r\ny"]:
        parts = media.paragraphs(text)
        items = media.parse(media.figure_page(parts, "aa"))
        assert media.aligned(items, parts, "aa")
        assert " ".join(i["text"] for i in items if i["kind"] == "text").split() == (text or "").split()
