"""Media columns: documents whose texts and media are interleaved.

A document with media is HTML: paragraphs of text and figures whose ``img``
names its payload by digest.  ``sequences`` parses it into an ordered array of
structs (position, kind, text, digest, caption): text and media keep the order
of the page and a caption stays on its media item.  Payloads live in a store,
a table of (digest, media) in the shared folder; ``resolve`` joins the media
items to it by digest, each with its position, so that what comes back lines up
with the sequence again.

``document_media`` makes such pages of documents: the text's own lines are its
paragraphs, a figure of the payload follows the first of them and another one ends
the page, each captioned with the number of its place.  The page is parsed as any
other; ``aligned`` tells whether texts, media and captions came back in order.

The store keeps a payload as a binary grey-scale image (PGM, P5) of 64 samples
a row, 8 bits each, so that any bytes padded to a multiple of 64 come back as
they were.  Stored bytes are read back and decoded where they lie; only the
digest and what was computed of them is shuffled.  The features of equal
payloads are merged before that shuffle, and the join back to the documents
may be split by AQE where one payload is frequent.

Defined results: null or empty text is a payload of 64 zero bytes; equal texts
give equal values; repeated rows and rows without id stay rows of their own;
an empty table gives an empty result; texts of any length are stored whole; other
columns are ignored.  Of broken markup: a caption that is left open ends with its
figure, or with the page; one before its image waits for it; one without an image, or
outside a figure, is text; scripts and styles are neither.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, stored

WIDTH = 64
ITEM = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_ITEM = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def pad(raw: bytes) -> bytes:
    """``raw`` and zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def to_image(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_image(stored_bytes: bytes) -> bytes:
    """The samples of a binary PGM of 8 bits; fails on anything else."""
    fields, at = [], 0
    while len(fields) < 4:
        end = at
        while stored_bytes[end : end + 1].strip():
            end += 1
        if end == at:
            raise ValueError("PGM header")
        fields.append(stored_bytes[at:end])
        at = end + 1
    width, height, depth = map(int, fields[1:])
    if fields[0] != b"P5" or depth != 255 or len(stored_bytes) - at != width * height:
        raise ValueError("PGM samples")
    return stored_bytes[at:]


def feature(payload: bytes) -> str:
    """A perceptual signature: mean and deviation of the samples, and 64 bits
    telling which of 8 x 8 areas are brighter than the mean of all areas."""
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    rows = np.minimum(np.arange(9) * len(samples) // 8, len(samples) - 1)[:8]
    columns = np.add.reduceat(samples.astype(np.uint32).reshape(len(samples), 8, 8).sum(axis=2, dtype=np.uint64), rows, axis=0)
    heights = np.maximum(np.diff(np.r_[rows, len(samples)]), 1)
    areas = columns / (heights[:, None] * 8)
    bits = "".join("1" if x else "0" for x in (areas > areas.mean()).ravel())
    return f"mean={samples.mean():.4f};std={samples.std():.4f};bright={int(bits, 2):016x}"


# Elements that end a text, and those whose content is never shown.
BLOCKS = frozenset("address article aside blockquote body dd div dl dt figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
UNSEEN = frozenset("script style template title noscript".split())


class _Interleaved(HTMLParser):
    """Ordered text and media items of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None  # of the open figcaption
        self.waiting: str | None = None  # a caption whose image hasn't come yet
        self.figure: list[dict] | None = None  # media of the open figure
        self.unseen: str | None = None

    def _end_text(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self._add("text", text, None)

    def _add(self, kind: str, text: str | None, digest: str | None) -> dict:
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "digest": digest, "caption": None})
        return self.items[-1]

    def _end_caption(self) -> None:
        text = " ".join("".join(self.caption or ()).split())
        self.caption = None
        if text and self.figure:
            self.figure[-1]["caption"] = text
        elif text:
            self.waiting = text

    def _end_figure(self) -> None:
        self._end_caption()
        self._end_text()
        if self.waiting:
            self._add("text", self.waiting, None)
        self.waiting = self.figure = None

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self.unseen = tag
        elif tag == "img":
            self._end_text()
            named = dict(attrs)
            item = self._add("media", None, (named.get("src") or "").rpartition(":")[2] or None)
            item["caption"] = named.get("alt") or None
            if self.figure is not None:
                self.figure.append(item)
                if self.waiting:
                    item["caption"], self.waiting = self.waiting, None
        elif tag == "figcaption":
            self._end_text()
            if self.figure is not None:
                self._end_caption()
                self.caption = []
        elif tag == "figure":
            self._end_figure()
            self.figure = []
        elif tag in BLOCKS:
            if self.caption is None:
                self._end_text()
            else:
                self.caption.append(" ")

    def handle_endtag(self, tag):
        if tag in UNSEEN:
            self.unseen = None
        elif tag == "figcaption":
            self._end_caption() if self.caption is not None else self._end_text()
        elif tag == "figure":
            self._end_figure()
        elif tag in BLOCKS:
            if self.caption is None:
                self._end_text()
            else:
                self.caption.append(" ")

    def handle_data(self, data):
        if not self.unseen:
            (self.text if self.caption is None else self.caption).append(data)

    def end(self) -> list[dict]:
        self.close()
        self._end_figure()
        return self.items


def parse(page: str | None) -> list[dict]:
    made = _Interleaved()
    made.feed(page or "")
    return made.end()


def sequences(pages: DataFrame, key: str = "doc_id", column: str = "html") -> DataFrame:
    """key, items: the interleaved sequence of every page."""

    def run(batches):
        for part in slices(batches, text=column):
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array([parse(t) for t in part.column(column).to_pylist()], _ITEM)], [key, "items"])

    return pages.select(key, column).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, items {ITEM}")


def paragraphs(text: str | None) -> list[str]:
    """The lines of a text that hold a word, white space made even."""
    return [even for line in (text or "").split("\n") if (even := " ".join(line.split()))]


def figure_page(parts: list[str], digest: str) -> str:
    """A page of ``parts`` with a figure after the first one and another at the end, captions before or after their image."""
    made = [f"<p>{html.escape(part, quote=False)}</p>" for part in parts]
    made.insert(1, f'<figure><img src="sha256:{digest}"><figcaption>Figure 1</figcaption></figure>')
    made.append(f'<figure><figcaption>Figure 2</figcaption><img src="sha256:{digest}"></figure>')
    return f"<article>{''.join(made)}</article>"


def aligned(items: list[dict], parts: list[str], digest: str) -> bool:
    """Whether a parsed ``figure_page`` has its texts, media and captions in order."""
    wanted = [("text", part, None, None) for part in parts]
    wanted.insert(1, ("media", None, digest, "Figure 1"))
    wanted.append(("media", None, digest, "Figure 2"))
    return [(i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == wanted and [i["position"] for i in items] == list(range(len(items)))


def store(docs: DataFrame) -> str:
    """Write the image of every text's payload; return the store's path.  A
    payload is written once for each Arrow batch that holds it."""

    def run(batches):
        for batch in batches:
            seen: set[bytes] = set()
            for part in slices([batch], text="text"):
                digests, images = [], []
                for text in part.column("text").to_pylist():
                    payload = pad((text or "").encode("utf-8"))
                    digest = hashlib.sha256(payload)
                    if digest.digest() not in seen:
                        seen.add(digest.digest())
                        digests.append(digest.hexdigest())
                        images.append(to_image(payload))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], ["digest", "media"])

    return stored(docs.select("text").mapInArrow(run, "digest string, media binary"), "media")


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes of each digest give when read back; one row per digest."""

    def run(batches):
        for part in slices(batches, text="media"):
            rows = []
            for image in part.column("media").to_pylist():
                payload = from_image(image)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("digest"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], FEATURES.replace(" long", "").replace(" string", "").split(", "))

    read = media.mapInArrow(run, FEATURES)
    return read.groupBy("digest").agg(*[F.max(c).alias(c) for c in read.columns[1:]])


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """Join the media items of ``items`` (one item a row) to ``media`` by digest; unknown digests keep nulls."""
    return items.join(media, "digest", "left")


def document_media(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store every text as media, build the page of its paragraphs and figures, parse it
    and resolve its media items: one row per document, that of its first figure."""
    made = spark.read.schema("digest string, media binary").parquet(store(docs))

    def refer(batches):
        for part in slices(batches, text="text"):
            rows = []
            for text in part.column("text").to_pylist():
                raw = (text or "").encode("utf-8")
                parts, digest = paragraphs(text), hashlib.sha256(pad(raw)).hexdigest()
                items = parse(figure_page(parts, digest))
                media = [i for i in items if i["kind"] == "media"]
                rows.append((len(raw), len(parts), aligned(items, parts, digest), media))
            kinds = (pa.int64(), pa.int32(), pa.bool_(), _ITEM)
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_texts", "aligned", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text").mapInArrow(refer, f"doc_id {kind}, n_bytes long, n_texts int, aligned boolean, items {ITEM}")
    flat = read.select("doc_id", "n_bytes", "n_texts", "aligned", F.size("items").alias("n_media"), F.explode("items").alias("item"))
    flat = flat.select("doc_id", "n_bytes", "n_texts", "n_media", "aligned", "item.position", "item.caption", "item.digest")
    found = resolve(flat, cut(features(made))).where("caption = 'Figure 1'")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_texts", "n_media", "aligned")
