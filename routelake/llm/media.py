"""Media columns: interleaved document sequences.

HTML is parsed into ordered items, each a text or a reference to media with its
alternative text and caption.  References that name a SHA-256 digest are resolved by a
join with a table of stored media; items keep their positions, and captions stay with
their references.

Media are stored as binary PGM images (64 samples a line, 8 bits), written to a Parquet
table in the shared folder, once for each digest and task, and read back for features.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import documents, split_join, texts
from routelake.session import discard, staged

WIDTH = 64
DIGEST = "sha256:"
ITEMS = "array<struct<position:int,kind:string,text:string,ref:string,alt:string,caption:string>>"

# Elements whose content is no text of a document, that end a run of text, and that refer to media.
HIDDEN = {"script", "style", "template", "noscript", "head"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}
MEDIA = {"img", "video", "audio", "embed", "source"}


class Sequence(HTMLParser):
    """Collects items in document order.  Unclosed and stray tags do no harm."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[dict] = []  # of each open figure: its media items and its caption
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "alt": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if tag in BLOCKS and self.caption is None:
            self._flush()
        if tag == "figure":
            self.figures.append({"media": [], "caption": None})
        elif tag == "figcaption" and self.figures:
            self.caption = []
        elif tag in MEDIA:
            given = dict(attrs)
            if ref := given.get("src") or given.get("data-src"):
                self._flush()
                item = {"kind": "media", "text": None, "ref": ref.strip(), "alt": given.get("alt"), "caption": None}
                self.items.append(item)
                if self.figures:
                    self.figures[-1]["media"].append(item)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            return
        if self.hidden:
            return
        if tag == "figcaption" and self.caption is not None:
            self.figures[-1]["caption"] = " ".join("".join(self.caption).split())
            self.caption = None
        elif tag == "figure" and self.figures:
            self._close_figure()
        elif tag in BLOCKS and self.caption is None:
            self._flush()

    def _close_figure(self) -> None:
        if self.caption is not None:
            self.figures[-1]["caption"] = " ".join("".join(self.caption).split())
            self.caption = None
        figure = self.figures.pop()
        for item in figure["media"]:
            item["caption"] = figure["caption"]

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)

    def finished(self) -> list[dict]:
        self.close()
        while self.figures:
            self._close_figure()
        self._flush()
        return [{"position": i} | item for i, item in enumerate(self.items)]


def parse(html: str) -> list[dict]:
    reader = Sequence()
    reader.feed(re.sub(r"<[A-Za-z/!][^<>]*\Z", "", html))  # a tag that the end cuts off is none
    return reader.finished()


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, position, kind, text, ref, alt, caption, digest: a row for each item of each page.  Null, empty and itemless pages have no row."""
    items_of = F.pandas_udf(lambda html: pd.Series([parse(page) for page in texts(html)]), ITEMS)
    item = pages.select(F.col(id_col), F.explode(items_of(F.col(html_col))).alias("item")).select(id_col, "item.*")
    return item.withColumn("digest", F.when(F.col("ref").startswith(DIGEST), F.lower(F.substring("ref", len(DIGEST) + 1, 64))))


def resolved(items: DataFrame, facts: DataFrame) -> DataFrame:
    """The items with what ``facts`` has of their digests; unknown or absent digests get nulls, and no item is lost (texts are not shuffled)."""
    return split_join(items, facts, "digest")


def interleaved(items: DataFrame, id_col: str) -> DataFrame:
    """One row for each page: its items as an array in the order of their positions."""
    fields = [c for c in items.columns if c not in (id_col, "position")]
    return items.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("position", *fields))).alias("items"))


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 0 up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def as_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(media: bytes) -> bytes:
    """The samples of a PGM image; raises where header and length disagree."""
    magic, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not an 8-bit binary PGM image")
    return samples


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples, and an average hash over 64 parts of the image."""
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.float64)
    parts = np.add.reduceat(samples, np.arange(64) * (len(samples) // 64)) / (len(samples) // 64)
    bits = sum(1 << i for i, high in enumerate(parts > parts.mean()) if high)
    return f"{samples.mean():.4f}/{samples.std():.4f}/{bits:016x}"


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[bytes] = set()
    for batch in batches:
        out = []
        for text in texts(batch["text"]):
            payload = padded(text.encode("utf-8", "surrogatepass"))
            digest = hashlib.sha256(payload)
            if digest.digest() not in seen:
                if len(seen) < 1_000_000:
                    seen.add(digest.digest())
                out.append((digest.hexdigest(), as_pgm(payload)))
        yield pd.DataFrame(out, columns=["digest", "media"])


FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in FACTS.split(", ")]
    for batch in batches:
        out = []
        for digest, media in zip(batch["digest"], batch["media"], strict=True):
            payload = from_pgm(bytes(media))
            out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
        yield pd.DataFrame(out, columns=names)


def stored(docs: DataFrame) -> DataFrame:
    """The media table of the texts (null: empty), written and read back: digest, media; a digest may repeat."""
    return staged(docs.select("text").mapInPandas(_store, "digest string, media binary"), "media", "zstd")


def facts_of(media: DataFrame) -> DataFrame:
    """One row for each digest: sizes, digests and features of the bytes read back."""
    return media.mapInPandas(_read, FACTS).dropDuplicates(["digest"])


def figure_pages(docs: DataFrame) -> DataFrame:
    """A page (page, html) for each document: its id as a heading, a figure that refers to its payload's digest
    with its unpadded length as caption, and a line after it.  ``page`` numbers the rows, since ids may repeat."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    n = F.octet_length(raw)
    lines = F.greatest(F.ceil(n / WIDTH), F.lit(1)).cast("int")
    payload = F.concat(raw, F.encode(F.repeat(F.lit("\0"), (lines * WIDTH - n).cast("int")), "utf-8"))
    html = F.concat(
        F.lit("<article><h1>"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(f'</h1><figure><img src="{DIGEST}'), F.sha2(payload, 256),
        F.lit('" alt="payload"><figcaption>'), n.cast("string"), F.lit("</figcaption></figure><p>end</p></article>"),
    )
    return docs.select(F.monotonically_increasing_id().alias("page"), html.alias("html"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the stored payload's facts for every row of documents, read from the interleaved sequence of its page.

    The id is the text at position 0, the payload's facts and its length (the caption) stand at
    position 1.  Repeated rows have a row each; a null id stays null, and a null text is empty.
    """
    docs = documents(spark, sf_dir)
    media = stored(docs)
    facts = staged(facts_of(media), "media-facts")
    discard(media)
    items = staged(sequences(figure_pages(docs), "page", "html"), "media-items")
    sequence = interleaved(resolved(items, facts), "page").select(F.col("items")[0]["text"].alias("id"), F.col("items")[1].alias("media"))
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return sequence.select(F.expr("try_cast(id as long)").alias("doc_id"), F.col("media.caption").cast("long").alias("n_bytes"), *[f"media.{c}" for c in names])
