"""Media columns: interleaved document sequences.

HTML is parsed into an ordered sequence of text and media-reference structs. Payloads live
in a table of their own, one row per digest; an equi-join on the digest resolves the
references, and each keeps its position and caption, and the size that its page states for
it: texts that differ only in zero bytes at their end share a padded payload, not a size.
Payloads here are 8-bit grey-scale PNG images, 64 samples a row, which store any bytes
without loss.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import ids_back, ids_whole, need

ROW = 64
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string,n_bytes:bigint>"
_PNG = b"\x89PNG\r\n\x1a\n"
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_RAW = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
_NAME = re.compile(r"<(/?)([a-zA-Z0-9]*)")
_BREAK = {"p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "article", "section", "tr", "table", "title", "nav", "footer"}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """Bytes, a positive multiple of 64, as an 8-bit grey-scale PNG of that many samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)  # filter type 0 before each row
    raw[:, 1:] = rows
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples of such an image, (rows, 64); checks signature, sizes and checksums."""
    if media[:8] != _PNG:
        raise ValueError("no PNG signature")
    at, data, shape = 8, b"", None
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)[:, 1:]


def _tokens(text: str) -> Iterator[tuple[str, str, bool]]:
    """``(token, tag, end)`` of a page in order; the tag is empty for text. Comments, scripts and styles are left out.

    Linear: a closing mark that does not come any more is looked for once.
    """
    at, size, gone = 0, len(text), set()
    while at < size:
        if text[at] != "<":
            end = text.find("<", at)
            yield text[at : (at := size if end < 0 else end)], "", False
            continue
        if text.startswith("<!--", at) and "-->" not in gone:
            if (end := text.find("-->", at + 4)) >= 0:
                at = end + 3
                continue
            gone.add("-->")
        end = -1 if ">" in gone else text.find(">", at)
        if end < 0:
            gone.add(">")
            yield "<", "", False
            at += 1
            continue
        name = _NAME.match(text, at)
        tag = name[2].lower()
        if tag in _RAW and not name[1] and tag not in gone:
            if close := _RAW[tag].search(text, at):
                at = close.end()
                continue
            gone.add(tag)
        yield text[at : end + 1], tag or "!", bool(name[1])
        at = end + 1


def parse_html(text: str | None) -> list[dict]:
    """Ordered text and media items. Media: img, video, audio and source with a src; a figcaption or else the alt text is the caption, data-bytes the size."""
    items: list[dict] = []
    buffer: list[str] = []
    caption: list[str] | None = None
    pending: dict | None = None

    def flush() -> None:
        said = " ".join("".join(buffer).split())
        buffer.clear()
        if said:
            items.append({"kind": "text", "text": said, "digest": None, "caption": None, "n_bytes": None})

    for token, tag, end in _tokens(text or ""):
        if not tag:
            (buffer if caption is None else caption).append(html.unescape(token))
            continue
        if tag in {"img", "video", "audio", "source"} and not end:
            attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(token)}
            if attrs.get("src"):
                flush()
                said = attrs.get("data-bytes", "")
                pending = {"kind": "media", "text": None, "digest": attrs["src"].removeprefix("sha256:"), "caption": attrs.get("alt") or None, "n_bytes": int(said) if said.isascii() and said.isdigit() and len(said) < 19 else None}
                items.append(pending)
        elif tag == "figcaption":
            if end and caption is not None:
                said = " ".join("".join(caption).split())
                if pending is not None:
                    pending["caption"] = said or pending["caption"]
                elif said:
                    items.append({"kind": "text", "text": said, "digest": None, "caption": None, "n_bytes": None})
                caption = None
            elif not end:
                flush()
                caption = []
        elif tag == "figure":
            flush()
            pending = None
        elif tag in _BREAK:
            (buffer if caption is None else caption).append(" ")
            if caption is None:
                flush()
    buffer.extend(caption or [])
    flush()
    return [{"position": i} | x for i, x in enumerate(items)]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "__no_id": pdf["__no_id"], "items": [parse_html(x) for x in pdf["html"]]})


def interleave(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, html)`` as ``doc_id, items``: the document's text and media references in order; null html has none."""
    rows = ids_whole(need(pages, ["doc_id", "html"]), "doc_id")
    return ids_back(rows.mapInPandas(_parse, f"doc_id long, __no_id boolean, items array<{ITEM}>"), "doc_id")


def references(sequences: DataFrame) -> DataFrame:
    """One row per media reference: ``doc_id, position, digest, caption, n_bytes``, and ``n_items``, the length of its sequence."""
    return sequences.select("doc_id", F.size("items").alias("n_items"), F.explode("items").alias("i")).where("i.kind = 'media'").select("doc_id", "i.position", "i.digest", "i.caption", "i.n_bytes", "n_items")


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """References with the columns of ``media(digest, ...)``, one row per digest; unresolved ones stay with nulls.

    A digest that very many references share is a skewed key of this join: both sides come
    from plain shuffles, so that Spark can split it.
    """
    return refs.join(media, "digest", "left")


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text (null: empty) and zero bytes up to a positive multiple of 64."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    missing = F.when(size == 0, ROW).otherwise(F.pmod(-size, F.lit(ROW)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), missing)))


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen = pdf.drop_duplicates("digest")
        yield pd.DataFrame({"digest": seen["digest"], "media": [encode_png(bytes(x)) for x in seen["payload"]]})


def store(payloads: DataFrame) -> DataFrame:
    """``payloads(digest, payload)`` as stored media, one row per digest: ``digest, media``."""
    stored = need(payloads, ["digest", "payload"]).mapInPandas(_store, "digest string, media binary")
    return stored.groupBy("digest").agg(F.first("media").alias("media"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for digest, media in zip(pdf["digest"], pdf["media"], strict=True):
            media = bytes(media)
            samples = decode_png(media)
            data = samples.tobytes()
            light = samples.mean(1)
            rest = np.array_split(light, 8)
            feature = f"{samples.shape[1]}x{samples.shape[0]};mean={samples.mean():.4f};std={samples.std():.4f};rows=" + "/".join(f"{p.mean() if len(p) else 0:.2f}" for p in rest)
            rows.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pd.DataFrame(rows, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Decodes ``media(digest, media)`` and describes the samples read back, one row per digest."""
    return need(media, ["digest", "media"]).mapInPandas(_read, FEATURES)


def media_of_documents(docs: DataFrame) -> DataFrame:
    """Every document of ``docs(doc_id, text, source)`` as an interleaved page with its payload, parsed, resolved and read back.

    The page holds the text's paragraphs and then a figure that refers to the payload by
    SHA-256 and states its unpadded size, captioned with the source. Null texts count as
    empty, and every row, repeated ones and those with null ids too, gives one row:
    ``doc_id, position, caption, n_bytes, n_items`` of the reference and the columns of
    ``features``. Empty tables give an empty result.
    """
    docs = need(docs, ["doc_id", "text", "source"])
    bytes_ = docs.select("doc_id", "text", "source", payload(F.col("text")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    body = F.coalesce("text", F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "</p><p>")):
        body = F.replace(body, F.lit(raw), F.lit(safe))
    caption = F.replace(F.replace(F.coalesce("source", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("string")
    page = F.concat(F.lit("<article><p>"), body, F.lit('</p></article><figure><img src="sha256:'), F.col("digest"), F.lit('" data-bytes="'), size, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    refs = references(interleave(bytes_.select("doc_id", page.alias("html"))))
    return resolve(refs, features(store(bytes_)))
