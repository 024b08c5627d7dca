"""Response bodies as they came over the wire: transfer encodings undone, text decoded."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query, texts

#: Bytes that one body may have when it is decoded; a larger one counts as broken.
MOST_BYTES = 64 << 20


def undone(body: bytes | None, encoding: str | None) -> bytes | None:
    """A body without its encoding (gzip, deflate with or without header, identity); None if it is broken, too large or of another encoding."""
    kind = (encoding or "identity").strip().lower()
    if body is None or kind in ("identity", ""):
        return body
    for window in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(kind, ()):
        try:
            unpack = zlib.decompressobj(window)
            out = unpack.decompress(body, MOST_BYTES)
            if unpack.eof:
                return out
        except zlib.error:
            continue
    return None


def decoded(responses: DataFrame, keep: list[str]) -> DataFrame:
    """``responses`` (body binary, encoding string, and ``keep``): ``keep`` and text, null where a body can't be decoded; bytes that are no UTF-8 are replaced."""
    inner = responses.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col("body").alias("b"), F.col("encoding").alias("e"))
    fields = ", ".join(f"c{i} {inner.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [undone(b, e) for b, e in zip(batch.column("b").to_pylist(), batch.column("e").to_pylist())]
            made = pa.array([None if p is None else p.decode("utf-8", "replace") for p in plain], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], made], names=[*batch.schema.names[:-2], "t"])

    return inner.mapInArrow(run, f"{fields}, t string").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("t").alias("text"))


def encoded(pages: DataFrame) -> DataFrame:
    """``pages`` as responses: bodies packed with gzip or deflate or not at all, some of them broken, by the page's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, kinds = [], []
            for i, t in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                kind = ("gzip", "deflate", None, "br")[i % 4]
                raw = (t or "").encode()
                packer = zlib.compressobj(wbits=31 if kind == "gzip" else 15)
                packed = packer.compress(raw) + packer.flush() if kind in ("gzip", "deflate") else raw
                bodies.append(packed[:-5] if i % 10 == 0 and kind else packed)
                kinds.append(kind)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(bodies, pa.binary()), pa.array(kinds, pa.string())], names=["page_id", "body", "encoding"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, body binary, encoding string")


@query("body_decoding", "SELECT page_id, CASE WHEN page_id % 4 = 3 OR (page_id % 10 = 0 AND page_id % 4 <> 2) THEN NULL ELSE md5(coalesce(html, '')) END AS digest FROM pages")
def body_decoding(spark, sf_dir):
    """Digests of bodies that were packed and unpacked again; broken ones and brotli (no library for it here) give null."""
    return decoded(encoded(texts(spark, sf_dir, "pages")), ["page_id"]).select("page_id", F.md5(F.col("text").cast("binary")).alias("digest"))
