"""PDF files to Markdown and images, behind a small backend: tables of spans, links, tables and pictures, then ``layout``."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import layout

#: Image formats that pages can be written in.
IMAGE_FORMATS = ("png", "jpg", "jpeg", "bmp", "tiff", "tif", "webp", "pam", "pnm")
#: Fixed value: points in an inch, to which the resolution is relative.
POINTS = 72


class PdfBackend(Protocol):
    """What a PDF library must tell of a file's content; pages count from 1."""

    def page_count(self, content: bytes) -> int: ...
    def spans(self, content: bytes) -> list[dict]: ...
    def links(self, content: bytes) -> list[dict]: ...
    def tables(self, content: bytes) -> list[dict]: ...
    def pictures(self, content: bytes) -> list[dict]: ...
    def render(self, content: bytes, page: int, options: RenderOptions) -> bytes: ...


@dataclass(frozen=True)
class RenderOptions:
    dpi: int = 200
    image_format: str = "png"
    alpha: bool = False
    clip: tuple[float, float, float, float] | None = None
    quality: int = 90

    def __post_init__(self):
        if self.format not in IMAGE_FORMATS:
            raise ValueError(f"image_format must be one of {IMAGE_FORMATS}")

    @property
    def format(self) -> str:
        return self.image_format.lower().lstrip(".")

    @property
    def zoom(self) -> float:
        return max(self.dpi, 1) / POINTS


class PyMuPdf:
    """The backend of an optional package, imported where it is used."""

    def _open(self, content: bytes):
        import pymupdf

        return pymupdf.open(stream=content, filetype="pdf")

    def page_count(self, content: bytes) -> int:
        return len(self._open(content))

    def spans(self, content: bytes) -> list[dict]:
        out = []
        for number, page in enumerate(self._open(content), 1):
            lines = (line for block in page.get_text("dict")["blocks"] if block.get("type") == 0 for line in block["lines"])
            for n, line in enumerate(lines):
                out += [{"page": number, "line": n, "span": k, **_box(s["bbox"]), **{c: s[c] for c in ("font", "size", "flags", "text")}} for k, s in enumerate(line["spans"])]
        return out

    def links(self, content: bytes) -> list[dict]:
        pages = enumerate(self._open(content), 1)
        return [{"page": n, **_box(x["from"]), "uri": uri} for n, page in pages for x in page.get_links() if (uri := x.get("uri") or x.get("name"))]

    def tables(self, content: bytes) -> list[dict]:
        pages = enumerate(self._open(content), 1)
        cell = lambda c: "" if c is None else str(c)
        return [
            {"page": n, "y": t.bbox[1], "headers": [cell(c) for c in t.header.names], "rows": [[cell(c) for c in row] for row in t.extract()[1:]]}
            for n, page in pages for t in page.find_tables().tables
        ]

    def pictures(self, content: bytes) -> list[dict]:
        import pymupdf

        file, out = self._open(content), []
        for n, page in enumerate(file, 1):
            for k, found in enumerate(page.get_images(full=True), 1):
                pixels = pymupdf.Pixmap(file, found[0])
                if pixels.n - pixels.alpha > 3:
                    pixels = pymupdf.Pixmap(pymupdf.csRGB, pixels)
                out.append({"page": n, "number": k, "image": pixels.tobytes("png")})
        return out

    def render(self, content: bytes, page: int, options: RenderOptions) -> bytes:
        import pymupdf

        clip = pymupdf.Rect(*options.clip) if options.clip else None
        pixels = self._open(content)[page - 1].get_pixmap(matrix=pymupdf.Matrix(options.zoom, options.zoom), alpha=options.alpha, clip=clip)
        if options.format in ("png", "pam", "pnm"):
            return pixels.tobytes(options.format)
        from PIL import Image

        image, out = Image.open(io.BytesIO(pixels.tobytes("png"))), io.BytesIO()
        kind = {"jpg": "JPEG", "tif": "TIFF"}.get(options.format, options.format.upper())
        if kind == "JPEG":
            if image.mode == "RGBA":  # it has no transparency
                image = Image.alpha_composite(Image.new("RGBA", image.size, "white"), image)
            image = image.convert("RGB")
        image.save(out, kind, quality=options.quality)
        return out.getvalue()


def _box(box) -> dict:
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, box), strict=True))


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``content`` of files; a path without any raises Spark's error."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _table(files: DataFrame, read: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows that ``read`` finds in each file; where it fails, the file has none."""
    names = ["path", *[x.strip().split(" ")[0] for x in schema.split(";")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [{"path": path, **row} for row in read(bytes(content))]
                except ImportError:
                    raise
                except Exception:  # noqa: BLE001, S112  a file that cannot be read has no rows
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, f"path string, {schema.replace(';', ',')}")


_BOX = "x0 double; y0 double; x1 double; y1 double"


def _keyed(rows: DataFrame) -> DataFrame:
    """A page is known by its file and number."""
    return rows.withColumn("page", F.struct("path", "page"))


def convert_pages(files: DataFrame, backend: PdfBackend, *, image_dir: str | None = None) -> DataFrame:
    """The Markdown of each page (``path``, ``page``, ``md``): text with links, tables, and with ``image_dir`` the pictures at its top."""
    spans = _keyed(_table(files, backend.spans, f"page int; line long; span long; {_BOX}; font string; size double; flags int; text string"))
    links = _keyed(_table(files, backend.links, f"page int; {_BOX}; uri string"))
    tables = _keyed(_table(files, backend.tables, "page int; y double; headers array<string>; rows array<array<string>>"))
    inserts = layout.table_markdown(tables).select("page", "y", "md")
    if image_dir is not None:
        pictures = _keyed(export_pictures(files, backend))
        inserts = inserts.unionByName(pictures.select("page", F.lit(0.0).alias("y"), layout.image_markdown(F.concat(F.lit(f"{image_dir.rstrip('/')}/"), "name")).alias("md")))
    return layout.page_markdown(spans, links, inserts).select("page.path", "page.page", "md")


def convert(files: DataFrame, backend: PdfBackend, **options) -> DataFrame:
    """The Markdown of each file (``path``, ``md``)."""
    return layout.merge_pages(convert_pages(files, backend, **options))


def picture_name(page: Column | str, number: Column | str) -> Column:
    return F.format_string("page%03d_img%02d.png", page, number)


def export_pictures(files: DataFrame, backend: PdfBackend) -> DataFrame:
    """Pictures inside pages: ``path``, ``page``, ``number``, ``image`` and ``name``."""
    found = _table(files, backend.pictures, "page int; number int; image binary")
    return found.withColumn("name", picture_name("page", "number"))


def render_pages(files: DataFrame, backend: PdfBackend, options: RenderOptions | None = None, first: int = 1, last: int | None = None) -> DataFrame:
    """Images of pages ``first`` to ``last`` (all): ``path``, ``page``, ``image`` and ``name``; IndexError outside a file's pages."""
    options = options or RenderOptions()
    counted = _table(files, lambda content: [{"pages": backend.page_count(content)}], "pages int")
    least = counted.agg(F.min("pages")).first()[0] or 0
    if first < 1 or (last is not None and (last > least or first > last)):
        raise IndexError(f"pages {first} to {last} of {least}")

    def read(content: bytes) -> list[dict]:
        stop = backend.page_count(content) if last is None else last
        return [{"page": n, "image": backend.render(content, n, options)} for n in range(first, stop + 1)]

    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return _table(files, read, "page int; image binary").withColumn("name", layout.image_name(stem, F.col("page"), options.format))
