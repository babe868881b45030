"""Files to documents (``path``, ``part``, ``text``); routing by extension; listings by metadata."""

from __future__ import annotations

import importlib
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Supported extensions, and the document type that each is split as.
EXTENSIONS = (".docx", ".xlsx", ".xls", ".pdf", ".txt", ".md", ".markdown", ".html", ".htm", ".json")
DOC_TYPES = {".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".json": "json"}
LOADERS = {".docx": "word", ".xlsx": "excel", ".xls": "excel", ".pdf": "pdf", ".txt": "text", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".json": "json"}
PDF_BACKENDS = {"pymupdf": "pymupdf", "pdfplumber": "pdfplumber", "pypdf": "pypdf"}


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _case(path: Column | str, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for ext, value in table.items():
        out = F.when(extension(path) == ext, F.lit(value)).otherwise(out)
    return out


def loader_of(path: Column | str) -> Column:
    return _case(path, LOADERS, "generic")


def doc_type_of(path: Column | str, default: str = "text") -> Column:
    return _case(path, DOC_TYPES, default)


def list_files(spark: SparkSession, directory: str, recursive: bool = True, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """``path``, ``length``, ``modificationTime`` of supported files in order; contents are not read."""
    wanted = [e if e.startswith(".") else f".{e}" for e in map(str.lower, extensions or EXTENSIONS)]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(directory)
    return found.select("path", "length", "modificationTime").where(extension("path").isin(wanted)).orderBy("path")


def load_text(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Each file is one document."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.lit(0).alias("part"), F.decode("content", encoding).alias("text"))


def load_json(spark: SparkSession, path: str, lines: bool = False, levels: int | None = None, longest: int | None = None) -> DataFrame:
    """Each file, or with ``lines`` each line, is one document, flattened (see ``flat_json``); what is no JSON has an error."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    rows.append((file, 0, flat_json(text, levels, longest), None))
                except ValueError as e:
                    rows.append((file, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "part", "text", "error"])

    if lines:
        rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.trim("text") != "")
    else:
        rows = load_text(spark, path).select("path", "text")
    return rows.mapInPandas(run, "path string, part int, text string, error string")


def docx_text(content: bytes) -> str:
    """Paragraphs of a word-processor document."""
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        root = ElementTree.fromstring(file.read("word/document.xml"))
    name = lambda tag: tag.rpartition("}")[2]
    found = [p for p in root.iter() if name(p.tag) == "p"]
    return "\n".join("".join(t.text or "" for t in p.iter() if name(t.tag) == "t") for p in found)


def xlsx_rows(content: bytes, sheet: int | None = None) -> list[str]:
    """The text of each sheet: cells joined by spaces, rows by line ends."""
    name = lambda tag: tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in file.namelist():
            for item in ElementTree.fromstring(file.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if name(t.tag) == "t"))
        sheets = sorted((x for x in file.namelist() if x.startswith("xl/worksheets/sheet")), key=lambda x: (len(x), x))
        out = []
        for path in sheets if sheet is None else [sheets[sheet]]:
            lines = []
            for row in (x for x in ElementTree.fromstring(file.read(path)).iter() if name(x.tag) == "row"):
                cells = []
                for cell in row:
                    value = "".join(v.text or "" for v in cell.iter() if name(v.tag) in ("v", "t"))
                    cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
                lines.append(" ".join(cells))
            out.append("\n".join(lines))
    return out


def flat_json(text: str, levels: int | None = None, longest: int | None = None) -> str:
    """JSON as lines of the keys that lead to a value, and the value.

    ``levels`` keeps the last so many keys (None: JSON as it is, 0: all of
    them); a container whose JSON is no longer than ``longest`` stays JSON.
    """
    if levels is None:
        return "\n".join(line.strip() for line in json.dumps(json.loads(text), indent=0, ensure_ascii=False).split("\n") if re.search(r"\w", line))
    lines, todo = [], [((), json.loads(text))]
    while todo:
        keys, value = todo.pop()
        whole = json.dumps(value, ensure_ascii=False)
        if isinstance(value, dict | list) and value and not (longest is not None and len(whole) <= longest and keys):
            inner = value.items() if isinstance(value, dict) else enumerate(value)
            todo += [((*keys, str(k)) if isinstance(value, dict) else keys, v) for k, v in reversed(list(inner))]
        else:
            lines.append(" ".join([*(keys[-levels:] if levels else keys), value if isinstance(value, str) else whole]))
    return "\n".join(lines)


def markdown_sections(text: str) -> list[str]:
    """A part for each heading and what stands below it; marks in code fences are no headings."""
    parts, fenced = [[]], False
    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        if not fenced and re.match(r"#{1,6}\s+\S", line):
            parts.append([])
        parts[-1].append(line)
    return [joined for p in parts if (joined := "\n".join(p).strip())]


def page_text(html: str) -> str:
    """The text of a page's body without scripts, styles and tags."""
    body = re.search(r"(?is)<body[^>]*>(.*?)(?:</body>|\Z)", html)
    bare = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", body[1] if body else html)
    return " ".join(re.sub(r"(?s)<[^>]*>", " ", bare).split())


def pdf_pages(content: bytes, backend: str) -> list[str]:
    module = importlib.import_module(PDF_BACKENDS[backend])
    if backend == "pymupdf":
        return [page.get_text() for page in module.open(stream=content, filetype="pdf")]
    if backend == "pypdf":
        return [page.extract_text() or "" for page in module.PdfReader(io.BytesIO(content)).pages]
    with module.open(io.BytesIO(content)) as file:
        return [page.extract_text() or "" for page in file.pages]


#: Parsers by loader: the content of a file to the texts of its documents. Another kind of file is an entry here and in ``LOADERS``.
PARSERS: dict[str, Callable[[bytes], list[str]]] = {
    "word": lambda content: [docx_text(content)],
    "excel": lambda content: xlsx_rows(content),
    "pdf": lambda content: pdf_pages(content, "pymupdf"),
    "text": lambda content: [content.decode("utf-8-sig")],
    "markdown": lambda content: [content.decode("utf-8-sig")],
    "html": lambda content: [content.decode("utf-8-sig", "replace")],
    "json": lambda content: [content.decode("utf-8-sig")],
    "generic": lambda content: [content.decode("utf-8-sig")],
}


def parse_files(files: DataFrame, parsers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """Documents of any files (``path``, ``content``), each parsed by its extension: ``path``, ``part``, ``doc_type``, ``text``, ``error``.

    A file that fails gives a row with its error, not a failed job.
    """
    own = PARSERS | (parsers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, loader, doc_type, content in zip(batch["path"], batch["loader"], batch["doc_type"], batch["content"], strict=True):
                try:
                    rows += [(path, k, doc_type, text, None) for k, text in enumerate(own[loader](bytes(content)))]
                except Exception as e:  # noqa: BLE001  reported beside the path
                    rows.append((path, 0, doc_type, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "part", "doc_type", "text", "error"])

    routed = files.select("path", loader_of("path").alias("loader"), doc_type_of("path").alias("doc_type"), "content")
    return routed.mapInPandas(run, "path string, part int, doc_type string, text string, error string")


def auto_load(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files at ``path``, which may be a pattern, by their extensions."""
    return parse_files(spark.read.format("binaryFile").load(path).select("path", "content"))


def load_directory(spark: SparkSession, directory: str, recursive: bool = True, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """The documents of all supported files of a directory."""
    wanted = [e if e.startswith(".") else f".{e}" for e in map(str.lower, extensions or EXTENSIONS)]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(directory)
    return parse_files(found.where(extension("path").isin(wanted)).select("path", "content"))


def load_markdown(spark: SparkSession, path: str) -> DataFrame:
    """A document for each section of Markdown files."""
    return parse_files(spark.read.format("binaryFile").load(path), {x: lambda content: markdown_sections(content.decode("utf-8-sig")) for x in LOADERS.values()})


def listing_size(listing: DataFrame) -> DataFrame:
    """``files`` and ``bytes`` of a listing."""
    return listing.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))


def _parsed(spark: SparkSession, path: str, parse) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return parse_files(files, {name: parse for name in PARSERS}).drop("doc_type")


def load_word(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, lambda content: [docx_text(content)])


def load_excel(spark: SparkSession, path: str, sheet: int | None = None) -> DataFrame:
    return _parsed(spark, path, lambda content: xlsx_rows(content, sheet))


def load_pdf(spark: SparkSession, path: str, backend: str = "pymupdf", full_document: bool = False) -> DataFrame:
    """Pages of PDF files by an optional package; ImportError without it, ValueError for an unknown one."""
    backend = backend.lower()
    if backend not in PDF_BACKENDS:
        raise ValueError(f"backend must be one of {sorted(PDF_BACKENDS)}")
    importlib.import_module(PDF_BACKENDS[backend])
    pages = _parsed(spark, path, lambda content: pdf_pages(content, backend))
    if not full_document:
        return pages
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n")
    return pages.groupBy("path").agg(F.lit(0).alias("part"), text.alias("text"), F.first("error", True).alias("error"))


def rows_to_text(table: DataFrame, group: list[Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """A table as text: cells joined by spaces; with ``group``, a group's rows joined by line ends in ``order``."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in table.columns])
    if group is None:
        return table.select(line.alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order or table.columns], line.alias("__line")))), lambda x: x["__line"])
    return table.groupBy(*group).agg(F.array_join(ordered, "\n").alias("text"))


def html_documents(pages: DataFrame, tag: str = "body", ignore_no_id: bool = False) -> DataFrame:
    """A document for each element ``tag``; ``ignore_no_id`` leaves out those without an id attribute."""
    attributes = r"(?is)<" + tag + r"(\s[^>]*)?>(.*?)(?:</" + tag + r">|\z)"
    found = pages.select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(attributes), F.lit(1)).alias("a"), F.regexp_extract_all("html", F.lit(attributes), F.lit(2)).alias("b"))).alias("part", "x"))
    if ignore_no_id:
        found = found.where(F.col("x.a").rlike(r"(?i)\sid\s*="))
    bare = F.regexp_replace(F.regexp_replace("x.b", r"(?s)<[^>]*>", " "), r"\s+", " ")
    return found.select("page_id", "part", F.trim(bare).alias("text"))
