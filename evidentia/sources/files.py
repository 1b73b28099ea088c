"""Files to documents: doc_ord, source, page, text. A binary scan that Spark deals out; parsers run next to the data."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import fixed_values as V
from evidentia.functions import text as T
from evidentia.functions.tables import materialize, small_side

#: Pages of one file that its place leaves room for.
PAGES = 1 << 20
#: Files whose places are broadcast at most; those of more files are joined.
SMALL_SIDE = 200_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def heading_level(style: Column) -> Column:
    """The number in a heading style's name, 1 to 6; 2 without one."""
    digits = F.regexp_replace(style, "[^0-9]", "")
    return F.when(digits == "", 2).otherwise(F.least(F.greatest(F.expr("1"), F.try_to_number(F.substring(digits, 1, 9), F.lit("999999999")).cast("int")), F.lit(6)))


def table_line(cells: Column) -> Column:
    """Cleaned cells that aren't empty, joined."""
    return F.array_join(F.filter(F.transform(cells, T.clean_text), lambda c: c != ""), " | ")


def scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, content of all files under a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


def load(files: DataFrame, unsupported: str = "raise") -> DataFrame:
    """files: path, content. Documents in path order; pages of a file in page order.

    Each file is read once, by one function that goes by its extension. Files of other formats raise, or are left out with
    unsupported="skip" (see quarantine()).
    """
    skip = unsupported != "raise"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows = parse(path, content.as_py() or b"", skip)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([p for p, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.string())], ["path", "page", "text"])

    parsed = files.select("path", "content").mapInArrow(run, "path string, page int, text string")
    places = small_side(path_order(files), SMALL_SIDE)
    docs = parsed.join(places, "path").withColumn("text", T.clean_text(F.col("text")))
    return docs.select((F.col("place") * F.lit(PAGES) + F.coalesce("page", F.lit(0))).alias("doc_ord"), file_name(F.col("path")).alias("source"), "page", "text")


def parse(path: str, content: bytes, skip: bool = False) -> list[tuple[int | None, str]]:
    """(page, text) of each part of a file."""
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext in ("md", "txt"):
        return [(None, content.decode("utf-8", "replace"))]
    if ext == "pdf":
        return pdf_pages(content)
    if ext == "docx":
        return [(None, docx_text(content))]
    if skip:
        return []
    raise ValueError(f"Unsupported file type: .{ext}")


def path_order(files: DataFrame) -> DataFrame:
    """path, place: distinct paths numbered from 0 in their order. Sorted by ranges; the driver adds up one count for each range."""
    ranged = files.select("path").distinct().repartitionByRange("path").sortWithinPartitions("path").withColumn("id", F.monotonically_increasing_id())
    ranged = materialize(ranged, "paths")  # the id is the range's number above 33 bits of the place in it
    part = F.shiftright("id", 33)
    sizes = sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each range
    before, offsets = 0, []
    for k, n in sizes:
        offsets.append((k, before))
        before += n
    offsets = F.broadcast(files.sparkSession.createDataFrame(offsets, "part long, before long"))
    return ranged.withColumn("part", part).join(offsets, "part").select("path", (F.col("before") + F.col("id") - F.shiftleft("part", 33)).alias("place"))


def quarantine(files: DataFrame) -> DataFrame:
    """Files whose format isn't supported."""
    return files.select("path", extension(F.col("path")).alias("ext")).where(~F.col("ext").isin(V.EXTENSIONS))


def pdf_pages(content: bytes) -> list[tuple[int, str]]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("PDF files need the pypdf package") from e
    return [(number, page.extract_text() or "") for number, page in enumerate(PdfReader(io.BytesIO(content)).pages, start=1)]


def _clean(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in text.replace("\0", " ").splitlines())).strip()


def _paragraph(p: ElementTree.Element) -> str:
    tags = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{_W}t" else tags.get(x.tag, "") for x in p.iter())


def docx_text(content: bytes) -> str:
    """Paragraphs as blocks (headings marked with # by level), then all tables; read with the standard library."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    blocks = []
    for p in body.findall(f"{_W}p"):
        text = _clean(_paragraph(p))
        style = p.find(f"{_W}pPr/{_W}pStyle")
        key = style.get(f"{_W}val") if style is not None else ""
        name = names.get(key, key or "").lower()
        if text and name.startswith("heading"):
            digits = re.sub("[^0-9]", "", name)
            text = "#" * (min(max(int(digits), 1), 6) if digits else 2) + " " + text
        if text:
            blocks.append(text)
    for table in body.findall(f"{_W}tbl"):
        lines = []
        for row in table.findall(f"{_W}tr"):
            cells = [_clean("\n".join(_paragraph(p) for p in c.iter(f"{_W}p"))) for c in row.findall(f"{_W}tc")]
            if any(cells):
                lines.append(" | ".join(c for c in cells if c))
        if lines:
            blocks.append("\n".join(lines))
    return _clean("\n\n".join(blocks))


def write(df: DataFrame, path: str) -> None:
    """Results as Parquet."""
    df.write.mode("overwrite").parquet(path)
