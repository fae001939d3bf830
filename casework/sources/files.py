"""File sources and sinks: discovery, text extraction, JSON lines, encrypted lines, single-file writers."""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casework.operators.manifest import custodian_of, doctype_of, extension_of, mime_of

TEXT = (".txt", ".md", ".log", ".csv", ".ocr")
IMAGES = (".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".gif")


def list_files(spark: SparkSession, root: str, *, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, size, mtime of the files below ``root`` whose name fits ``pattern``, sorted by path; links are not followed."""
    base = _root(root)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(base)
    return f.select(_local("path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).where(inside(F.col("path"), base)).where(~_link("path")).orderBy("path")


def _root(root: str) -> str:
    return str(Path(root).resolve())


def _local(column: str) -> Column:
    return F.regexp_replace(column, "^file:/+", "/")


def inside(path: Column, root: str) -> Column:
    """Whether a path lies below ``root`` and has no step up in it."""
    return path.startswith(root.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)")


def _link(column: str) -> Column:
    return F.udf(lambda p: os.path.islink(p), "boolean", useArrow=True)(column)


def discover(spark: SparkSession, root: str, *, recursive: bool = True, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """One manifest record per file below ``root``: path, sha256, size, mime_type, extension, mtime, custodian, doctype.

    Files are read in parallel and hashed in the JVM; ``include`` and ``exclude`` are extensions, whatever their
    case.  Links are skipped, as are files that vanish while they are read; nothing outside of the root can appear.  An
    empty folder gives no rows.
    """
    base = _root(root)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(base)
    path = _local("path")
    ext = extension_of(path)
    r = f.where(~_link("path")).select(
        path.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), mime_of(ext).alias("mime_type"), ext.alias("extension"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("mtime"), custodian_of(path).alias("custodian"), doctype_of(mime_of(ext), ext).alias("doctype"),
    ).where(inside(F.col("path"), base))
    low = F.lower("extension")
    if include:
        r = r.where(low.isin([x.lower() for x in include]))
    if exclude:
        r = r.where(~low.isin([x.lower() for x in exclude]))
    return r


def discover_one(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """The record of one file; raises where it is missing, no file, or outside of ``root``."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    if not p.is_file():
        raise ValueError(f"{path} is no file")
    real = p.resolve()
    if root is not None and not real.is_relative_to(_root(root)):
        raise ValueError(f"{path} lies outside of {root}")
    return discover(spark, str(real.parent), recursive=False).where(F.col("path") == str(real))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs that are not blank, and table rows with their cells joined by a bar."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p" and text(e).strip():
            out.append(text(e))
        elif e.tag == f"{_W}tbl":
            out += [" | ".join(text(c).strip() for c in row.iter(f"{_W}tc")) for row in e.iter(f"{_W}tr")]
    return "\n".join(out)


def image_size(content: bytes) -> tuple[str, int, int] | None:
    """Format, width and height from an image's header."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return ("PNG", *struct.unpack(">II", content[16:24]))
    if content[:3] == b"GIF":
        return ("GIF", *struct.unpack("<HH", content[6:10]))
    if content[:4] in (b"II*\0", b"MM\0*"):
        return _tiff_size(content)
    if content[:2] == b"BM":
        return ("BMP", *struct.unpack("<ii", content[18:26]))
    if content[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(content):
            if content[i] != 0xFF:
                break
            if 0xC0 <= content[i + 1] <= 0xCF and content[i + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[i + 5 : i + 9])
                return ("JPEG", w, h)
            i += 2 + struct.unpack(">H", content[i + 2 : i + 4])[0]
    return None


def _tiff_size(content: bytes) -> tuple[str, int, int] | None:
    """From the first directory: tags 256 and 257, as short or long numbers."""
    end = "<" if content[:2] == b"II" else ">"
    at = struct.unpack(end + "I", content[4:8])[0]
    found = {}
    for i in range(struct.unpack(end + "H", content[at : at + 2])[0]):
        tag, kind = struct.unpack(end + "HH", content[at + 2 + 12 * i : at + 6 + 12 * i])
        value = content[at + 10 + 12 * i : at + 14 + 12 * i]
        found[tag] = struct.unpack(end + "H", value[:2])[0] if kind == 3 else struct.unpack(end + "I", value)[0]
    return ("TIFF", found[256], found[257]) if 256 in found and 257 in found else None


def docx_properties(content: bytes) -> dict[str, str]:
    """The core properties that are set, by their plain names."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "docProps/core.xml" not in z.namelist():
            return {}
        return {e.tag.rpartition("}")[2].lower(): e.text for e in ElementTree.fromstring(z.read("docProps/core.xml")) if e.text}


def pdf_pages(content: bytes) -> list[str]:
    """Texts of the pages; needs an optional library and raises without one."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional library pypdf") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def extract(spark: SparkSession, root: str) -> DataFrame:
    """path, text, page_count, format, metadata, error of every file below ``root``; a file that cannot be read has an error.

    Plain texts stay in the JVM (bytes that are no UTF-8 become the replacement sign); only documents and images go
    through Python.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_root(root)).where(~_link("path"))
    f = f.select(_local("path").alias("path"), "content")
    low = F.lower(extension_of(F.col("path")))
    none = lambda kind: F.lit(None).cast(kind)
    plain = f.where(low.isin(*TEXT)).select(
        "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), none("int").alias("page_count"), F.lit("text").alias("format"),
        F.create_map(F.lit("format"), F.lit("text")).alias("metadata"), none("string").alias("error"),
    )
    known = (".docx", ".pdf", *IMAGES)
    other = f.where(~low.isin(*TEXT, *known)).select(
        "path", none("string").alias("text"), none("int").alias("page_count"), none("string").alias("format"), none("map<string,string>").alias("metadata"),
        F.concat(F.lit("unsupported: "), low).alias("error"),
    )

    def read(ext: str, content: bytes):
        if ext == ".docx":
            return docx_text(content), None, "docx", docx_properties(content)
        if ext == ".pdf":
            pages = pdf_pages(content)
            return "\n\n".join(pages), len(pages), "pdf", {}
        s = image_size(content)
        return "", 1, f"{s[0]} {s[1]}x{s[2]}" if s else "image", {"has_exif": str(b"Exif\0\0" in content[:65536]).lower()}

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, *read(os.path.splitext(path)[1].lower(), bytes(content)), None))
                except Exception as e:
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            out = pd.DataFrame(rows, columns=["path", "text", "page_count", "format", "metadata", "error"])
            yield out.astype({"page_count": "Int32"})

    made = f.where(low.isin(*known)).mapInPandas(run, "path string, text string, page_count int, format string, metadata map<string,string>, error string")
    return plain.unionByName(made).unionByName(other)


def ocr(docs: DataFrame, recognise, *, threshold: int = 10) -> DataFrame:
    """path, page, text, native, conf of pages (path, page, text, content): those with more than ``threshold`` characters as they
    are, with confidence 1; the others as ``recognise`` (bytes to text and word confidences) reads them."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, page, text, content in zip(pdf["path"], pdf["page"], pdf["text"], pdf["content"]):
                if text is not None and len(text.strip()) > threshold:
                    rows.append((path, page, text, True, 1.0))
                else:
                    read, confs = recognise(bytes(content) if content is not None else b"")
                    good = [c for c in confs if c != -1]
                    rows.append((path, page, read, False, sum(good) / len(good) / 100 if good else 0.0))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "native", "conf"])

    return docs.select("path", "page", "text", "content").mapInPandas(run, "path string, page int, text string, native boolean, conf double")


# What a recogniser takes.
OCR_SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")


def ocr_folder(spark: SparkSession, root: str, recognise) -> DataFrame:
    """``ocr`` over all files below ``root`` that a recogniser takes, one page each: what has no text layer of its own is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_root(root)).where(~_link("path"))
    low = F.lower(extension_of(_local("path")))
    pages = f.where(low.isin(*OCR_SUFFIXES)).select(_local("path").alias("path"), F.lit(0).alias("page"), F.lit(None).cast("string").alias("text"), "content")
    return ocr(pages, recognise)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def stamp(df: DataFrame, schema_id: str, version: int, producer: str, produced_at: str) -> DataFrame:
    return df.withColumns({"schema_id": F.lit(schema_id), "schema_version": F.lit(version), "producer": F.lit(producer), "produced_at": F.lit(produced_at)})


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with their keys in order; the committer makes the write whole or nothing."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def encrypt_lines(df: DataFrame, key: bytes) -> DataFrame:
    """One base64 line (AES-GCM) per row's JSON."""
    body = F.to_json(F.struct(*sorted(df.columns)))
    return df.select(F.base64(F.aes_encrypt(F.encode(body, "UTF-8"), F.lit(key))).alias("value"))


def decrypt_lines(lines: DataFrame, key: bytes, schema: str) -> DataFrame:
    """The rows of lines that are encrypted, or plain where they begin with a brace."""
    plain = F.col("value").startswith("{")
    body = F.when(plain, F.col("value")).otherwise(F.decode(F.try_aes_decrypt(F.unbase64(F.when(~plain, F.col("value"))), F.lit(key)), "UTF-8"))
    return lines.select(F.from_json(body, schema).alias("r")).select("r.*")


def append_encrypted(df: DataFrame, path: str, key: bytes) -> None:
    """Adds the rows to an encrypted store that is only ever appended to."""
    encrypt_lines(df, key).write.mode("append").text(path)


def read_store(spark: SparkSession, path: str, key: bytes, schema: str, document: str | None = None) -> DataFrame:
    """All rows of an encrypted store, or those of one ``document`` (column path)."""
    r = decrypt_lines(spark.read.text(path), key, schema)
    return r if document is None else r.where(F.col("path") == document)


def write_text(df: DataFrame, path: str, *, order: str = "line_no", line: str = "line") -> None:
    """A load file in parts, written by the executors: read in the order of their names, the parts are the file."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(line).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str, header: str | None = None) -> int:
    """A small file in one piece on the driver's machine, streamed partition by partition; the number of lines.

    For load files of a whole collection use ``write_text``.
    """
    tmp, n = Path(str(path) + ".tmp"), 0
    with tmp.open("w", encoding="utf-8") as f:
        if header is not None:
            f.write(header + "\n")
        for r in df.toLocalIterator():
            f.write(r[0] + "\n")
            n += 1
        f.flush()
        os.fsync(f.fileno())
    tmp.replace(path)
    return n


def archive(folder: str, to: str) -> str:
    """A zip of a folder with sorted entries and fixed times, the same for the same files."""
    base = Path(folder)
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(x for x in base.rglob("*") if x.is_file()):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(base)), (1980, 1, 1, 0, 0, 0)), p.read_bytes())
    return to


def json_in_text(text: str) -> dict:
    """The JSON object in a model's answer: as it is, in a fenced block, or from the first to the last brace."""
    tries = [text, *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)]
    if "{" in text:
        tries.append(text[text.index("{") : text.rindex("}") + 1] if "}" in text else "")
    for t in tries:
        try:
            out = json.loads(t)
            if isinstance(out, dict):
                return out
        except ValueError:
            continue
    raise ValueError("no JSON object in the text")
