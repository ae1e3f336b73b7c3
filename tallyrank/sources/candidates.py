"""Reading candidates and role descriptions."""

from __future__ import annotations

import io
import re
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.functions import columns as C
from tallyrank.operators.pool import HISTORY

SCHEMA = f"candidate_id string, name string, name_not_extracted boolean, current_title string, years_experience double, career_history {HISTORY}, skills_listed array<string>, last_active string, education string, location string, resume_text string, source_file string, _corrupt_record string"
REQUIRED = ("candidate_id", "name", "current_title", "resume_text")
#: The largest ZIP entry that is read.
MOST_BYTES = 256 << 20


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whichever file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array (or several) of candidates; a path that is not there gives an empty pool."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA).drop("_corrupt_record")
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").json(path, multiLine=True)
    return rows.filter("_corrupt_record is null").drop("_corrupt_record")


def validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): rows that have what a record needs, with defaults, and the others with the reason."""
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED)))
    told = rows.withColumn("missing_fields", lacking)
    good = told.filter(F.size("missing_fields") == 0)
    history = F.filter(F.coalesce("career_history", F.array().cast(HISTORY)), lambda j: j.isNotNull())
    good = good.select("candidate_id", "name", "current_title", F.coalesce("years_experience", F.lit(1.0)).alias("years_experience"), F.coalesce("skills_listed", F.array().cast("array<string>")).alias("skills_listed"), history.alias("career_history"), "last_active", "resume_text", *(c for c in ("education", "location") if c in told.columns))
    return good, told.filter(F.size("missing_fields") > 0)


def read_description(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def templates(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, content, seniority) of the text files of a folder; one stock template where there is none."""
    stock = spark.createDataFrame([("default", "Default", "Job Title: Software Engineer\nSeniority Level: Senior", "Senior")], "id string, name string, content string, seniority string")
    if not exists(spark, path):
        return stock
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select("value", F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("id"))
    low = F.lower("id")
    seniority = F.when(F.contains(low, F.lit("react")) | F.contains(low, F.lit("backend")), "Senior").when(F.contains(low, F.lit("ml")), "Lead").otherwise("Senior")
    found = files.select("id", F.initcap(F.translate("id", "_", " ")).alias("name"), F.col("value").alias("content"), seniority.alias("seniority"))
    return found.orderBy("id") if found.take(1) else stock


def zip_entries(files: DataFrame) -> DataFrame:
    """(archive, entry, content, error) of the PDFs in archives (path, content); one that can't be read has an error."""

    def run(frames):
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        for info in z.infolist():
                            name = info.orig_filename.replace("\\", "/")  # archives made on Windows
                            if not name.lower().endswith(".pdf") or name.rsplit("/", 1)[-1].startswith("._") or name.startswith("__MACOSX"):
                                continue
                            try:
                                if info.file_size > MOST_BYTES:
                                    raise ValueError("entry is too large")
                                rows.append((path, name, z.read(info), None))
                            except Exception as e:  # one bad entry leaves the others
                                rows.append((path, name, None, str(e)))
                except Exception as e:
                    rows.append((path, None, None, str(e)))
                yield pd.DataFrame(rows, columns=["archive", "entry", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "archive string, entry string, content binary, error string")


_STREAM = re.compile(rb"<<((?:(?!stream).)*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\[((?:[^\[\]()]|\((?:\\.|[^\\()])*\))*)\]\s*TJ|(\((?:\\.|[^\\()])*\))\s*(?:Tj|'|\")|(T\*|\b(?:T[dD]|ET)\b)", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)


def pdf_text(data: bytes) -> str | None:
    """The text that a PDF's pages show in one-byte fonts, a line for each move to another; plain and deflated streams are read. None where
    the bytes are no PDF; text in fonts with glyph numbers is not found."""
    if not data.startswith(b"%PDF"):
        return None
    special = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}

    def plain(m) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() and int(c[:1]) < 8 else special.get(c, b"" if c.strip() == b"" else c)

    shown = lambda s: _ESCAPE.sub(plain, s[1:-1])
    out: list[bytes] = []
    for head, body in _STREAM.findall(data):
        if b"/FlateDecode" in head:
            body = zlib.decompressobj().decompress(body)
        elif b"/Filter" in head:
            continue  # pictures and other codings
        if b"Tj" not in body and b"TJ" not in body:
            continue
        for several, one, move in _SHOWN.findall(body):
            out.append(b"\n" if move else b"".join(map(shown, _STRING.findall(several or one))))
    lines = b"".join(out).decode("cp1252", "replace").split("\n")
    return "\n".join(x.strip() for x in lines if x.strip()) or None


def extract_text(files: DataFrame, extractors: list | None = None) -> DataFrame:
    """Adds text, what the first extractor that finds any gives, and extract_errors, what the extractors before it failed with. An extractor
    takes bytes and gives text or None; ``pdf_text`` is the one there is."""
    tried = [pdf_text] if extractors is None else extractors

    @F.pandas_udf("struct<text string, errors array<string>>")
    def first(content: pd.Series) -> pd.DataFrame:
        def one(data):
            errors: list[str] = []
            for f in tried:
                try:
                    if data is not None and (text := f(bytes(data))) and text.strip():
                        return text, errors
                except Exception as e:  # the next one may do
                    errors.append(f"{getattr(f, '__name__', 'extractor')}: {str(e) or type(e).__name__}")
            return None, errors

        return pd.DataFrame([one(x) for x in content], columns=["text", "errors"])

    told = files.withColumn("__told", first("content"))
    return told.withColumns({"text": F.col("__told.text"), "extract_errors": F.col("__told.errors")}).drop("__told")


# fixed values: MIME types of archives and documents
MIME = {"application/pdf": "pdf", "application/zip": "zip", "application/x-zip-compressed": "zip", "application/json": "json"}


def read_candidates(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """By extension, or by ``format``, an extension or MIME type: a PDF or ZIP as files, anything else as JSON."""
    kind = MIME.get(format or "", format) or (path.rsplit(".", 1)[-1].lower() if "." in path else "json")
    if kind == "zip":
        return zip_entries(spark.read.format("binaryFile").load(path))
    if kind == "pdf":
        return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.regexp_extract("path", r"([^/]+)$", 1).alias("entry"), "content", F.lit(None).cast("string").alias("error"))
    return read_pool(spark, path)


def by_id(pool: DataFrame, wanted: str) -> DataFrame:
    found = pool.filter(F.col("candidate_id") == wanted).limit(1)
    if not found.take(1):
        raise LookupError(f"no candidate {wanted}")
    return found


def mentions(docs: DataFrame, keyword: str, text: str = "text") -> DataFrame:
    return docs.filter(F.contains(F.lower(text), F.lit(keyword.lower())))


def console_text(c):
    return C.plain_ascii(c)
