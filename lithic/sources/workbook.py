"""Workbooks (.xlsx) as tables: validation, inspection, cells and sheets.

Files come in through Spark's ``binaryFile`` reader, so any file system that the cluster
reads will do. One task inflates a file, of capped size, and cuts the XML of each wanted
sheet before row tags into parts of ``PART`` bytes, without parsing it; the parts are dealt
out and parsed in parallel, and shared texts, cut the same way, are joined to the cells that
name them. Nothing but headers and column kinds, a row per column, reaches the driver.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions.types import cell

MOST_BYTES = 25 * 1024 * 1024
#: Bytes of XML that a task parses at once.
PART = 4 << 20
VERSION = "workbook/1"
# The signature of compound files, which is what encrypted workbooks are.
ENCRYPTED = "D0CF11E0A1B11AE1"
# Texts that stand for a missing cell.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Built-in number formats that show a date or a time.
DATE_FORMAT_IDS = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47))

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CELLS = "path string, sheet string, sheet_index int, row long, col int, kind string, value string, error string"


class BadWorkbookError(ValueError):
    """The file is missing, no workbook, or damaged."""


class PasswordProtectedError(BadWorkbookError):
    """The workbook is encrypted."""


def _texts(node: ET.Element) -> str:
    """All text of a string item but its phonetic hints."""
    return "".join(t.text or "" for part in node for t in ([part] if part.tag == MAIN + "t" else part.iter(MAIN + "t") if part.tag == MAIN + "r" else []))


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style, whether it shows numbers as dates."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {}
    for f in root.iter(MAIN + "numFmt"):
        plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", ""))
        own[int(f.get("numFmtId", "0"))] = re.search(r"[dmyhs]", plain.lower()) is not None
    styles = root.find(MAIN + "cellXfs")
    ids = [int(x.get("numFmtId", "0")) for x in styles] if styles is not None else []
    return [own.get(i, i in DATE_FORMAT_IDS) for i in ids]


def _moment(serial: float, late: bool) -> str:
    base = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30) if serial >= 60 else dt.datetime(1899, 12, 31)
    return (base + dt.timedelta(seconds=round(serial * 86400))).isoformat(sep=" ")


def _number(text: str) -> tuple[str, str]:
    try:
        return "int", str(int(text))
    except ValueError:
        x = float(text)
        return ("int", str(int(x))) if x.is_integer() and abs(x) < 2**53 else ("float", repr(x))


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def sheet_names(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each worksheet in order."""
    targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet"):
        part = targets[s.get(REL + "id")]
        out.append((s.get("name"), part.lstrip("/") if part.startswith("/") else posixpath.normpath("xl/" + part)))
    return out


PARTS = "path string, sheet string, sheet_index int, first long, part binary, dates binary, late boolean, error string"


def _cut(stream: io.BufferedIOBase, tag: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """(number of the element before, XML) of parts that begin with an element ``tag``, each with the namespaces of the whole.

    Elements count from 1, or as their attribute ``r`` says. A text that has declarations
    inside, or that is not UTF-8, is not cut.
    """
    opening = re.compile(rb"<(?:[\w.-]+:)?" + tag + rb"(?=[\s/>])[^>]*>")
    named = re.compile(rb"\sr=[\"'](\d+)")
    held, header, at = stream.read(size), None, 0
    whole = held.startswith((b"\xff\xfe", b"\xfe\xff")) or re.match(rb"[^>]*encoding=[\"'](?!utf-8)", held, re.I) is not None
    while True:
        more = stream.read(size)
        first = opening.search(held)
        if header is None and (first or not more):
            if whole or (first is None and not more):
                yield 0, held + more + stream.read()
                return
            header = b"<parts " + b" ".join(re.findall(rb"xmlns(?::[\w.-]+)?=(?:\"[^\"]*\"|'[^']*')", held[: first.start()])) + b">"
            held = held[first.start() :]
        if not more:
            break
        tags = list(opening.finditer(held)) if header else []
        if len(tags) > 1 and b"<!" not in held:
            yield at, header + held[: tags[-1].start()] + b"</parts>"
            for t in tags[:-1]:
                told = named.search(t[0])
                at = int(told[1]) if told else at + 1
            held = held[tags[-1].start() :]
        held += more
    end = re.search(rb"</(?:[\w.-]+:)?(?:sheetData|sst)\s*>", held)
    if end is None:
        raise ValueError("the sheet breaks off")
    yield at, header + held[: end.start()] + b"</parts>"


def _split(want: str, only: str | None = None):
    """Parts of the worksheets of files, or of one sheet of each, or of their shared texts; and a row per file with its error, if any."""
    size = PART

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARTS.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                error = None
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as book:
                        if want == "texts":
                            wanted = [("", -1, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
                        else:
                            wanted = [(n, i, part) for i, (n, part) in enumerate(sheet_names(book)) if only in (None, n)]
                        props = ET.fromstring(book.read("xl/workbook.xml")).find(MAIN + "workbookPr")
                        late = props is not None and props.get("date1904") in ("1", "true")
                        dates = bytes(_date_styles(book))
                        for name, index, part in wanted:
                            with book.open(part) as stream:
                                for first, xml in _cut(stream, b"si" if want == "texts" else b"row", size):
                                    yield pd.DataFrame([(path, name, index, first, xml, dates, late, None)], columns=names)
                except FAULTS as e:
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame([(path, None, None, None, None, None, None, error)], columns=names)

    return step


#: What a damaged file raises.
FAULTS = (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError, EOFError, zlib.error, NotImplementedError)


def read_part(xml: bytes, first: int, dates: bytes, late: bool) -> Iterator[tuple[int, int, str, str]]:
    """(row, column, kind, value) of every cell with a value, rows and columns from 1; of kind ``shared`` the value is a number."""
    at_row = first
    for _, row in ET.iterparse(io.BytesIO(xml)):
        if row.tag != MAIN + "row":
            continue
        at_row = int(row.get("r", at_row + 1))
        at_col = 0
        for c in row:
            at_col = _column(c.get("r", "")) or at_col + 1
            kind, raw = c.get("t", "n"), c.find(MAIN + "v")
            if kind == "inlineStr":
                item = c.find(MAIN + "is")
                if item is not None:
                    yield at_row, at_col, "text", _texts(item)
            elif raw is not None and raw.text is not None:
                if kind == "s":
                    yield at_row, at_col, "shared", str(int(raw.text))
                elif kind == "b":
                    yield at_row, at_col, "bool", "True" if raw.text == "1" else "False"
                elif kind == "n":
                    style = int(c.get("s", "0"))
                    if style < len(dates) and dates[style]:
                        yield at_row, at_col, "date", _moment(float(raw.text), late)
                    else:
                        yield at_row, at_col, *_number(raw.text)
                elif kind == "d":
                    yield at_row, at_col, "date", raw.text.replace("T", " ").rstrip("Z")
                else:
                    yield at_row, at_col, "text", raw.text
        row.clear()


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CELLS.split(", ")]
    for batch in batches:
        for p in batch.itertuples():
            rows, error = [], p.error
            if p.part is not None:
                try:
                    for cell in read_part(bytes(p.part), int(p.first), bytes(p.dates), bool(p.late)):
                        rows.append((p.path, p.sheet, p.sheet_index, *cell, None))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except FAULTS as e:
                    error = f"{type(e).__name__}: {e}"
            if p.part is None or error is not None:
                rows.append((p.path, None, None, None, None, None, None, error))
            yield pd.DataFrame(rows, columns=names)


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, number, text) of shared texts; a damaged table gives none, so that its cells are found to lack their texts."""
    for batch in batches:
        for p in batch.itertuples():
            if p.part is not None:
                try:
                    texts = [_texts(x) for _, x in ET.iterparse(io.BytesIO(bytes(p.part))) if x.tag == MAIN + "si"]
                except ET.ParseError:
                    continue
                yield pd.DataFrame({"_path": p.path, "number": range(int(p.first), int(p.first) + len(texts)), "text": texts})


# Kinds of files that uploads may have, with what their first bytes show.
WORKBOOK_MIME = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
ATTACHMENTS = (
    ("application/pdf", ".pdf", "255044462D"), ("image/png", ".png", "89504E470D0A1A0A"), ("image/jpeg", ".jpg", "FFD8FF"), ("image/jpeg", ".jpeg", "FFD8FF"),
    ("image/gif", ".gif", "47494638"), ("image/webp", ".webp", "52494646"),
)
MOST_ATTACHED = 32 * 1024 * 1024


def attachments(found: DataFrame) -> DataFrame:
    """(path, size_bytes, mime, family, problem) of files (path, length, content): pdf and images up to 32 MB.

    A name and the first bytes must tell of the same kind.
    """
    head, name = F.hex(F.substring("content", 1, 12)), F.lower("path")
    named = mime = F.lit(None).cast("string")
    for kind, ending, start in ATTACHMENTS:
        shown = head.startswith(start) & (head.endswith("57454250") if kind == "image/webp" else F.lit(True))
        named, mime = F.when(name.endswith(ending), kind).otherwise(named), F.when(shown, kind).otherwise(mime)
    problem = (
        F.when(F.col("length") == 0, "empty file")
        .when(F.col("length") > MOST_ATTACHED, f"larger than {MOST_ATTACHED} bytes")
        .when(mime.isNull() | named.isNull(), "unknown kind of file")
        .when(mime != named, "name and contents differ")
    )
    family = F.when(mime == "application/pdf", "document").when(mime.isNotNull(), "image")
    return found.select("path", F.col("length").alias("size_bytes"), mime.alias("mime"), family.alias("family"), problem.alias("problem"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256, encrypted, problem): validity of workbook files, without parsing them."""
    found = spark.read.format("binaryFile").load(path)
    encrypted = F.hex(F.substring("content", 1, 8)) == ENCRYPTED
    problem = (
        F.when(~F.lower("path").endswith(".xlsx"), "only .xlsx files are read")
        .when(F.col("length") == 0, "empty file")
        .when(F.col("length") > MOST_BYTES, f"larger than {MOST_BYTES} bytes")
        .when(encrypted, "password protected")
        .when(F.hex(F.substring("content", 1, 4)) != "504B0304", f"not of kind {WORKBOOK_MIME}")
    )
    return found.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), encrypted.alias("encrypted"), problem.alias("problem"))


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose fingerprint is not among ``known.file_sha256``."""
    return found.join(known.select(F.col("file_sha256").alias("_sha")), F.col("sha256") == F.col("_sha"), "left_anti")


def cells(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """All cells of the workbooks under a path, or of one sheet of each, and a row without a sheet per file that holds its error, if any.

    A file above MOST_BYTES is not parsed; its size is its error.
    """
    found = spark.read.format("binaryFile").load(path)
    large = found.where(F.col("length") > MOST_BYTES).select("path")
    fields = [c.split() for c in CELLS.split(", ")]
    said = {"path": F.col("path"), "error": F.lit(f"larger than {MOST_BYTES} bytes")}
    refused = large.select(*[said.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])
    small = found.where(F.col("length") <= MOST_BYTES).select("path", "content")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = small.mapInPandas(_split("cells", only), PARTS).repartition(tasks, "path", "sheet_index", "first").mapInPandas(_parse, CELLS)
    texts = small.mapInPandas(_split("texts"), PARTS).repartition(tasks, "path", "first").mapInPandas(_shared, "_path string, number long, text string")
    number = F.when(F.col("kind") == "shared", F.col("value").cast("long"))
    named = told.withColumn("_number", number).join(texts, (F.col("path") == F.col("_path")) & (F.col("_number") == F.col("number")), "left")
    lost = F.col("_number").isNotNull() & F.col("number").isNull()
    value = F.when(F.col("_number").isNotNull(), F.col("text")).otherwise(F.col("value"))
    error = F.when(lost, F.concat(F.lit("no shared text "), F.col("value"))).otherwise(F.col("error"))
    named = named.select("path", "sheet", "sheet_index", "row", "col", F.when(F.col("kind") == "shared", "text").otherwise(F.col("kind")).alias("kind"), value.alias("value"), error.alias("error"))
    return named.unionByName(refused)


def checked(spark: SparkSession, path: str) -> str:
    """The path of sound workbooks; raises what is wrong with the first that is not."""
    try:
        found = files(spark, path)
        bad = found.where("encrypted OR problem IS NOT NULL").orderBy("path").limit(1).collect()
        if not bad and not found.take(1):
            raise BadWorkbookError(f"no file at {path}")
    except AnalysisException as e:
        raise BadWorkbookError(f"no file at {path}") from e
    if bad and bad[0].encrypted:
        raise PasswordProtectedError(bad[0].path)
    if bad:
        raise BadWorkbookError(f"{bad[0].path}: {bad[0].problem}")
    return path


def _raise_errors(all_cells: DataFrame) -> None:
    bad = all_cells.where("error IS NOT NULL").select("path", "error").limit(1).collect()
    if bad:
        raise BadWorkbookError(f"{bad[0].path}: {bad[0].error}")


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, row_count, column_count): rows with a non-empty cell, the header among them, and the last such column.

    A cell with spaces only is not empty. Sheets without cells have zero rows and columns.
    """
    found = cells(spark, checked(spark, path)).persist()
    _raise_errors(found)
    filled = found.where("sheet IS NOT NULL AND value <> ''")
    wide = filled.groupBy("sheet_index", "sheet", "row").agg(F.max("col").alias("w"))
    counted = wide.groupBy("sheet_index", "sheet").agg(F.count("*").alias("row_count"), F.max("w").cast("long").alias("column_count"))
    every = spark.createDataFrame([(i, n) for i, n in enumerate(_names(spark, path))], "sheet_index int, sheet string")
    out = every.join(counted, ["sheet_index", "sheet"], "left").na.fill(0, ["row_count", "column_count"])
    return out.orderBy("sheet_index").select("sheet", "row_count", "column_count")


def _names(spark: SparkSession, path: str) -> list[str]:
    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as book:
                    yield pd.DataFrame([(i, n) for i, (n, _) in enumerate(sheet_names(book))], columns=["i", "name"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "i int, name string")
    return [r.name for r in found.orderBy("i").collect()]


def _headers(first: dict[int, str], width: int) -> list[str]:
    """Column names: blanks get a numbered name, repeated names a suffix."""
    out, seen = [], set()
    for i in range(width):
        base = first.get(i + 1) or f"Unnamed: {i}"
        name, n = base, 0
        while name in seen:
            n += 1
            name = f"{base}.{n}"
        seen.add(name)
        out.append(name)
    return out


def sheets(spark: SparkSession, path: str, only: str | None = None, default_na: bool = True) -> dict[str, DataFrame]:
    """Every sheet (or one) as a DataFrame with ``_row_index`` from 0; the first row names the columns.

    A column takes a type if all its cells agree (whole numbers, numbers, booleans, dates),
    else it holds display texts. Texts that stand for a missing value are null.
    """
    found = cells(spark, checked(spark, path), only).persist()
    _raise_errors(found)
    names = _names(spark, path)
    if only is not None and only not in names:
        raise ValueError(f"unknown sheet {only!r}")
    missing = (F.col("kind") == "text") & F.col("value").isin(*(MISSING if default_na else ("",)))
    body = found.where((F.col("row") > 1) & ~missing)
    facts = body.groupBy("sheet", "col").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.max("row").alias("last"))
    kinds = {(r.sheet, r.col): (tuple(r.kinds), r.last) for r in facts.collect()}
    heads: dict[str, dict[int, str]] = {}
    for r in found.where("row = 1").select("sheet", "col", "value").collect():
        heads.setdefault(r.sheet, {})[r.col] = r.value
    types = {("int",): "bigint", ("float",): "double", ("float", "int"): "double", ("bool",): "boolean", ("date",): "timestamp"}
    out = {}
    for name in names if only is None else [only]:
        own = {c: k for (s, c), k in kinds.items() if s == name}
        width = max([*heads.get(name, {}), *own], default=0)
        columns = _headers(heads.get(name, {}), width)
        last = max((k[1] for k in own.values()), default=1)
        wide = found.where((F.col("sheet") == name) & (F.col("row") > 1) & ~missing).groupBy("row").agg(*[F.max(F.when(F.col("col") == i + 1, F.col("value"))).alias(f"_c{i}") for i in range(width)]) if width else None
        rows = spark.range(2, last + 1).withColumnRenamed("id", "row")
        if wide is not None:
            rows = rows.join(wide, "row", "left")
        picked = [F.col(f"_c{i}").cast(types.get(own.get(i + 1, (("text",), 0))[0], "string")).alias(c) for i, c in enumerate(columns)]
        out[name] = rows.select((F.col("row") - 2).alias("_row_index"), *picked)
    return out


def rows_at(sheet: DataFrame, indices: list[int]) -> DataFrame:
    """The rows with the given positions, in that order; positions outside the sheet are left out."""
    spark = sheet.sparkSession
    wanted = spark.createDataFrame(list(enumerate(indices)), "_turn int, _row_index long")
    shown = [F.date_format(cell(c), "yyyy-MM-dd").alias(c) if t in ("timestamp", "timestamp_ntz", "date") else cell(c) for c, t in sheet.dtypes]
    asked = sheet.where(F.col("_row_index").isin(indices)) if indices else sheet.limit(0)
    return asked.select(*shown).join(wanted, "_row_index").orderBy("_turn").drop("_turn")
