"""Tolerant scan of delimited text: encoding, separator and header row are found, all columns are text."""

from __future__ import annotations

import atexit
import csv
import re
import tempfile
import uuid
from contextlib import suppress
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.sources import workbook

SEPARATORS = (",", ";", "\t", "|")
PROBE_LINES = 50
#: Working tables that go when the program ends.
_LEFT: list[tuple[SparkSession, str]] = []
_LATIN = "".join(map(chr, range(0x80, 0xA0)))
_WESTERN = "".join(bytes([k]).decode("cp1252", "replace") for k in range(0x80, 0xA0))
#: Bytes that windows-1252 has no letter for.
_LATIN_KNOWN = "".join(chr(k) for k in range(0x80, 0xA0) if bytes([k]).decode("cp1252", "replace") != "�")
_WESTERN_KNOWN = "".join(bytes([ord(c)]).decode("cp1252") for c in _LATIN_KNOWN)
_UNUSED = "".join(chr(k) for k in range(0x80, 0xA0) if bytes([k]).decode("cp1252", "replace") == "�")


@dataclass
class ReadReport:
    encoding: str = "UTF-8"
    separator: str = ","
    header_row: int = 0
    columns: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    line_breaks_in_cells: bool = False
    damaged_accents: bool = False


def find_separator(lines: list[str]) -> str:
    """The separator with the highest least count over the lines, then the least spread."""
    def rank(sep: str) -> tuple[int, int]:
        n = [len(r) - 1 for r in csv.reader(lines, delimiter=sep)]
        return min(n, default=0), -(max(n, default=0) - min(n, default=0))

    return max(SEPARATORS, key=rank)


def _numeric(x: str) -> bool:
    try:
        float(x.replace(" ", "").replace(",", "."))
    except ValueError:
        return False
    return True


def find_header(rows: list[list[str]]) -> int:
    """The first of ten rows with 60 % of its cells (two at least) filled and at most 30 % of these numeric."""
    width = max(map(len, rows), default=0)
    for k, r in enumerate(rows[:10]):
        filled = [x for x in r if x.strip()]
        if len(filled) >= max(2, 0.6 * width) and sum(map(_numeric, filled)) <= 0.3 * len(filled):
            return k
    return 0


def repaired(names: list[str]) -> list[str]:
    """Blank names become ``colonne_k``; repeated ones get a number."""
    out: list[str] = []
    for k, n in enumerate(names, 1):
        n = n.strip().lstrip("﻿")
        n = f"colonne_{k}" if not n or n.startswith("Unnamed:") else n
        base, i = n, 2
        while n in out:
            n, i = f"{base}_{i}", i + 1
        out.append(n)
    return out


# Pairs of letters that a text in UTF-8 shows where it was read as windows-1252.
_DAMAGED = r"Ã[©¨ªàâ¯«»]|â€™|â€œ|Ã‰|Ã§"


def _bytes_as_letters(spark: SparkSession, path: str, line_end: str | None = None) -> DataFrame:
    """Lines, each byte as the letter of its number."""
    read = spark.read.option("lineSep", line_end) if line_end else spark.read
    return read.text(path).select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("value"), "_metadata")


def _utf16(spark: SparkSession, path: str) -> str | None:
    """UTF-16LE or UTF-16BE, where the first file begins with the mark of one."""
    first = spark.read.format("binaryFile").load(path).select(F.col("path")).orderBy("path").limit(1)
    names = [r.path for r in first.collect()]
    if not names:
        return None
    # The reader of lines keeps bytes as they are, and a mark is no valid UTF-8.
    line = spark.read.text(names[0]).limit(1).select(F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).alias("mark")).first()
    return {"FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}.get(line.mark) if line else None


@dataclass(frozen=True)
class _Lines:
    """What all lines of the files show."""

    encoding: str
    breaks: bool
    damaged: bool
    lone_returns: bool


def _lines_of(spark: SparkSession, path: str) -> _Lines:
    """The encoding that reads all lines, not a first few; whether a cell goes over several lines (a line has an odd number of quotes); whether accents are damaged."""
    if wide := _utf16(spark, path):
        return _Lines(wide, True, False, True)
    v = F.col("value")
    quotes = F.length(v) - F.length(F.replace(v, F.lit('"'), F.lit("")))
    body = F.when(F.endswith(v, F.lit("\r")), F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(v)
    r = spark.read.option("lineSep", "\n").text(path).agg(F.count_if(~F.is_valid_utf8(v)).alias("bad"), F.count_if(quotes % 2 == 1).alias("odd"), F.count_if(v.rlike(_DAMAGED)).alias("damaged"), F.count_if(F.contains(body, F.lit("\r"))).alias("returns")).first()
    if not r.bad:
        return _Lines("UTF-8", bool(r.odd), bool(r.damaged), bool(r.returns))
    unused = _bytes_as_letters(spark, path).agg(F.count_if(F.col("value").rlike(f"[{_UNUSED}]"))).first()[0]
    return _Lines("latin-1" if unused else "windows-1252", bool(r.odd), False, bool(r.returns))


def mended(c: Column) -> Column:
    """A text whose accents were damaged by reading UTF-8 as windows-1252, as it was before; others are left as they are."""
    back = F.decode(F.encode(F.translate(c, _WESTERN_KNOWN, _LATIN_KNOWN), "ISO-8859-1"), "UTF-8")
    narrow = ~F.translate(c, _WESTERN_KNOWN, _LATIN_KNOWN).rlike(r"[^\x00-\xFF]")
    bytes_ = F.encode(F.translate(c, _WESTERN_KNOWN, _LATIN_KNOWN), "ISO-8859-1")
    return F.when(c.rlike(_DAMAGED) & narrow & F.is_valid_utf8(bytes_.cast("string")), back).otherwise(c)


def _ends_open(line: Column, sep: str) -> Column:
    """1 if a line that begins outside a quoted cell ends inside one, else 0. Doubled quotes and whole quoted cells are taken out; what is left may open one."""
    s = re.escape(sep)
    bare = F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), rf'(^|{s})"[^"]*"(?={s}|\r?$)', "$1")
    return bare.rlike(rf'(^|{s})"').cast("int")


def _records(lines: DataFrame, sep: str) -> DataFrame:
    """(record, file, start, at): the records of files whose cells may hold line breaks, from (value, file, start, at), lines by where their block of the file starts.

    A line takes the state before it (outside or inside a quoted cell) to that
    after it; most lines set it or keep it, some turn it. So the state at a
    line is that set by the last line that sets it, turned as often as lines
    since then turn it: sums within each block, on top of what the blocks
    before it do. No task reads more than a block, and only the lines of
    records that have several are put together.
    """
    d = lines.withColumn("from_out", _ends_open(F.col("value"), sep)).withColumn("from_in", _ends_open(F.concat(F.lit('"'), "value"), sep))
    sets = F.col("from_out") == F.col("from_in")
    own = W.partitionBy("file", "start").orderBy("at")
    before = own.rowsBetween(W.unboundedPreceding, -1)
    turns = F.when(~sets & (F.col("from_out") == 1), 1).otherwise(0)
    d = d.withColumn("turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    d = d.withColumn("set", F.last(F.when(sets, F.struct(F.col("from_out").alias("to"), F.col("turned").alias("turned"))), ignorenulls=True).over(before))
    d = written(d.select("value", "file", "start", "at", "from_out", "from_in", "turned", "set"))
    state = lambda last, turned, incoming: F.when(last.isNull(), (incoming + turned) % 2).otherwise((last["to"] + turned - last["turned"]) % 2)
    # One row a block: what its last line makes of the state, and the last line that begins a record for either state.
    after = lambda x, incoming: F.when(x == 1, F.col("from_in")).otherwise(F.col("from_out"))
    in0, in1 = (state(F.col("set"), F.col("turned"), F.lit(k)) for k in (0, 1))
    ends = d.groupBy("file", "start").agg(*[F.max_by(after(x, k), "at").alias(f"to{k}") for k, x in enumerate((in0, in1))], *[F.max(F.when(x == 0, F.col("at"))).alias(f"begin{k}") for k, x in enumerate((in0, in1))])
    ends = ends.withColumn("turn", F.when((F.col("to0") == 1) & (F.col("to1") == 0), 1).otherwise(0))
    blocks = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("turned_b", F.coalesce(F.sum("turn").over(blocks), F.lit(0)))
    ends = ends.withColumn("set_b", F.last(F.when(F.col("to0") == F.col("to1"), F.struct(F.col("to0").alias("to"), F.col("turned_b").alias("turned"))), ignorenulls=True).over(blocks))
    ends = ends.withColumn("incoming", state(F.col("set_b"), F.col("turned_b"), F.lit(0)))
    ends = ends.withColumn("begin", F.when(F.col("incoming") == 1, F.col("begin1")).otherwise(F.col("begin0")))
    ends = ends.withColumn("open", F.last(F.when(F.col("begin").isNotNull(), F.struct("start", F.col("begin").alias("at"))), ignorenulls=True).over(blocks))
    d = d.join(F.broadcast(ends.select("file", "start", "incoming", "open")), ["file", "start"])  # a row a block
    inside = state(F.col("set"), F.col("turned"), F.col("incoming"))
    d = d.withColumn("inside", inside).withColumn("left_open", F.when(inside == 1, F.col("from_in")).otherwise(F.col("from_out")))
    whole = d.where("inside = 0 AND left_open = 0").select(F.col("value").alias("record"), "file", "start", "at")
    first = F.last(F.when(F.col("inside") == 0, F.struct("start", "at")), ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0))
    parts = d.withColumn("first", F.coalesce(first, F.col("open"))).where("inside = 1 OR left_open = 1")
    joined = parts.groupBy("file", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("start").alias("b"), "at", "value"))), lambda x: x["value"]), "\n").alias("record"))
    joined = joined.select("record", "file", F.col("first.start").alias("start"), F.col("first.at").alias("at"))
    out = whole.unionByName(joined)
    return out.withColumn("record", F.regexp_replace("record", "\r$", "")).where("trim(record) <> ''")


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, ReadReport]:
    """The table and what was found. Short rows are filled with null, rows with too many cells are left out, empty cells are null.

    Lines up to the header are left out once for each file, where it begins;
    rows that look like them further down are data. Where cells hold line
    breaks, records are put together by blocks of the file; a file in UTF-16, or
    with returns that end no line, is read by one task then. Damaged accents
    leave a note and are not mended, which ``mended`` does on request. Raises
    ValueError where there is no row.
    """
    found = _lines_of(spark, path)
    wide = found.encoding.startswith("UTF-16")
    report = ReadReport(encoding=found.encoding, line_breaks_in_cells=found.breaks and not wide)
    if wide:
        report.notes.append("S01_encoding")
        lines = [r[0] for r in spark.read.schema("value string").option("encoding", found.encoding).option("sep", "\x01").option("quote", "").option("multiLine", True).csv(path).limit(PROBE_LINES).collect()]
        report.line_breaks_in_cells = False
    elif found.encoding == "UTF-8":
        lines = [r.value for r in spark.read.text(path).limit(PROBE_LINES).collect()]
        if found.damaged:
            report.notes.append("S01_encoding")
            report.damaged_accents = True
    else:
        report.notes.append("S01_encoding")
        lines = [r[0] for r in _bytes_as_letters(spark, path).limit(PROBE_LINES).collect()]
    lines = [x for x in lines if x and x.strip()]
    if not lines:
        raise ValueError("B04_file_unreadable")
    report.separator = find_separator(lines[:20])
    if report.separator != ",":
        report.notes.append("S02_separator")
    rows = list(csv.reader(lines, delimiter=report.separator))
    report.header_row = find_header(rows)
    if report.header_row:
        report.notes.append("S04_header_offset")
    head = rows[report.header_row]
    width = max(len(head), 1)
    report.columns = repaired(head)
    if len({x.strip() for x in head}) < len(head) or not all(x.strip() for x in head):
        report.notes.append("S09_duplicate_headers")
    # One column more than the header has shows rows with too many cells.
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width + 1)])
    options = {"sep": report.separator, "nullValue": "", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    cells = [f"c{k}" for k in range(width + 1)]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")]
    if report.line_breaks_in_cells and not found.lone_returns:
        raw = spark.read.option("lineSep", "\n").text(path) if found.encoding == "UTF-8" else _bytes_as_letters(spark, path, "\n")
        # Options of from_csv are those of the reader.
        df = _records(raw.where("value IS NOT NULL").select("value", *place), report.separator)
        df = df.select(F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r"), "file", "start", "at").select("r.*", "file", "start", "at")
    else:
        encoding = found.encoding if wide else "UTF-8" if found.encoding == "UTF-8" else "ISO-8859-1"
        read = spark.read.schema(schema).options(**options).option("encoding", encoding).option("multiLine", wide or report.line_breaks_in_cells)
        df = read.csv(path).select(*cells, *place)
    tops = [[x.strip().lstrip("﻿") or None for x in r[: width + 1]] for r in rows[: report.header_row + 1]]
    which = F.coalesce(*[F.when(_is_row(r, width), F.lit(k)) for k, r in enumerate(tops)])
    first = df.withColumn("top", which).where("top IS NOT NULL AND start = 0").groupBy("file", "top").agg(F.min("at").alias("at")).select("file", "at")
    # A few rows for each file.
    df = df.where(F.col(f"c{width}").isNull()).join(first, ["file", "at"], "left_anti").select(*cells[:width])
    if report.encoding == "windows-1252":  # Spark's reader lacks it: the bytes where it differs from latin-1
        df = df.select(*[F.translate(c, _LATIN, _WESTERN).alias(c) for c in df.columns])
    return df.toDF(*report.columns), report


def _is_row(cells: list[str | None], width: int) -> Column:
    own = [F.nullif(F.regexp_replace(F.trim(F.col(f"c{k}")), "^﻿", ""), F.lit("")) for k in range(width + 1)]
    return reduce(lambda a, b: a & b, [c.eqNullSafe(F.lit(cells[k] if k < len(cells) else None)) for k, c in enumerate(own)])


def read_any(spark: SparkSession, source: str | bytes, name: str | None = None) -> tuple[DataFrame, ReadReport]:
    """A table from a path, or from the bytes of an uploaded file called ``name``; Excel files by their ending."""
    excel = (name or (source if isinstance(source, str) else "")).lower().endswith((".xlsx", ".xls", ".xlsm"))
    if excel:
        return read_excel(spark, source)
    if isinstance(source, bytes):
        path = f"{scratch_folder(spark)}/upload"
        spark.createDataFrame([(bytearray(source),)], "value binary").select(F.col("value").cast("string").alias("value")).coalesce(1).write.option("lineSep", "\n").text(path)
        source = path
    return scan(spark, source)


def read_excel(spark: SparkSession, source: str | bytes) -> tuple[DataFrame, ReadReport]:
    """The first sheet of a workbook, all columns text; workbooks are small, so the driver reads them, up to ``workbook.MOST_BYTES``."""
    return from_rows(spark, workbook.rows(source))


def from_rows(spark: SparkSession, rows: list[list[str]]) -> tuple[DataFrame, ReadReport]:
    """A table from the text cells of a sheet; blank rows are left out. Raises ValueError where there is none."""
    rows = [r for r in rows if any(x.strip() for x in r)]
    if not rows:
        raise ValueError("B04_file_unreadable")
    report = ReadReport(header_row=find_header(rows))
    if report.header_row:
        report.notes.append("S04_header_offset")
    head = rows[report.header_row]
    report.columns = repaired(head)
    body = [tuple(x or None for x in (r + [""] * len(head))[: len(head)]) for r in rows[report.header_row + 1 :]]
    return spark.createDataFrame(body, T.StructType([T.StructField(c, T.StringType()) for c in report.columns])), report


def read_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Delimited text with a header and known types, dates included; what doesn't read as its type is null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def view(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a view that SQL can name; nothing is read."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def described(df: DataFrame) -> DataFrame:
    """(position, column, type) of the columns."""
    return df.sparkSession.createDataFrame([(k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema)], "position int, column string, type string")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under the one all machines share; only a local session that has none gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallymark-")
    return f"{base.rstrip('/')}/scratch/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again: later steps start from its files. They go with that folder, or when the program ends."""
    path = f"{scratch_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    _LEFT.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_left() -> None:
    with suppress(Exception):  # the session may have been stopped
        for spark, path in _LEFT:
            if spark.sparkContext._jsc is None:
                return
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """Each row as one line of JSON text."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def sample_sales(spark: SparkSession, n_rows: int, seed: int = 0) -> DataFrame:
    """Synthetic orders of the benchmark's shape, made by all tasks."""
    cats = F.array(*[F.lit(f"cat{k}") for k in range(10)])
    cities = F.array(*[F.lit(f"city{k}") for k in range(8)])
    pick = lambda n, s: (F.floor(F.rand(seed + s) * n) + 1).cast("int")
    status = F.element_at(F.array(*([F.lit("livré")] * 17 + [F.lit(x) for x in ("annulé", "remboursé", "en cours")])), pick(20, 4))
    return spark.range(n_rows).select(
        F.format_string("C%09d", "id").alias("order_id"), F.format_string("CL%07d", F.floor(F.rand(seed) * max(1, n_rows // 3)).cast("long")).alias("customer_id"),
        F.date_add(F.lit("2022-01-01").cast("date"), pick(1000, 1) - 1).alias("date"), F.element_at(cats, pick(10, 2)).alias("categorie"), F.element_at(cities, pick(8, 3)).alias("ville"),
        status.alias("statut"), pick(5, 5).alias("quantite"), F.round(F.exp(F.randn(seed + 6) * 0.7 + 3.5), 2).alias("montant"),
    )
