"""Journal rankings: SJR (CSV), Qualis (XLSX or CSV), JQL (CSV or positional spans)."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.identifiers import normalize_issn

# Column names of the published files.
SJR_COLUMNS = {
    "Title": "title",
    "SJR": "sjr_score",
    "SJR Best Quartile": "quartile",
    "H index": "h_index",
    "Country": "country",
    "Areas": "area",
    "Type": "type",
    "Publisher": "publisher",
}
JQL_COLUMNS = {
    "journal": "title",
    "subject": "subject",
    "ft2016": "ft50",
    "cnrs2020": "cnrs",
    "hceres2021": "hceres",
    "ajg_abs2024": "abs",
    "abdc2025": "abdc",
    "fnege2025": "fnege",
    "vhb2024": "vhb",
    "scopus2024": "scopus_citescore",
}
# Left edge of each column of the printed table; what its header and footer rows begin with or are; an entry's number.
JQL_EDGES = {
    "issn": 0,
    "journal": 55,
    "subject": 234,
    "ft2016": 287,
    "cnrs2020": 310,
    "den2021": 335,
    "hceres2021": 358,
    "meta2023": 385,
    "ajg_abs2024": 410,
    "ejl2024": 436,
    "scopus2024": 458,
    "vhb2024": 488,
    "abdc2025": 516,
    "fnege2025": 542,
}
JQL_SKIP_PREFIXES = ["ISSN", "Journal", "Subject", "Harzing", "Professor", "Journal Quality", "©", "Page"]
JQL_SKIP_ROWS = ["1=Y", "1*-4", "highest to", "lowest]", "[Range"]
JQL_ISSN = r"^\d{4}-\d{3}[\dX](?:\s+|$)"


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def last_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row a key: that of the greatest position."""
    order = W.partitionBy(key).orderBy(F.col(position).desc())
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def sjr_index(raw: DataFrame, position: str) -> DataFrame:
    """One row an ISSN, as the last line that names it has it; ``position`` orders the lines."""
    names = {v: F.trim(_text(k)) if v == "title" else _text(k) if k in raw.columns else F.lit("") for k, v in SJR_COLUMNS.items()}
    issns = F.posexplode(F.split(_text("Issn"), ",")).alias("at", "_issn")
    rows = raw.where(F.trim(_text("Issn")) != "").select(F.col(position).alias("pos"), *[c.alias(k) for k, c in names.items()], issns)
    rows = rows.withColumn("issn", normalize_issn(F.col("_issn"))).where("issn <> ''")
    rows = rows.withColumn("pos", F.struct("pos", "at"))
    return last_wins(rows, "issn", "pos").select("issn", *names, F.col("pos.pos").alias("pos"))


def sjr_names(raw: DataFrame, position: str) -> DataFrame:
    """(name, issn, first_pos): lower-cased title, first ISSN of its last line, place of its first line."""
    rows = raw.where((F.trim(_text("Issn")) != "") & (F.trim(_text("Title")) != "")).select(
        F.lower(F.trim(_text("Title"))).alias("name"), normalize_issn(F.get(F.split(_text("Issn"), ","), 0)).alias("issn"), F.col(position).alias("pos")
    )
    return _names(rows)


def _names(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.max_by("issn", "pos").alias("issn"), F.min("pos").alias("first_pos"))


def _in_file_order(raw: DataFrame) -> DataFrame:
    """The lines with their place, ``pos``: by file, block and line, over a file or a folder of them.

    The numbering is one task's: a ranking file has some 100,000 lines.
    """
    lines = raw.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})
    numbered = lines.withColumn("pos", (F.row_number().over(W.orderBy("_file", "_block", "_line")) - 1).cast("bigint"))
    return numbered.drop("_file", "_block", "_line")


def read_sjr(spark: SparkSession, path: str) -> DataFrame:
    """The semicolon CSV with a ``pos`` column in file order."""
    return _in_file_order(spark.read.option("sep", ";").option("header", True).csv(path))


def qualis_columns(headers: list[str]) -> dict[str, str]:
    """Which header holds what: the first that contains the telling part of its name."""
    low = {h: h.lower() for h in headers}
    find = lambda f: next((h for h in headers if f(low[h])), None)
    found = {
        "issn": find(lambda h: "issn" in h),
        "title": find(lambda h: "tulo" in h or "title" in h),
        "classification": find(lambda h: "estrato" in h or "qualis" in h),
        "area": find(lambda h: "rea" in h and len(h) > 2),
    }
    return {k: v for k, v in found.items() if v is not None}


def qualis_index(raw: DataFrame, position: str) -> DataFrame:
    """One row an ISSN, as its last line has it; empty without a column for ISSNs."""
    at = qualis_columns([c for c in raw.columns if c != position])
    get = lambda k: _text(at[k]) if k in at else F.lit("")
    issn = normalize_issn(get("issn"))
    rows = raw.select(issn.alias("issn"), get("title").alias("title"), get("classification").alias("classification"), get("area").alias("area"), F.col(position).alias("pos"))
    return last_wins(rows.where((F.col("issn") != "") & (F.lower("issn") != "nan")), "issn", "pos")


def jql_index(raw: DataFrame, position: str) -> DataFrame:
    """One row an ISSN, as its last line has it, under the canonical names."""
    columns = [(_text(k) if k in raw.columns else F.lit("")).alias(v) for k, v in JQL_COLUMNS.items()]
    rows = raw.where(F.trim(_text("issn")) != "").select(normalize_issn(_text("issn")).alias("issn"), *columns, F.col(position).alias("pos"))
    return last_wins(rows, "issn", "pos")


def jql_names(raw: DataFrame, position: str) -> DataFrame:
    rows = raw.where((F.trim(_text("issn")) != "") & (F.trim(_text("journal")) != "")).select(
        F.lower(F.trim(_text("journal"))).alias("name"), normalize_issn(_text("issn")).alias("issn"), F.col(position).alias("pos")
    )
    return _names(rows)


def read_jql(spark: SparkSession, path: str) -> DataFrame:
    return _in_file_order(spark.read.option("header", True).csv(path))


# --- XLSX without a spreadsheet library -----------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _cells(raw: bytes) -> list[list[str]]:
    """Rows of a workbook's first sheet as strings."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")) for item in root.findall("m:si", _NS)]
        sheet = sorted(n for n in book.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n))[0]
        rows = []
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{{{_NS['m']}}}row"):
            out: list[str] = []
            for cell in row.findall("m:c", _NS):
                letters = re.match(r"[A-Z]+", cell.get("r", "")) or None
                place = len(out)
                if letters:
                    place = 0
                    for ch in letters[0]:
                        place = place * 26 + ord(ch) - 64
                    place -= 1
                out += [""] * (place - len(out))
                value = cell.find("m:v", _NS)
                if cell.get("t") == "s" and value is not None:
                    out.append(shared[int(value.text)])
                elif cell.get("t") == "inlineStr":
                    out.append("".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")))
                else:
                    out.append(value.text or "" if value is not None else "")
            rows.append(out)
    return rows


def qualis_rows(books: DataFrame) -> DataFrame:
    """The first sheet of workbooks (a binary column ``content``) as (pos, issn, titulo, estrato, area) rows, one a line.

    A book is read by one task; the headers tell which column holds what.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for raw in pdf["content"]:
                cells = _cells(raw)
                at = qualis_columns(cells[0]) if cells else {}
                places = {k: cells[0].index(h) for k, h in at.items()}
                for i, row in enumerate(cells[1:]):
                    get = lambda k, row=row: row[places[k]] if k in places and places[k] < len(row) else ""
                    out.append((i, get("issn"), get("title"), get("classification"), get("area")))
            yield pd.DataFrame(out, columns=["pos", "issn", "titulo", "estrato", "area"])

    return books.select("content").mapInPandas(run, "pos bigint, issn string, titulo string, estrato string, area string")


def read_qualis_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a workbook, or of a folder of them, read as binary files on the executors."""
    return qualis_rows(spark.read.format("binaryFile").load(path))


# --- JQL from positional spans --------------------------------------------

def _column_of(x: Column) -> Column:
    """The table's column at a left edge (half-open bins; the last one beyond all)."""
    out = F.lit("issn")
    for name, edge in JQL_EDGES.items():
        out = F.when(x >= edge, F.lit(name)).otherwise(out)
    return F.when(x < 0, F.lit("fnege2025")).otherwise(out)


def row_groups(spans: DataFrame, gap: float = 3.0) -> DataFrame:
    """(page, row, at, x, text): spans grouped in rows by the height of each row's first span.

    A span starts a new row if it is more than ``gap`` from the first span of
    the current one, so the grouping is a fold over a page in order, not a
    difference between neighbours.  Spans are ordered by rounded height, so
    within one height only those above all earlier ones can start a row (if
    ``gap`` is at least the rounding's width of 1; else any of them can): the
    fold reads these alone, and spans meet by page and height.
    """
    own = W.partitionBy("page", "h").orderBy("x", "y", "text")
    s = spans.where(F.trim("text") != "").select("page", F.bround("y", 0).alias("h"), "x", "y", F.trim("text").alias("text")).withColumn("n", F.row_number().over(own))
    highest = F.max("y").over(own.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("some", (F.col("n") == 1) | (F.coalesce(F.col("y") > highest, F.lit(False)) if gap >= 1 else F.lit(True)))
    marks = s.where("some").groupBy("page").agg(F.sort_array(F.collect_list(F.struct("h", "n", F.col("y").cast("double").alias("y")))).alias("marks"))
    starts = F.filter("marks", lambda m: F.lit(False))
    zero = F.struct(F.lit(None).cast("double").alias("y"), F.lit(True).alias("first"), starts.alias("starts"))

    def step(a: Column, m: Column) -> Column:
        new = a["first"] | (m["y"].isNotNull() & F.coalesce(F.abs(m["y"] - a["y"]) > gap, F.lit(True)))
        return F.struct(F.when(new, m["y"]).otherwise(a["y"]).alias("y"), F.lit(False).alias("first"), F.when(new, F.array_append(a["starts"], m)).otherwise(a["starts"]).alias("starts"))

    begins = marks.select("page", F.explode(F.aggregate("marks", zero, step, lambda a: a["starts"])).alias("m")).groupBy("page", "m.h").agg(F.collect_list("m.n").alias("starts"))
    heights = s.groupBy("page", "h").agg(F.count("*").alias("spans"))
    none = F.array().cast("array<int>")
    same = lambda a, b: a["page"].eqNullSafe(b["page"]) & a["h"].eqNullSafe(b["h"])
    heights = heights.join(begins, same(heights, begins), "left").select(heights["page"], heights["h"], "spans", F.coalesce("starts", none).alias("starts"))
    before = W.partitionBy("page").orderBy("h").rowsBetween(W.unboundedPreceding, -1)
    held = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    places = heights.select(F.col("page").alias("p"), F.col("h").alias("g"), "starts", held(F.col("spans")).alias("at0"), held(F.size("starts")).alias("row0"))
    out = s.join(places, F.col("page").eqNullSafe(F.col("p")) & F.col("h").eqNullSafe(F.col("g")))
    row = F.col("row0") + F.size(F.filter("starts", lambda i: i <= F.col("n"))) - 1
    return out.select("page", row.alias("row"), (F.col("at0") + F.col("n") - 1).alias("at"), "x", "text")


def jql_from_spans(spans: DataFrame) -> DataFrame:
    """Journal rows of the printed table: header and footer rows go, continuation rows join their entry."""
    rows = row_groups(spans)
    first = F.min_by("text", "at")
    begins = F.bool_or((F.col("x") < 55) & F.col("text").rlike(JQL_ISSN))
    about = rows.groupBy("page", "row").agg(first.alias("first"), begins.alias("begins"))
    skip = F.lit(False)
    for p in JQL_SKIP_PREFIXES:
        skip = skip | F.col("first").startswith(p)
    skip = skip | F.col("first").isin(JQL_SKIP_ROWS) | F.col("first").rlike(r"^\d+ of \d+$")
    about = about.where(~skip)
    # a printed list is small; the order of its rows is global
    about = about.withColumn("entry", F.sum(F.col("begins").cast("int")).over(W.orderBy("page", "row").rowsBetween(W.unboundedPreceding, 0)))
    cells = rows.join(about.where("entry > 0"), ["page", "row"]).withColumn("col", _column_of(F.col("x")))
    issn = F.regexp_extract("text", r"^(\d{4}-\d{3}[\dX])(?:\s+|$)", 1)
    rest = F.regexp_replace("text", JQL_ISSN, "")
    starts = F.col("begins") & (F.col("col") == "issn") & (issn != "")
    cells = cells.withColumn("issn", F.when(starts, issn)).withColumn("text", F.when(starts, rest).otherwise(F.col("text")))
    cells = cells.withColumn("col", F.when(F.col("col") == "issn", "journal").otherwise(F.col("col")))
    # ratings stand in an entry's first row only
    cells = cells.where(F.col("begins") | F.col("col").isin("journal", "subject"))
    order = F.struct("page", "row", "at", "text")
    joined = lambda c: F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("col") == c) & (F.col("text") != ""), order))), lambda s: s["text"]), " "))
    names = [c for c in JQL_EDGES if c != "issn"]
    out = cells.groupBy("entry").agg(F.coalesce(F.max("issn"), F.lit("")).alias("issn"), *[joined(c).alias(c) for c in names])
    return out.select(F.col("entry").alias("pos"), "issn", *names)


def write_jql(df: DataFrame, path: str) -> None:
    """The CSV that read_jql() reads."""
    df.drop("pos").write.mode("overwrite").option("header", True).csv(path)


# --- snapshots -------------------------------------------------------------

def update_snapshots(spark: SparkSession, folder: str, sjr: str | None = None, qualis: str | None = None, jql: str | None = None) -> list[str]:
    """Rewrite the ranking tables under ``folder`` from new files; returns the names of those rewritten.

    Qualis is a workbook (or folder of them), the others are CSV files.  A
    table that no file is given for stays as it is.
    """
    done = []

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        done.append(name)

    if sjr:
        raw = read_sjr(spark, sjr)
        write(sjr_index(raw, "pos"), "sjr")
        write(sjr_names(raw, "pos"), "sjr_names")
    if qualis:
        write(qualis_index(read_qualis_xlsx(spark, qualis), "pos"), "qualis")
    if jql:
        raw = read_jql(spark, jql)
        write(jql_index(raw, "pos"), "jql")
        write(jql_names(raw, "pos"), "jql_names")
    return done
