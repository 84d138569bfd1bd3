"""Writers (K1-K11)."""

from __future__ import annotations

import re
import tempfile
import zipfile
from collections.abc import Iterator
from itertools import chain, islice
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a sheet beside its header, names of the workbook format, characters that XML can't hold.
SHEET_ROWS = 1_048_575
_CONTENT = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE_NS = "http://schemas.openxmlformats.org/package/2006"
_UNSAVABLE = re.compile("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")


def write_buckets(df: DataFrame, path: str, max_rows: int = 1_000_000) -> None:
    """One table for all buckets. Rows are spread over the writers by bucket, in as many parts as its counted rows make
    files, so that files are few and no writer holds a hot bucket alone."""
    bucket = ["category_key", "brand_type"]
    parts = df.groupBy(*bucket).agg(F.ceil(F.count("*") / max_rows).alias("__parts"))
    by = F.pmod(F.xxhash64(*[c for c in df.columns if c not in ("product_embedding", "nutrition_information")]), F.coalesce("__parts", F.lit(1)))
    salted = df.join(parts, bucket, "left").withColumn("__part", by).drop("__parts").repartition(*bucket, "__part").drop("__part")
    salted.write.mode("overwrite").option("maxRecordsPerFile", max_rows).partitionBy("category_key", "brand_type").parquet(path)


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines; ``single`` makes one file, for small results only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON object (category map, translation cache)."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Files that hold one JSON array each, one a partition, as array readers want them; rows stream through."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = "["
        for batch in batches:
            rows = batch["value"].tolist()
            yield pd.DataFrame({"value": [f"{start if i == 0 else ','}{r}" for i, r in enumerate(rows)]})
            start = "," if rows else start
        yield pd.DataFrame({"value": ["[]" if start == "[" else "]"]})

    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInPandas(lines, "value string").write.mode("overwrite").text(path)


def cells_as_text(df: DataFrame) -> DataFrame:
    """Every cell as the text a report shows: booleans as ``True`` and ``False``, nested values as JSON, null empty."""
    def one(name: str, kind: str):
        if kind == "boolean":
            shown = F.when(F.col(f"`{name}`"), "True").when(~F.col(f"`{name}`"), "False")
        elif kind.startswith(("array", "struct", "map")):
            shown = F.to_json(F.col(f"`{name}`"))
        else:
            shown = F.col(f"`{name}`").cast("string")
        return F.coalesce(shown, F.lit("")).alias(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def write_report_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """``;`` CSV with header, quotes doubled, CRLF line ends, null and empty cells both empty."""
    out = cells_as_text(df)
    writer = (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("sep", ";").option("escape", '"').option("emptyValue", "").option("nullValue", "")
    writer.option("lineSep", "\r\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _sheet(names: list[str], rows: Iterator[list[str]], limit: int) -> Iterator[str]:
    """The XML of one sheet: the header and up to ``limit`` rows of texts."""
    cells = lambda values: "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_UNSAVABLE.sub("", v))}</t></is></c>' for v in values)
    yield f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_SHEET_NS}"><sheetData><row>{cells(names)}</row>'
    for row in islice(rows, limit):
        yield f"<row>{cells(row)}</row>"
    yield "</sheetData></worksheet>"


def write_xlsx(df: DataFrame, path: str, sheet_rows: int = SHEET_ROWS) -> int:
    """One workbook of texts with the header on every sheet; rows beyond ``sheet_rows`` go on to further sheets. Rows
    stream through the driver a partition at a time, as a workbook is one file. Returns the number of sheets."""
    texts = cells_as_text(df)
    rows = ([v for v in r] for r in texts.toLocalIterator())
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        n, first = 0, next(rows, None)
        while first is not None or n == 0:
            n += 1
            with book.open(f"xl/worksheets/sheet{n}.xml", "w", force_zip64=True) as sheet:
                for part in _sheet(texts.columns, chain([first], rows) if first is not None else iter(()), sheet_rows):
                    sheet.write(part.encode())
            first = next(rows, None)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_CONTENT}.worksheet+xml"/>' for i in range(1, n + 1))
        sheets = "".join(f'<sheet name="Sheet{i}" sheetId="{i}" r:id="rId{i}"/>' for i in range(1, n + 1))
        links = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE_NS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PACKAGE_NS}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_CONTENT}.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE_NS}/relationships"><Relationship Id="rId1" Type="{_OFFICE_NS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_SHEET_NS}" xmlns:r="{_OFFICE_NS}"><sheets>{sheets}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE_NS}/relationships">{links}</Relationships>')
    return n


def write_xlsx_file(df: DataFrame, folder: str, name: str) -> str:
    """A workbook on any file system: written beside the driver, then copied to ``folder``."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    with tempfile.TemporaryDirectory() as beside:
        write_xlsx(df, f"{beside}/{name}")
        target = fs.Path(folder, name)
        system = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        system.copyFromLocalFile(False, True, fs.Path(f"file:{beside}/{name}"), target)
    return f"{folder}/{name}"


def write_markdown(df: DataFrame, path: str) -> None:
    """A small metric table as one markdown file."""
    lines = df.sparkSession.createDataFrame([(line,) for line in markdown(df)], "value string")
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_translations(entries: DataFrame, path: str) -> None:
    """The translation cache ``original, translated`` as one JSON object; a word listed twice keeps its smallest entry."""
    one = entries.where("original is not null").groupBy("original").agg(F.min("translated").alias("translated"))
    one.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("original", "translated"))))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def progress(counts: dict[str, DataFrame]) -> DataFrame:
    """One row per named stage with its number of rows: the monitoring table."""
    out = None
    for name, df in counts.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        out = row if out is None else out.unionAll(row)
    return out


def markdown(df: DataFrame) -> Iterator[str]:
    """The lines of a table as markdown, every row; rows stream through the driver a partition at a time."""
    yield "| " + " | ".join(df.columns) + " |"
    yield "|" + " --- |" * len(df.columns)
    for r in df.toLocalIterator():
        yield "| " + " | ".join(str(v).replace("|", "\\|") for v in r) + " |"
