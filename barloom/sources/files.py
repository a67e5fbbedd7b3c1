"""Bars and tables from CSV, Parquet and databases, and tables to CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.store import Fetch

TIME_COLUMNS = ("date", "timestamp", "time")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header; the first of TIME_COLUMNS that is there becomes ts."""
    if path.rstrip("/").endswith(".csv"):
        # a fixed type for all columns saves the extra pass of schema inference; numbers are cast by name
        df = spark.read.option("header", True).csv(path)
        numbers = ("open", "high", "low", "close", "volume", "quote_volume", "n_trades", "taker_buy_base_vol", "taker_buy_quote_vol")
        df = df.withColumns({c: F.col(c).try_cast("double") for c in df.columns if c.lower() in numbers})
    else:
        df = spark.read.parquet(path)
    by_lower = {c.lower(): c for c in df.columns}
    found = next((by_lower[c] for c in TIME_COLUMNS if c in by_lower), None)
    if found is None or "ts" in df.columns:
        return df
    return df.withColumn(found, F.col(f"`{found}`").try_cast("timestamp_ntz")).withColumnRenamed(found, "ts")


def jdbc(spark: SparkSession, url: str, table: str, parts: int = 16, **options: str) -> Fetch:
    """A source of raw bars in a database table with series_id, period, ts and prices.

    Series, period and time range are pushed down, and the range is read in `parts` slices of equal length.
    """

    def fetch(symbol: str, period: str, start: str, end: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
        if start < end:
            reader = reader.option("partitionColumn", "ts").option("lowerBound", start).option("upperBound", end).option("numPartitions", parts)
        df = reader.load()
        at = lambda t: F.lit(t).cast(df.schema["ts"].dataType)
        df = df.where((F.col("series_id") == symbol) & (F.col("period") == period) & (F.col("ts") >= at(start)) & (F.col("ts") <= at(end)))
        return df.drop("period").withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    return fetch


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one_file is for reports, whose size the caller knows."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


# ---- Excel -----------------------------------------------------------------------------------------------------------

_NS = {"x": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
EXCEL_ROWS = 1_048_575  # what a sheet holds beneath its heading


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def read_excel(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """A sheet whose first row names the columns; columns of numbers alone are DOUBLE, others STRING. A sheet is small and read on the driver."""
    import io
    import zipfile
    from xml.etree import ElementTree as X

    book = zipfile.ZipFile(io.BytesIO(bytes(spark.read.format("binaryFile").load(path).first()["content"])))
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{{{_NS['x']}}}t"))
    shared = [text(i) for i in X.fromstring(book.read("xl/sharedStrings.xml")).findall("x:si", _NS)] if "xl/sharedStrings.xml" in book.namelist() else []
    rows: list[dict[int, str]] = []
    for row in X.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{{{_NS['x']}}}row"):
        cells: dict[int, str] = {}
        for k, c in enumerate(row.findall("x:c", _NS)):
            at, value = _column(c.get("r")) if c.get("r") else k, c.find("x:v", _NS)
            if c.get("t") == "inlineStr":
                cells[at] = text(c)
            elif value is not None and value.text is not None:
                cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
        rows.append(cells)
    names = rows[0] if rows else {}
    columns = {k: [r.get(k) for r in rows[1:]] for k in sorted(names)}

    def numbers(values: list[str | None]) -> list | None:
        try:
            return [None if v is None else float(v) for v in values]
        except ValueError:
            return None

    made = {names[k]: (n, "double") if (n := numbers(v)) is not None and any(x is not None for x in v) else (v, "string") for k, v in columns.items()}
    schema = ", ".join(f"`{n}` {t}" for n, (_, t) in made.items())
    return spark.createDataFrame(list(zip(*[v for v, _ in made.values()], strict=True)), schema)


def write_excel(df: DataFrame, path: str) -> None:
    """One sheet with a heading; more rows than a sheet holds are refused, and CSV is the way for them."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    rows = df.limit(EXCEL_ROWS + 1).collect()
    if len(rows) > EXCEL_ROWS:
        raise ValueError(f"a sheet holds {EXCEL_ROWS} rows; write CSV instead")

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [df.columns, *rows])
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    types, rels = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{types}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{types}/relationships"><Relationship Id="r1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_NS["x"]}" xmlns:r="{rels}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{types}/relationships"><Relationship Id="r1" Type="{rels}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet xmlns="{_NS["x"]}"><sheetData>{lines}</sheetData></worksheet>')
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    stream.write(bytearray(out.getvalue()))
    stream.close()
