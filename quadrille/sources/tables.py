"""Reading and writing the engine's tables: Parquet or CSV folders, and JDBC databases.

A data folder holds raw tables; derived ones live in its ``processed`` subfolder. All paths go through Spark, so
any file system that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import schemas
from .footers import read_footers

# Known names of the columns of daily returns, the preferred one first.
RETURN_COLUMNS = ("ret", "dlyret")
ALIASES = {"date": ("date", "dlycaldt", "caldt"), "prc": ("prc", "dlyprc"), "vol": ("vol", "dlyvol"), "shrout": ("shrout", "dlyshrout")}
BATCH = 400


def candidates(data_dir: str, name: str, processed_first: bool = False) -> list[str]:
    folders = [data_dir, f"{data_dir}/processed"]
    return [f"{d}/{name}.{kind}" for d in (folders[::-1] if processed_first else folders) for kind in ("parquet", "csv")]


def read_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet file or folder, or a CSV file with a header; types are inferred if no schema is given."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return spark.read.parquet(path)


def read_table(spark: SparkSession, data_dir: str, name: str, schema: str | None = None, processed_first: bool = False) -> DataFrame:
    """The first of a table's candidate files that exists; FileNotFoundError if there is none."""
    for path in candidates(data_dir, name, processed_first):
        try:
            return read_file(spark, path, schema)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
    raise FileNotFoundError(f"no table {name} in {data_dir}")


def read_optional(spark: SparkSession, data_dir: str, name: str, schema: str | None = None) -> DataFrame | None:
    try:
        return read_table(spark, data_dir, name, schema)
    except FileNotFoundError:
        return None


def save_table(df: DataFrame, data_dir: str, name: str, subdir: str | None = "processed", by: list[str] | None = None, kind: str = "parquet") -> str:
    """Writes a table over its older version, as shards by column values if ``by`` is given; returns its path.

    A table whose types Parquet cannot hold (calendar intervals, say) is written as CSV instead, as text where need be.
    """
    path = "/".join(x for x in (data_dir, subdir, f"{name}.{kind}") if x)
    try:
        _write(df, path, by, kind)
    except AnalysisException as e:
        if kind == "csv" or "UNSUPPORTED" not in str(e):
            raise
        kept = {"string", "boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp"}
        plain = df.select(*[F.col(f.name) if f.dataType.typeName() in kept else F.col(f.name).cast("string").alias(f.name) for f in df.schema.fields])
        path = path.removesuffix(kind) + "csv"
        _write(plain, path, by, "csv")
    return path


def _write(df: DataFrame, path: str, by: list[str] | None, kind: str) -> None:
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    (writer.option("header", True).csv if kind == "csv" else writer.parquet)(path)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns that the table has, matched without case, cast; NaN becomes NULL."""
    spec = [part.strip().split(" ", 1) for part in schema.split(",")]
    by_lower = {c.lower(): c for c in df.columns}
    out = []
    for name, kind in spec:
        if name.lower() in by_lower:
            c = df[by_lower[name.lower()]].try_cast(kind)
            out.append((F.nanvl(c, F.lit(None).cast("double")) if kind == "double" else c).alias(name))
    return df.select(*out)


def load_data(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """The four core tables, cast: returns, eligibility, calendar, membership."""
    names = {"returns": ("daily_returns", schemas.RETURNS), "eligibility": ("window_eligibility", schemas.ELIGIBILITY), "calendar": ("trading_calendar", schemas.CALENDAR), "membership": ("membership", schemas.MEMBERSHIP)}
    return {k: conform(read_table(spark, data_dir, name), schema) for k, (name, schema) in names.items()}


# Databases


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def table_columns(spark: SparkSession, url: str, table: str, **options: str) -> set[str]:
    """Lower-case columns of a database table; empty if it can't be read."""
    try:
        return {c.lower() for c in jdbc(spark, url, f"SELECT * FROM {table} WHERE 1 = 0", **options).columns}
    except Exception:
        return set()


def membership_query(table: str, start: str, end: str) -> str:
    """Spells that overlap the closed span; dates are plain literals, which databases cast alike."""
    return f"SELECT permno, mbrstartdt, mbrenddt FROM {table} WHERE mbrenddt >= '{start}' AND mbrstartdt <= '{end}'"


def overlapping_members(membership: DataFrame, start: str, end: str) -> DataFrame:
    return membership.filter((F.col("mbrenddt") >= F.lit(start).cast("date")) & (F.col("mbrstartdt") <= F.lit(end).cast("date")))


def return_column(columns) -> str:
    """The first known name of the return column that is present, else the first known one."""
    return _first(columns, RETURN_COLUMNS) or RETURN_COLUMNS[0]


def _first(columns, names) -> str | None:
    present = {c.lower() for c in columns}
    return next((c for c in names if c in present), None)


def returns_predicates(permnos: list[int], start: str, end: str, batch: int = BATCH, date_col: str = "date") -> list[str]:
    """One WHERE clause, hence one partition of the read, for each batch of ids."""
    ids = sorted(set(permnos))
    return [f"permno IN ({', '.join(map(str, ids[k : k + batch]))}) AND {date_col} BETWEEN '{start}' AND '{end}'" for k in range(0, len(ids), batch)]


def read_returns(spark: SparkSession, url: str, table: str, permnos: list[int], start: str, end: str, properties: dict | None = None) -> DataFrame:
    """Daily returns of the given ids in the closed span, in batches of ids; columns as clean_returns gives them."""
    options = properties or {}
    columns = table_columns(spark, url, table, **options)
    date_col = _first(columns, ALIASES["date"]) or "date"
    if not permnos:
        return clean_returns(jdbc(spark, url, f"SELECT * FROM {table} WHERE 1 = 0", **options))
    return clean_returns(spark.read.jdbc(url, table, predicates=returns_predicates(permnos, start, end, date_col=date_col), properties=options))


def clean_returns(df: DataFrame) -> DataFrame:
    """permno, date, ret and what there is of prc, vol, shrout, by any of their known names: cast, prices made positive, in order."""
    by_lower = {c.lower(): c for c in df.columns}
    number = lambda c: F.nanvl(df[c].try_cast("double"), F.lit(None).cast("double"))
    out = [df[by_lower["permno"]].cast("int").alias("permno"), df[by_lower[_first(by_lower, ALIASES["date"]) or "date"]].cast("date").alias("date")]
    if ret := by_lower.get(return_column(df.columns)):
        out.append(number(ret).alias("ret"))
    for name in ("prc", "vol", "shrout"):
        if found := _first(by_lower, ALIASES[name]):
            value = number(by_lower[found])
            out.append((F.abs(value) if name == "prc" else value).alias(name))
    return df.select(*out).orderBy("permno", "date")


IDENTIFIERS = ("permno", "permco", "ticker", "securitynm", "issuernm", "primaryexch", "sharetype", "securitytype")


def identifiers(names: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct rows of the known identifier columns, by lower-case names, for members only."""
    return names.select(*[F.col(c).alias(c.lower()) for c in schemas.available(names, *IDENTIFIERS)]).distinct().join(members.select("permno").distinct(), "permno", "left_semi")


# Viewer


def describe(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """One row: number of rows and columns, and the span of the date column if there is one."""
    date_col = date_col or next((c for c in df.columns if c.lower() == "date"), None)
    span = [F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date")] if date_col else []
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *span).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def list_tables(spark: SparkSession, data_dir: str) -> DataFrame:
    """name, bytes, size (as text), n_rows and n_cols of every Parquet table of a folder, from one scan of the files' footers."""
    each = read_footers(spark, data_dir).groupBy("name").agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"))
    return each.select("name", "bytes", human_bytes_column(F.col("bytes").cast("double")).alias("size"), "n_rows", "n_cols").orderBy("name")


def export_csv(df: DataFrame, path: str, max_rows: int | None = None, sheet_rows: int = 1_048_576, cap: int = 100_000) -> int:
    """Writes a CSV; a table of more rows than a sheet holds is cut to cap rows. Returns the limit that held, or -1.

    max_rows of -1 asks for all rows, which are then written by as many tasks as there are.
    """
    if max_rows == -1:
        df.write.mode("overwrite").option("header", True).csv(path)
        return -1
    limit = max_rows if max_rows is not None else cap if df.limit(sheet_rows + 1).count() > sheet_rows else -1
    (df if limit < 0 else df.limit(limit)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return limit


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def human_bytes_column(n):
    """The same text from a column of numbers."""
    out = F.format_string("%.1f TB", n / 1024.0**4)
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", n / 1024.0**k)).otherwise(out)
    return out
