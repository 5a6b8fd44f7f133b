"""Sources: files of several kinds, JDBC, registries of named queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def jsonl(spark: SparkSession, path: str, schema: str, newest: str | None = None) -> DataFrame:
    """Lines of JSON with a stated schema; malformed ones are left out. Newest first by a column, if asked."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.desc_nulls_last(newest)) if newest else rows


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of objects, or objects of objects under `schema`."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_registry(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A file of one object of objects: a row for each entry with its key."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, struct<{value_schema}>>")).alias("key", "v")).select("key", "v.*")


def csv_strings(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A file with a header, all columns as strings; missing columns are an error that names them."""
    rows = spark.read.option("header", True).csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return rows


def texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text) of whole files, in any depth of folders."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of files in any depth of folders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def extracted(files: DataFrame, extract: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """(path, page, text, error) of every page that an extractor yields, blank ones left out.

    A table function joined laterally: pages leave a task one by one, so a long file needs no more memory than its content and one page. Where an extractor fails,
    the pages before the fault stay, and a row with the error and the page's number follows; the job goes on.
    """

    @F.udtf(returnType="page int, text string, error string")
    class Pages:
        def eval(self, content: bytes):
            page = 0
            try:
                for text in extract(bytes(content)):
                    yield page, text, None
                    page += 1
            except Exception as e:
                yield page, None, f"{type(e).__name__}: {e}"

    pages = files.lateralJoin(Pages(F.col("content").outer())).select("path", "page", "text", "error")
    return pages.where(F.col("error").isNotNull() | (F.trim(F.coalesce("text", F.lit(""))) != ""))


def longer_extraction(first: DataFrame, second: DataFrame, factor: float = 1.1) -> DataFrame:
    """Of two extractions (path, page, text), for each file the second's pages if they are longer by the factor, else the first's."""
    lengths = lambda df, name: df.groupBy("path").agg(F.sum(F.length("text")).alias(name))
    chosen = lengths(first, "a").join(lengths(second, "b"), "path", "full").select("path", (F.coalesce("b", F.lit(0)) > F.coalesce("a", F.lit(0)) * factor).alias("use_second"))
    return first.join(chosen.where("NOT use_second"), "path", "left_semi").unionByName(second.join(chosen.where("use_second"), "path", "left_semi"))


def changed_files(source: DataFrame, known: DataFrame) -> DataFrame:
    """Files of `source` (path, modificationTime) that `known` (name, modificationTime) lacks or has older; of one name the newest."""
    named = source.withColumn("name", F.element_at(F.split("path", "/"), -1))
    newest = named.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("modificationTime"), F.desc("path")))).where("k = 1").drop("k")
    have = known.select("name", F.col("modificationTime").alias("have"))
    return newest.join(have, "name", "left").where(F.col("have").isNull() | (F.col("modificationTime") > F.col("have"))).drop("have")


def sql_entries(files: DataFrame) -> DataFrame:
    """(path, entry, sql, tables) of the SELECT statements in SQL files (path, text), blocks parted by empty lines or `---`."""
    blocks = files.select("path", F.posexplode(F.split("text", r"\n\s*\n\s*\n+|\n-{3,}\s*\n")).alias("entry", "sql")).withColumn("sql", F.btrim("sql", F.lit(" \t\r\n")))
    return blocks.where(F.col("sql").rlike(r"(?i)\bselect\b")).withColumn("tables", F.array_distinct(F.transform(F.regexp_extract_all("sql", F.lit(r"(?i)\b(?:from|join)\s+([\w.]+)"), F.lit(1)), F.upper)))


def jdbc(spark: SparkSession, url: str, source: str, column: str | None = None, parts: int = 8, seconds: int = 30, **options: str) -> DataFrame:
    """Rows of a table, or of a SELECT, on a database; drivers and credentials come from `options`, `seconds` limits each statement.

    With a numeric or date `column` the rows are read in `parts` ranges of it, each by a task and connection of its own; the database gives the bounds, and
    null goes with the first range. Spark sends filters and the columns that are needed along with either kind of source.
    """
    chosen = f"({source}) wanted" if source.lstrip().upper().startswith(("SELECT", "WITH")) else source
    read = lambda **more: spark.read.format("jdbc").options(url=url, queryTimeout=str(seconds), **options, **more).load()
    if column is None:
        return read(dbtable=chosen)
    low, high = read(dbtable=chosen).agg(F.min(column), F.max(column)).first()
    if low is None:
        return read(dbtable=chosen)
    return read(dbtable=chosen, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))


def jdbc_columns(spark: SparkSession, url: str, schema: str | None = None, tables: str = "%", **options: str) -> DataFrame:
    """(schema, table, position, column, type, size, nullable) of a database's tables, from the driver's own catalog calls, which every database answers.

    `tables` is a pattern as in LIKE. A catalog is small; it is read by the driver over one connection.
    """
    jvm = spark.sparkContext._jvm
    settings = jvm.java.util.Properties()
    for k, v in options.items():
        settings.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        found, rows = connection.getMetaData().getColumns(None, schema, tables, "%"), []
        while found.next():
            rows.append((found.getString("TABLE_SCHEM"), found.getString("TABLE_NAME"), found.getInt("ORDINAL_POSITION"), found.getString("COLUMN_NAME"), found.getString("TYPE_NAME"), found.getInt("COLUMN_SIZE"), found.getInt("NULLABLE") != 0))
    finally:
        connection.close()
    return spark.createDataFrame(rows, "schema string, table string, position int, column string, type string, size int, nullable boolean")


class NamedQueries:
    """Queries by key, with a version for past days where there is one. Dates are parameters, never text."""

    def __init__(self, today: dict[str, str], past: dict[str, str] | None = None):
        self.today, self.past = today, past or {}

    def run(self, spark: SparkSession, key: str, day: str | None = None) -> DataFrame:
        """Rows of a key for a day; keys without a version for past days give today's. Unknown keys are errors."""
        if key not in self.today:
            raise KeyError(key)
        return spark.sql(self.past[key], args={"d": day}) if day and key in self.past else spark.sql(self.today[key])


def catalog_columns(spark: SparkSession, tables: list[str]) -> DataFrame:
    """(table, position, column, type) of tables or views."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t in tables for i, f in enumerate(spark.table(t).schema.fields)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")


#: Names that the name of a map's feature goes by, in the order in which they are tried (fixed values).
FEATURE_NAMES = ("SIG_KOR_NM", "name", "NM", "adm_nm", "sggnm")


def geojson_features(files: DataFrame, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    """(path, at, name, properties, geometry) of the features of GeoJSON files (path, text), whatever their properties; properties and geometry are variants.

    A file's name field is the first of `names` that its first feature has; without one the names are null. A text that is no JSON has no features.
    """
    parsed = files.select("path", F.try_parse_json("text").alias("v"))
    features = F.expr("try_variant_get(v, '$.features', 'array<variant>')")
    own = lambda v, n: F.expr(f"trim(try_variant_get({v}, '$.properties.{n}', 'string'))")
    first = F.coalesce(*(F.when(F.expr(f"try_variant_get(v, '$.features[0].properties.{n}', 'variant') is not null"), F.lit(n)) for n in names))
    each = parsed.select("path", first.alias("field"), F.posexplode(features).alias("at", "f"))
    name = F.coalesce(*(F.when(F.col("field") == n, own("f", n)) for n in names))
    return each.select("path", "at", name.alias("name"), F.expr("try_variant_get(f, '$.properties', 'variant')").alias("properties"), F.expr("try_variant_get(f, '$.geometry', 'variant')").alias("geometry"))


def variant_fields(df: DataFrame, column: str) -> str:
    """The one schema that all values of a variant column fit, as Spark merges them."""
    return df.agg(F.schema_of_variant_agg(column).alias("s")).first().s


def column_descriptions(tables: DataFrame) -> DataFrame:
    """(table, column, type, description) from one text a table: a JSON object of names and descriptions, or lines parted by tabs.

    Lines have a name and a description, with a type between them if there are three or more fields; those after the third belong to nothing. A first line that names its
    fields is left out, as are lines of one field. The text decides which of the two it is, table by table.
    """
    read = tables.select("table", "text", F.try_parse_json("text").alias("v"))
    of_json = read.select("table", F.explode(F.expr("try_variant_get(v, '$', 'map<string,string>')")).alias("column", "description")).select("table", "column", F.lit(None).cast("string").alias("type"), "description")
    cells = F.transform(F.split("line", "\t"), lambda c: F.trim(c))
    lines = read.where("try_variant_get(v, '$', 'map<string,string>') is null").select("table", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).select("table", "at", cells.alias("c"))
    head = (F.col("at") == 0) & F.lower(F.get("c", F.lit(0))).isin("column", "column_name", "컬럼", "컬럼명")
    good = lines.where((F.size("c") >= 2) & (F.get("c", F.lit(0)) != "") & ~head)
    typed = F.size("c") >= 3
    return of_json.unionByName(good.select("table", F.get("c", F.lit(0)).alias("column"), F.when(typed, F.get("c", F.lit(1))).alias("type"), F.when(typed, F.get("c", F.lit(2))).otherwise(F.get("c", F.lit(1))).alias("description")))


def column_specs(lines: DataFrame) -> DataFrame:
    """(name, id, type, length, nullable, description) of lines (line) that state a column: its name, an id in small letters, C or N, a length, NN or not, and words.

    A name may have several words. The last place where id, type and length follow each other counts, behind words of letters, digits and `_-()` only.
    """
    words = F.filter(F.split(F.regexp_replace("line", r"\s+", " "), " "), lambda w: w != "")
    place = lambda w: F.array_max(F.filter(F.sequence(F.lit(2), F.greatest(F.size(w) - 1, F.lit(2))), lambda i: (
        F.get(w, i).isin("C", "N") & F.get(w, i + 1).rlike("^[0-9.]+$") & F.get(w, i - 1).rlike("^[a-z0-9]+$") & ~F.exists(F.slice(w, 1, i - 1), lambda x: x.rlike("[^가-힣A-Za-z0-9_()-]")))))
    found = lines.select(words.alias("w")).where(F.size("w") >= 4).select("w", place(F.col("w")).alias("i")).where("i is not null")
    required = F.get("w", F.col("i") + 2) == "NN"
    rest = F.slice("w", F.col("i") + F.when(required, 4).otherwise(3), F.size("w"))
    return found.select(F.array_join(F.slice("w", F.lit(1), F.col("i") - 1), " ").alias("name"), F.get("w", F.col("i") - 1).alias("id"), F.get("w", F.col("i")).alias("type"), F.get("w", F.col("i") + 1).alias("length"), F.when(required, "NN").otherwise("").alias("nullable"), F.array_join(rest, " ").alias("description"))
