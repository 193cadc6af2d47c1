"""Where queries are registered with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; sql: the same in DuckDB's dialect."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(df: DataFrame, rows: int) -> int:
    """How many partitions of about so many rows a table has, at least as many as a shuffle has: a task's memory then does not grow with the table. Parquet files tell their rows without being read."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """A table by keys in partitions of about so many rows: Parquet of few bytes may hold many rows, which Spark reads in few tasks."""
    return df.repartition(parts_of(df, rows), *keys)


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """Literal rows that both dialects read; ¶ in a text is a line end, ¦ a tab."""
    df = spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")
    from pyspark.sql import functions as F

    return df.select(*(F.translate(c, "¶¦", "\n\t").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def sql_values(rows: str, columns: str, texts: tuple[str, ...] = ()) -> str:
    out = ", ".join(f"translate({c}, '¶¦', chr(10) || chr(9)) AS {c}" if c in texts else c for c in columns.replace(" ", "").split(","))
    return f"(SELECT {out} FROM (VALUES {rows}) AS t({columns}))"


# --- stated cases over a table: each row of the table gets the case that its key's remainder names, § in it is the key -------


def cases(spark: SparkSession, sf_dir: str, rows: str, columns: str, name: str = "part", key: str = "p_partkey") -> DataFrame:
    """(row_id, columns): rows are numbered 1, 2, ... in their first column."""
    from pyspark.sql import functions as F

    given = values(spark, rows, columns)
    first, n = given.columns[0], given.count()
    keys = table(spark, sf_dir, name).select(F.col(key).cast("bigint").alias("row_id"))
    put = lambda c, t: F.replace(c, F.lit("§"), F.col("row_id").cast("string")) if t == "string" else F.col(c)
    joined = keys.join(F.broadcast(given), (F.col("row_id") % n + 1) == F.col(first))  # the stated cases
    return joined.select("row_id", *(put(c, t).alias(c) for c, t in given.dtypes))


def sql_cases(rows: str, columns: str, texts: tuple[str, ...] = (), name: str = "part", key: str = "p_partkey", n: int | None = None) -> str:
    """The same in SQL; texts: the columns in which the key is put and line ends stand. n: how many cases there are, where a case has several rows or none."""
    names = columns.replace(" ", "").split(",")
    out = ", ".join(f"replace(translate({c}, '¶¦', chr(10) || chr(9)), '§', {key}::VARCHAR) AS {c}" if c in texts else c for c in names)
    count = n if n is not None else f"(SELECT count(*) FROM (VALUES {rows}) AS z({columns}))"
    return f"(SELECT {key}::BIGINT AS row_id, {out} FROM {name} JOIN (VALUES {rows}) AS t({columns}) ON {key} % {count} + 1 = {names[0]})"


def texts(spark: SparkSession, sf_dir: str, rows: str) -> DataFrame:
    """(id, s): every document's whole text behind one of the stated beginnings (id, s)."""
    from pyspark.sql import functions as F

    begun = cases(spark, sf_dir, rows, "n, s", "documents", "doc_id").withColumnRenamed("row_id", "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(begun, "doc_id").select(F.col("doc_id").alias("id"), F.concat("s", F.lit("\n"), F.coalesce("text", F.lit(""))).alias("s"))


def sql_texts(rows: str) -> str:
    return f"(SELECT doc_id AS id, s || chr(10) || coalesce(text, '') AS s FROM documents JOIN {sql_cases(rows, 'n, s', ('s',), 'documents', 'doc_id')} ON row_id = doc_id)"
