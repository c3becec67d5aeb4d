"""Reading: declared schemas for every text format, so that no pass over the data infers one."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BANDS = "hometown STRING, id BIGINT, name STRING, year BIGINT"
GUITARS = "guitarType STRING, id BIGINT, make STRING, model STRING"
GUITAR_PLAYERS = "band BIGINT, guitars ARRAY<BIGINT>, id BIGINT, name STRING"
EMPLOYEES = "id INT, firstName STRING, middleName STRING, lastName STRING, dept INT, birthDate TIMESTAMP, ssn STRING, salary INT"
CARS = (
    "Name STRING, Miles_per_Gallon DOUBLE, Cylinders BIGINT, Displacement DOUBLE, Horsepower BIGINT, "
    "Weight_in_lbs BIGINT, Acceleration DOUBLE, Year STRING, Origin STRING"
)
STOCKS = "company STRING, date DATE, value DOUBLE"
PERSONS = "id INT, firstName STRING, middleName STRING, lastName STRING, gender STRING, birthDate DATE, ssn STRING, salary INT"
FLIGHTS = "arrdelay DOUBLE, carrier STRING, dest STRING, origin STRING"
MOVIES = "Title STRING, IMDB_Rating DOUBLE, Release_Date STRING, Major_Genre STRING"
LAPTOPS = "registration STRING, make STRING, model STRING, procSpeed DOUBLE"
LAPTOP_OFFERS = "make STRING, model STRING, procSpeed DOUBLE, salePrice DOUBLE"
EXAM_IDS = "id BIGINT, name STRING"
EXAM_EMAILS = "id BIGINT, email STRING"
EXAM_SCORES = "id BIGINT, score DOUBLE"
METRICS = "name STRING, value DOUBLE"
ENCOUNTERS = "personId STRING, approachValue DOUBLE"
LOOKUP = "id INT, order STRING"

SOCKET_PORT = 12345


def data_path(root: str, name: str) -> str:
    """Folder of a named data set."""
    return str(Path(root) / name)


def json_path(root: str, name: str) -> str:
    return f"{data_path(root, name)}/{name}.json"


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON lines. Without a schema Spark reads the data once more to infer one."""
    return (spark.read if schema is None else spark.read.schema(schema)).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines in a column ``value``."""
    return spark.read.text(path)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("sep", sep).csv(path)


def read_employees(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Positional CSV; the headed twin has the same columns."""
    return read_csv(spark, path, EMPLOYEES, header)


def read_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Key and value separated by one space: exam ids, e-mails, scores, metrics."""
    return read_csv(spark, path, schema, sep=" ")


def read_tagged(spark: SparkSession, path: str, sep: str = " // ") -> DataFrame:
    """Lines ``SOURCE // TEXT`` to (source INT, text). The text may hold the separator; lines without it go."""
    found = F.instr("value", sep)
    return (
        read_lines(spark, path)
        .where(found > 0)
        .select(
            F.substring("value", F.lit(1), found - 1).cast("int").alias("source"),
            F.substring("value", found + len(sep), F.length("value")).alias("text"),
        )
    )


def range_source(spark: SparkSession, start: int, end: int, step: int = 1, partitions: int | None = None) -> DataFrame:
    """``id`` from start, before end. 64-bit: multiples of it don't overflow where 32-bit ones would."""
    return spark.range(start, end, step, partitions)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def lookup_table(spark: SparkSession) -> DataFrame:
    """Four medal names by position."""
    return literal(spark, [(1, "first"), (2, "second"), (3, "third"), (4, "fourth")], LOOKUP)


def catalog_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def socket_options(port: int = SOCKET_PORT, host: str = "localhost") -> dict[str, str]:
    return {"host": host, "port": str(port)}


def socket_stream(spark: SparkSession, port: int = SOCKET_PORT, host: str = "localhost") -> DataFrame:
    """Lines from a socket as a stream, column ``value``."""
    return spark.readStream.format("socket").options(**socket_options(port, host)).load()


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
