"""Delimited text without a header, typed as pandas would type it.

Spark splits the files, each line read once; types are chosen over all values of
a column in one aggregation, so every partition has the same schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts that pandas reads as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
_TYPES = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "int": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "float32": "float", "float64": "double", "float": "double", "bool": "boolean", "object": "string", "str": "string", "string": "string", "bytes": "binary"}
_INTEGER = r"^\s*[+-]?[0-9]{1,18}\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^[+-]?[iI]nf(inity)?$"
_BOOLEAN = ["True", "TRUE", "true", "False", "FALSE", "false"]


def spark_type(name: str) -> str:
    """Spark's type for a numpy type name."""
    if name in _TYPES:
        return _TYPES[name]
    if name.startswith(("|S", "S")):
        return "binary"
    if name.startswith(("<U", "U")):
        return "string"
    raise ValueError(f"no Spark type for {name!r}")


def _present(c: str) -> Column:
    return F.when(~F.col(c).isin(NA_TOKENS), F.col(c))


def _infer(df: DataFrame) -> list[str]:
    """bigint, double, boolean or string for each column; integers with missing values are doubles."""
    counts = [F.count("*").alias("n")]
    for c in df.columns:
        v = F.col(c)
        counts += [F.count(v).alias(f"{c}_v"), F.count_if(v.rlike(_INTEGER)).alias(f"{c}_i"), F.count_if(v.rlike(_NUMBER)).alias(f"{c}_d"), F.count_if(v.isin(_BOOLEAN)).alias(f"{c}_b")]
    r = df.agg(*counts).first()

    def kind(c: str) -> str:
        v = r[f"{c}_v"]
        if not v:
            return "double" if r["n"] else "string"
        if r[f"{c}_i"] == v:
            return "bigint" if v == r["n"] else "double"
        if r[f"{c}_d"] == v:
            return "double"
        return "boolean" if r[f"{c}_b"] == v == r["n"] else "string"

    return [kind(c) for c in df.columns]


def _cast(c: str, kind: str) -> Column:
    v = F.col(c)
    if kind == "boolean":
        return F.lower(v).cast("boolean")
    if kind in ("double", "float"):
        inf = F.when(F.trim(v).rlike(r"(?i)^[+]?inf(inity)?$"), F.lit("Infinity")).when(F.trim(v).rlike(r"(?i)^-inf(inity)?$"), F.lit("-Infinity")).otherwise(F.trim(v))
        return F.nanvl(inf.cast(kind), F.lit(None).cast(kind))
    return (F.trim(v) if kind in ("tinyint", "smallint", "int", "bigint") else v).cast(kind)


def scan_csv(spark: SparkSession, path: str | list[str], types: list[str] | None = None, delimiter: str = ",") -> DataFrame:
    """Columns "0", "1", ...; a first line of names is data; blank lines are skipped;
    quotes are doubled inside quotes; pandas' 19 texts for missing values are NULL.

    Defined cases: an empty file without ``types`` has the one string column "0"
    and no rows; a value that a declared type can't hold fails the job."""
    reader = spark.read.options(header=False, sep=delimiter, quote='"', escape='"', inferSchema=False, multiLine=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if types is not None:
        names = [str(k) for k in range(len(types))]
        raw = reader.csv(path)
        if len(raw.columns) not in (0, len(types)):
            raise ValueError(f"{len(types)} types for {len(raw.columns)} columns")
        if not raw.columns:
            raw = spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
        raw, kinds = raw.toDF(*names), [spark_type(t) for t in types]
    else:
        raw = reader.csv(path)
        if not raw.columns:
            return spark.createDataFrame([], "`0` string")
        names = [str(k) for k in range(len(raw.columns))]
        raw, kinds = raw.toDF(*names), []
    raw = raw.select(*[_present(c).alias(c) for c in names])
    kinds = kinds or _infer(raw)
    return raw.select(*[_cast(c, k).alias(c) for c, k in zip(names, kinds, strict=True)])


def probe(spark: SparkSession, path: str, delimiter: str = ",", lines: int = 2000) -> dict:
    """{"bytes", "approx_rows", "types"} of a file from its first ``lines`` lines and
    its length, without reading the rest; ``types`` are Spark's names by position."""
    from ..plans.planner import approx_rows

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    total = where.getFileSystem(conf).getContentSummary(where).getLength()
    head = spark.read.text(path).limit(lines)
    size = head.agg(F.sum(F.octet_length("value") + 1), F.count("*")).first()
    texts = [r.value for r in head.collect()]  # ``lines`` at most
    raw = spark.read.options(header=False, sep=delimiter, quote='"', escape='"', inferSchema=False).csv(spark.sparkContext.parallelize(texts, 1)) if texts else None
    kinds = _infer(raw.select(*[_present(c).alias(c) for c in raw.columns])) if raw is not None else []
    return {"bytes": total, "approx_rows": approx_rows(total, size[0] or 0, size[1]), "types": kinds}
