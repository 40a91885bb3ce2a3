"""Files as documents, and results as files."""

from __future__ import annotations

import ast
import io
import tokenize

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of each kind of text.
KINDS = {"md": "markdown", "markdown": "markdown", "py": "python", "txt": "text", "text": "text"}


class ContractError(ValueError):
    """An input that breaks its contract; nothing is returned then."""


def kind_of(path: Column, explicit: str | None = None) -> Column:
    """Kind by the suffix of a path; an explicit kind wins, an unknown suffix fails."""
    if explicit is not None:
        if explicit not in KINDS.values():
            raise ContractError(f"unknown kind {explicit}")
        return F.lit(explicit)
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.when(suffix == "", F.lit("text")).otherwise(F.coalesce(known[suffix], F.raise_error(F.concat(F.lit("unknown suffix: "), path))))


def scan(spark: SparkSession, folder: str, pattern: str = "*", exclude: str | None = None, kind: str | None = None) -> DataFrame:
    """doc_id, source, kind, text of all files under a folder; bytes that are not UTF-8 fail the scan.

    doc_id is a hash of the path, so that no order over all files is needed. Files under ``exclude`` are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    if exclude:
        files = files.where(~F.contains("path", F.lit(exclude)))
    return files.select(F.abs(F.xxhash64("path")).alias("doc_id"), F.col("path").alias("source"), kind_of(F.col("path"), kind).alias("kind"), F.validate_utf8(F.col("content").cast("string")).alias("text"))


def quarantined(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """source, n_bytes of files that are not UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.where(~F.is_valid_utf8(F.col("content").cast("string"))).select(F.col("path").alias("source"), F.col("length").alias("n_bytes"))


def inline(spark: SparkSession, text: str, source: str = "<query>") -> DataFrame:
    return spark.createDataFrame([(0, source, "text", text)], "doc_id long, source string, kind string, text string")


def canonical_json(table: DataFrame) -> Column:
    """Each row as JSON, its fields by name."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(table.columns)]), {"ignoreNullFields": "false"})


def write_jsonl(table: DataFrame, path: str, order: list[str] | None = None, one_file: bool = False) -> None:
    """Rows as lines of canonical JSON, in order by range over the files; one file only where that is asked for."""
    rows = table.orderBy(*order) if order else table
    lines = rows.select(canonical_json(table).alias("value"))
    (lines.coalesce(1) if one_file else lines).write.text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON that must fit the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append(table: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the store lacks; how many there were. One writer at a time is assumed."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        table = table.join(spark.read.schema(table.schema).parquet(path).select(key), key, "left_anti").select(*table.columns)
    n = table.count()
    if n:
        table.write.mode("append").parquet(path)
    return n


def python_parts(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the comments and docstrings of Python source, in code points; bad syntax fails."""
    lines = text.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    try:
        tree = ast.parse(text)
    except SyntaxError as error:
        raise ContractError(f"not Python: {error}") from error
    out = []
    for token in tokenize.generate_tokens(io.StringIO(text).readline):
        if token.type == tokenize.COMMENT:
            out.append((starts[token.start[0] - 1] + token.start[1], starts[token.end[0] - 1] + token.end[1], "python_comment"))

    def place(line: int, column: int) -> int:
        # columns of the tree count bytes
        return starts[line - 1] + len(lines[line - 1].encode()[:column].decode())

    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.body:
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                out.append((place(first.lineno, first.col_offset), place(first.end_lineno, first.end_col_offset), "python_docstring"))
    return sorted(out)


def python_segments(docs: DataFrame) -> DataFrame:
    """doc_id, s, e, kind, text of comments and docstrings; only the parser needs Python, one batch at a time."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = [(d, s, e, k, t[s:e]) for d, t in zip(frame["doc_id"], frame["text"]) for s, e, k in python_parts(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "s", "e", "kind", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, s int, e int, kind string, text string")
