"""Text files as rows, compressed results as files, and the command line."""

from __future__ import annotations

import argparse
import math
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevis.functions import rewriting


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_texts(df: DataFrame, path: str, text: str = "compressed") -> None:
    df.select(F.col(text).alias("value")).write.text(path)


def save_snapshot(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A stored conversation state; fields that an older snapshot lacks take their defaults."""
    df = spark.read.parquet(path)
    memory = "array<struct<id:string,text:string,kind:string,source:struct<from:bigint,to:bigint>>>"
    if "memories" not in df.columns:
        df = df.withColumn("memories", F.array().cast(memory))
    if "recent" not in df.columns:
        df = df.withColumn("recent", F.array().cast("array<struct<turn:bigint,role:string,content:string>>"))
    for name, default in (("raw_tokens", F.lit(0).cast("bigint")), ("ingested", F.size("recent").cast("bigint"))):
        df = df.withColumn(name, F.coalesce(name, default) if name in df.columns else default)
    return df


def main(argv: list[str] | None = None) -> int:
    """Compress one file or standard input; the report goes to standard error."""
    parser = argparse.ArgumentParser(prog="brevis")
    parser.add_argument("file", nargs="?")
    parser.add_argument("--aggressive", "-a", action="store_true")
    parser.add_argument("--type", choices=rewriting.TYPES)
    args = parser.parse_args(argv)
    if not args.file and sys.stdin.isatty():
        parser.print_usage(sys.stderr)
        return 1
    from brevis.operators.content import compress_content
    from brevis.session import build_session

    try:
        if args.file:
            with open(args.file, encoding="utf-8") as f:
                text = f.read()
        else:
            text = sys.stdin.read()
    except OSError as e:
        print(f"brevis: cannot read {args.file}: {e}", file=sys.stderr)
        return 1
    df = build_session(cpus=1).createDataFrame([(text,)], "text string")
    row = compress_content(df, level="aggressive" if args.aggressive else "safe", kind=args.type).first()
    print(f"brevis: {row['type']} · {row['original_tokens']}→{row['compressed_tokens']} tok ({math.floor(row['saved'] * 100 + 0.5)}% saved)", file=sys.stderr)
    print(row["compressed"])
    return 0
