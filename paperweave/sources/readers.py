"""Readers of record dumps and landed result pages."""

from __future__ import annotations

import tarfile
import zlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperweave.operators.grouping import top_k_per_key

CORRUPT = "_corrupt_record"
SERVICE_PAGE = 100


def read_entities(spark: SparkSession, path: str | list[str], schema: str, mode: str = "FAILFAST") -> DataFrame:
    """Newline-JSON records (plain or gz parts) under an explicit schema.

    FAILFAST stops at the first bad line. QUARANTINE keeps bad lines in a
    `_corrupt_record` column beside their file, for `split_malformed`.
    """
    if mode == "FAILFAST":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if mode != "QUARANTINE":
        raise ValueError("mode must be 'FAILFAST' or 'QUARANTINE'")
    return (
        spark.read.schema(f"{schema}, {CORRUPT} string")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .json(path).withColumn("source_file", F.col("_metadata.file_path"))
    )


def split_malformed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines with their file) of a QUARANTINE read."""
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "source_file")
    # Spark reads bad lines only beside a parsed column, so the filter mentions one.
    beside = F.coalesce(F.to_json(F.struct(F.col(good.columns[0]))), F.lit("")) >= ""
    rejects = df.where(F.col(CORRUPT).isNotNull() & beside).select("source_file", F.col(CORRUPT).alias("line"))
    return good, rejects


def malformed_report(rejects: DataFrame) -> DataFrame:
    """(source_file, bad_lines, sample) per file with rejected lines; of numbered ones the first is the sample, with its `first_line`."""
    per_file = rejects.groupBy("source_file")
    if "line_number" not in rejects.columns:
        return per_file.agg(F.count("*").alias("bad_lines"), F.min("line").alias("sample"))
    return per_file.agg(F.count("*").alias("bad_lines"), F.min("line_number").alias("first_line"), F.min_by("line", "line_number").alias("sample"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, line_number, line) of every line of text files, numbers from 1 in the whole file.

    Files are read in blocks as Spark splits them; a row per block, its number of
    lines, turns a line's place in the block into its place in the file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("place"))
    blocks = lines.groupBy("source_file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("source_file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return lines.join(starts, ["source_file", "block"]).select(
        "source_file", (F.col("start") + F.col("place") - F.col("first") + 1).alias("line_number"), "line")


def malformed_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(source_file, line_number, line) of the lines that are not JSON of the schema; blank lines are no records."""
    read = F.from_json("line", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    bad = (F.trim("line") != "") & read[CORRUPT].isNotNull()
    return numbered_lines(spark, path).where(bad)


def read_archives(spark: SparkSession, paths: list[str], schema: str, mode: str = "FAILFAST") -> DataFrame:
    """Records of tar archives whose members are (gzipped) newline-JSON parts.

    One task per archive lists its members; each member is then one row of work
    that a task streams line by line from its own offset, so the parts of one big
    archive are read in parallel and none is held in memory. Paths are URIs of any
    store that Arrow's file systems reach, or absolute paths of a shared mount.
    FAILFAST stops at the first bad line. QUARANTINE keeps bad lines in a
    `_corrupt_record` column beside their archive, member and line number, for
    `split_members`.
    """
    if mode not in ("FAILFAST", "QUARANTINE"):
        raise ValueError("mode must be 'FAILFAST' or 'QUARANTINE'")
    archives = spark.createDataFrame([(p,) for p in paths], "path string")

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                with _open(path) as raw, tarfile.open(fileobj=raw) as tar:
                    found = [(path, m.name, m.offset_data, m.size) for m in tar if m.isfile()]
                yield pd.DataFrame(found, columns=["path", "member", "start", "size"])

    work = archives.repartition(max(len(paths), 1), "path").mapInPandas(
        members, "path string, member string, start bigint, size bigint"
    )

    errors = "strict" if mode == "FAILFAST" else "replace"

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                with _open(row.path) as raw:
                    batch = []
                    for number, line in enumerate(_member_lines(raw, row.member, row.start, row.size), start=1):
                        if line.strip():
                            batch.append((row.path, row.member, number, line.decode("utf-8", errors)))
                        if len(batch) == 10_000:
                            yield pd.DataFrame(batch, columns=["archive", "member", "line_number", "line"])
                            batch = []
                    yield pd.DataFrame(batch, columns=["archive", "member", "line_number", "line"])

    text = work.repartition("path", "member").mapInPandas(
        lines, "archive string, member string, line_number bigint, line string"
    )
    if mode == "QUARANTINE":
        read = F.from_json("line", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        return text.select("archive", "member", "line_number", read.alias("r")).select("archive", "member", "line_number", "r.*")
    parsed = text.select("member", "line_number", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("member", "line_number", "r.*")


def split_members(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of a QUARANTINE read of archives; `source_file` of a rejected line is archive and member."""
    rejects = df.where(F.col(CORRUPT).isNotNull()).select(
        F.concat_ws("!", "archive", "member").alias("source_file"), "line_number", F.col(CORRUPT).alias("line"))
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "archive"), rejects


def _open(path: str):
    """A seekable file of a URI or an absolute path."""
    store, inner = FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store.open_input_file(inner)


def _blocks(raw, start: int, size: int) -> Iterator[bytes]:
    """The bytes of one archive member, a megabyte at a time."""
    raw.seek(start)
    while size > 0 and (block := raw.read(min(size, 1 << 20))):
        size -= len(block)
        yield block


def _unzipped(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Plain bytes of a gzip stream, which may be several streams end to end."""
    unzip = zlib.decompressobj(wbits=zlib.MAX_WBITS | 16)
    for block in blocks:
        while block:
            yield unzip.decompress(block)
            block = unzip.unused_data if unzip.eof else b""
            if unzip.eof:
                unzip = zlib.decompressobj(wbits=zlib.MAX_WBITS | 16)


def _member_lines(raw, name: str, start: int, size: int) -> Iterator[bytes]:
    """Lines of one archive member, read and unzipped block by block."""
    blocks = _blocks(raw, start, size)
    rest = b""
    for block in _unzipped(blocks) if name.endswith(".gz") else blocks:
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        yield from parts
    yield rest


def limit_per_input(inputs: Mapping[str, DataFrame], n: int | None) -> dict[str, DataFrame]:
    """Each input cut to its own first `n` rows; all rows when n is None."""
    return {name: df if n is None else df.limit(n) for name, df in inputs.items()}


def explode_pages(pages: DataFrame, max_results: int | None = None, fetch: Sequence[str] = ()) -> DataFrame:
    """Items of landed result pages, in page order, with their fetch, page and place.

    `pages`: page_number, header, results array<struct>, and the `fetch` columns
    that tell one paged request (an organization, a date range, a run) from
    another. Within a fetch, reading stops as the paged service itself does: after
    the first short or empty page, and after the page that reaches the header's
    numFound, where it has one. `max_results` is the caller's own cap on the
    items of each fetch.
    """
    items = F.filter("results", lambda r: r.isNotNull())
    header = pages.schema["header"].dataType.fieldNames()
    sized = pages.withColumn("size", F.coalesce(F.size(items), F.lit(0))).withColumn(
        "_fetch", F.struct(*fetch) if fetch else F.lit(0)
    )
    wanted = F.coalesce(F.nullif(F.col("header.pageSize"), F.lit(0)), F.lit(SERVICE_PAGE))
    last = F.col("size") < wanted
    if {"numFound", "page"} <= set(header):
        reached = (F.col("header.numFound") > 0) & (F.col("header.page") * wanted >= F.col("header.numFound"))
        last = last | F.coalesce(reached, F.lit(False))
    ends = sized.where(last).groupBy("_fetch").agg(F.min("page_number").alias("_last"))
    live = sized.join(ends, "_fetch", "left").where(F.col("page_number") <= F.coalesce("_last", "page_number"))
    out = live.select(*fetch, "page_number", F.posexplode(items).alias("place", "item")).select(
        *fetch, "page_number", "place", "item.*"
    )
    if max_results is None:
        return out
    order = [F.asc("page_number"), F.asc("place")]
    if not fetch:
        return out.orderBy(*order).limit(max_results)
    return top_k_per_key(out, list(fetch), order, max_results)


def union_results(*frames: DataFrame) -> DataFrame:
    """One frame of all record kinds, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def register_views(frames: Mapping[str, DataFrame]) -> None:
    """Make every frame queryable by name in SQL."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
