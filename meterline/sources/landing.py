"""Landing zone: listing, control records, feed text with row order, checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.functions.joins import fits_broadcast, lookup_join
from meterline.schemas import SIDECAR
from meterline.session import cut_lineage

SIDECAR_SUFFIX = ".manifest.json"  # fixed value
LISTING = "path string, size_bytes long, received_at timestamp"
# What counts as white space around a field.
BLANKS = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Stands for a separating comma while a record is split; the code point never stands for a character.
MARK = "\uffff"
#: A split with more blank lines is numbered by a window instead of a list of them.
FEW_BLANKS = 100
#: Files up to so many bytes are hashed as one value, longer ones in pieces of so many, in at most so many tasks.
WHOLE_FILE = 64 << 20
PIECE = 4 << 20
MAX_LONG_TASKS = 10_000
#: Lines and bytes up to which one task numbers all files, without written intermediates.
FEW_LINES = 100_000
FEW_BYTES = 32 << 20
#: Headers of at most so many files are broadcast.
HEADED_FILES = 20_000


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def empty_files(files: DataFrame) -> DataFrame:
    """Listing of the files without a byte, which Spark's readers know by name but never return."""
    spark = files.sparkSession
    plain = F.regexp_replace("path", "^([a-z]+):/+", "$1:/")
    names = spark.createDataFrame([(path,) for path in files.inputFiles()], "name string").select(F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B"))).alias("path"))
    missing = names.withColumn("key", plain).join(files.select(plain.alias("key")), "key", "left_anti").select("path").collect()
    conf, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = []
    for row in missing:
        path = path_of(row.path)
        found.append((path.toString(), path.getFileSystem(conf).getFileStatus(path).getModificationTime()))
    rows = spark.createDataFrame(found, "path string, at long")
    return rows.select("path", F.lit(0).cast("long").alias("size_bytes"), F.timestamp_millis("at").alias("received_at"))


def list_zone(
    spark: SparkSession, folder: str, name: Column | None = None, suffixes: str = r"\.(csv|json)$"
) -> DataFrame:
    """CSV and JSON files of a zone, newest first; a missing folder is an empty zone.

    Only names, sizes and times are read. `name` derives the feed file name from
    the path where a file is delivered inside its own folder.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except AnalysisException:
        empty = spark.createDataFrame([], LISTING)
        return empty.withColumn("file_name", base_name(F.col("path")))
    listed = files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("received_at"))
    listed = listed.unionByName(empty_files(files))
    named = listed.withColumn("file_name", name if name is not None else base_name(F.col("path")))
    return named.filter(F.col("path").rlike(suffixes)).orderBy(F.col("received_at").desc(), "file_name")


def read_sidecars(
    spark: SparkSession, folder: str, name: Column | None = None, glob: str = f"*{SIDECAR_SUFFIX}"
) -> DataFrame:
    """Control records by feed file name; unreadable ones come back with null fields."""
    try:
        docs = (
            spark.read.schema(SIDECAR)
            .option("multiLine", "true")
            .option("mode", "PERMISSIVE")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .json(folder)
        )
    except AnalysisException:
        return spark.createDataFrame([], "feed_file string, expected_rows double, checksum_sha256 string, source_system string")
    path = F.col("_metadata.file_path").alias("path")
    feed = name if name is not None else F.regexp_replace(base_name(F.col("path")), r"\.manifest\.json$", "")
    return docs.select(path, "*").select(feed.alias("feed_file"), "expected_rows", "checksum_sha256", "source_system")


def streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the files named in `path`, a few megabytes at a time."""
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            system, inner = pa.fs.FileSystem.from_uri(path)
            state = hashlib.sha256()
            with system.open_input_stream(inner) as stream:
                while piece := stream.read(PIECE):
                    state.update(piece)
            digests.append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(digests, pa.string())], ["path", "computed_checksum"])


def checksums(
    spark: SparkSession, folder: str, name: Column | None = None, glob: str = "*.csv", whole: int = WHOLE_FILE
) -> DataFrame:
    """SHA-256 of every file's content, whatever its size.

    A digest covers a file from start to end, so a file is one task's work. Files
    of at most `whole` bytes are hashed as values; longer ones are read in
    pieces by a task of their own, on storage that Arrow can open (local and
    shared folders, HDFS, object stores).
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    )

    def named(found: DataFrame) -> DataFrame:
        shown = found.withColumn("file_name", name if name is not None else base_name(F.col("path")))
        return shown.select("file_name", "computed_checksum", "size_bytes")

    # The reader drops files by length before it opens them.
    short = files.filter(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("computed_checksum"), F.col("length").alias("size_bytes"))
    long = cut_lineage(files.filter(F.col("length") > whole).select("path", F.col("length").alias("size_bytes")))
    nothing = empty_files(files).select("path", F.sha2(F.lit("").cast("binary"), 256).alias("computed_checksum"), "size_bytes")
    short = short.unionByName(nothing)
    n = long.count()
    if n == 0:
        return named(short)
    dealt = long.select("path").repartitionByRange(min(n, MAX_LONG_TASKS), "path")
    digests = long.join(dealt.mapInArrow(streamed_digests, "path string, computed_checksum string"), "path")
    return named(short.unionByName(digests.select(*short.columns)))


def split_fields(raw: Column) -> Column:
    """Trimmed fields of a CSV record: commas outside quotes separate, a doubled quote inside quotes is one quote.

    Every second piece between quotes lies inside them; an empty piece between
    two of those is a doubled quote. Works in one pass whatever the length.
    """
    pieces = F.split(F.translate(raw, MARK, "\ufffd"), '"')

    def piece(text: Column, at: Column) -> Column:
        doubled = (text == "") & (at > 0) & (at < F.size(pieces) - 1)
        return F.when(at % 2 == 1, text).when(doubled, F.lit('"')).otherwise(F.replace(text, F.lit(","), F.lit(MARK)))

    quoted = F.split(F.array_join(F.transform(pieces, piece), ""), MARK)
    fields = F.when(F.contains(raw, F.lit('"')), quoted).otherwise(F.split(raw, ","))
    return F.transform(fields, lambda field: F.btrim(field, F.lit(BLANKS)))


def text_lines(reader, folder: str, glob: str = "*.csv") -> DataFrame:
    """Lines of all feed files with path, split and line ending; `reader` is `spark.read` or `spark.readStream`."""
    files = reader.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").load(folder)
    # A line ends with LF, CR LF or a lone CR; which one matters only inside quotes.
    bare = F.regexp_replace("value", "\r$", "")
    cut = F.when(F.contains(bare, F.lit("\r")), F.split(bare, "\r")).otherwise(F.array(bare))
    end = F.when(F.col("value").endswith("\r"), "\r\n").otherwise("\n")
    parts = files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), end.alias("end"),
        F.size(cut).alias("parts"), F.posexplode(cut).alias("part", "raw"),
    )
    return parts.select("path", "block", "raw", F.when(F.col("part") < F.col("parts") - 1, "\r").otherwise(F.col("end")).alias("end"))


def joined_records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Records of files in which quotes span lines: path, row_index (header is -1), raw.

    A line lies inside quotes if an odd number of quotes comes before it in its
    file. Quotes are counted per split, so each split knows the state it starts
    in, and one window over a split finds the lines that start a record; the
    record that a split starts inside belongs to the last start before it. A
    quote that is never closed takes the rest of its file into its record.
    """
    inside = Window.partitionBy("path", "block").orderBy("mid")
    before, through = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    quotes = F.col("odd_before") + F.coalesce(F.sum(F.col("odd").cast("long")).over(before), F.lit(0))
    starts = (F.col("continues") == 0) & ~F.col("blank")
    marked = (
        lines.join(splits.select("path", "block", "odd_before"), ["path", "block"])
        .withColumn("continues", quotes % 2)
        .withColumn("starts", starts)
        .withColumn("local", F.sum(F.col("starts").cast("long")).over(through))
    )
    marked = cut_lineage(marked.filter("continues = 1 or starts"))
    counts = marked.groupBy("path", "block").agg(F.max("local").alias("records"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "block", F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("records_before"))
    # A continuing line has the number of the record that started last.
    numbered = marked.join(offsets, ["path", "block"]).withColumn("row_index", F.col("records_before") + F.col("local") - 2)
    single = (F.col("continues") == 0) & ~F.col("odd")
    pieces = numbered.filter(~single).groupBy("path", "row_index").agg(
        F.sort_array(F.collect_list(F.struct("block", "mid", "raw", "end"))).alias("p")
    )
    last = F.size("p") - 1
    text = F.array_join(F.transform("p", lambda x, i: F.concat(x["raw"], F.when(i < last, x["end"]).otherwise(""))), "")
    return numbered.filter(single).select("path", "row_index", "raw").unionByName(pieces.select("path", "row_index", text.alias("raw")))


def quotes_of(raw: Column) -> Column:
    return F.when(F.contains(raw, F.lit('"')), F.length(raw) - F.length(F.replace(raw, F.lit('"'), F.lit("")))).otherwise(0)


def are_few(records: DataFrame) -> bool:
    """Whether all lines together are few enough for `index_few`, by one count of them."""
    seen = records.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("size")).first()
    return seen.lines <= FEW_LINES and seen.size <= FEW_BYTES


def index_few(records: DataFrame, name: Column | None = None) -> DataFrame:
    """The rows of `index_records` for lines that are few together (`are_few`).

    One task sorts the lines of each file, so nothing is shuffled or written in
    between and a small micro-batch costs one job.
    """
    lines = records.select("path", "block", "raw", "end").coalesce(1).withColumns(
        {"odd": (quotes_of(F.col("raw")) % 2).cast("long"), "blank": F.btrim("raw", F.lit(BLANKS)) == "", "mid": F.monotonically_increasing_id()}
    )
    inside = Window.partitionBy("path").orderBy("block", "mid")
    before, through = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("continues", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    marked = marked.withColumn("starts", ~F.col("continues") & ~F.col("blank"))
    # A continuing line has the number of the record that started last; the header is -1.
    numbered = marked.withColumn("row_index", F.sum(F.col("starts").cast("long")).over(through) - 2).filter("continues or starts")
    pieces = numbered.groupBy("path", "row_index").agg(F.sort_array(F.collect_list(F.struct("block", "mid", "raw", "end"))).alias("p"))
    last = F.size("p") - 1
    text = F.array_join(F.transform("p", lambda x, i: F.concat(x["raw"], F.when(i < last, x["end"]).otherwise(""))), "")
    found = pieces.select("path", "row_index", text.alias("raw"))
    plain = F.when(F.col("row_index") == -1, F.regexp_replace("raw", "^\ufeff", "")).otherwise(F.col("raw"))
    split = found.select("path", "row_index", split_fields(plain).alias("fields"))
    header = F.max(F.when(F.col("row_index") == -1, F.col("fields"))).over(Window.partitionBy("path"))
    rows = split.withColumn("header", header).filter("row_index >= 0")
    named = name if name is not None else base_name(F.col("path"))
    return rows.select(named.alias("file_name"), "row_index", "header", "fields", F.size("fields").cast("long").alias("n_fields"))


def index_records(records: DataFrame, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Split lines into records and fields, number the data rows of each file and profile the files.

    The lines are written once with their place, and everything else comes from
    that copy, so another cut into splits between two scans cannot lose rows. A
    file may span many splits: lines are counted per split, the counts of earlier
    splits are added, and the position inside the split gives the rest, so no
    window ever covers a file and most lines are never shuffled. Only files in
    which quotes span lines, or with many blank lines, are shuffled once, split
    by split (`joined_records`). Blank records do not count.

    Rows: file_name, row_index (0-based), header, fields, n_fields.
    Profiles: file_name, header, lines (records, header included).
    """
    lines = records.select("path", "block", "raw", "end").withColumns(
        {"odd": quotes_of(F.col("raw")) % 2 == 1, "blank": F.btrim("raw", F.lit(BLANKS)) == "", "mid": F.monotonically_increasing_id()}
    )
    lines = cut_lineage(lines)
    blocks = lines.groupBy("path", "block").agg(
        F.min("mid").alias("first_mid"), F.count_if("odd").alias("odd"), F.count_if("blank").alias("blanks"),
        F.count_if(~F.col("blank")).alias("n"),
    )
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    splits = cut_lineage(
        blocks.select(
            "path", "block", "first_mid", "blanks", F.coalesce(F.sum("odd").over(earlier), F.lit(0)).alias("odd_before"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
            ((F.sum("odd").over(whole) == 0) & (F.max("blanks").over(whole) <= FEW_BLANKS)).alias("plain"),
        )
    )
    kinds = splits.agg(F.max(~F.col("plain")).alias("joined"), F.max(F.col("plain") & (F.col("blanks") > 0)).alias("gaps")).first()

    # In plain files a record is a line; at most FEW_BLANKS blank lines of its split may come before it.
    plain = splits.filter("plain").withColumn("gaps", F.array().cast("array<long>"))
    if kinds.gaps:
        blank = lines.filter("blank").select("path", "block", "mid")
        gaps = blank.join(splits.filter("plain"), ["path", "block"], "left_semi").groupBy("path", "block").agg(F.collect_list("mid").alias("gaps"))
        plain = cut_lineage(
            splits.filter("plain").join(gaps, ["path", "block"], "left").withColumn("gaps", F.coalesce("gaps", F.array().cast("array<long>")))
        )
    side = F.broadcast(plain) if fits_broadcast(plain) else plain
    skipped = F.when(F.size("gaps") == 0, 0).otherwise(F.size(F.filter("gaps", lambda gap: gap < F.col("mid"))))
    whole_lines = lines.filter("not blank").join(side, ["path", "block"]).select(
        "path", (F.col("mid") - F.col("first_mid") - skipped + F.col("before") - 1).alias("row_index"), "raw"
    )
    found = whole_lines
    if kinds.joined:
        found = whole_lines.unionByName(cut_lineage(joined_records(lines.join(
            splits.filter("not plain").select("path").distinct(), "path", "left_semi"), splits.filter("not plain"))))

    named = name if name is not None else base_name(F.col("path"))
    heads = cut_lineage(
        found.groupBy("path").agg(F.max(F.when(F.col("row_index") == -1, F.col("raw"))).alias("head"), F.count(F.lit(1)).alias("lines"))
    )
    heads = heads.select("path", split_fields(F.regexp_replace("head", "^\ufeff", "")).alias("header"), "lines")
    data = found.filter("row_index >= 0").withColumn("fields", split_fields(F.col("raw")))
    headed = lookup_join(data, heads.select("path", "header"), ["path"], "inner", ["row_index"], HEADED_FILES)
    rows = headed.select(named.alias("file_name"), "row_index", "header", "fields", F.size("fields").cast("long").alias("n_fields"))
    return rows, heads.select(named.alias("file_name"), "header", "lines")


def read_feed(spark: SparkSession, folder: str, name: Column | None = None, glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """Numbered rows and file profiles of a feed folder."""
    return index_records(text_lines(spark.read, folder, glob), name)


def field_of(column: str) -> Column:
    """Text of a named field, blank when the header or a short row lacks it."""
    at = F.array_position("header", column)
    return F.when(at > 0, F.try_element_at("fields", at.cast("int"))).otherwise(F.lit(""))


def feed_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Named text columns in place of the field array."""
    keep = [c for c in rows.columns if c not in ("header", "fields", *columns)]
    return rows.select(*keep, *[F.coalesce(field_of(c), F.lit("")).alias(c) for c in columns])


def structural_errors(rows: DataFrame) -> DataFrame:
    """Files holding a row with more fields than their header, with the first such row.

    Short rows are fine; a long row aborts the load of its file.
    """
    long = rows.filter(F.col("n_fields") > F.size("header"))
    first = long.groupBy("file_name").agg(F.min(F.struct("row_index", "n_fields", F.size("header").alias("declared"))).alias("e"))
    return first.select(
        "file_name",
        F.format_string("record %d holds %d fields, the header %d", F.col("e.row_index") + 2, F.col("e.n_fields"), F.col("e.declared")).alias(
            "load_error"
        ),
    )
