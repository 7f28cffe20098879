"""Readers. Every text reader attaches line_no, from 0, because row order carries meaning.

A file is read in splits, one task each; a line's number is its place in its split and the lines of the
splits before it, so files of any size go the same way and no task sees a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.sources import schemas

CHUNK = 100_000


def lines(spark: SparkSession, path: str, trim: bool = True) -> DataFrame:
    """(line_no, line) of one file; blanks stay. Lines end with a line feed, before which a carriage
    return is dropped; an empty file has none."""
    read = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__id"), F.regexp_replace("value", "\r$", "").alias("line"))
    splits = read.groupBy("__split").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = splits.withColumn("__before", F.sum("__n").over(W.orderBy("__split")) - F.col("__n")).drop("__n")  # a row for each split
    rows = read.join(F.broadcast(before), "__split").select((F.col("__id") - F.col("__first") + F.col("__before")).alias("line_no"), "line")
    return rows.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")) if trim else rows


def counted_before(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """Column name: how many flagged rows there are up to each, in order of line_no. Chunks of lines
    are counted first, so no window is one task but that over the chunks' counts."""
    chunked = rows.withColumn("__c", F.floor(F.col("line_no") / CHUNK)).withColumn("__f", F.when(flag, 1).otherwise(0))
    sums = chunked.groupBy("__c").agg(F.sum("__f").alias("__s"))
    before = sums.withColumn("__before", F.sum("__s").over(W.orderBy("__c")) - F.col("__s")).drop("__s")
    here = F.sum("__f").over(W.partitionBy("__c").orderBy("line_no"))
    return chunked.withColumn("__here", here).join(F.broadcast(before), "__c").withColumn(name, F.col("__here") + F.col("__before")).drop("__c", "__f", "__here", "__before")


def non_blank(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """Non-blank lines, numbered anew; a cap counts raw lines."""
    kept = rows.where((F.col("line") != "") & (F.lit(cap is None) | (F.col("line_no") < (cap or 0))))
    return counted_before(kept, F.lit(True), "__at").select((F.col("__at") - 1).alias("line_no"), "line")


def length_report(*sides: DataFrame, names: list[str]) -> DataFrame:
    """Lines of each side, and how many of them ``zipped`` cuts off."""
    rows = None
    for side, name in zip(sides, names, strict=True):
        one = side.agg(F.lit(name).alias("side"), F.count("*").alias("lines"))
        rows = one if rows is None else rows.union(one)
    return rows.join(F.broadcast(rows.agg(F.min("lines").alias("least")))).select("side", "lines", (F.col("lines") - F.col("least")).alias("cut"))


def zipped(*sides: DataFrame, names: list[str], strict: bool = False) -> DataFrame:
    """Lines side by side, down to the shortest; ``strict`` asks for equal lengths."""
    if strict and len({s.count() for s in sides}) > 1:
        raise ValueError("the files differ in length")
    out = sides[0].withColumnRenamed("line", names[0])
    for side, name in zip(sides[1:], names[1:], strict=True):
        out = out.join(side.withColumnRenamed("line", name), "line_no")
    return out


def pairs(spark: SparkSession, source: str, target: str, blanks: str = "pairs") -> DataFrame:
    """(line_no, source, target). Blanks: ``keep``; drop ``pairs`` with a blank side; or drop them
    from each ``side`` before pairing, which can put lines out of step."""
    a, b = lines(spark, source), lines(spark, target)
    if blanks == "side":
        a, b = non_blank(a), non_blank(b)
    out = zipped(a, b, names=["source", "target"])
    return out.where("source <> '' and target <> ''") if blanks == "pairs" else out


def splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Parquet files of several splits as one table with a split column."""
    out = None
    for name, path in paths.items():
        part = spark.read.parquet(path).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def columns(spark: SparkSession, path: str, keep: list[str]) -> DataFrame:
    """These columns of a Parquet table; no others are read."""
    return spark.read.parquet(path).select(*keep)


def staged(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of these Parquet tables that is there: a download, then its cached copy."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            return spark.read.parquet(path)
    raise FileNotFoundError(", ".join(paths))


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header, multiLine=True, escape='"', mode="PERMISSIVE")


def raw_csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Rows of up to ``width`` columns c0, c1, ..., null where short."""
    return spark.read.csv(path, schema=", ".join(f"c{i} string" for i in range(width)), header=False, mode="PERMISSIVE")


def tsv(spark: SparkSession, path: str, schema: str = schemas.ALIGNED) -> DataFrame:
    """Rows with all of the schema's fields; no quoting."""
    wanted = len(schema.split(","))
    rows = lines(spark, path, trim=False).where("line_no > 0").withColumn("f", F.split("line", "\t")).where(F.size("f") >= wanted)
    fields = [f.split() for f in schema.split(",")]
    return rows.select("line_no", *(F.get("f", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)))


def pipe_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A table of | cells under two heading lines."""
    cells = F.transform(F.filter(F.split("line", r"\|"), lambda c: F.trim(c) != ""), lambda c: F.trim(c))
    rows = lines(spark, path).where("line_no >= 2").withColumn("f", cells).where(F.size("f") >= len(names))
    return rows.select("line_no", *(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)))


def separated_pairs(spark: SparkSession, path: str, mark: str = "<sep>") -> DataFrame:
    """(line_no, pos, src, tgt) of src<sep>tgt tokens."""
    words = lines(spark, path).select("line_no", F.posexplode(tokens(F.col("line"))).alias("pos", "t")).where(F.contains("t", F.lit(mark)))
    return words.select("line_no", "pos", F.substring_index("t", mark, 1).alias("src"), F.substr("t", F.locate(mark, F.col("t")) + len(mark)).alias("tgt"))


def dictionary_audit(rows: DataFrame, mark: str = "->") -> DataFrame:
    """Every line with its entry and why it is skipped: empty line, missing separator, empty source."""
    parts = F.split("line", mark, 2)
    src, tgt = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    reason = F.when(F.trim("line") == "", "empty line").when(F.size(parts) < 2, "missing separator").when(src == "", "empty source")
    return rows.select("line_no", src.alias("src"), tgt.alias("tgt"), reason.alias("reason"))


def dictionary(rows: DataFrame, mark: str = "->") -> DataFrame:
    """(src, tgt): the last entry of each source wins."""
    return dictionary_audit(rows, mark).where("reason is null").groupBy("src").agg(F.max_by("tgt", "line_no").alias("tgt"))


def sectioned_mapping(rows: DataFrame, begin: str = "Core Mappings", end: str = "Special Cases") -> DataFrame:
    """(src, tgt) of the lines between two headings; a file of settings, read in one task."""
    heading = F.when(F.startswith("line", F.lit("##")), F.col("line"))
    under = rows.withColumn("h", F.last(heading, ignorenulls=True).over(W.orderBy("line_no")))
    kept = under.where(F.contains("h", F.lit(begin)) & ~F.contains("h", F.lit(end)) & ~F.startswith("line", F.lit("#")))
    return dictionary(kept.select("line_no", "line"))


def disambiguated(rows: DataFrame) -> DataFrame:
    """(line_no, block, prob, word, analysis) of ``prob: word analysis`` lines; blank lines end a
    block. Malformed lines are left out but do not."""
    blocks = counted_before(rows, F.col("line") == "", "block")
    pattern = r"^(-?[0-9.eE+-]+):\s+(\S+)\s+(.+)$"
    return blocks.where(F.col("line").rlike(pattern)).select("line_no", "block", F.regexp_extract("line", pattern, 1).try_cast("double").alias("prob"), F.regexp_extract("line", pattern, 2).alias("word"), F.regexp_extract("line", pattern, 3).alias("analysis")).where("prob is not null")


def strict_pairs(rows: DataFrame, mark: str = " -> ") -> tuple[DataFrame, DataFrame]:
    """((line_no, src, tgt) of every line with the mark, repeats and all; lines that have none)."""
    has = F.contains("line", F.lit(mark))
    src = F.trim(F.substring_index("line", mark, 1))
    tgt = F.trim(F.substr("line", F.locate(mark, F.col("line")) + len(mark)))
    return rows.where(has).select("line_no", src.alias("src"), tgt.alias("tgt")), rows.where(~has & (F.trim("line") != ""))


def keys(rows: DataFrame, mark: str = "->") -> DataFrame:
    """(line_no, src): what stands before the mark."""
    return rows.where(F.contains("line", F.lit(mark))).select("line_no", F.trim(F.substring_index("line", mark, 1)).alias("src"))


def repeated_entries(rows: DataFrame, mark: str = "->") -> DataFrame:
    """(line_no, src, tgt, first_line) of entries whose source an earlier line has."""
    entries = dictionary_audit(rows, mark).where("reason is null").drop("reason")
    first = entries.groupBy("src").agg(F.min("line_no").alias("first_line"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return entries.join(first, "src").where("line_no > first_line").select("line_no", "src", "tgt", "first_line")


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """``key: value`` lines of a small file of settings, those of sections as section.key; quotes
    and comments go. Read on the driver."""
    out, section = {}, ""
    for line in spark.read.text(path, wholetext=True).first()[0].splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#") or ":" not in bare:
            continue
        name, _, value = bare.partition(":")
        if bare[0] not in " \t":
            section = "" if value.strip() else f"{name.strip()}."
        out |= {(section if bare[0] in " \t" else "") + name.strip(): value.strip().strip("'\"")} if value.strip() else {}
    return out


def segmentations(rows: DataFrame) -> DataFrame:
    """(line_no, word, segmented) of two-column lines."""
    f = F.split("line", "\t")
    return rows.where(F.size(f) == 2).select("line_no", F.get(f, F.lit(0)).alias("word"), F.get(f, F.lit(1)).alias("segmented"))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def sentences(document: DataFrame) -> DataFrame:
    """A row for each sentence of analysis documents."""
    return document.select(F.explode("sentences").alias("s")).select("s.sentence_id", "s.text", "s.analyses")


def jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines). Lines that do not parse are reported, not fatal."""
    made = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(made.alias("r")).select("r.*")
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select("_corrupt_record")


def folder(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Lines of files below a folder, with parts of their paths as columns."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).withColumn("__path", F.col("_metadata.file_path"))
    return rows.select(*(F.regexp_extract("__path", pattern, i + 1).alias(n) for i, n in enumerate(names)), F.col("value").alias("line"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))


def lexicon(rows: DataFrame) -> DataFrame:
    """(line_no, stem, class) of ``stem Class;`` entries; ! begins a comment."""
    bare = F.trim(F.regexp_replace("line", "!.*$", ""))
    pattern = r"^(\S+)\s+(\w+)\s*;"
    return rows.where(bare.rlike(pattern)).select("line_no", F.regexp_extract(bare, pattern, 1).alias("stem"), F.regexp_extract(bare, pattern, 2).alias("class"))


def lexicon_with_includes(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, stem, class) of a lexicon and of all that it includes, each file once. Names of
    included files are read on the driver, entries are not."""
    folder, done, open_, out = path.rsplit("/", 1)[0], [], [path], None
    while open_:
        file = open_.pop(0)
        if file in done:
            continue
        done.append(file)
        rows = lines(spark, file)
        found = rows.where(F.col("line").rlike(r'^#include\s+"')).orderBy("line_no").select(F.regexp_extract("line", r'^#include\s+"([^"]+)"', 1).alias("f")).collect()
        open_ += [f"{folder}/{r.f}" for r in found]
        part = lexicon(rows).withColumn("file", F.lit(file.rsplit("/", 1)[1]))
        out = part if out is None else out.unionByName(part)
    return out.select("file", "line_no", "stem", "class")


def template(spark: SparkSession, path: str) -> str:
    """A prompt template: a small text, read on the driver."""
    return spark.read.text(path, wholetext=True).first()[0]


def checkpoints(names: DataFrame, column: str = "name") -> DataFrame:
    """The name with the largest step."""
    step: Column = F.regexp_extract(column, r"step_(\d+)", 1).try_cast("long")
    return names.select(F.max_by(column, step).alias(column), F.max(step).alias("step"))
