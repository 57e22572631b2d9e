"""Message logs of several layouts as one stream: timestamp, can_id, dlc, label,
capture, seq.

Text layouts are read as lines, all files in one scan.  A line's place is the
start of its split and its number within the task, so ``seq`` orders lines as the
file does although files are split.  Header lines are collected once per distinct
layout, not per file; a file whose layout can't be resolved is left out.
Captures number the files with messages, in the order of their paths.
"""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators.stream import cap, clean, positions

LOG = logging.getLogger("framelark")
READERS: dict[str, Callable] = {}

# First-row words by which a header is told from data.
HEADER_WORDS = ("timestamp", "arbitration_id", "class", "can_id")
FILES = {"generic_csv": "*.{csv,tsv,txt}", "car_hacking": "*.{csv,txt}", "can_ids": "*.{txt,log,csv}", "ornl": "*.csv", "sad": "*.{csv,txt}", "candump": "*.log"}


def reader(name: str):
    """Register a reader: (spark, path, **options) -> timestamp, can_id, dlc, label, file, seq."""

    def add(f):
        READERS[name] = f
        return f

    return add


def lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """value, file, seq of all lines of the matching files below ``path``."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("seq"))


def _first_lines(rows: DataFrame) -> DataFrame:
    return rows.where("seq.start = 0").groupBy("file").agg(F.min_by("value", "seq").alias("head"))


def _separator(sep: str) -> str:
    """A pattern for ``sep`` outside of quotes: an even number of them follows."""
    return "\\Q" + sep + "\\E" + '(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _fields(sep: str) -> Column:
    return F.transform(F.split("value", _separator(sep)), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))


def _names(head: str, sep: str) -> list[str]:
    return [c.strip().strip('"') for c in re.split(re.escape(sep) + '(?=(?:[^"]*"[^"]*")*[^"]*$)', head)]


def _layouts(spark: SparkSession, rows: DataFrame, resolve: Callable[[str], tuple | None]) -> DataFrame:
    """file, head and the places that ``resolve`` gives for its first line; unresolved
    files are left out.  One row a file passes the driver, as in any file listing."""
    made, places = [], {}
    for r in _first_lines(rows).collect():
        if r.head not in places:
            places[r.head] = resolve(r.head or "")
            if places[r.head] is None:
                LOG.warning("left out: no readable layout in %r", (r.head or "")[:80])
        if places[r.head] is not None:
            made.append((r.file, r.head, *places[r.head]))
    return spark.createDataFrame(made, "file string, head string, header boolean, t int, i int, d int, l int")


def _header_places(head: str, sep: str, options: dict, need_label: bool = True) -> tuple | None:
    names = _names(head, sep)
    place = lambda option, known: names.index(options[option]) if options.get(option) in names else (names.index(found) if (found := parsing.resolve(names, known)) is not None else None)
    t, i, d, label = place("timestamp_col", parsing.TIMESTAMP_NAMES), place("can_id_col", parsing.CAN_ID_NAMES), place("dlc_col", parsing.DLC_NAMES), place("label_col", parsing.LABEL_NAMES)
    if t is None or i is None or (need_label and label is None):
        return None
    return True, t, i, -1 if d is None else d, -1 if label is None else label


def _table(spark: SparkSession, path: str, pattern: str, sep: str, resolve: Callable[[str], tuple | None], label: Callable[[Column], Column] | None = None) -> DataFrame:
    rows = lines(spark, path, pattern)
    told = rows.join(F.broadcast(_layouts(spark, rows, resolve)), "file").where(~(F.col("header") & F.equal_null("value", "head")) & (F.trim("value") != ""))
    f = told.select("file", "seq", "t", "i", "d", "l", "header", _fields(sep).alias("f"))
    at = lambda k: F.get("f", F.col(k))
    raw_id = at("i")
    flag = F.when(F.col("header"), at("l")).otherwise(parsing.last_field(F.col("f")))
    hexes = f.groupBy("file").agg(F.max(parsing.looks_hex(raw_id)).alias("hexadecimal"), F.max(F.coalesce(parsing.not_a_number(flag), F.lit(False))).alias("words"))
    told_label = F.when(F.col("words"), parsing.label(flag)).otherwise(parsing.numeric_label(flag))
    return f.join(F.broadcast(hexes), "file").select(
        at("t").try_cast("double").alias("timestamp"), parsing.can_id(raw_id, F.col("hexadecimal")).alias("can_id"), F.when(F.col("d") >= 0, at("d").try_cast("double").cast("long")).alias("dlc"),
        (label(at("t").try_cast("double")) if label else told_label).alias("label"), "file", "seq")


@reader("generic_csv")
def generic(spark, path, **options):
    if path.endswith(".parquet"):
        return _frame(spark.read.parquet(path), options)
    sep = options.get("sep") or ("\t" if path.endswith(".tsv") else ",")
    return _table(spark, path, options.get("pattern", FILES["generic_csv"]), sep, lambda head: _header_places(head, sep, options))


def _frame(raw: DataFrame, options: dict) -> DataFrame:
    name = lambda option, known: options.get(option) or parsing.resolve(raw.columns, known)
    t, i, d, label = name("timestamp_col", parsing.TIMESTAMP_NAMES), name("can_id_col", parsing.CAN_ID_NAMES), name("dlc_col", parsing.DLC_NAMES), name("label_col", parsing.LABEL_NAMES)
    if not (t and i and label):
        raise ValueError(f"no time, id or label among {raw.columns[:10]}")
    numeric, plain_ids = (dict(raw.dtypes)[c] != "string" for c in (label, i))
    rows = raw.select(F.col(f"`{t}`").alias("t"), F.col(f"`{i}`").alias("i"), (F.col(f"`{d}`") if d else F.lit(None)).alias("d"), F.col(f"`{label}`").alias("l"), F.col("_metadata.file_path").alias("file"),
                      F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("seq"))
    hexes = rows.groupBy("file").agg(F.max(parsing.looks_hex(F.col("i"))).alias("hexadecimal"))
    return rows.join(F.broadcast(hexes), "file").select(
        F.col("t").try_cast("double").alias("timestamp"), (parsing.numeric_id(F.col("i")) if plain_ids else parsing.can_id(F.col("i"), F.col("hexadecimal"))).alias("can_id"), F.col("d").try_cast("long").alias("dlc"),
        (parsing.numeric_label(F.col("l")) if numeric else parsing.label(F.col("l"))).alias("label"), "file", "seq")


def _headerless(_head: str) -> tuple:
    return False, 0, 1, 2, -1


@reader("car_hacking")
def car_hacking(spark, path, **options):
    def places(head):
        return _header_places(head, ",", options) if any(n.lower() in HEADER_WORDS for n in _names(head, ",")) else _headerless(head)

    return _table(spark, path, FILES["car_hacking"], ",", places)


@reader("sad")
def sad(spark, path, **options):
    return _table(spark, path, FILES["sad"], ",", lambda head: _header_places(head, ",", options) or _headerless(head))


@reader("can_ids")
def can_ids(spark, path, **options):
    """Log lines, labelled by the file's name, and CSV exports."""
    text = lines(spark, path, "*.{txt,log}")
    p = parsing.LOG_LINE
    name = F.element_at(F.split("file", "/"), -1)
    logs = text.where(F.col("value").rlike(p["dlc"])).select(
        parsing.found(F.col("value"), p["timestamp"]).try_cast("double").alias("timestamp"), F.conv(parsing.found(F.col("value"), p["can_id"]), 16, 10).cast("long").alias("can_id"),
        parsing.found(F.col("value"), p["dlc"]).cast("long").alias("dlc"), parsing.file_label(name).alias("label"), "file", "seq")
    tables = _table(spark, path, "*.csv", ",", lambda head: _header_places(head, ",", options))
    return logs.unionByName(tables)


@reader("ornl")
def ornl(spark, path, attack_start: float | None = None, attack_end: float | None = None, **options):
    """Labelled files as they are; files without a label column by the attack interval."""
    rows = lines(spark, path, FILES["ornl"])
    heads = [h for (h,) in _first_lines(rows).select("head").distinct().collect()]
    labelled = all(_header_places(h or "", ",", options) for h in heads)
    if labelled:
        return _table(spark, path, FILES["ornl"], ",", lambda head: _header_places(head, ",", options))
    if attack_start is None or attack_end is None:
        raise ValueError("files without a label column need attack_start and attack_end")
    known = _table(spark, path, FILES["ornl"], ",", lambda head: _header_places(head, ",", options))
    interval = lambda t: parsing.between(t, F.lit(float(attack_start)), F.lit(float(attack_end)))
    bare = _table(spark, path, FILES["ornl"], ",", lambda head: None if _header_places(head, ",", options) else _header_places(head, ",", options, need_label=False), interval)
    return known.unionByName(bare)


@reader("candump")
def candump(spark, path, metadata: str | dict | None = None, **options):
    """candump frames, labelled by the injection interval of their capture (seconds since
    its first frame in file order).  With metadata, captures that it lacks are left out; those
    with a null interval too, unless their path has a part named ambient."""
    from ..plans.catalog import candump_lines

    rows = candump_lines(lines(spark, path, FILES["candump"]).withColumnRenamed("value", "line"))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.log$", "")
    firsts = rows.groupBy("file").agg(F.min_by("timestamp", "seq").alias("first")).withColumn("name", name).withColumn("ambient", F.col("file").contains("/ambient/"))
    if metadata is not None:
        told = json.loads("\n".join(r.value for r in spark.read.text(metadata).collect())) if isinstance(metadata, str) else metadata
        spans = [(k, float(v["injection_interval"][0]), float(v["injection_interval"][1])) for k, v in told.items() if isinstance(v.get("injection_interval"), list) and len(v["injection_interval"]) == 2]
        intervals = spark.createDataFrame(spans, "name string, start double, stop double")
        firsts = firsts.join(F.broadcast(intervals), "name", "left").where(F.col("start").isNotNull() | F.col("ambient"))
    else:
        firsts = firsts.withColumn("start", F.lit(None).cast("double")).withColumn("stop", F.lit(None).cast("double"))
    attack = ~F.col("ambient") & F.coalesce((F.col("timestamp") - F.col("first")).between(F.col("start"), F.col("stop")), F.lit(False))
    ident = F.when(F.col("id").rlike("^[0-9A-F]{1,15}$"), F.conv("id", 16, 10).cast("long")).otherwise(-1)
    return rows.join(F.broadcast(firsts.select("file", "first", "start", "stop", "ambient")), "file").select("timestamp", ident.alias("can_id"), "dlc", attack.cast("tinyint").alias("label"), "file", "seq")


def number_captures(rows: DataFrame) -> DataFrame:
    """``file`` -> ``capture``: 0, 1, ... over the files with a valid message, by path."""
    valid = clean(rows.withColumn("capture", F.lit(0)).withColumn("seq", F.struct("file", "seq"))).select(F.col("seq.file").alias("file")).distinct()
    numbered = valid.select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("capture"))
    return rows.join(F.broadcast(numbered), "file").drop("file")


def read(spark: SparkSession, adapter: str, path: str, max_messages: int | None = None, **options) -> DataFrame:
    """The stream of all files of one dataset: timestamp, t_us, can_id, dlc, label,
    capture, seq; with ``max_messages``, the central part of every capture."""
    if adapter not in READERS:
        raise KeyError(f"unknown adapter {adapter!r}; there are {sorted(READERS)}")
    rows = clean(number_captures(READERS[adapter](spark, path, **options)))
    rows = rows.withColumn("t_us", F.round(F.col("timestamp") * 1e6).cast("long"))
    return cap(positions(rows), max_messages).drop("pos") if max_messages else rows


def cached(spark: SparkSession, folder: str, name: str, adapter: str, path: str, max_messages: int | None = None, **options) -> DataFrame:
    """``read`` through a Parquet copy in ``folder``.  The copy's name is made of all
    arguments and of the files' sizes and times, so that changed files are read anew."""
    from ..search.space import stable_hash

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").cast("string").alias("t"))
    state = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "t").cast("decimal(38,0)")).cast("string")).first()
    copy = f"{folder.rstrip('/')}/{name}_{stable_hash([name, adapter, path, max_messages, options, list(state)])}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(copy)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(copy + "/_SUCCESS")):
        read(spark, adapter, path, max_messages, **options).write.mode("overwrite").parquet(copy)
    return spark.read.parquet(copy)
