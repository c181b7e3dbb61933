"""Scans of run folders: metadata, JSON-lines logs, game notation, progress logs.

Every scan is one distributed read over a path glob, so a root with a million runs is one job and
not a loop. The run key comes from the file path; `game` leaves every reader as an int.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rookery import schemas
from rookery.functions import names

_CORRUPT = "_corrupt"


def run_globs(root: str, file: str, include_invalid: bool = True) -> list[str]:
    root = root.rstrip("/")
    paths = [f"{root}/[!_]*/{file}"]
    if include_invalid:
        paths.append(f"{root}/_invalid/*/{file}")
    return paths


def _path_columns(path: Column | None = None) -> dict[str, Column]:
    path = F.col("_metadata.file_path") if path is None else path
    folder = F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
    quarantined = F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1) == "_invalid"
    return {
        "run_id": names.run_id(folder, quarantined),
        "valid": ~quarantined,
        "run_dir": F.regexp_replace(path, r"/[^/]+$", ""),
        "folder": folder,
    }


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Globs with at least one match (names only, nothing is read)."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for pattern in paths:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        matches = path.getFileSystem(conf).globStatus(path)
        if matches is not None and len(matches) > 0:
            found.append(pattern)
    return found


def read_log(
    spark: SparkSession,
    paths: str | list[str],
    schema: str,
    mode: str = "tolerant",
    with_run: bool = True,
) -> DataFrame:
    """JSON-lines scan. A missing file is an empty table.

    tolerant: blank and malformed lines are dropped (a truncated last line after a crash).
    strict:   a malformed line fails the job.
    Column `_seq` numbers the rows in file order within a run (last one wins on duplicates).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = _existing(spark, paths)
    fields = [f.name for f in StructType.fromDDL(schema).fields]
    if mode not in ("tolerant", "strict"):
        raise ValueError(f"mode must be tolerant or strict, not {mode!r}")
    if not found:
        empty = spark.createDataFrame([], schema)
        if with_run:
            empty = empty.withColumn("run_id", F.lit(None).cast("string")).withColumn(
                "_seq", F.lit(None).cast("bigint")
            )
        return _int_game(empty)
    extra = []
    if with_run:
        extra = [
            _path_columns()["run_id"].alias("run_id"),
            # task order follows (file, offset); the low bits count rows inside the split
            (F.col("_metadata.file_block_start") * F.lit(1 << 20)
             + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("_seq"),
        ]
    if mode == "strict":
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(found).select(*fields, *extra)
    else:
        # lines are parsed here and not by the reader, which refuses to count rows by their
        # corrupt-record column alone
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
        parsed = F.from_json("value", f"{schema}, {_CORRUPT} string", options)
        lines = spark.read.text(found).select(parsed.alias("_r"), F.col("value"), *extra)
        kept = lines.where((F.trim("value") != "") & F.col(f"_r.{_CORRUPT}").isNull())
        df = kept.select(*[F.col(f"_r.{f}").alias(f) for f in fields], *[c for c in kept.columns if c not in ("_r", "value")])
    return _int_game(df)


def _int_game(df: DataFrame) -> DataFrame:
    if "game" in df.columns and dict(df.dtypes)["game"] != "int":
        df = df.withColumn("game", F.col("game").try_cast("int"))
    return df


def discover_runs(
    spark: SparkSession, root: str, prefix: str | None = None, include_invalid: bool = True
) -> DataFrame:
    """Folders with a meta.json: run_id, valid, run_dir. `prefix` is a substring of the name."""
    runs = read_meta(spark, root, include_invalid).select("run_id", "valid", "run_dir", "folder")
    return runs.where(F.col("folder").contains(prefix)) if prefix else runs


def read_meta(spark: SparkSession, root: str, include_invalid: bool = True) -> DataFrame:
    """One row per run with the metadata text and its parsed fields; invalid JSON gives NULL fields."""
    found = _existing(spark, run_globs(root, "meta.json", include_invalid))
    if not found:
        base = spark.createDataFrame(
            [], "run_id string, valid boolean, run_dir string, folder string, meta_json string"
        )
    else:
        cols = _path_columns()
        base = spark.read.text(found, wholetext=True).select(
            *[c.alias(n) for n, c in cols.items()], F.col("value").alias("meta_json")
        )
    parsed = F.from_json("meta_json", schemas.META)
    return base.withColumn("meta", parsed).select(
        "run_id", "valid", "run_dir", "folder", "meta_json", "meta.*"
    )


def run_rows(meta: DataFrame, commit: str | None = None) -> DataFrame:
    """Rows of the `runs` store table out of `read_meta`."""
    return meta.select(
        "run_id",
        "label",
        names.started_at(F.col("folder")).alias("started_at"),
        "run_dir",
        "meta_json",
        F.lit(commit).cast("string").alias("git_commit"),
        "valid",
        F.current_timestamp().alias("ingested_at"),
    )


def pgn_columns(text: Column) -> dict[str, Column]:
    """Header map and move tokens of one game text.

    Tokenises only: comments, numbers, glyphs and the result marker are dropped and variations in
    brackets are left out at any depth. Legality is not checked.
    """
    header = r'(?m)^\[(\w+) "((?:[^"\\\\]|\\\\.)*)"\]'
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(header), F.lit(1)),
        F.regexp_extract_all(text, F.lit(header), F.lit(2)),
        lambda k, v: F.struct(k.alias("key"), v.alias("value")),
    )
    # the last header of a name wins
    keyed = F.transform(
        F.array_distinct(F.transform(pairs, lambda p: p["key"])),
        lambda k: F.struct(
            k.alias("key"),
            F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value"),
        ),
    )
    body = F.regexp_replace(text, r"(?m)^\[[^\n]*$", "")
    body = F.regexp_replace(body, r"(?s)\{.*?\}", " ")
    body = F.regexp_replace(body, r"(?m);[^\n]*$", " ")
    # text outside all brackets; a bracket that nothing opens counts as a space
    body = F.aggregate(
        F.regexp_extract_all(body, F.lit(r"([()]|[^()]+)"), F.lit(1)),
        F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")),
        lambda s, t: F.struct(
            F.when(t == "(", s["depth"] + 1).when(t == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"]).alias("depth"),
            F.when(t.isin("(", ")"), F.concat(s["text"], F.lit(" ")))
            .when(s["depth"] == 0, F.concat(s["text"], t)).otherwise(s["text"]).alias("text"),
        ),
        lambda s: s["text"],
    )
    body = F.regexp_replace(body, r"\$\d+|\d+\.+|[!?]+", " ")
    body = F.regexp_replace(body, r"(?<!\S)(1-0|0-1|1/2-1/2|\*)(?!\S)", " ")
    moves = F.filter(F.split(body, r"\s+"), lambda m: m != "")
    return {"headers": F.map_from_entries(keyed), "sans": moves}


def read_pgn(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Games of many notation files: run_id, seq, idx, headers, sans, pgn.

    The record separator is the first tag of a game, so large files are split between tasks.
    `idx` is the Round tag, the position in the file where Round is not a number.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = _existing(spark, paths)
    if not found:
        return spark.createDataFrame(
            [],
            "run_id string, seq bigint, round int, idx int, headers map<string,string>, "
            "sans array<string>, pgn string",
        )
    cols = _path_columns()
    raw = (
        spark.read.option("lineSep", "[Event ")
        .text(found)
        .select(
            cols["run_id"].alias("run_id"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"),
            F.when(F.col("value").startswith('"'), F.concat(F.lit("[Event "), F.col("value")))
            .otherwise(F.col("value"))
            .alias("pgn"),
        )
        .where(F.trim(F.col("pgn")).rlike(r"\S"))
    )
    # Games that open with another tag: a tag block after a blank line after move text.
    pieces = F.split(F.trim("pgn"), r"(?<=[^\]\s])\s*\n\s*\n(?=\[\w+ \")")
    raw = raw.select("run_id", "_file", "_block", "_at", F.posexplode(pieces).alias("_piece", "pgn"))
    parts = pgn_columns(F.col("pgn"))
    games = raw.withColumn("headers", parts["headers"]).withColumn("sans", parts["sans"])
    # Position in the file, used where Round is not a number; a file holds the games of one run. Games are
    # numbered inside their block of the file, which is as large as a task's share at most; the games of the
    # blocks before it are added from one row per block.
    inside = Window.partitionBy("_file", "_block").orderBy("_at", "_piece")
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n")).select(
        "_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    round_text = F.coalesce(F.try_element_at("headers", F.lit("Round")), F.lit("0"))
    round_no = F.when(F.trim(round_text) == "", F.lit(0)).otherwise(round_text.try_cast("int"))
    return (
        games.withColumn("_in", F.row_number().over(inside)).join(blocks, ["_file", "_block"])
        .withColumn("seq", F.col("_before") + F.col("_in") - 1)
        .withColumn("round", round_no)
        .withColumn("idx", F.coalesce(round_no, F.col("seq").cast("int")))
        .select("run_id", "seq", "round", "idx", "headers", "sans", F.trim("pgn").alias("pgn"))
    )


_PLY = r"^\[g(\d+)\] ply +(\d+)"


def progress_lines(lines: DataFrame, line: str = "value", file: str = "file") -> DataFrame:
    """Per (file, game): last ply seen and whether a RESULT line appeared."""
    text = F.col(line)
    is_ply = text.rlike(_PLY)
    is_result = text.contains("RESULT")
    game = F.when(is_ply, F.regexp_extract(text, _PLY, 1)).when(
        is_result, F.ltrim(F.split_part(text, F.lit("]"), F.lit(1)), F.lit("[g"))
    )
    return (
        lines.select(
            F.col(file).alias("file"),
            game.alias("game"),
            F.when(is_ply, F.regexp_extract(text, _PLY, 2).cast("bigint")).alias("ply"),
            is_result.alias("done"),
        )
        .where(F.col("game").isNotNull())
        .groupBy("file", "game")
        .agg(F.max("ply").alias("ply"), F.max("done").alias("done"))
    )


def read_progress_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = _existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "file string, game string, ply bigint, done boolean")
    stem = F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return progress_lines(spark.read.text(found).select(stem.alias("file"), "value"))


__all__ = [
    "discover_runs",
    "pgn_columns",
    "progress_lines",
    "read_log",
    "read_meta",
    "read_pgn",
    "read_progress_log",
    "run_globs",
    "run_rows",
]
