"""Scans of suites, result CSVs, opening lists, concept pages, opening plans and tablebase replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery import constants as K
from rookery import schemas
from rookery.sources.logs import read_log


def read_suite(spark: SparkSession, path: str, results: bool = False) -> DataFrame:
    """Suite items, or suite results; the natural key is `src`."""
    schema = schemas.SUITE_RESULTS if results else schemas.SUITE_ITEMS
    return read_log(spark, path, schema, mode="strict", with_run=False)


def read_games_csv(spark: SparkSession, path: str) -> DataFrame:
    """Experiment games; the literal None is NULL and termination is quoted."""
    df = spark.read.schema(schemas.GAMES_CSV).csv(path, header=True, nullValue="None")
    return df.withColumn("harness", F.lower("harness").cast("boolean"))


def read_openings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """eco, name, pgn out of tab-separated opening lists."""
    return spark.read.schema("eco string, name string, pgn string").csv(path, sep="\t", header=True)


def eco_index(entries: DataFrame, key: str, plies: str, order: list[str]) -> DataFrame:
    """One entry per position key: the fewest plies, then the first in `order`.

    min_by combines on the map side, so a key shared by many entries costs no large sort.
    """
    rest = [c for c in entries.columns if c != key]
    rank = F.struct(F.col(plies).alias("_p"), *[F.col(c) for c in order])
    return (
        entries.groupBy(key)
        .agg(F.min_by(F.struct(*rest), rank).alias("_e"))
        .select(key, *[F.col(f"_e.{c}").alias(c) for c in rest])
    )


def concept_columns(text: Column) -> dict[str, Column]:
    """title, tags and the first four summary bullets of one page text."""
    title = F.trim(F.regexp_extract(text, r"(?m)^title:\s*(.+)$", 1))
    tags = F.regexp_extract(text, r"(?m)^tags:\s*\[?([^\]\n]*)\]?$", 1)
    summary = F.regexp_extract(text, r"(?ms)^## Summary\s*\n(.*?)(?:^## |\z)", 1)
    bullets = F.filter(F.split(summary, "\n"), lambda s: s.startswith("- "))
    return {
        "title": F.when(title != "", title),
        "tags": F.filter(F.transform(F.split(tags, ","), lambda s: F.trim(s)), lambda t: t != ""),
        "summary": F.slice(F.transform(bullets, lambda b: F.trim(F.substr(b, F.lit(3)))), 1, 4),
    }


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """slug, title, tags, summary of the concept pages."""
    slug = F.url_decode(F.regexp_extract("_metadata.file_path", r"([^/]+)\.md$", 1))
    cols = concept_columns(F.col("value"))
    return spark.read.text(path, wholetext=True).select(
        slug.alias("slug"),
        F.coalesce(cols["title"], slug).alias("title"),
        cols["tags"].alias("tags"),
        cols["summary"].alias("summary"),
    )


def plan_rows(texts: DataFrame, text: str = "value") -> DataFrame:
    """One row per `## ` block: family, prefixes, plan."""
    blocks = F.slice(F.split(F.col(text), r"(?m)^## "), 2, 1_000_000_000)
    keep = [c for c in texts.columns if c != text]
    lines = F.filter(F.transform(F.split(F.col("_block"), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    match = F.try_element_at(F.filter(F.col("_lines"), lambda s: s.startswith("match:")), F.lit(1))
    return (
        texts.select(*keep, F.posexplode(blocks).alias("block_no", "_block"))
        .withColumn("_lines", lines)
        .where(F.size("_lines") > 0)
        .select(
            *keep,
            "block_no",
            F.element_at("_lines", 1).alias("family"),
            F.filter(
                F.transform(F.split(F.coalesce(F.substr(match, F.lit(7)), F.lit("")), ","), lambda s: F.trim(s)),
                lambda p: p != "",
            ).alias("prefixes"),
            F.array_join(
                F.filter(
                    F.slice(F.col("_lines"), 2, 1_000_000_000), lambda s: ~s.startswith("match:")
                ),
                " ",
            ).alias("plan"),
        )
    )


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    return plan_rows(spark.read.text(path, wholetext=True))


_TB = "category string, dtz int, moves array<struct<san:string,uci:string,category:string,dtz:int>>"


def _rank(category: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in K.TABLEBASE_RANKS for x in pair])
    return F.try_element_at(ranks, category)


def parse_tablebase(df: DataFrame, json_text: str) -> DataFrame:
    """wdl, dtz, moves(san, wdl, dtz) of lookup replies; unknown categories are dropped.

    A move's category is the opponent's view after the move, so rank and distance are negated.
    """
    parsed = F.from_json(F.col(json_text), _TB)
    moves = F.transform(
        F.filter(
            F.coalesce(F.col("_tb.moves"), F.array().cast(_TB.split("moves ")[1])),
            lambda m: _rank(m["category"]).isNotNull(),
        ),
        lambda m: F.struct(
            F.coalesce(m["san"], m["uci"], F.lit("?")).alias("san"),
            (-_rank(m["category"])).alias("wdl"),
            (-m["dtz"]).alias("dtz"),
        ),
    )
    return (
        df.withColumn("_tb", parsed)
        .withColumn("wdl", _rank(F.col("_tb.category")))
        .where(F.col("wdl").isNotNull())
        .withColumn("dtz", F.col("_tb.dtz"))
        .withColumn("moves", moves)
        .drop("_tb")
    )


def verdict(wdl: Column) -> Column:
    words = {
        2: "WIN",
        1: "draw (win only without the 50-move rule)",
        0: "DRAW",
        -1: "draw (loss only without the 50-move rule)",
        -2: "LOSS",
    }
    return F.try_element_at(F.create_map(*[F.lit(x) for p in words.items() for x in p]), wdl)


def best_moves(moves: Column) -> Column:
    """Moves that keep the best result: quickest wins first, longest defence first, draws as given."""
    top = F.array_max(F.transform(moves, lambda m: m["wdl"]))
    kept = F.filter(moves, lambda m: m["wdl"] == top)
    rank = lambda m: (
        F.when(m["wdl"] > 0, F.coalesce(F.abs(m["dtz"]), F.lit(999)))
        .when(m["wdl"] < 0, -F.coalesce(F.abs(m["dtz"]), F.lit(0)))
        .otherwise(F.lit(0))
    )
    keyed = F.transform(
        kept, lambda m, i: F.struct(rank(m).alias("r"), i.alias("i"), m["san"].alias("san"))
    )
    return F.transform(F.array_sort(keyed), lambda m: m["san"])
