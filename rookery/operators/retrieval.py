"""Lookups: openings, plans by longest prefix, concept pages by tags, tablebase rows, prompt studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery import constants as K
from rookery.functions.text import sections
from rookery.operators.ordered import top_k
from rookery.session import staged


def identify_opening(
    plies: DataFrame,
    eco: DataFrame,
    max_book_plies: int,
    game: tuple[str, ...] = ("game",),
    ply: str = "ply",
    key: str = "key",
    slack: int = 12,
    start_ply: int = 0,
    start_move: int = 1,
) -> DataFrame:
    """Deepest book position of each game: eco, name, best_ply, left_at_move.

    `plies` has one row per position (ply 0 = start). Only the first `max_book_plies + slack` plies
    are looked up; `start_ply` is 1 when Black moves first. left_at_move is NULL while the last
    position is still in the book. One lookup join, one map-side aggregation per game.
    """
    game = list(game)
    total = plies.groupBy(*game).agg(F.max(ply).alias("_total"))
    early = plies.where(F.col(ply) <= max_book_plies + slack)
    hits = early.join(eco.select(key, "eco", "name"), key)
    best = hits.groupBy(*game).agg(
        F.max_by(F.struct("eco", "name"), ply).alias("_e"), F.max(ply).alias("best_ply")
    )
    left = F.floor((F.col("best_ply") + start_ply) / 2) + start_move
    return best.join(total, game).select(
        *game,
        "_e.eco",
        "_e.name",
        "best_ply",
        F.when(F.col("best_ply") < F.col("_total"), left).alias("left_at_move"),
    )


def opening_label(eco: Column, name: Column, left_at: Column) -> Column:
    return F.concat(
        eco, F.lit(" "), name,
        F.coalesce(
            F.concat(F.lit(" (out of book since move "), left_at.cast("string"), F.lit(")")), F.lit("")
        ),
    )


def longest_prefix(df: DataFrame, name: str, prefixes: DataFrame) -> DataFrame:
    """Rows with the plan of the longest prefix of `name` (columns of `prefixes`), or NULL.

    Distinct names are cut at every length that a prefix has and equi-joined with the prefixes, so
    no nested loop is planned whatever the sizes are.
    """
    # one row: the different lengths, as many as the longest prefix has letters at most
    lengths = F.broadcast(prefixes.agg(F.collect_set(F.length("prefix")).alias("_lens")))
    rest = [c for c in prefixes.columns if c != "prefix"]
    cuts = (
        df.select(name).distinct().crossJoin(lengths)
        .withColumn("_len", F.explode(F.filter("_lens", lambda n: (n > 0) & (n <= F.length(name)))))
        .drop("_lens")
        .withColumn("prefix", F.substr(name, F.lit(1), F.col("_len")))
    )
    best = (
        cuts.join(prefixes, "prefix").groupBy(name)
        .agg(F.max_by(F.struct("prefix", *rest), "_len").alias("_p"))
        .select(name, "_p.*")
    )
    return df.join(best, name, "left")


def weight_of(tag: Column, weights=K.TAG_WEIGHTS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights for x in pair])
    return F.coalesce(F.try_element_at(table, tag), F.lit(1.0))


#: Page sets per block and per salt of a hot head; blocks and tag sets of positions per salt of a join.
BLOCK, SETS_PER_SALT, BLOCKS_PER_SALT, POSITIONS_PER_SALT = 64, 4096, 64, 65_536
#: Bytes of tags and slugs, as JSON, up to which the blocks are sent to all tasks and positions stay where they are.
FEW_BYTES = 32 << 20


def page_blocks(pages: DataFrame, k: int, slug: str, weights) -> DataFrame:
    """Pages by first tag in blocks of falling upper bound: _head, _block, _bound, _tags (of all), _sets.

    Pages with equal tags score alike, so they are one set with its k least slugs. The bound of a block is
    the score of a position that has every tag of its best set.
    """
    rows = pages.where(F.size("tags") > 0).select(
        F.element_at("tags", 1).alias("_head"), F.array_sort("tags").alias("_set"), F.col(slug).alias("_slug")
    ).where(F.col("_head").isNotNull())
    least = top_k(rows.distinct(), ["_head", "_set"], [F.asc("_slug")], k)
    sets = least.groupBy("_head", "_set").agg(F.array_sort(F.collect_list("_slug")).alias("_slugs")).select(
        "*",
        F.aggregate("_set", F.greatest(weight_of(F.col("_head"), weights), F.lit(0.0)),
                    lambda acc, t: acc + F.greatest(weight_of(t, weights), F.lit(0.0))).alias("_bound"),
    )
    # a hot head is numbered in salts of about SETS_PER_SALT sets, the best first in each of them
    sizes = sets.groupBy("_head").agg(F.ceil(F.count(F.lit(1)) / SETS_PER_SALT).alias("_salts"))
    salted = sets.join(sizes, "_head").withColumn("_salt", F.pmod(F.xxhash64("_set"), F.col("_salts")))
    local = Window.partitionBy("_head", "_salt").orderBy(F.desc("_bound"), "_set")
    placed = salted.withColumn("_n", F.row_number().over(local) - 1)
    # the first sets of every salt lie in the first blocks
    block = F.struct(F.floor(F.col("_n") / BLOCK).cast("int").alias("row"), F.col("_salt").cast("int").alias("salt"))
    return placed.groupBy("_head", block.alias("_block")).agg(
        F.max("_bound").alias("_bound"), F.array_distinct(F.flatten(F.collect_list("_set"))).alias("_tags"),
        F.collect_list(F.struct("_set", "_slugs")).alias("_sets"),
    )


def retrieve(
    positions: DataFrame, pages: DataFrame, k: int = 3, key: str = "pos", tags: str = "tags",
    slug: str = "slug", weights=K.TAG_WEIGHTS,
) -> DataFrame:
    """Top k pages per position: key, slug, score, rank.

    A page is eligible when its first tag is among the position's tags, so the join is on that one
    tag; the other tags are weighed inside the joined row. The first tag counts twice.

    Equal tag sets are scored once on both sides. A position meets the leading block of each of its heads
    first; its k-th best score there then keeps out all blocks whose bound is below it. A joined row gives
    its k best pages at most, so candidates are k per block. Blocks of FEW_BYTES at most are broadcast, so the
    tags of a position are shuffled once, to find equal ones. With more, positions move to the blocks of each
    of their heads, and heads that many pages or positions share are split over salts, from their counts. A
    NULL tag never matches.
    """
    pid = F.md5(F.to_json(F.struct(F.array_sort(F.array_distinct(F.col(tags))).alias("t"))))
    # written once: the tags may come out of long expressions, and every later step reads them
    named = staged(positions.select(F.col(key).alias("_key"), F.col(tags).alias("_have"), pid.alias("_pid")), "tags")
    distinct = staged(named.select("_pid", "_have").groupBy("_pid").agg(F.first("_have").alias("_have")), "sets")
    blocks = staged(page_blocks(pages, k, slug, weights), "blocks")
    size = blocks.agg(F.sum(F.octet_length(F.to_json(F.struct("_sets", "_tags")))).alias("n")).first()[0] or 0
    few = size <= FEW_BYTES
    # narrow rows first: only (position, tag) meets the heads; the tag arrays join the few matches.
    # outer: an inner explode would push its emptiness test into whatever computed the tags
    heads = blocks.groupBy("_head").agg(F.count(F.lit(1)).alias("_blocks"), F.min("_block").alias("_first"))

    def by_head(sets: DataFrame, *kept: str) -> DataFrame:
        spread = sets.select("_pid", F.explode_outer(F.array_distinct("_have")).alias("_head"), *kept)
        return spread.join(F.broadcast(heads) if few else heads, "_head")

    near = by_head(distinct)
    # one row per head: into how many salts its positions and its blocks are split
    split = near.groupBy("_head").agg(
        F.ceil(F.count(F.lit(1)) / POSITIONS_PER_SALT).cast("int").alias("_ps"),
        F.ceil(F.max("_blocks") / BLOCKS_PER_SALT).cast("int").alias("_bs"),
    )
    dealt = blocks.join(split, "_head").withColumn("_b", F.pmod(F.xxhash64("_block"), F.col("_bs"))).withColumn(
        "_p", F.explode(F.sequence(F.lit(0), F.col("_ps") - 1))
    )

    def scored(asked: DataFrame, held: DataFrame, bound: Column | None = None) -> DataFrame:
        """_pid, score, _slug: the k best of every (position, block)."""
        if few:
            met = asked.join(F.broadcast(held), "_head")
        else:
            rows = asked.join(split, "_head").withColumn("_p", F.pmod(F.xxhash64("_pid"), F.col("_ps"))).withColumn(
                "_b", F.explode(F.sequence(F.lit(0), F.col("_bs") - 1))
            ).drop("_ps", "_bs")
            met = rows.join(held.drop("_ps", "_bs"), ["_head", "_p", "_b"])
        met = met if bound is None else met.where(bound)
        common = F.array_intersect("_tags", "_have")
        one = lambda s: F.aggregate(
            F.filter(s["_set"], lambda t: F.array_contains(F.col("_common"), t)), weight_of(F.col("_head"), weights),
            lambda acc, t: acc + weight_of(t, weights),
        )
        listed = F.flatten(F.transform("_sets", lambda s: F.transform(
            s["_slugs"], lambda g: F.struct((-one(s)).alias("minus"), g.alias("slug")))))
        best = met.withColumn("_common", common).select("_pid", F.explode(F.slice(F.array_sort(listed), 1, k)).alias("_c"))
        return best.select("_pid", (-F.col("_c.minus")).alias("score"), F.col("_c.slug").alias("_slug"))

    order = [F.desc("score"), F.asc("_slug")]
    asked = by_head(distinct, "_have") if few else near.select("_pid", "_head", "_first").join(distinct, "_pid")
    held = blocks if few else dealt
    leading = top_k(scored(asked.drop("_first", "_blocks"), held.join(heads.select("_head", F.col("_first").alias("_block")), ["_head", "_block"])), ["_pid"], order, k).drop("rank")
    floor = leading.groupBy("_pid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_floor"))
    judged = by_head(distinct.join(floor, "_pid", "left"), "_have", "_floor") if few else asked.join(floor, "_pid", "left")
    later = scored(
        judged, held,
        (F.col("_block") != F.col("_first")) & (F.col("_floor").isNull() | (F.col("_bound") >= F.col("_floor"))),
    )
    best = top_k(leading.unionByName(later), ["_pid"], order, k)
    return named.select("_key", "_pid").distinct().join(best, "_pid").select(
        F.col("_key").alias(key), F.col("_slug").alias(slug), "score", "rank"
    )


def tablebase_lookup(
    positions: DataFrame, table: DataFrame, pieces: Column, castling: Column, key: str = "fen",
    max_pieces: int = K.TABLEBASE_MAX_PIECES,
) -> DataFrame:
    """Known results of positions with few pieces and no castling rights; others stay NULL."""
    probe = F.when((pieces <= max_pieces) & (castling == "-"), F.col(key))
    rest = [c for c in table.columns if c != key]
    right = table.select(F.col(key).alias("_key"), *rest)
    return positions.withColumn("_probe", probe).join(
        right, F.col("_probe") == F.col("_key"), "left"
    ).drop("_probe", "_key")


def coverage(decisions: DataFrame, best: str, proposed: str, prompt: str, loss: str,
             cut: int = K.SUITE_BLUNDER) -> DataFrame:
    """Share of decisions whose best move was proposed, and was named in the prompt, by outcome."""
    band = F.when(F.col(loss) >= cut, F.lit("blunder")).otherwise(F.lit("ok"))
    yes = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return decisions.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("decisions"),
        yes(F.array_contains(proposed, F.col(best))).alias("proposed"),
        yes(F.col(prompt).contains(F.col(best))).alias("mentioned"),
    )


def section_sizes(df: DataFrame, text: str) -> DataFrame:
    """Mean characters and count per `## ` section title."""
    return (
        df.select(F.explode(sections(F.col(text))).alias("s"))
        .groupBy(F.col("s.title").alias("title"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("s.body")).alias("mean_chars"))
    )


NOTE_PATTERNS = (
    ("vetoed", "vetoed "), ("injected", "injected "), ("fail_low", "fail-low"),
    ("mate", "mate in"), ("threat", "threat "), ("only_legal", "only legal move"),
)


def note_anatomy(df: DataFrame, note: str, patterns=NOTE_PATTERNS, group: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce(F.col(note), F.lit(""))
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("decisions"),
        *[F.count_if(text.contains(p)).alias(name) for name, p in patterns],
    )
