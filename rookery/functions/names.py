"""Names: players, runs, experiment configurations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rookery import constants as K

_PLAYER = r"^(.+?)(?:\(([^)]*)\))?(?:#[AB])?$"
_DEPTH, _ELO, _SKILL = r"^d(\d+)$", r"^elo(\d+)$", r"^skill(\d+)$"
_KNOWN_TOKEN = r"^(d\d+|elo\d+|skill\d+|full)$"


def name_any(name: Column, words=K.SUBJECT_WORDS) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | name.contains(word)
    return hit


def name_none(name: Column, words=K.OPPONENT_WORDS) -> Column:
    return ~name_any(name, words)


def player_kind(name: Column) -> Column:
    base = F.regexp_extract(name, _PLAYER, 1)
    return F.when(base == "", name).otherwise(base)


def _tokens(name: Column) -> Column:
    raw = F.split(F.regexp_extract(name, _PLAYER, 2), ",")
    return F.filter(F.transform(raw, lambda t: F.trim(t)), lambda t: t != "")


def player_model(name: Column) -> Column:
    """Last token between the brackets that is not a setting."""
    return F.try_element_at(F.filter(_tokens(name), lambda t: ~t.rlike(_KNOWN_TOKEN)), F.lit(-1))


def player_config(name: Column) -> Column:
    """Settings between the brackets as map<string,string>; the last one of a kind wins."""
    tokens = _tokens(name)

    def last(pattern: str) -> Column:
        found = F.try_element_at(F.filter(tokens, lambda t: t.rlike(pattern)), F.lit(-1))
        return F.regexp_extract(found, pattern, 1)

    strength = F.when(F.array_contains(tokens, "full"), F.lit("full"))
    entries = F.array(
        F.struct(F.lit("depth").alias("key"), last(_DEPTH).alias("value")),
        F.struct(F.lit("elo").alias("key"), last(_ELO).alias("value")),
        F.struct(F.lit("skill").alias("key"), last(_SKILL).alias("value")),
        F.struct(F.lit("strength").alias("key"), strength.alias("value")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def parse_player(name: Column) -> Column:
    config = player_config(name)
    return F.struct(
        player_kind(name).alias("kind"),
        player_model(name).alias("model"),
        config.alias("config"),
        F.try_element_at(config, F.lit("depth")).cast("int").alias("depth"),
        F.try_element_at(config, F.lit("elo")).cast("int").alias("elo"),
        F.try_element_at(config, F.lit("skill")).cast("int").alias("skill"),
    )


def display_name(name: Column) -> Column:
    """Short public label of a player name."""
    slug = F.regexp_extract(name, K.OWN_SOURCE + r"-([a-z]+-\d+(?:-\d+)?)", 1)
    family = K.OWN_SOURCE.capitalize()
    model = F.when(slug == "", F.lit(family)).otherwise(F.concat(F.lit(family + " "), slug))
    return (
        F.when(name.rlike("^(" + "|".join(K.HARNESS_PREFIXES) + ")"), F.concat(model, F.lit(" + harness")))
        .when(name.startswith("naive"), F.concat(model, F.lit(" (no harness)")))
        .otherwise(name)
    )


def run_id(folder: Column, quarantined: Column) -> Column:
    return F.when(quarantined, F.concat(F.lit("_invalid/"), folder)).otherwise(folder)


def started_at(folder: Column) -> Column:
    """Start time in the folder name `YYYYmmdd_HHMMSS_label`, NULL when absent or not a date."""
    stamp = F.regexp_extract(folder, r"^(\d{8}_\d{6})_", 1)
    return F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyyMMdd_HHmmss"))


def model_bucket(model: Column, buckets=K.MODEL_BUCKETS) -> Column:
    out = F.when(model.isNull(), F.lit("?"))
    for name in buckets:
        out = out.when(model.contains(name), F.lit(name))
    return out.otherwise(model)


def subject_spec(white_spec: Column, black_spec: Column, opponent: str = K.LADDER_OPPONENT) -> Column:
    """First of the two specs that is not the rated opponent."""
    white = F.coalesce(white_spec, F.lit(""))
    black = F.coalesce(black_spec, F.lit(""))
    return F.when(~white.startswith(opponent), white).when(~black.startswith(opponent), black)


def opponent_level(white_spec: Column, black_spec: Column) -> Column:
    both = F.concat_ws(" ", F.coalesce(white_spec, F.lit("")), F.coalesce(black_spec, F.lit("")))
    return F.regexp_extract(both, K.LEVEL_PATTERN, 1).try_cast("int")


def is_harness(spec: Column) -> Column:
    return spec.rlike("^(" + "|".join(K.HARNESS_PREFIXES) + ")")


def config_label(model: Column, harness: Column, ctx_version: Column) -> Column:
    """`model-harness|naive`, with `-ctxN` for harness runs of context version 3 and later.

    An absent or zero version counts as 2.
    """
    version = F.when(F.coalesce(ctx_version, F.lit(0)) == 0, F.lit(2)).otherwise(ctx_version)
    suffix = F.when(harness & (version >= 3), F.concat(F.lit("-ctx"), version.cast("string")))
    arm = F.when(harness, F.lit("-harness")).otherwise(F.lit("-naive"))
    return F.concat(model, arm, F.coalesce(suffix, F.lit("")))
