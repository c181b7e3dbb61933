"""Decision replay: the choice policy re-evaluated from logged candidates.

A decision is one row with its candidates as an array in proposal order
(san, prior, score, own, mate, threat_cp, positional), so that every rule, and a sweep over many
margins, runs inside the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_score(cands: Column) -> Column:
    return F.array_max(F.transform(cands, lambda c: c["score"]))


def veto(cands: Column, margin) -> Column:
    """Candidates within `margin` of the best score."""
    return F.filter(cands, lambda c: c["score"] >= best_score(cands) - margin)


def vetoed(cands: Column, margin) -> Column:
    """Moves dropped by `veto`."""
    return F.transform(
        F.filter(cands, lambda c: c["score"] < best_score(cands) - margin), lambda c: c["san"]
    )


def apply_threats(cands: Column, delta: int = 50) -> Column:
    """A named reply that costs more than `delta` is verified and replaces the score."""
    def one(c):
        hit = F.coalesce(c["threat_cp"] < c["score"] - delta, F.lit(False))
        return F.struct(
            c["san"].alias("san"),
            c["prior"].alias("prior"),
            F.when(hit, c["threat_cp"]).otherwise(c["score"]).alias("score"),
            c["own"].alias("own"),
            c["mate"].alias("mate"),
            c["threat_cp"].alias("threat_cp"),
            c["positional"].alias("positional"),
            hit.alias("threat_verified"),
        )

    return F.transform(cands, one)


def _first_max(cands: Column, *rank) -> Column:
    """First candidate of the highest rank."""
    keyed = F.transform(
        cands,
        lambda c, i: F.struct(
            *[r(c).alias(f"r{k}") for k, r in enumerate(rank)], (-i).alias("i"), c["san"].alias("san")
        ),
    )
    return F.array_max(keyed)["san"]


def choose_prior(cands: Column) -> Column:
    """Plain mode: highest prior."""
    return _first_max(cands, lambda c: F.coalesce(c["prior"], F.lit(0.0)))


def choose_score(cands: Column) -> Column:
    """Plain search: best child score, then prior."""
    return _first_max(cands, lambda c: c["score"], lambda c: F.coalesce(c["prior"], F.lit(0.0)))


def choose(cands: Column, margin, tablebase: Column | None = None, delta: int = 50) -> Column:
    """struct(san, why) of the hybrid policy.

    Tablebase move (an own one if possible), else fastest mate, else the single survivor of the
    veto, else, after verified threats and a second veto, the best score plus positional value.
    """
    mates = F.filter(cands, lambda c: c["mate"] > 0)
    fastest = _first_max(mates, lambda c: -c["mate"])
    survivors = veto(cands, margin)
    threatened = apply_threats(survivors, delta)
    named = F.exists(survivors, lambda c: c["threat_cp"].isNotNull())
    final = F.when(named, veto(threatened, margin)).otherwise(threatened)
    hybrid = _first_max(
        final,
        lambda c: c["score"] + F.coalesce(c["positional"], F.lit(0)),
        lambda c: F.coalesce(c["prior"], F.lit(0.0)),
    )
    pick = lambda san, why: F.struct(san.alias("san"), F.lit(why).alias("why"))
    out = (
        F.when(F.size(mates) > 0, pick(fastest, "mate"))
        .when(F.size(survivors) == 1, pick(survivors[0]["san"], "only tactically sound candidate"))
        .otherwise(pick(hybrid, "hybrid"))
    )
    if tablebase is None:
        return out
    own = F.filter(cands, lambda c: c["own"] & F.array_contains(tablebase, c["san"]))
    known = F.coalesce(F.try_element_at(own, F.lit(1))["san"], F.try_element_at(tablebase, F.lit(1)))
    return F.when(F.size(tablebase) > 0, pick(known, "tablebase")).otherwise(out)


def inject(cands: Column, margin, fail_low=0) -> Column:
    """struct(pool, injected, fail_low): searched moves enter at best own score plus margin."""
    own = F.filter(cands, lambda c: c["own"])
    best = best_score(own)
    extra = F.filter(cands, lambda c: ~c["own"] & (c["score"] >= best + margin))
    return F.struct(
        F.concat(own, extra).alias("pool"),
        F.transform(extra, lambda c: c["san"]).alias("injected"),
        (best < fail_low).alias("fail_low"),
    )


def minimax(leaves: DataFrame, decision: list[str], cand="cand", score="leaf_cp", side="side",
            prior="prior", pos="pos", reply="reply") -> DataFrame:
    """Backed-up choice from logged leaves: decision, cand, value, reply.

    Leaf scores are White's view. A candidate is worth its worst reply, a decision its best
    candidate; equal values go to the higher prior, then to the earlier candidate.
    """
    sign = F.when(F.col(side) == "white", 1).otherwise(-1)
    mover = leaves.withColumn("_v", F.col(score) * sign)
    per_cand = mover.groupBy(*decision, cand).agg(
        F.min(F.struct(F.col("_v").alias("v"), F.col(pos).alias("p"), F.col(reply).alias("r"))).alias("_m"),
        F.max(F.coalesce(prior, F.lit(0.0))).alias("_prior"),
        F.min(pos).alias("_pos"),
    )
    best = per_cand.groupBy(*decision).agg(
        F.max(F.struct(F.col("_m.v").alias("v"), "_prior", (-F.col("_pos")).alias("p"),
                       F.col(cand).alias("c"), F.col("_m.r").alias("r"))).alias("_b")
    )
    return best.select(
        *decision, F.col("_b.c").alias(cand), F.col("_b.v").alias("value"), F.col("_b.r").alias(reply)
    )


def prune_stats(df: DataFrame, note: str, group: tuple[str, ...] = ()) -> DataFrame:
    """Leaves evaluated, pruned and in total, out of the search notes."""
    pattern = r"ab: (\d+) leaf evals, (\d+)/(\d+) pruned"
    num = lambda i: F.sum(F.regexp_extract(F.col(note), pattern, i).try_cast("bigint"))
    return df.where(F.col(note).rlike(pattern)).groupBy(*group).agg(
        F.count(F.lit(1)).alias("searches"),
        num(1).alias("evaluated"), num(2).alias("pruned"), num(3).alias("leaves"),
    )


def sweep(
    df: DataFrame, cands: str, margins: list[int], played: str, loss: str | None = None
) -> DataFrame:
    """Per margin: decisions, how many keep the played move, mean veto count, mean loss kept.

    The margins multiply rows in place (explode of a literal array) and are reduced map-side.
    """
    rows = df.withColumn("margin", F.explode(F.array(*[F.lit(m) for m in margins])))
    rows = rows.withColumn("_c", choose(F.col(cands), F.col("margin"))).withColumn(
        "_v", F.size(vetoed(F.col(cands), F.col("margin")))
    )
    same = F.col("_c.san") == F.col(played)
    aggs = [
        F.count(F.lit(1)).alias("decisions"),
        F.count_if(same).alias("agree"),
        F.sum("_v").alias("vetoed"),
        F.count_if(F.col("_c.why") == "hybrid").alias("hybrid"),
    ]
    if loss:
        aggs.append(F.sum(F.when(same, F.col(loss))).alias("loss_kept"))
    return rows.groupBy("margin").agg(*aggs)
