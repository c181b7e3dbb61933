"""Decision replay on candidates derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, query
from rookery.operators import replay as rp


def decisions(t: Tables):
    """Four candidates per event in proposal order; m3 comes from the search."""
    v = F.floor(F.col("value") * 10).cast("int")
    u = F.col("user_id").cast("int")

    def c(san, prior, score, own, mate, threat, pos):
        return F.struct(
            F.lit(san).alias("san"), F.lit(prior).alias("prior"), score.cast("int").alias("score"), F.lit(own).alias("own"),
            mate.cast("int").alias("mate"), threat.cast("int").alias("threat_cp"), pos.cast("int").alias("positional"),
        )

    zero, none = F.lit(0), F.lit(None)
    return t.events.drop("props", "ts").select(
        "event_id", "user_id", "event_type", v.alias("v"),
        F.array(
            c("m0", 0.5, v, True, zero, F.when(F.col("event_type") == "click", v - 60), F.pmod(u, F.lit(40))),
            c("m1", 0.3, u * 2, True, zero, none, F.pmod(u, F.lit(30)) * 2),
            c("m2", 0.3, F.lit(100), True, F.when(F.col("event_type") == "purchase", F.pmod(u, F.lit(3))).otherwise(0), none, zero),
            c("m3", 0.0, v * 2, False, F.when(F.col("event_type") == "purchase", F.lit(1)).otherwise(0), none, zero),
        ).alias("cands"),
        F.concat(F.lit("m"), F.pmod("event_id", F.lit(4)).cast("string")).alias("played"),
    )


BASE = """
b AS (SELECT event_id, event_type, user_id AS u, CAST(floor(value * 10) AS BIGINT) AS v, 'm' || (event_id % 4) AS played FROM events),
c AS (SELECT event_id, 'm0' AS san, 0 AS i, 0.5 AS prior, v AS score, 0 AS mate, CASE WHEN event_type = 'click' THEN v - 60 END AS threat, u % 40 AS pos, true AS own FROM b
  UNION ALL SELECT event_id, 'm1', 1, 0.3, u * 2, 0, NULL, u % 30 * 2, true FROM b
  UNION ALL SELECT event_id, 'm2', 2, 0.3, 100, CASE WHEN event_type = 'purchase' THEN u % 3 ELSE 0 END, NULL, 0, true FROM b
  UNION ALL SELECT event_id, 'm3', 3, 0.0, v * 2, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, NULL, 0, false FROM b)"""


def policy(margins: str) -> str:
    """CTEs ending in `chosen` (margin, event_id, san, why)."""
    return f"""{BASE}, mg AS (SELECT * FROM (VALUES {margins}) v(margin)),
m AS (SELECT margin, c.*, max(score) OVER (PARTITION BY margin, event_id) AS best FROM c, mg),
s AS (SELECT *, count(*) OVER (PARTITION BY margin, event_id) AS k, max(threat) OVER (PARTITION BY margin, event_id) IS NOT NULL AS named FROM m WHERE score >= best - margin),
th AS (SELECT *, CASE WHEN threat < score - 50 THEN threat ELSE score END AS ts FROM s),
t2 AS (SELECT *, max(ts) OVER (PARTITION BY margin, event_id) AS tbest FROM th),
hy AS (SELECT margin, event_id, san FROM (SELECT *, row_number() OVER (PARTITION BY margin, event_id ORDER BY ts + pos DESC, prior DESC, i) AS r
   FROM t2 WHERE NOT named OR ts >= tbest - margin) WHERE r = 1),
ma AS (SELECT event_id, san FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY mate, i) AS r FROM c WHERE mate > 0) WHERE r = 1),
chosen AS (SELECT hy.margin, hy.event_id, coalesce(ma.san, CASE WHEN k = 1 THEN one ELSE hy.san END) AS san,
   CASE WHEN ma.san IS NOT NULL THEN 'mate' WHEN k = 1 THEN 'only tactically sound candidate' ELSE 'hybrid' END AS why
   FROM hy JOIN (SELECT margin, event_id, max(k) AS k, min(san) AS one FROM s GROUP BY 1, 2) z USING (margin, event_id) LEFT JOIN ma ON ma.event_id = hy.event_id)"""


@query(
    "veto",
    "C01 W07",
    f"""WITH {BASE} SELECT event_id, coalesce(string_agg(san, ',' ORDER BY i) FILTER (score < best - 100), '') AS vetoed
      FROM (SELECT *, max(score) OVER (PARTITION BY event_id) AS best FROM c) GROUP BY 1""",
)
def veto(t: Tables):
    return decisions(t).select("event_id", F.array_join(rp.vetoed(F.col("cands"), 100), ",").alias("vetoed"))


@query(
    "threats_applied",
    "C02",
    f"""WITH {BASE} SELECT event_id, string_agg(san || '=' || CASE WHEN threat < score - 50 THEN threat || '!' ELSE CAST(score AS VARCHAR) END, ',' ORDER BY i) AS scores FROM c GROUP BY 1""",
)
def threats_applied(t: Tables):
    text = F.transform(
        rp.apply_threats(F.col("cands")),
        lambda c: F.concat(c["san"], F.lit("="), c["score"].cast("string"), F.when(c["threat_verified"], F.lit("!")).otherwise(F.lit(""))),
    )
    return decisions(t).select("event_id", F.array_join(text, ",").alias("scores"))


@query(
    "policy_choice",
    "C03 C02 C01",
    f"WITH {policy('(100)')} SELECT event_id, san, why FROM chosen",
)
def policy_choice(t: Tables):
    d = decisions(t).withColumn("c", rp.choose(F.col("cands"), 100))
    return d.select("event_id", "c.san", "c.why")


@query(
    "plain_choices",
    "C03",
    f"""WITH {BASE} SELECT event_id, 'm0' AS by_prior, arg_max(san, struct_pack(a := score, b := prior, c := -i)) AS by_score,
      CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'm1' ELSE 'zz' END END AS by_tablebase FROM c GROUP BY event_id""",
)
def plain_choices(t: Tables):
    c = F.col("cands")
    tb = F.when(
        F.col("event_id") % 3 == 0,
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit("zz"), F.lit("m1"))).otherwise(F.array(F.lit("zz"))),
    ).otherwise(F.array().cast("array<string>"))
    pick = rp.choose(c, 100, tablebase=tb)
    return decisions(t).select(
        "event_id", rp.choose_prior(c).alias("by_prior"), rp.choose_score(c).alias("by_score"),
        F.when(pick["why"] == "tablebase", pick["san"]).alias("by_tablebase"),
    )


@query(
    "minimax_backup",
    "C04",
    """WITH l AS (SELECT l_orderkey, o_orderstatus = 'F' AS white, l_suppkey % 3 AS cand, l_linenumber * 10000000 + l_partkey * 100 + l_suppkey AS pos,
        l_partkey AS reply, CAST(floor(l_extendedprice) AS BIGINT) % 2001 - 1000 AS cp FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
      k AS (SELECT l_orderkey, cand, min(CASE WHEN white THEN cp ELSE -cp END) AS v, min(pos) AS pos FROM l GROUP BY 1, 2)
    SELECT l_orderkey, arg_max(cand, struct_pack(a := v, b := -cand, c := -pos)) AS cand, max(v) AS value FROM k GROUP BY 1""",
)
def minimax_backup(t: Tables):
    li = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    leaves = li.select(
        "l_orderkey", F.when(F.col("o_orderstatus") == "F", F.lit("white")).otherwise(F.lit("black")).alias("side"),
        F.pmod("l_suppkey", F.lit(3)).alias("cand"), (-F.pmod("l_suppkey", F.lit(3))).cast("double").alias("prior"),
        (F.col("l_linenumber").cast("bigint") * 10000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("pos"),
        F.col("l_partkey").alias("reply"), (F.pmod(F.floor("l_extendedprice"), F.lit(2001)) - 1000).alias("leaf_cp"),
    )
    return rp.minimax(leaves, ["l_orderkey"]).select("l_orderkey", "cand", "value")


@query(
    "injected_moves",
    "C05",
    f"""WITH {BASE}, o AS (SELECT event_id, max(score) FILTER (own) AS best, max(score) FILTER (NOT own) AS extra FROM c GROUP BY 1)
    SELECT event_id, CASE WHEN extra >= best + 100 THEN 'm3' ELSE '' END AS injected, best < 150 AS fail_low FROM o""",
)
def injected_moves(t: Tables):
    d = decisions(t).withColumn("i", rp.inject(F.col("cands"), 100, 150))
    return d.select("event_id", F.array_join("i.injected", ",").alias("injected"), F.col("i.fail_low").alias("fail_low"))


@query(
    "prune_stats",
    "C06",
    """SELECT event_type, count(*) AS searches, CAST(sum(user_id) AS BIGINT) AS evaluated, CAST(sum(event_id % 9) AS BIGINT) AS pruned, CAST(sum(event_id) AS BIGINT) AS leaves
      FROM events WHERE value > 3 GROUP BY 1""",
)
def prune_stats(t: Tables):
    note = F.when(
        F.col("value") > 3,
        F.format_string("vetoed a; ab: %d leaf evals, %d/%d pruned; alpha-beta", F.col("user_id"), F.col("event_id") % 9, F.col("event_id")),
    ).otherwise(F.lit("hybrid"))
    return rp.prune_stats(t.events.withColumn("note", note), "note", group=("event_type",))


@query(
    "margin_sweep",
    "C07 C01 C02 C03",
    f"""WITH {policy('(0), (50), (100), (200), (400)')}
    SELECT margin, count(*) AS decisions, count(*) FILTER (san = played) AS agree, CAST(sum(vt) AS BIGINT) AS vetoed,
      count(*) FILTER (why = 'hybrid') AS hybrid, CAST(sum(v) FILTER (san = played) AS BIGINT) AS loss_kept
    FROM chosen JOIN b USING (event_id) JOIN (SELECT margin, event_id, count(*) FILTER (score < best - margin) AS vt FROM m GROUP BY 1, 2) q USING (margin, event_id) GROUP BY 1""",
)
def margin_sweep(t: Tables):
    return rp.sweep(decisions(t), "cands", [0, 50, 100, 200, 400], "played", "v")
