"""Openings, plans, concept pages, tablebase rows and prompt studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, py_round, query
from rookery.functions.numeric import half_even
from rookery.operators import retrieval as re
from rookery.sources import tables as st


@query(
    "eco_index",
    "S06",
    """SELECT l_partkey AS key, l_suppkey AS eco, l_linenumber AS plies FROM (SELECT *, row_number() OVER
      (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""",
)
def eco_index(t: Tables):
    e = t.lineitem.select(
        F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("eco"),
        F.col("l_linenumber").alias("plies"), "l_orderkey",
    )
    return st.eco_index(e, "key", "plies", ["l_orderkey", "eco"]).select("key", "eco", "plies")


@query(
    "openings_identified",
    "J08",
    """WITH tot AS (SELECT l_orderkey, max(l_linenumber) AS total FROM lineitem GROUP BY 1),
      h AS (SELECT l_orderkey, l_linenumber, p_brand, p_name, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 6),
      b AS (SELECT l_orderkey, max(l_linenumber) AS best_ply FROM h GROUP BY 1)
    SELECT b.l_orderkey, best_ply, CASE WHEN best_ply < total THEN best_ply // 2 + 1 END AS left_at_move FROM b JOIN tot USING (l_orderkey)""",
)
def openings_identified(t: Tables):
    plies = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("ply"), F.col("l_partkey").alias("key"))
    eco = t.part.select(
        F.col("p_partkey").alias("key"), F.col("p_brand").alias("eco"), F.col("p_name").alias("name")
    )
    out = re.identify_opening(plies, eco, 4, game=("l_orderkey",), slack=2)
    return out.select("l_orderkey", "best_ply", "left_at_move")


@query(
    "plans_by_prefix",
    "J09",
    """SELECT p_partkey, (SELECT arg_max(plan, length(prefix)) FROM (VALUES ('small', 'A'), ('small r', 'B'), ('red', 'C'), ('red widget', 'D'), ('b', 'E'),
      ('blue', 'F'), ('la', 'G')) v(prefix, plan) WHERE starts_with(p_name, prefix)) AS plan FROM part""",
)
def plans_by_prefix(t: Tables):
    rows = [("small", "A"), ("small r", "B"), ("red", "C"), ("red widget", "D"), ("b", "E"), ("blue", "F"), ("la", "G")]
    prefixes = t.spark.createDataFrame(rows, "prefix string, plan string")
    return re.longest_prefix(t.part, "p_name", prefixes).select("p_partkey", "plan")


_WORDS = "regexp_split_to_array(trim(text), '[ \\n\\t]+')"
_WEIGHTS = (("the", 5.0), ("and", 2.5), ("of", 0.5))


@query(
    "pages_retrieved",
    "J10",
    f"""WITH d AS (SELECT doc_id, unnest(list_distinct({_WORDS})) AS tag FROM documents),
      p AS (SELECT item_id, {_WORDS}[1] AS head, unnest(list_distinct({_WORDS})) AS tag FROM benchmark),
      w AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _WEIGHTS)}) v(tag, w)),
      s AS (SELECT d.doc_id, p.item_id, CAST(sum(coalesce(w.w, 1.0)) + max(coalesce(hw.w, 1.0)) AS DOUBLE) AS score
        FROM p JOIN d ON d.tag = p.tag LEFT JOIN w ON w.tag = p.tag LEFT JOIN w hw ON hw.tag = p.head
        WHERE EXISTS (SELECT 1 FROM d x WHERE x.doc_id = d.doc_id AND x.tag = p.head) GROUP BY 1, 2)
    SELECT doc_id, item_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s) WHERE rank <= 3""",
)
def pages_retrieved(t: Tables):
    words = lambda c: F.split(F.trim(c), r"[ \n\t]+")
    docs = t.documents.select("doc_id", "text").select(
        "doc_id", F.array_distinct(words("text")).alias("tags")
    )
    pages = t.benchmark.select("item_id", F.array_distinct(words("text")).alias("tags"))
    return re.retrieve(docs, pages, 3, key="doc_id", slug="item_id", weights=_WEIGHTS)


def page_markdown():
    """Pages as concept pages: title, two tags, five bullets."""
    k = F.col("page_id").cast("string")
    return F.concat(
        F.lit("---\ntitle: T"), k, F.lit(" x\ntags: [a"), k, F.lit(", b , ]\n---\n# head\n## Summary\n- "),
        F.regexp_replace("url", r"\s", ""), F.lit("\n- two\nplain\n-  three \n- four\n- five\n## Next\n- no\n"),
    )


@query(
    "concept_pages",
    "S07",
    """SELECT page_id, 'T' || page_id || ' x' AS title, 'a' || page_id || '|b' AS tags,
      regexp_replace(url, '\\s', '', 'g') || '|two|three|four' AS summary FROM pages""",
)
def concept_pages(t: Tables):
    cols = st.concept_columns(F.col("md"))
    return t.pages.withColumn("md", page_markdown()).select(
        "page_id", cols["title"].alias("title"), F.array_join(cols["tags"], "|").alias("tags"),
        F.array_join(cols["summary"], "|").alias("summary"),
    )


@query(
    "opening_plans",
    "S08",
    """SELECT doc_id, 0 AS block_no, 'Fam ' || lang AS family, source || '|Q' AS prefixes, 'line one line two' AS plan FROM documents
    UNION ALL SELECT doc_id, 1, 'Other', '', md5(text) FROM documents""",
)
def opening_plans(t: Tables):
    md = F.concat(
        F.lit("intro\n## Fam "), "lang", F.lit("\nmatch: "), "source", F.lit(", Q,\n\n line one\nline two\n## Other\n"),
        F.md5(F.col("text").cast("binary")), F.lit("\n"),
    )
    rows = st.plan_rows(t.documents.select("doc_id", md.alias("value")))
    return rows.select("doc_id", "block_no", "family", F.array_join("prefixes", "|").alias("prefixes"), "plan")


@query(
    "tablebase_rows",
    "S12 O05",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 0 ELSE -2 END AS wdl,
      CASE event_type WHEN 'click' THEN CASE WHEN user_id <= 50 THEN 'a,b' ELSE 'b,a' END WHEN 'view' THEN 'a' ELSE CASE WHEN user_id < 50 THEN 'b,a,c' ELSE 'a,b,c' END END AS best
    FROM events WHERE event_type IN ('click', 'view', 'error')""",
)
def tablebase_rows(t: Tables):
    cat = (
        F.when(F.col("event_type") == "click", F.lit("win")).when(F.col("event_type") == "view", F.lit("draw"))
        .when(F.col("event_type") == "error", F.lit("loss")).otherwise(F.lit("unknown"))
    )
    reply = (
        F.when(F.col("event_type") == "click", F.lit("loss")).when(F.col("event_type") == "view", F.lit("draw"))
        .otherwise(F.lit("win"))
    )
    second = F.when(F.col("event_type") == "view", F.lit("win")).otherwise(reply)
    third = F.when(F.col("event_type") == "error", F.lit("win")).otherwise(F.lit("strange"))
    doc = F.concat(
        F.lit('{"category": "'), cat, F.lit('", "dtz": 3, "moves": [{"san": "a", "category": "'), reply,
        F.lit('", "dtz": '), (-F.col("user_id")).cast("string"), F.lit('}, {"san": "b", "category": "'), second,
        F.lit('", "dtz": -50}, {"uci": "c", "category": "'), third, F.lit('", "dtz": null}]}'),
    )
    out = st.parse_tablebase(t.events.select("event_id", doc.alias("j")), "j")
    return out.select("event_id", "wdl", F.array_join(st.best_moves(F.col("moves")), ",").alias("best"))


@query(
    "tablebase_lookup",
    "J11",
    """SELECT e.event_id, u.wdl FROM events e LEFT JOIN (SELECT user_id, count(*) AS wdl FROM events WHERE event_type = 'click' GROUP BY 1) u
      ON u.user_id = e.user_id AND e.value <= 7 AND e.event_type <> 'view'""",
)
def tablebase_lookup(t: Tables):
    tb = t.events.where("event_type = 'click'").groupBy(F.col("user_id").alias("fen")).agg(F.count(F.lit(1)).alias("wdl"))
    pos = t.events.select("event_id", F.col("user_id").alias("fen"), "value", "event_type")
    castling = F.when(F.col("event_type") == "view", F.lit("KQ")).otherwise(F.lit("-"))
    return re.tablebase_lookup(pos, tb, F.col("value"), castling).select("event_id", "wdl")


@query(
    "candidate_coverage",
    "A14",
    f"""WITH x AS (SELECT n_chars, text, {_WORDS} AS w, toxic FROM documents JOIN labels USING (doc_id)),
      y AS (SELECT *, CASE toxic WHEN 0 THEN coalesce(w[2], w[1]) ELSE w[1] || 'zz' END AS best FROM x)
    SELECT CASE WHEN n_chars >= 200 THEN 'blunder' ELSE 'ok' END AS band, count(*) AS decisions,
      {py_round('avg(CAST(coalesce(list_contains(w, best), false) AS INT))', 6)} AS proposed,
      {py_round("avg(CAST(coalesce(contains(text, best), false) AS INT))", 6)} AS mentioned
    FROM y GROUP BY 1""",
)
def candidate_coverage(t: Tables):
    """The best word is the second one, or the only one of a document."""
    d = t.documents.join(t.labels, "doc_id").withColumn("w", F.split(F.trim("text"), r"[ \n\t]+")).withColumn(
        "best",
        F.when(F.col("toxic") == 0, F.coalesce(F.get("w", F.lit(1)), F.get("w", F.lit(0))))
        .otherwise(F.concat(F.get("w", F.lit(0)), F.lit("zz"))),
    )
    out = re.coverage(d, "best", "w", "text", "n_chars")
    return out.select(
        "band", "decisions", half_even(F.col("proposed"), 6).alias("proposed"),
        half_even(F.col("mentioned"), 6).alias("mentioned"),
    )


@query(
    "section_sizes",
    "A15",
    f"""SELECT title, count(*) AS n, {py_round('avg(n)', 6)} AS mean_chars FROM (
      SELECT lang AS title, length(text) + 1 AS n FROM documents UNION ALL SELECT 'Tail', length(source) FROM documents) GROUP BY 1""",
)
def section_sizes(t: Tables):
    # lines of the text that would open a section are indented
    body = F.regexp_replace("text", r"(?m)^## ", "#_ ")
    md = F.concat(F.lit("# top\n## "), "lang", F.lit("\n"), body, F.lit("\n## Tail\n"), "source")
    out = re.section_sizes(t.documents.select(md.alias("md")), "md")
    return out.withColumn("mean_chars", half_even(F.col("mean_chars"), 6))


@query(
    "note_anatomy",
    "A16",
    """SELECT lang, count(*) AS decisions, count(*) FILTER (contains(text, 'the')) AS vetoed, count(*) FILTER (contains(text, 'la ')) AS injected,
      count(*) FILTER (contains(text, '@')) AS mail FROM documents GROUP BY 1""",
)
def note_anatomy(t: Tables):
    pats = (("vetoed", "the"), ("injected", "la "), ("mail", "@"))
    return re.note_anatomy(t.documents, "text", pats, group=("lang",))


@query(
    "notation_scan",
    "S05 P04",
    """SELECT doc_id, lang AS white, source AS black, n_chars AS round, len(list_filter(regexp_split_to_array(clean, '[ ]+'), lambda w: w <> '')) AS plies,
      md5(array_to_string(list_filter(regexp_split_to_array(clean, '[ ]+'), lambda w: w <> ''), ' ')) AS moves
    FROM (SELECT *, regexp_replace(lower(text), '[^a-z]+', ' ', 'g') AS clean FROM documents)""",
)
def notation_scan(t: Tables):
    """Game texts composed of document words with headers, comments, numbers and a result."""
    from rookery.sources.logs import pgn_columns

    word = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^a-z]+", " "), " +"), lambda w: w != "")
    numbered = F.transform(
        word, lambda w, i: F.when(i % 2 == 0, F.concat((F.floor(i / 2) + 1).cast("string"), F.lit(". "), w)).otherwise(
            F.concat(w, F.lit(" {note (x) 1. zz} $4")))
    )
    pgn = F.concat(
        F.lit('[Event "e"]\n[Round "'), F.col("n_chars").cast("string"), F.lit('"]\n[White "'), "lang", F.lit('"]\n[Black "'), "source",
        F.lit('"]\n\n'), F.array_join(numbered, " "), F.lit(" 1/2-1/2\n"),
    )
    cols = pgn_columns(F.col("pgn"))
    return t.documents.withColumn("pgn", pgn).select(
        "doc_id", cols["headers"].alias("h"), cols["sans"].alias("s")
    ).select(
        "doc_id", F.col("h")["White"].alias("white"), F.col("h")["Black"].alias("black"),
        F.col("h")["Round"].cast("bigint").alias("round"), F.size("s").cast("bigint").alias("plies"),
        F.md5(F.array_join("s", " ").cast("binary")).alias("moves"),
    )
