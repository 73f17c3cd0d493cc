"""The test tables seen as contests, deliveries, spells and scored rows.

Each view exists twice, as a DataFrame and as SQL text, and both say the same:
an order is a contest between the customer's nation and the nation of the
order's first supplier; its lines are the spells of suppliers; a user's events
are the deliveries of a contest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.sizing import long_side
from tallyline.session import staged


# Stating the schema saves the footer-reading job that inference would start.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def contests(spark: SparkSession, sf: str, **extra: Column) -> DataFrame:
    """Contests of the orders; ``extra``: further aggregates of an order's lines."""
    lines = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.min("l_suppkey").alias("s_suppkey"),
            F.sum("l_quantity").alias("first_total"),
            F.count(F.lit(1)).alias("n_lines"),
            *[c.alias(n) for n, c in extra.items()],
        )
    )
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    home = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("team1"),
        F.col("r_name").alias("competition"),
    )
    away = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("team2"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, sf, "orders")
    # The customer goes to the narrow orders, so that the lines are dealt once, by their order.
    joined = (
        orders.join(long_side(customer), orders.o_custkey == customer.c_custkey)
        .join(lines, "o_orderkey")
        .join(supplier, "s_suppkey")
        .where("c_nationkey <> s_nationkey")
        .join(home, "c_nationkey")
        .join(away, "s_nationkey")
    )
    c = F.col
    status, void = c("o_orderstatus"), c("o_totalprice") < 20000
    even_total = (F.floor("first_total") % 2) == 0
    toss_winner = F.when(even_total, c("team1")).otherwise(c("team2"))
    bats = (c("n_lines") % 2) == 0
    return joined.select(
        c("o_orderkey").alias("match_id"),
        c("o_orderdate").cast("date").alias("date"),
        F.when(c("o_orderpriority") == "1-URGENT", "T20I")
        .when(c("o_orderpriority") == "2-HIGH", "T20")
        .when(c("o_orderpriority") == "3-MEDIUM", "ODI")
        .when(c("o_orderpriority") == "4-NOT SPECIFIED", "TEST")
        .otherwise("HUNDRED").alias("format"),
        F.when(c("c_mktsegment").isin("BUILDING", "MACHINERY"), "female").otherwise("male").alias("gender"),
        "competition",
        c("c_mktsegment").alias("venue"),
        "team1",
        "team2",
        F.when(void, None).when(status == "F", c("team1")).when(status == "O", c("team2")).alias("winner"),
        F.when(void, "no result").when(status == "P", "draw").otherwise("win").alias("result_type"),
        toss_winner.alias("toss_winner"),
        F.when(bats, "bat").otherwise("field").alias("toss_decision"),
        F.when(bats == even_total, c("team1")).otherwise(c("team2")).alias("batting_first"),
        c("first_total"),
        *extra,
    )


CONTESTS = """
lines AS (
  SELECT l_orderkey AS o_orderkey, min(l_suppkey) AS s_suppkey, sum(l_quantity) AS first_total,
         count(*) AS n_lines
  FROM lineitem GROUP BY l_orderkey
),
joined AS (
  SELECT o.*, l.first_total, l.n_lines, c.c_mktsegment, h.n_name AS team1, r.r_name AS competition,
         a.n_name AS team2, (o_totalprice < 20000) AS void,
         (CAST(floor(l.first_total) AS BIGINT) % 2 = 0) AS even_total, (l.n_lines % 2 = 0) AS bats
  FROM orders o JOIN lines l USING (o_orderkey)
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON s.s_suppkey = l.s_suppkey
  JOIN nation h ON h.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = h.n_regionkey
  JOIN nation a ON a.n_nationkey = s.s_nationkey
  WHERE c.c_nationkey <> s.s_nationkey
),
contests AS (
  SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS date,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'T20I' WHEN '2-HIGH' THEN 'T20'
      WHEN '3-MEDIUM' THEN 'ODI' WHEN '4-NOT SPECIFIED' THEN 'TEST' ELSE 'HUNDRED' END AS format,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'female' ELSE 'male' END AS gender,
    competition, c_mktsegment AS venue, team1, team2,
    CASE WHEN void THEN NULL WHEN o_orderstatus = 'F' THEN team1
      WHEN o_orderstatus = 'O' THEN team2 END AS winner,
    CASE WHEN void THEN 'no result' WHEN o_orderstatus = 'P' THEN 'draw' ELSE 'win' END AS result_type,
    CASE WHEN even_total THEN team1 ELSE team2 END AS toss_winner,
    CASE WHEN bats THEN 'bat' ELSE 'field' END AS toss_decision,
    CASE WHEN bats = even_total THEN team1 ELSE team2 END AS batting_first, first_total
  FROM joined
),
team_log AS (
  SELECT c.*, 1 AS side, team1 AS team, team2 AS opponent FROM contests c
  UNION ALL
  SELECT c.*, 2 AS side, team2 AS team, team1 AS opponent FROM contests c
),
flagged AS (
  SELECT *, coalesce(CAST(team = winner AS INT), 0) AS won, (winner IS NOT NULL) AS decisive,
         (winner IS NOT NULL OR result_type = 'draw') AS played
  FROM team_log
)
"""


def spells(spark: SparkSession, sf: str) -> DataFrame:
    """One spell per contest and supplier; the key of a line is not unique, so group."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").cast("string").alias("player"))
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.sum("l_linenumber").alias("numbers"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("l_returnflag") == "R").alias("returned"),
            F.count_if(F.col("l_linestatus") == "F").alias("finished"),
            F.min("l_suppkey").alias("first_seq"),
        )
    )


SPELLS = """
spells AS (
  SELECT l_orderkey AS match_id, CAST(l_suppkey AS VARCHAR) AS player, sum(l_quantity) AS quantity,
         sum(l_linenumber) AS numbers, count(*) AS n,
         count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
         count(*) FILTER (WHERE l_linestatus = 'F') AS finished, min(l_suppkey) AS first_seq
  FROM lineitem GROUP BY l_orderkey, l_suppkey
)
"""


def batting_and_bowling(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both event tables from one stored spell table, as a corpus would have them."""
    stored = staged(spells(spark, sf))
    batting = stored.select(
        "match_id", F.lit(1).alias("innings"), "player", F.col("quantity").alias("runs"),
        F.col("numbers").alias("balls"), (F.col("returned") > 0).alias("out"), "first_seq",
    )
    bowling = stored.where("finished > 0").select(
        "match_id", F.lit(2).alias("innings"), "player", (F.col("n") * 6).alias("balls"),
        F.col("quantity").alias("runs"), F.col("finished").alias("wickets"), "first_seq",
    )
    return batting, bowling


def contests_with_lineups(spark: SparkSession, sf: str) -> DataFrame:
    """Contests with each side's list: the order's suppliers of odd and of even lines.

    Stored, like the match table of a corpus, because history reads it several times.
    """
    odd = (F.col("l_linenumber") % 2) == 1
    lists = {
        n: F.transform(F.array_sort(F.collect_set(F.when(c, F.col("l_suppkey")))), lambda x: x.cast("string"))
        for n, c in (("team1_players", odd), ("team2_players", ~odd))
    }
    return staged(contests(spark, sf, **lists))


LINEUPS = """
members AS (
  SELECT DISTINCT l_orderkey AS match_id, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS side,
         l_suppkey, CAST(l_suppkey AS VARCHAR) AS player
  FROM lineitem
),
lineups AS (
  SELECT match_id, side, list(player ORDER BY l_suppkey) AS xi FROM members GROUP BY match_id, side
)
"""


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("match_id"),
        F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("innings"),
        "ts",
        F.col("event_id").alias("seq"),
        F.floor("value").alias("runs_total"),
        (kind == "purchase").alias("wicket"),
        (kind == "error").alias("is_wide"),
        (kind == "signup").alias("is_noball"),
    )


DELIVERIES = """
deliveries AS (
  SELECT user_id AS match_id, CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS innings, ts,
         event_id AS seq, CAST(floor(value) AS BIGINT) AS runs_total,
         (event_type = 'purchase') AS wicket, (event_type = 'error') AS is_wide,
         (event_type = 'signup') AS is_noball
  FROM events
)
"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a probability made from their length."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    p = (F.col("n_chars") % 997) / 996.0
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("match_id"), F.col("quality").alias("y"), p.alias("p"), "lang",
        "source", "toxic", "n_chars",
    )


SCORED = """
scored AS (
  SELECT doc_id AS match_id, quality AS y, (n_chars % 997) / 996.0 AS p, lang, source, toxic, n_chars
  FROM labels JOIN documents USING (doc_id)
)
"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One question per customer: its nation against another, on a day of its own."""
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    key, home = F.col("c_custkey"), F.col("c_nationkey")
    asked = customer.select(
        (-(key + 1)).alias("match_id"),
        F.date_add(F.lit("1996-01-01").cast("date"), (key % 2000).cast("int")).alias("date"),
        F.when(key % 2 == 0, "T20I").otherwise("T20").alias("format"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "female").otherwise("male").alias("gender"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("venue"),
        "c_nationkey",
        ((home + 1 + key % 24) % 25).cast("int").alias("away_key"),
        F.col("c_acctbal").alias("balance"),
    )
    first = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("team1"))
    second = nation.select(F.col("n_nationkey").alias("away_key"), F.col("n_name").alias("team2"))
    return asked.join(first, "c_nationkey").join(second, "away_key").select(
        "match_id", "date", "format", "gender", "venue", "team1", "team2", "balance",
        F.lit(True).alias("is_request"),
    )


REQUESTS = """
requests AS (
  SELECT -(c_custkey + 1) AS match_id, DATE '1996-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS date,
    CASE WHEN c_custkey % 2 = 0 THEN 'T20I' ELSE 'T20' END AS format,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'female' ELSE 'male' END AS gender,
    CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS venue, h.n_name AS team1, a.n_name AS team2,
    c_acctbal AS balance
  FROM customer c JOIN nation h ON h.n_nationkey = c.c_nationkey
  JOIN nation a ON a.n_nationkey = (c.c_nationkey + 1 + c_custkey % 24) % 25
)
"""
