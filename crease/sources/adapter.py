"""Ball-by-ball views over `lineitem`, so that the engine's queries run on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Balls after which a wicket has fallen, and those of an innings that loses all ten.
FALLS, ALL_OUT = (2, 6, 12, 20, 32, 110), (2, 6, 12, 20, 32, 42, 54, 68, 84, 110)

ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def _text(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _match_columns(m) -> dict:
    home = m % 10
    away = (home + 1 + F.floor(m / 10) % 9) % 10
    year = (18 + m % 6).cast("string")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return {
        "match_id": _text("M", m),
        "match_class": F.element_at(F.array(*map(F.lit, ["TEST", "ODI", "T20I", "T20"])), (m % 4 + 1).cast("int")),
        "gender": F.when(m % 3 == 0, "female").otherwise("male"),
        "season": F.when(m % 7 != 0, F.when(m % 7 == 3, F.lit("2007/08")).otherwise(F.concat(F.lit("20"), year))),
        "event_name": F.when(m % 11 != 0, _text("League ", m % 5)),
        "venue": F.when(m % 17 != 0, _text("Ground ", m % 9)),
        "city": _text("City ", m % 4),
        "match_date": F.when(m % 13 != 0, F.concat(F.lit("20"), year, F.lit("-"), two(m % 12 + 1), F.lit("-"), two(m % 28 + 1))),
        "home": home,
        "away": away,
    }


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per match."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    m = F.col("m")
    c = _match_columns(m)
    home, away = c.pop("home"), c.pop("away")
    return (
        items.select(F.floor(F.col("l_partkey") / 10).alias("m"))
        .distinct()
        .select(
            *[v.alias(k) for k, v in c.items()],
            (m % 50).cast("int").alias("event_match_number"),
            _text("T", home).alias("team_home"),
            _text("T", away).alias("team_away"),
            _text("T", F.when(m % 2 == 0, home).otherwise(away)).alias("toss_winner"),
            F.when(m % 3 == 0, "bat").otherwise("field").alias("toss_decision"),
            F.when(m % 5 != 4, _text("T", F.when(m % 3 == 0, home).otherwise(away))).alias("outcome_winner"),
            (m % 3 + 1).cast("int").alias("revision"),
        )
    )


def deliveries(spark: SparkSession, sf_dir: str, whole_matches: bool = False) -> DataFrame:
    """One row per ball, hash-partitioned by (match_id, innings_no) after its only shuffle; whole_matches: by match_id."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    m, inn, rn, over = F.col("m"), F.col("innings_no"), F.col("rn"), F.floor(F.col("rn") / 6)
    rows = items.select(
        *ORDER, "l_returnflag", F.floor(F.col("l_partkey") / 10).alias("m"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("innings_no")
    ).withColumn("match_id", _text("M", m))
    rows = rows.repartition("match_id") if whole_matches else rows
    ball = W.partitionBy("match_id", "innings_no").orderBy(*ORDER)
    rows = rows.withColumn("rn", F.row_number().over(ball) - 1)
    c = _match_columns(m)
    home, away = c.pop("home"), c.pop("away")
    c.pop("match_id")
    first = (m + inn) % 2 == 1
    bats, bowls = F.when(first, home).otherwise(away), F.when(first, away).otherwise(home)
    # a wicket falls on the last ball before each of these; innings of every sixth match lose all ten
    fall = lambda ends: sum((rn >= e).cast("int") for e in ends)
    all_out = m % 6 == 1
    spell = F.when(all_out, F.least(fall(ALL_OUT), F.lit(9))).otherwise(fall(FALLS))
    # one bowler an over, but in some matches another bowls its first two balls
    bowler = F.when(m % 10 == 0, 4).when((m % 9 == 4) & (over == 0) & (rn < 2), 6).otherwise(4 + over % 5)
    player = lambda team, k: _text("P", team * 11 + k)
    extras = F.array(*map(F.lit, ["wides", "noballs", "byes", "legbyes"]))
    extra = F.when(F.col("l_returnflag") == "R", F.get(extras, F.col("l_linenumber") - 1))
    quantity = F.col("l_quantity").cast("int")
    kinds = F.array(*map(F.lit, ["bowled", "caught", "run out", "lbw", "stumped", "caught and bowled", "hit wicket"]))
    wicket = F.when(all_out, rn.isin(*(e - 1 for e in ALL_OUT))).otherwise(rn.isin(*(e - 1 for e in FALLS)))
    # the other end may be run out
    out_k = F.when((quantity % 7 == 2) & (m % 3 == 0), F.col("k") + 1).otherwise(F.col("k"))
    return (
        rows.withColumn("extra_type", extra)
        .withColumn("bat_team", bats)
        .withColumn("bowl_team", bowls)
        .withColumn("k", spell)
        .withColumn("is_wicket", wicket)
        .withColumn("runs_batter", F.when(F.col("extra_type").isNotNull() | (quantity <= 25), 0).otherwise(quantity % 7))
        .withColumn("runs_extras", F.when(F.col("extra_type").isNotNull(), 1).otherwise(0))
        .select(
            "match_id",
            *[v.alias(k) for k, v in c.items()],
            "innings_no",
            over.cast("int").alias("over_no"),
            (rn % 6 + 1).cast("int").alias("ball_in_over"),
            _text("T", F.col("bat_team")).alias("batting_team"),
            _text("T", F.col("bowl_team")).alias("bowling_team"),
            player(F.col("bat_team"), F.col("k")).alias("batter_id"),
            F.concat(F.lit("Player "), (F.col("bat_team") * 11 + F.col("k")).cast("string")).alias("batter_name"),
            player(F.col("bat_team"), F.col("k") + 1).alias("non_striker_id"),
            F.concat(F.lit("Player "), (F.col("bat_team") * 11 + F.col("k") + 1).cast("string")).alias("non_striker_name"),
            player(F.col("bowl_team"), bowler).alias("bowler_id"),
            F.concat(F.lit("Player "), (F.col("bowl_team") * 11 + bowler).cast("string")).alias("bowler_name"),
            "runs_batter",
            "runs_extras",
            (F.col("runs_batter") + F.col("runs_extras")).alias("runs_total"),
            "extra_type",
            "is_wicket",
            F.when(F.col("is_wicket"), F.get(kinds, quantity % 7)).alias("dismissal_kind"),
            F.when(F.col("is_wicket"), player(F.col("bat_team"), out_k)).alias("player_out_id"),
        )
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known players: id, name, external id (null for some); a few who never appear, a few appear unknown."""
    return spark.range(2, 120).select(
        _text("P", F.col("id")).alias("player_id"),
        _text("Player ", F.col("id")).alias("name"),
        F.when(F.col("id") % 4 != 0, _text("X", F.col("id") * 7)).alias("external_id"),
    )


#: The same views for DuckDB: CTEs items, matches, deliveries, players.
SQL = """
WITH items AS (
  SELECT *, l_partkey // 10 AS m, CAST(1 + l_suppkey % 2 AS INTEGER) AS inn FROM lineitem),
keyed AS (
  SELECT m, 'M' || m AS match_id,
    CASE m % 4 WHEN 0 THEN 'TEST' WHEN 1 THEN 'ODI' WHEN 2 THEN 'T20I' ELSE 'T20' END AS match_class,
    CASE WHEN m % 3 = 0 THEN 'female' ELSE 'male' END AS gender,
    CASE WHEN m % 7 = 0 THEN NULL WHEN m % 7 = 3 THEN '2007/08' ELSE '20' || (18 + m % 6) END AS season,
    CASE WHEN m % 11 = 0 THEN NULL ELSE 'League ' || (m % 5) END AS event_name,
    CASE WHEN m % 17 = 0 THEN NULL ELSE 'Ground ' || (m % 9) END AS venue,
    'City ' || (m % 4) AS city,
    CASE WHEN m % 13 = 0 THEN NULL ELSE '20' || (18 + m % 6) || '-' || lpad(CAST(m % 12 + 1 AS VARCHAR), 2, '0')
      || '-' || lpad(CAST(m % 28 + 1 AS VARCHAR), 2, '0') END AS match_date,
    m % 10 AS home, (m % 10 + 1 + (m // 10) % 9) % 10 AS away
  FROM (SELECT DISTINCT m FROM items)),
matches AS (
  SELECT match_id, match_class, gender, season, event_name, venue, city, match_date,
    CAST(m % 50 AS INTEGER) AS event_match_number, 'T' || home AS team_home, 'T' || away AS team_away,
    'T' || CASE WHEN m % 2 = 0 THEN home ELSE away END AS toss_winner,
    CASE WHEN m % 3 = 0 THEN 'bat' ELSE 'field' END AS toss_decision,
    CASE WHEN m % 5 = 4 THEN NULL ELSE 'T' || CASE WHEN m % 3 = 0 THEN home ELSE away END END AS outcome_winner,
    CAST(m % 3 + 1 AS INTEGER) AS revision
  FROM keyed),
numbered AS (
  SELECT i.*, CAST(row_number() OVER (PARTITION BY m, inn ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey,
    l_quantity, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS rn FROM items i),
placed AS (
  SELECT n.rn, n.inn, n.l_quantity, k.*,
    CASE WHEN (n.m + n.inn) % 2 = 1 THEN home ELSE away END AS bat,
    CASE WHEN (n.m + n.inn) % 2 = 1 THEN away ELSE home END AS bowl,
    CASE WHEN n.m % 6 = 1 THEN least(9, len(list_filter([2, 6, 12, 20, 32, 42, 54, 68, 84, 110], lambda e: e <= rn)))
      ELSE len(list_filter([2, 6, 12, 20, 32, 110], lambda e: e <= rn)) END AS spell,
    CASE WHEN n.m % 10 = 0 THEN 4 WHEN n.m % 9 = 4 AND rn < 2 THEN 6 ELSE 4 + (rn // 6) % 5 END AS b,
    CASE WHEN l_returnflag = 'R' THEN
      CASE l_linenumber WHEN 1 THEN 'wides' WHEN 2 THEN 'noballs' WHEN 3 THEN 'byes' WHEN 4 THEN 'legbyes' END
    END AS extra_type,
    CAST(floor(l_quantity) AS INTEGER) AS q, rn IN (1, 5, 11, 19, 31, 109) OR n.m % 6 = 1 AND rn IN (41, 53, 67, 83) AS is_wicket
  FROM numbered n JOIN keyed k USING (m)),
balls AS (
  SELECT *, CASE WHEN extra_type IS NOT NULL OR q <= 25 THEN 0 ELSE q % 7 END AS runs_batter,
    CASE WHEN extra_type IS NOT NULL THEN 1 ELSE 0 END AS runs_extras FROM placed),
deliveries AS MATERIALIZED (
  SELECT match_id, match_class, gender, season, event_name, venue, city, match_date, inn AS innings_no,
    rn // 6 AS over_no, rn % 6 + 1 AS ball_in_over, 'T' || bat AS batting_team, 'T' || bowl AS bowling_team,
    'P' || (bat * 11 + spell) AS batter_id, 'Player ' || (bat * 11 + spell) AS batter_name,
    'P' || (bat * 11 + spell + 1) AS non_striker_id, 'Player ' || (bat * 11 + spell + 1) AS non_striker_name,
    'P' || (bowl * 11 + b) AS bowler_id, 'Player ' || (bowl * 11 + b) AS bowler_name,
    runs_batter, runs_extras, runs_batter + runs_extras AS runs_total, extra_type, is_wicket,
    CASE WHEN is_wicket THEN (['bowled','caught','run out','lbw','stumped','caught and bowled','hit wicket'])[q % 7 + 1]
    END AS dismissal_kind,
    CASE WHEN is_wicket THEN 'P' || (bat * 11 + spell + CASE WHEN q % 7 = 2 AND m % 3 = 0 THEN 1 ELSE 0 END) END AS player_out_id
  FROM balls),
players AS (
  SELECT 'P' || i AS player_id, 'Player ' || i AS name, CASE WHEN i % 4 = 0 THEN NULL ELSE 'X' || (i * 7) END AS external_id
  FROM range(2, 120) t(i))
"""
