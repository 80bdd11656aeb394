"""Documents and pages made from the driver's tables, so that readers and parsers run as queries over them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.sources import adapter, matchdocs, shape

#: What the page parsers look for.
ELEMENT, BASE = "PAGE_DATA", "props.content"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ball-by-ball view as match documents: one JSON text a match, parsed again with the readers' schema.

    Balls are shuffled once, by match: overs, innings, people and documents are then put together where they are.
    """
    balls, matches = adapter.deliveries(spark, sf_dir, whole_matches=True), adapter.matches(spark, sf_dir)
    none = F.lit(None)
    wicket = F.struct(
        F.col("dismissal_kind").alias("kind"),
        F.concat(F.lit("Player "), F.expr("substring(player_out_id, 2)")).alias("player_out"),
        F.when(F.col("dismissal_kind") == "caught", F.array(F.struct(F.col("bowler_name").alias("name")), F.struct(F.lit(" ").alias("name")), F.struct(F.lit("Sub").alias("name")))).alias("fielders"),
    )
    ball = F.struct(
        F.col("ball_in_over").alias("b"),
        F.col("batter_name").alias("batter"),
        F.concat(F.lit(" "), "bowler_name").alias("bowler"),
        F.col("non_striker_name").alias("non_striker"),
        F.struct(F.col("runs_batter").alias("batter"), F.col("runs_extras").alias("extras"), F.when(F.col("ball_in_over") != 2, F.col("runs_total")).alias("total")).alias("runs"),
        F.when(F.col("extra_type").isNotNull(), F.create_map("extra_type", "runs_extras")).alias("extras"),
        F.when(F.col("is_wicket"), F.array(wicket)).alias("wickets"),
    )
    people = F.array(*[F.struct(F.col(f"{who}_name").alias("k"), F.col(f"{who}_id").alias("v")) for who in ("batter", "bowler", "non_striker")])
    together = lambda lists: F.array_distinct(F.flatten(F.collect_list(lists)))
    overs = balls.groupBy("match_id", "innings_no", "over_no").agg(F.min("batting_team").alias("team"), together(people).alias("people"), F.array_sort(F.collect_list(ball), lambda a, b: a["b"] - b["b"]).alias("deliveries"))
    over = F.struct(F.col("over_no").alias("over"), "deliveries")
    innings = overs.groupBy("match_id", "innings_no").agg(F.min("team").alias("team"), together("people").alias("people"), F.array_sort(F.collect_list(over), lambda a, b: a["over"] - b["over"]).alias("overs"))
    inning = F.struct("innings_no", "team", "overs")
    played = innings.groupBy("match_id").agg(F.map_from_entries(together("people")).alias("people"), F.array_sort(F.collect_list(inning), lambda a, b: a["innings_no"] - b["innings_no"]).alias("innings"))
    kind = F.when(F.col("match_class") == "TEST", "Test").when(F.col("match_class") == "ODI", "ODI").otherwise("T20")
    info = F.struct(
        kind.alias("match_type"),
        F.when(F.col("match_class") == "T20", "club").otherwise("international").alias("team_type"),
        *["gender", "season", "venue", "city"],
        F.when(F.col("match_date").isNotNull(), F.array("match_date")).alias("dates"),
        F.struct(F.col("event_name").alias("name"), F.col("event_match_number").alias("match_number")).alias("event"),
        F.array("team_home", "team_away").alias("teams"),
        F.struct(F.col("toss_winner").alias("winner"), F.upper("toss_decision").alias("decision")).alias("toss"),
        F.struct(F.col("outcome_winner").alias("winner")).alias("outcome"),
        F.struct("people").alias("registry"),
        F.create_map(F.col("team_home"), F.array_sort(F.map_keys("people"))).alias("players"),
        none.cast("int").alias("balls_per_over"),
    )
    text = F.to_json(F.struct(F.struct("revision").alias("meta"), info.alias("info"), "innings"))
    texts = matches.join(played, "match_id").select("match_id", text.alias("text"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    return texts.select("match_id", F.from_json("text", matchdocs.SCHEMA, options).alias("d")).select("match_id", "d.*")


def _page(data) -> F.Column:
    """A page with embedded JSON."""
    return F.concat(F.lit(f'<html><title>t</title><script id="{ELEMENT}" type="application/json">'), data, F.lit("</script></html>"))


def fixture_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures pages from orders, one a customer; some matches use other field names, some pages have no data."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    state = F.when(k % 4 == 0, "LIVE").when(k % 4 == 1, "POST").when(k % 4 == 2, "PRE").otherwise("ODD")
    match = F.struct(
        F.when(k % 2 == 0, k).alias("objectId"),
        k.alias("id"),
        F.when(k % 9 != 0, F.concat(F.lit("m"), k.cast("string"))).alias("slug"),
        F.concat(F.lit(" Match "), k.cast("string")).alias("title"),
        F.when(k % 3 == 0, "T20I").when(k % 3 == 1, "ODI").alias("format"),
        state.alias("state"),
        F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("isCancelled"),
        F.when(k % 7 == 0, F.col("o_orderpriority")).alias("statusText"),
        F.col("o_orderstatus").alias("status"),
        (k % 3).alias("tossWinnerChoice"),
        F.when(k % 6 == 0, "night").when(k % 6 == 1, "day").when(k % 6 == 2, "day/night").alias("floodlit"),
        F.struct(F.lit("cup").alias("slug"), F.when(k % 8 != 0, F.col("o_custkey")).alias("objectId")).alias("series"),
        F.when(k % 11 != 0, k % 2 == 0).alias("hasScorecard"),
    )
    entry = F.struct(k.alias("o"), F.to_json(match).alias("m"))
    listed = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["m"]), ",").alias("all"))
    data = F.concat(F.lit('{"props":{"content":{"matches":['), "all", F.lit("]}}}"))
    html = F.when(F.col("o_custkey") % 10 == 0, F.lit("<html>none</html>")).otherwise(_page(data))
    return listed.select(F.col("o_custkey").alias("page_id"), html.alias("html"))


def scorecard_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecard pages from lineitem: an order is a match, its lines are batting and bowling lines in two shapes.

    Lines become texts one by one, in compiled code, before they are put together; a function over a list of lines is interpreted.
    """
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # lines in order; those of one number by their other columns
    order = ["l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_extendedprice"]
    odd = F.col("l_orderkey") % 2 == 1
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    who = F.struct(F.col("l_partkey").alias("objectId"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"))
    bat = lambda name, *more: F.struct(
        n.alias("n"),
        who.alias(name),
        F.when(n != 3, q).alias("runs"),
        (q + 1).alias("balls"),
        F.when(n % 2 == 0, q % 4).alias("fours"),
        *more,
        F.when(n % 2 == 0, F.struct(F.lit("c X b Y").alias("long"))).alias("dismissalText"),
    )
    bowl = lambda name, *more: F.struct(
        n.alias("n"), who.alias(name), *more, (q + 2).alias("runs"), (n % 3).alias("wickets"), F.concat(n.cast("string"), F.lit(".0")).alias("overs")
    )
    text = lambda one, other: F.when(odd, F.to_json(one)).otherwise(F.to_json(other))
    lines = (
        i.select("l_orderkey", *order)
        .repartition("l_orderkey")
        .select(
            "l_orderkey",
            *order,
            text(bat("player", (n % 2 == 0).alias("isOut")), bat("batsman")).alias("bat"),
            text(bowl("player", q.alias("conceded")), bowl("bowler")).alias("bowl"),
        )
    )
    lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*order, "bat", "bowl"))).alias("all"))
    bats, bowls = F.array_join("all.bat", ","), F.array_join("all.bowl", ",")
    one = F.concat(F.lit('"scorecard":{"innings":[{"inningNumber":7,"runs":100,"inningBatsmen":['), bats, F.lit('],"inningBowlers":['), bowls, F.lit("]}]}"))
    other = F.concat(F.lit('"innings":[{"runs":100,"batting":['), bats, F.lit('],"bowlers":['), bowls, F.lit("]}]"))
    data = F.concat(F.lit('{"props":{"content":{'), F.when(odd, one).otherwise(other), F.lit("}}}"))
    return lists.select(F.col("l_orderkey").alias("page_id"), data.alias("data"))


def profile_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player pages from customers, in two shapes."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    odd = k % 2 == 1
    player = F.struct(
        F.when(odd, k).alias("objectId"),
        k.alias("id"),
        F.when(odd, F.concat(F.lit(" "), "c_name")).alias("longName"),
        F.col("c_name").alias("name"),
        F.when(k % 3 == 0, F.struct(F.lit("Land").alias("name"))).alias("country"),
        F.lit("Team").alias("teamName"),
        F.when(k % 5 != 0, F.col("c_mktsegment")).alias("playingRole"),
        F.when(k % 4 == 0, F.array(F.lit("Right hand"))).alias("longBattingStyles"),
        F.when(k % 4 == 1, "rhb").alias("battingStyle"),
    )
    return c.select(k.alias("page_id"), F.to_json(F.struct(F.struct(player.alias("content")).alias("props"))).alias("data"))


def second_if_longer(items: list) -> dict:
    """Of balls the second, which has all the fields; of other lists the first."""
    return items[1] if len(items) > 1 and "bowler" in items[1] else items[0]


def odd_documents(spark: SparkSession, sf_dir: str, table: list[shape.Rule]) -> DataFrame:
    """Hand-written documents, one an order: order k breaks rule number k % (number of rules + 1), the last of these none."""
    texts, names = [], []
    for rule in [*table, None]:
        document = {
            "meta": {"revision": 2, "version": "1.1"},
            "info": {
                "match_type": "ODI", "dates": ["2024-05-01"], "event": {"name": "Cup", "match_number": 3, "stage": "Final"}, "teams": ["Reds", "Blues"],
                "toss": {"winner": "Reds", "decision": "Bat"}, "outcome": {"by": {"runs": 3}, "winner": "Reds"}, "player_of_match": ["Ash"],
                "players": {"Reds": ["Ash"], "Blues": ["Ed"]}, "registry": {"people": {"Ash": "a1", "Ed": "e1"}}, "balls_per_over": 6,
            },
            "innings": [
                {"team": "Reds", "overs": [{"over": 0, "deliveries": [
                    {"batter": "Ash", "bowler": "Ed", "non_striker": "Bo", "runs": {"batter": 4, "extras": 0, "total": 4}},
                    {"batter": "Ash", "bowler": "Ed", "runs": {"total": 1}, "extras": {"wides": 1}, "review": {"by": "Reds"}, "wickets": [{"kind": "run out", "fielders": [{}]}]},
                ]}], "powerplays": []},
                {"team": "Blues", "overs": []},
            ],
        }
        name = "m"
        if rule is not None:
            how = rule.how.split(" ")[0]
            bad = int(rule.how.split(" ")[1]) - 1 if how == "least" else {"filled": " ", "one": "toss a coin"}.get(how)
            if rule.path == "match_id":
                name = ""
            else:
                *way, last = shape._steps(rule.path)
                node = document
                for step in way:
                    node = second_if_longer(node) if step == "[]" else next(iter(node.values())) if step == "{}" else node[step]
                node[0 if last == "[]" else next(iter(node)) if last == "{}" else last] = bad
        texts.append(json.dumps(document))
        names.append(name)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    at = (F.col("o_orderkey") % len(texts)).cast("int")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), at)
    name = F.when(pick(names) == "", "").otherwise(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")))
    parsed = F.from_json(pick(texts), shape.schema([r for r in table if r.path != "match_id"]))
    return orders.select("o_orderkey", name.alias("match_id"), parsed.alias("d")).select("o_orderkey", "match_id", "d.*")
