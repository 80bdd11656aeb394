"""Match documents from JSON to gold, with figures worked out by hand."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from crease.operators import careers, editions, ratings, scorecards
from crease.plans import layout
from crease.sources import matchdocs
from crease.streaming import ingest

PEOPLE = {n: f"id-{n}" for n in ("Ash", "Bo", "Cy", "Di", "Ed", "Flo", "Gus")}


def ball(batter, bowler, non_striker, batter_runs=0, extras=None, wicket=None):
    n = sum((extras or {}).values())
    out = {"batter": batter, "bowler": bowler, "non_striker": non_striker, "runs": {"batter": batter_runs, "extras": n, "total": batter_runs + n}}
    if extras:
        out["extras"] = extras
    if wicket:
        out["wickets"] = [wicket]
    return out


def document(revision=1, winner="Reds"):
    first = [
        ball("Ash", "Ed", "Bo", 4),
        ball("Ash", "Ed", "Bo", 0, {"wides": 1, "byes": 2}),
        ball("Ash", "Ed", "Bo", 1),
        ball("Bo", "Ed", "Ash", 0, None, {"kind": "caught", "player_out": "Bo", "fielders": [{"name": "Gus"}, {"name": "Flo"}]}),
        ball("Cy", "Ed", "Ash", 6),
    ]
    second = [ball("Flo", "Di", "Gus", 0)] * 6
    third = [ball("Gus", "Cy", "Flo", 2), ball("Gus", "Cy", "Flo", 0, {"noballs": 1}, {"kind": "run out", "player_out": "Nobody"})]
    return {
        "meta": {"revision": revision},
        "info": {
            "balls_per_over": 6, "city": " Town ", "dates": ["2024-05-01", "2024-05-02"], "event": {"name": "Cup", "match_number": 3},
            "gender": "male", "match_type": "T20", "outcome": {"winner": winner}, "player_of_match": ["Cy"],
            "players": {"Reds": ["Ash", "Bo", "Cy", "Di"], "Blues": ["Ed", "Flo", "Gus"]}, "registry": {"people": PEOPLE},
            "season": "2007/08", "team_type": "club", "teams": ["Reds", "Blues"], "toss": {"decision": "Field", "winner": "Blues"}, "venue": "",
        },
        "innings": [
            {"team": "Reds", "overs": [{"over": 0, "deliveries": first}]},
            {"team": "Blues", "overs": [{"over": 0, "deliveries": second}, {"over": 1, "deliveries": third}]},
        ],
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    (path / "m1.json").write_text(json.dumps(document()))
    (path / "bad.json").write_text('{"meta": {')
    (path / "README.json").write_text("{}")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return matchdocs.split_valid(matchdocs.read_folder(spark, str(folder)))


def test_valid_and_broken(docs):
    good, bad = docs
    assert [r.match_id for r in good.collect()] == ["m1"]
    assert [(r.match_id, r.reason) for r in bad.collect()] == [("bad", "not JSON")]


def test_flat_balls(docs):
    rows = matchdocs.deliveries(docs[0]).orderBy("innings_no", "over_no", "ball_in_over").collect()
    assert len(rows) == 13
    assert rows[0].match_class == "T20" and rows[0].venue is None and rows[0].city == "Town" and rows[0].bowling_team == "Blues"
    assert rows[1].extra_type == "wides" and rows[1].runs_total == 3
    assert (rows[3].dismissal_kind, rows[3].player_out_id, rows[3].fielders) == ("caught", "id-Bo", "Gus;Flo")
    assert rows[12].player_out_name == "Nobody" and rows[12].player_out_id is None and rows[12].is_wicket
    assert [r.ball_in_over for r in rows[:5]] == [1, 2, 3, 4, 5]


def test_scorecards(docs):
    balls = matchdocs.deliveries(docs[0])
    totals = {r.innings_no: (r.runs, r.wickets, r.balls) for r in scorecards.innings_totals(balls).collect()}
    assert totals == {1: (14, 1, 4), 2: (3, 1, 7)}
    batting = {(r.innings_no, r.name): (r.batting_pos, r.runs, r.balls, r.out, r.strike_rate) for r in scorecards.batting_card(balls).collect()}
    assert batting[1, "Ash"] == (1, 5, 2, False, 250.0)
    assert batting[1, "Bo"] == (2, 0, 1, True, 0.0)
    assert batting[1, "Cy"] == (3, 6, 1, False, 600.0)
    assert batting[2, "Gus"] == (2, 2, 2, False, 100.0)
    bowling = {r.name: (r.balls, r.maidens, r.runs, r.wickets) for r in scorecards.bowling_card(balls).collect()}
    assert bowling == {"Ed": (4, 0, 14, 1), "Di": (6, 1, 0, 0), "Cy": (1, 0, 3, 0)}
    overs = {r.innings_no: json.loads(r.overs) for r in scorecards.overs_json(balls).collect()}
    assert overs[1] == [{"o": 0, "r": 14, "w": 1, "f": 1, "s": 1, "c": 14}]
    assert [o["c"] for o in overs[2]] == [0, 3]


def test_match_rows(docs):
    row = matchdocs.matches(docs[0]).first()
    assert (row.team_home, row.team_away, row.toss_decision, row.outcome_winner, row.revision) == ("Reds", "Blues", "field", "Reds", 1)
    summary = scorecards.match_summary(matchdocs.matches(docs[0]), matchdocs.deliveries(docs[0])).first()
    assert (summary.inn1_score, summary.inn2_score) == ("14/1 (0.4)", "3/1 (1.1)")
    assert matchdocs.squads(docs[0]).count() == 7


def test_standings_and_rating(docs):
    matches, balls = matchdocs.matches(docs[0]), matchdocs.deliveries(docs[0])
    table = {r.team: (r.points, r.won, r.lost, round(r.nrr, 6), r.place) for r in editions.standings(matches, scorecards.innings_totals(balls)).collect()}
    nrr = 14 / (4 / 6) - 3 / (7 / 6)
    assert table == {"Reds": (2, 1, 0, round(nrr, 6), 1), "Blues": (0, 0, 1, round(-nrr, 6), 2)}
    rated = {r.team: r.rating for r in ratings.elo_ratings(matches, min_matches=1).collect()}
    assert rated == {"Reds": 1516, "Blues": 1484}


def test_silver_and_gold(spark, docs, tmp_path):
    register = tmp_path / "people.csv"
    register.write_text('identifier,name,key_external\r\nid-Ash,"Ash, ""A""",1\r\nid-Bo,Bo,\r\nid-Ash,Ash,2\r\nid-Cy,Cy,3\r\n')
    crosswalk = matchdocs.read_register(spark, str(register))
    assert {r.player_id: r.external_id for r in crosswalk.collect()} == {"id-Ash": "2", "id-Cy": "3"}
    good = docs[0]
    silver = str(tmp_path / "silver")
    layout.write_silver(matchdocs.deliveries(good, crosswalk), matchdocs.matches(good), matchdocs.players(good, crosswalk), silver)
    layout.write_silver(matchdocs.deliveries(good, crosswalk), matchdocs.matches(good), matchdocs.players(good, crosswalk), silver, single_files=True)
    assert len(list((tmp_path / "silver" / "players").glob("*.parquet"))) == 1
    tables = layout.read_silver(spark, silver)
    assert tables["deliveries"].first().season == "2007/08"
    counts = layout.write_gold(tables, str(tmp_path / "gold"))
    assert counts["batting"] == 5 and counts["innings"] == 2 and counts["careers"] == 7  # five strikers and three bowlers, one of whom does both
    careers_by = {r.player_id: r for r in careers.career_stats(tables["deliveries"]).collect()}
    assert careers_by["id-Di"].bat_innings == 0 and careers_by["id-Di"].best_bowling_wkts == 0
    assert careers_by["id-Cy"].high_score_not_out and careers_by["id-Cy"].batting_avg is None
    tree = layout.match_tree(
        tables["matches"], *[spark.read.parquet(f"{tmp_path}/gold/{t}") for t in ("innings", "batting", "bowling")]
    ).first()
    assert [len(i.batting) for i in tree.innings] == [3, 2]
    assert json.loads(layout.as_json(tables["players"].filter("player_id = 'id-Bo'")).first().json)["external_id"] is None


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("x/m7.json", json.dumps(document()))
        z.writestr("readme.json", "{}")
        z.writestr("x/notes.txt", "")
        z.writestr("bad.json", "[")
    good, bad = matchdocs.split_valid(matchdocs.read_archives(spark, str(tmp_path)))
    assert [r.match_id for r in good.collect()] == ["m7"] and [r.match_id for r in bad.collect()] == ["bad"]
    assert matchdocs.deliveries(good).filter("extra_type = 'wides'").count() == 1


def test_stream_takes_revisions(spark, tmp_path):
    landing, silver, check = tmp_path / "in", str(tmp_path / "silver"), str(tmp_path / "check")
    landing.mkdir()
    for name, d in (("m1", document()), ("m2", document())):
        (landing / f"{name}.json").write_text(json.dumps(d))
    ingest.ingest(spark, str(landing), silver, check).awaitTermination()
    (landing / "later").mkdir()
    (landing / "m1.json").unlink()
    (landing / "late-m1.json").write_text("{")
    (landing / "m3.json").write_text(json.dumps(document(2, "Blues")))
    ingest.ingest(spark, str(landing), silver, check).awaitTermination()
    now = {r.match_id: r.rev for r in ingest.current_documents(spark, silver).select("match_id", "rev").collect()}
    assert now == {"m1": 1, "m2": 1, "m3": 2}
    known = spark.createDataFrame([("m1", 1), ("m3", 1)], "match_id string, revision int")
    docs = matchdocs.read_folder(spark, str(landing)).filter("broken is null")
    assert sorted(r.match_id for r in ingest.new_documents(docs, known).collect()) == ["m2", "m3"]
    assert sorted(r.match_id for r in ingest.new_documents(docs, known, sweep=False).collect()) == ["m2"]


def test_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert ingest.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_feeds(spark):
    got = {r.feed: (r.file, r.label) for r in matchdocs.feeds(spark, [("all", "everything.zip", "All")], ["all", "cup"]).collect()}
    assert got == {"all": ("everything.zip", "All"), "cup": ("cup_json.zip", "cup")}


def test_documents_are_made_from_one_shuffle_of_balls(spark, sf_dir):
    """The balls are read and shuffled once, by match; the matches are read and shuffled beside them."""
    from crease.sources import made

    plan = made.documents(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("FileScan parquet") == 2
