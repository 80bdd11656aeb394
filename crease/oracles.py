"""DuckDB SQL of the queries: from the definitions, over a row for each part of a player in a ball."""

from __future__ import annotations

from crease.sources.adapter import SQL as VIEWS

def _n(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _r2(top: str, bottom: str, when: str) -> str:
    return f"CASE WHEN {when} THEN round(CAST({top} AS DOUBLE) / ({bottom}) * 100) / 100 END"


#: Each ball with what it counts as.
FLAGS = """
flagged AS (
  SELECT *, coalesce(extra_type, '') NOT IN ('wides', 'noballs') AS legal, coalesce(extra_type, '') <> 'wides' AS faced,
    runs_batter + CASE extra_type WHEN 'wides' THEN runs_extras WHEN 'noballs' THEN runs_extras ELSE 0 END AS charged,
    coalesce(list_contains(['bowled', 'caught', 'lbw', 'stumped', 'caught and bowled', 'hit wicket'], dismissal_kind), false) AS credited
  FROM deliveries)"""

OVERS = f"""
per_over AS (
  SELECT match_id, innings_no, over_no, {_n('sum(runs_total)')} AS r, {_n('count_if(is_wicket)')} AS w,
    {_n('count_if(runs_batter = 4)')} AS f, {_n('count_if(runs_batter = 6)')} AS s
  FROM deliveries GROUP BY ALL),
cum AS (
  SELECT a.*, {_n('(SELECT sum(b.r) FROM per_over b WHERE b.match_id = a.match_id AND b.innings_no = a.innings_no AND b.over_no <= a.over_no)')} AS c
  FROM per_over a)"""

#: Innings as the sums of their overs.
INNINGS = f"""{FLAGS},
over_sums AS (
  SELECT match_id, innings_no, over_no, min(batting_team) AS side, sum(runs_total) AS r, count_if(is_wicket) AS w, count_if(legal) AS b
  FROM flagged GROUP BY ALL),
innings_sums AS (
  SELECT match_id, innings_no, min(side) AS batting_team, {_n('sum(r)')} AS runs, {_n('sum(w)')} AS wickets, {_n('sum(b)')} AS balls
  FROM over_sums GROUP BY ALL),
score AS (
  SELECT match_id, innings_no, format('{{}}/{{}} ({{}}.{{}})', runs, wickets, balls // 6, balls % 6) AS score FROM innings_sums)"""

#: A row for each part that a player has in a ball, and from them one row a player and innings.
LINES = f"""{FLAGS},
parts AS (
  SELECT * EXCLUDE (part), part.who AS player_id, part.called AS called, part.kind AS kind FROM (
    SELECT *, unnest([
      {{'who': batter_id, 'called': batter_name, 'kind': 'on strike'}}, {{'who': non_striker_id, 'called': non_striker_name, 'kind': 'waiting'}},
      {{'who': player_out_id, 'called': NULL, 'kind': 'leaving'}}, {{'who': bowler_id, 'called': bowler_name, 'kind': 'bowling'}}]) AS part
    FROM flagged)
  WHERE part.who IS NOT NULL),
lines AS (
  SELECT match_id, innings_no, player_id, min(match_class) AS match_class, min(gender) AS gender, min(match_date) AS match_date,
    min(called) FILTER (WHERE kind IN ('on strike', 'waiting')) AS bat_name, min(called) FILTER (WHERE kind = 'bowling') AS bowl_name,
    min(over_no * 10000 + ball_in_over * 10 + CASE kind WHEN 'waiting' THEN 1 ELSE 0 END) FILTER (WHERE kind IN ('on strike', 'waiting')) AS bat_at,
    min(over_no * 1000 + ball_in_over) FILTER (WHERE kind = 'bowling') AS bowl_at,
    count_if(kind = 'on strike') AS strikes, {_n("coalesce(sum(runs_batter) FILTER (WHERE kind = 'on strike'), 0)")} AS runs,
    {_n("count_if(kind = 'on strike' AND faced)")} AS balls, {_n("count_if(kind = 'on strike' AND runs_batter = 4)")} AS fours,
    {_n("count_if(kind = 'on strike' AND runs_batter = 6)")} AS sixes, bool_or(kind = 'leaving') AS was_out,
    arg_min(dismissal_kind, over_no * 1000 + ball_in_over) FILTER (WHERE kind = 'leaving') AS dismissal,
    {_n("count_if(kind = 'bowling' AND legal)")} AS bowl_balls, {_n("coalesce(sum(charged) FILTER (WHERE kind = 'bowling'), 0)")} AS conceded,
    {_n("count_if(kind = 'bowling' AND credited)")} AS wickets
  FROM parts GROUP BY match_id, innings_no, player_id)"""

#: The same after INNINGS, which has the flags.
LINES_ON = LINES.removeprefix(FLAGS + ",")

BATTING = """
bat_lines AS (
  SELECT match_id, innings_no, CAST(row_number() OVER (PARTITION BY match_id, innings_no ORDER BY bat_at, player_id) AS INTEGER) AS batting_pos,
    player_id, bat_name AS name, runs, balls, fours, sixes,
    CASE WHEN balls > 0 THEN round(CAST(runs * 100 AS DOUBLE) / balls * 100) / 100 END AS strike_rate, was_out AS out, dismissal
  FROM lines WHERE bat_at IS NOT NULL)"""

BOWLING = f"""
quiet AS (
  SELECT match_id, innings_no, bowler_id AS player_id, over_no, sum(charged) = 0 AS nothing, count_if(legal) >= 6 AS whole
  FROM flagged GROUP BY ALL),
bowl_lines AS (
  SELECT match_id, innings_no, CAST(row_number() OVER (PARTITION BY match_id, innings_no ORDER BY bowl_at, player_id) AS INTEGER) AS bowling_pos,
    player_id, bowl_name AS name, bowl_balls AS balls, {_n('coalesce(m.n, 0)')} AS maidens, conceded AS runs, wickets,
    {_r2('conceded', 'bowl_balls / 6.0', 'bowl_balls > 0')} AS economy
  FROM lines LEFT JOIN (SELECT match_id, innings_no, player_id, count_if(nothing AND whole) AS n FROM quiet GROUP BY ALL) m
    USING (match_id, innings_no, player_id)
  WHERE bowl_at IS NOT NULL)"""

#: Careers as one fold of the lines; a highest score with its star and best figures are each packed into one number.
CAREERS = f"""
folded AS (
  SELECT player_id, match_class, {_n('count(DISTINCT match_id)')} AS matches, count_if(strikes > 0) AS bat_innings,
    {_n('sum(runs)')} AS runs, {_n('sum(balls)')} AS balls_faced, count_if(strikes > 0 AND NOT was_out) AS not_outs,
    max(CASE WHEN strikes > 0 THEN runs * 2 + CASE WHEN was_out THEN 0 ELSE 1 END END) AS high,
    count_if(strikes > 0 AND runs BETWEEN 50 AND 99) AS fifties, count_if(runs >= 100) AS hundreds,
    count_if(strikes > 0 AND runs = 0 AND was_out) AS ducks, {_n('sum(fours)')} AS fours, {_n('sum(sixes)')} AS sixes,
    count(bowl_at) AS bowl_innings, {_n('sum(bowl_balls)')} AS balls_bowled, {_n('sum(conceded)')} AS runs_conceded,
    {_n('sum(wickets)')} AS wickets, max(CASE WHEN bowl_at IS NOT NULL THEN wickets * 100000 + 99999 - conceded END) AS figures,
    count_if(wickets >= 5) AS five_wickets
  FROM lines WHERE strikes > 0 OR bowl_at IS NOT NULL GROUP BY ALL),
career_rows AS (
  SELECT player_id, match_class, matches, bat_innings, runs, balls_faced, not_outs, {_n('coalesce(high // 2, 0)')} AS high_score,
    coalesce(high % 2 = 1, false) AS high_score_not_out, fifties, hundreds, ducks, fours, sixes,
    {_r2('runs', 'bat_innings - not_outs', 'bat_innings > not_outs')} AS batting_avg,
    {_r2('runs * 100', 'balls_faced', 'balls_faced > 0')} AS strike_rate, bowl_innings, balls_bowled, runs_conceded, wickets,
    {_n('coalesce(figures // 100000, 0)')} AS best_bowling_wkts, {_n('coalesce(99999 - figures % 100000, 0)')} AS best_bowling_runs, five_wickets,
    {_r2('runs_conceded', 'balls_bowled / 6.0', 'balls_bowled > 0')} AS economy,
    {_r2('runs_conceded', 'wickets', 'wickets > 0')} AS bowling_avg, {_r2('balls_bowled', 'wickets', 'wickets > 0')} AS bowling_sr
  FROM folded)"""

PLAYERS = f"""
career_players AS (
  SELECT l.player_id, coalesce(any_value(p.name), l.player_id) AS name, any_value(p.external_id) AS external_id, min(l.gender) AS gender,
    {_n('count(DISTINCT l.match_id)')} AS career_matches, {_n('sum(l.runs)')} AS career_runs, {_n('sum(l.wickets)')} AS career_wickets
  FROM lines l LEFT JOIN players p ON p.player_id = l.player_id
  WHERE l.strikes > 0 OR l.bowl_at IS NOT NULL GROUP BY l.player_id)"""

EDITIONS = f"""
bt AS (
  SELECT event_name, season, coalesce(player_id, 'name:' || name) AS player, {_n('sum(runs)')} AS runs,
    {_n('sum(balls)')} AS balls, {_n('sum(fours)')} AS fours, {_n('sum(sixes)')} AS sixes
  FROM bat_lines JOIN matches USING (match_id) GROUP BY ALL),
wt AS (
  SELECT event_name, season, coalesce(player_id, 'name:' || name) AS player, {_n('sum(balls)')} AS balls,
    {_n('sum(runs)')} AS runs, {_n('sum(wickets)')} AS wickets
  FROM bowl_lines JOIN matches USING (match_id) GROUP BY ALL),
limited AS (
  SELECT event_name, season, arg_min(match_class, match_id) IN ('ODI','T20I','LIST_A','T20','T10','HUNDRED') AS lo
  FROM matches GROUP BY ALL)"""


def _with(*parts: str) -> str:
    return ",".join([VIEWS, *parts])


def _leaders(source: str, order: str, columns: str, k: int = 10) -> str:
    return f"""
SELECT event_name, season, place, {columns} FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY event_name, season ORDER BY {order}) AS INTEGER) AS place FROM ({source}))
WHERE place <= {k}"""


def _rated(table: str, rate: str, limited: int, longer: int) -> str:
    return f"""SELECT t.*, {rate} AS rate FROM {table} t JOIN limited l
  ON t.event_name IS NOT DISTINCT FROM l.event_name AND t.season IS NOT DISTINCT FROM l.season
  WHERE t.balls >= CASE WHEN lo THEN {limited} ELSE {longer} END"""


CARDS = _with(LINES, BATTING, BOWLING, EDITIONS)
CLASS = """CASE WHEN t = 'Test' THEN CASE WHEN team_type = 'international' THEN 'TEST' ELSE 'FIRST_CLASS' END
  WHEN t = 'MDM' THEN 'FIRST_CLASS' WHEN t = 'ODI' THEN CASE WHEN team_type = 'international' THEN 'ODI' ELSE 'LIST_A' END
  WHEN t = 'ODM' THEN 'LIST_A' WHEN t = 'T20' THEN CASE WHEN team_type = 'international' THEN 'T20I' ELSE 'T20' END
  WHEN t = 'IT20' THEN 'T20I' WHEN t = 'T10' THEN 'T10' WHEN t = 'The Hundred' THEN 'HUNDRED' ELSE 'OTHER' END"""

SQL: dict[str, str] = {
    "over_rollup": _with(OVERS) + "SELECT * FROM per_over",
    "over_cumulative": _with(OVERS) + "SELECT * FROM cum",
    "overs_json": _with(OVERS)
    + "SELECT match_id, innings_no, CAST(to_json(list(struct_pack(o := over_no, r := r, w := w, f := f, s := s, c := c)"
    " ORDER BY over_no)) AS VARCHAR) AS overs FROM cum GROUP BY match_id, innings_no",
    "innings_totals": _with(INNINGS) + "SELECT * FROM innings_sums",
    "innings_score_text": _with(INNINGS) + "SELECT * FROM score",
    "match_summary": _with(INNINGS)
    + "SELECT m.*, a.score AS inn1_score, b.score AS inn2_score FROM matches m"
    " LEFT JOIN score a ON a.match_id = m.match_id AND a.innings_no = 1"
    " LEFT JOIN score b ON b.match_id = m.match_id AND b.innings_no = 2",
    "batting_order": _with(LINES, BATTING) + "SELECT match_id, innings_no, player_id, name, batting_pos AS pos FROM bat_lines",
    "batting_card": _with(LINES, BATTING) + "SELECT * FROM bat_lines",
    "dismissals": _with(LINES) + "SELECT match_id, innings_no, player_id, dismissal FROM lines WHERE was_out",
    "bowling_card": _with(LINES, BOWLING) + "SELECT * FROM bowl_lines",
    "maiden_overs": _with(LINES, BOWLING) + "SELECT match_id, innings_no, player_id, maidens FROM bowl_lines",
    "career_stats": _with(LINES, CAREERS) + "SELECT * FROM career_rows",
    "career_totals": _with(LINES, CAREERS)
    + f"SELECT player_id, {_n('sum(matches)')} AS matches, {_n('sum(runs)')} AS runs, {_n('sum(wickets)')} AS wickets"
    " FROM career_rows GROUP BY player_id",
    "career_players": _with(LINES, PLAYERS) + "SELECT * FROM career_players",
    "career_coverage": _with(LINES)
    + f"""SELECT player_id, match_class, min(match_date) AS first_match_date, max(match_date) AS last_match_date,
  {_n('count(DISTINCT match_id)')} AS matches_covered, 'BALL_BY_BALL' AS source,
  'Open ball-by-ball coverage only; not an official complete career total.' AS coverage_note
FROM lines WHERE strikes > 0 OR bowl_at IS NOT NULL GROUP BY player_id, match_class""",
    "chase_features": VIEWS
    + """, played AS (
  SELECT b.match_id, innings_no, CASE match_class WHEN 'T20I' THEN 120 ELSE 300 END AS max_balls, outcome_winner = batting_team AS ahead,
    sum(runs_total) FILTER (WHERE innings_no = 1) OVER (PARTITION BY b.match_id) AS set_runs,
    list(struct_pack(r := runs_total, w := is_wicket)) OVER (PARTITION BY b.match_id, innings_no ORDER BY over_no, ball_in_over) AS so_far
  FROM deliveries b JOIN (SELECT match_id, outcome_winner FROM matches WHERE outcome_winner IS NOT NULL) USING (match_id)
  WHERE match_class IN ('ODI', 'T20I') AND batter_id IS NOT NULL),
states AS (
  SELECT match_id, max_balls, ahead, len(so_far) AS ball, list_sum(list_transform(so_far, lambda x: x.r)) AS runs,
    len(list_filter(so_far, lambda x: x.w)) AS wkts, set_runs FROM played WHERE innings_no = 2 AND set_runs > 0)
SELECT match_id, max_balls, CAST(ball AS INTEGER) AS ball, CAST(runs AS BIGINT) AS runs, CAST(wkts AS BIGINT) AS wkts,
  CAST(10 - wkts AS BIGINT) AS wickets_in_hand, CAST(set_runs - runs + 1 AS BIGINT) AS runs_needed, CAST(max_balls - ball AS INTEGER) AS balls_left,
  CAST(max_balls = 120 AS INTEGER) AS is_t20, CAST(ahead AS INTEGER) AS won,
  CAST(set_runs - runs + 1 AS DOUBLE) / (greatest(max_balls - ball, 1) / CAST(6 AS DOUBLE)) AS req_run_rate
FROM states""",
    "standings_nrr": _with(INNINGS)
    + """, q AS (
  SELECT *, CASE WHEN match_class IN ('ODI','LIST_A') THEN 300 WHEN match_class IN ('T20','T20I') THEN 120
    WHEN match_class = 'HUNDRED' THEN 100 WHEN match_class = 'T10' THEN 60 ELSE 0 END AS quota FROM matches),
firsts AS (
  SELECT match_id, batting_team, runs, wickets, balls FROM innings_sums
  QUALIFY row_number() OVER (PARTITION BY match_id, batting_team ORDER BY innings_no) = 1),
both_sides AS (
  SELECT event_name, season, match_id, quota, team_home AS team, team_away AS opp, outcome_winner FROM q
  UNION ALL
  SELECT event_name, season, match_id, quota, team_away, team_home, outcome_winner FROM q),
joined AS (
  SELECT s.*, a.runs AS r1, b.runs AS r2, CASE WHEN quota > 0 AND a.wickets >= 10 THEN quota ELSE a.balls END AS b1,
    CASE WHEN quota > 0 AND b.wickets >= 10 THEN quota ELSE b.balls END AS b2,
    a.runs IS NOT NULL AND b.runs IS NOT NULL AS ok
  FROM both_sides s LEFT JOIN firsts a ON a.match_id = s.match_id AND a.batting_team = s.team
  LEFT JOIN firsts b ON b.match_id = s.match_id AND b.batting_team = s.opp),
sums AS (
  SELECT event_name, season, team, count(*) AS played, count(*) FILTER (WHERE outcome_winner = team) AS won,
    count(*) FILTER (WHERE outcome_winner = opp) AS lost,
    count(*) FILTER (WHERE outcome_winner IS NULL OR (outcome_winner <> team AND outcome_winner <> opp)) AS no_result,
    coalesce(sum(r1) FILTER (WHERE ok), 0) AS rf, coalesce(sum(b1) FILTER (WHERE ok), 0) AS bf,
    coalesce(sum(r2) FILTER (WHERE ok), 0) AS ra, coalesce(sum(b2) FILTER (WHERE ok), 0) AS ba
  FROM joined GROUP BY ALL),
rated AS (
  SELECT *, 2 * won + no_result AS points,
    CASE WHEN bf > 0 THEN CAST(rf AS DOUBLE) / (CAST(bf AS DOUBLE) / 6.0) ELSE 0 END
      - CASE WHEN ba > 0 THEN CAST(ra AS DOUBLE) / (CAST(ba AS DOUBLE) / 6.0) ELSE 0 END AS nrr FROM sums)
SELECT event_name, season, team, played, won, lost, no_result, CAST(points AS BIGINT) AS points, nrr,
  CAST(row_number() OVER (PARTITION BY event_name, season ORDER BY points DESC, nrr DESC, team) AS INTEGER) AS place
FROM rated""",
    "edition_meta": VIEWS
    + """, c AS (SELECT event_name, season, match_class, count(*) AS n FROM matches GROUP BY ALL),
top AS (
  SELECT event_name, season, match_class FROM c
  QUALIFY row_number() OVER (PARTITION BY event_name, season ORDER BY n DESC, match_class) = 1)
SELECT m.event_name, m.season, count(*) AS matches, min(match_date) AS first_date, max(match_date) AS last_date,
  any_value(top.match_class) AS main_class
FROM matches m JOIN top ON top.event_name IS NOT DISTINCT FROM m.event_name AND top.season IS NOT DISTINCT FROM m.season
GROUP BY m.event_name, m.season""",
    "edition_venues": VIEWS + "SELECT event_name, season, venue, city, count(*) AS matches FROM matches WHERE venue IS NOT NULL GROUP BY ALL",
    "competitions_nested": VIEWS
    + f""", s AS (SELECT event_name, season, count(*) AS n FROM matches WHERE event_name IS NOT NULL GROUP BY ALL)
SELECT event_name, {_n('sum(n)')} AS total, max(season) AS latest,
  string_agg(coalesce(season, '-') || ':' || n, ',' ORDER BY season DESC NULLS LAST) AS seasons FROM s GROUP BY event_name""",
    "edition_most_runs": CARDS + _leaders("SELECT * FROM bt WHERE runs > 0", "runs DESC, player", "player, runs"),
    "edition_sixes": CARDS + _leaders("SELECT * FROM bt WHERE sixes > 0", "sixes DESC, player", "player, sixes"),
    "edition_fours": CARDS + _leaders("SELECT * FROM bt WHERE fours > 0", "fours DESC, player", "player, fours"),
    "edition_highest_scores": CARDS
    + _leaders(
        "SELECT event_name, season, match_id, innings_no, runs, balls, runs || CASE WHEN out THEN '' ELSE '*' END AS score,"
        " coalesce(player_id, 'name:' || name) AS player FROM bat_lines JOIN matches USING (match_id)",
        "runs DESC, match_id, innings_no, player",
        "player, score, balls",
    ),
    "edition_strike_rate": CARDS
    + _leaders(_rated("bt", "CAST(t.runs AS DOUBLE) / t.balls * 100", 30, 120), "rate DESC, player", "player, rate"),
    "edition_wickets": CARDS + _leaders("SELECT * FROM wt WHERE wickets > 0", "wickets DESC, runs, player", "player, wickets, runs"),
    "edition_economy": CARDS
    + _leaders(_rated("wt", "CAST(t.runs AS DOUBLE) / (CAST(t.balls AS DOUBLE) / 6.0)", 60, 240), "rate, player", "player, rate"),
    "edition_squads": _with(INNINGS, LINES_ON, BATTING, BOWLING)
    + f""", who AS (
  SELECT match_id, innings_no, batting_team AS team, coalesce(player_id, 'name:' || name) AS player, b.runs, 0 AS wickets
  FROM bat_lines b JOIN (SELECT match_id, innings_no, batting_team FROM innings_sums) USING (match_id, innings_no)
  UNION ALL
  SELECT match_id, innings_no, CASE WHEN batting_team = team_home THEN team_away ELSE team_home END,
    coalesce(player_id, 'name:' || name), 0, b.wickets
  FROM bowl_lines b JOIN (SELECT match_id, innings_no, batting_team FROM innings_sums) USING (match_id, innings_no) JOIN matches USING (match_id))
SELECT event_name, season, team, player, count(DISTINCT match_id) AS appearances, {_n('sum(who.runs)')} AS runs,
  {_n('sum(who.wickets)')} AS wickets FROM who JOIN matches USING (match_id) WHERE team IS NOT NULL GROUP BY ALL""",
    "team_squad": _with(INNINGS, LINES_ON, BATTING)
    + f""", t AS (
  SELECT batting_team AS team, player_id, name, count(*) AS innings, {_n('sum(b.runs)')} AS runs
  FROM bat_lines b JOIN (SELECT match_id, innings_no, batting_team FROM innings_sums) USING (match_id, innings_no) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY team ORDER BY innings DESC, runs DESC, player_id) AS INTEGER) AS place
FROM t QUALIFY place <= 30""",
    "team_record": VIEWS
    + """, s AS (SELECT team_home AS team, outcome_winner FROM matches UNION ALL SELECT team_away, outcome_winner FROM matches)
SELECT team, count(*) AS played, count(*) FILTER (WHERE outcome_winner = team) AS won,
  count(*) FILTER (WHERE outcome_winner <> team) AS lost, count(*) FILTER (WHERE outcome_winner IS NULL) AS no_result,
  round(count(*) FILTER (WHERE outcome_winner = team) * CAST(1000 AS DOUBLE) / count(*)) / 10 AS win_pct FROM s GROUP BY team""",
    "team_counts": VIEWS
    + """, s AS (SELECT lower(team_home) AS team FROM matches UNION ALL SELECT lower(team_away) FROM matches)
SELECT team, count(*) AS matches FROM s GROUP BY team""",
    "match_search_page": VIEWS
    + """, hit AS (
  SELECT *, row_number() OVER (ORDER BY match_date DESC NULLS FIRST, match_id) AS rn, count(*) OVER () AS n FROM matches
  WHERE match_class = 'ODI' AND (event_name ILIKE '%league 1%' OR venue ILIKE '%league 1%' OR team_home ILIKE '%league 1%'
    OR team_away ILIKE '%league 1%'))
SELECT match_id, match_date FROM hit WHERE (rn - 1) // 5 = least(1, greatest((n + 4) // 5 - 1, 0))""",
    "team_matches_page": VIEWS
    + """, hit AS (
  SELECT *, row_number() OVER (ORDER BY match_date DESC NULLS FIRST, match_id) AS rn, count(*) OVER () AS n FROM matches
  WHERE team_home = 'T3' OR team_away = 'T3')
SELECT match_id, match_date FROM hit WHERE (rn - 1) // 7 = (n - 1) // 7""",
    "player_page": _with(LINES, PLAYERS)
    + """, hit AS (
  SELECT *, row_number() OVER (ORDER BY career_runs DESC, player_id) AS rn, count(*) OVER () AS n FROM career_players)
SELECT * EXCLUDE (rn, n) FROM hit WHERE (rn - 1) // 36 = least(1, (n - 1) // 36)""",
    **{
        f"format_leaders_{x}": _with(LINES, CAREERS)
        + f"SELECT match_class, CAST(row_number() OVER (PARTITION BY match_class ORDER BY {x} DESC, player_id) AS INTEGER) AS place,"
        f" player_id, {x} FROM career_rows WHERE {x} > 0 QUALIFY place <= 10"
        for x in ("runs", "wickets")
    },
    "match_class_rules": f"""
WITH p AS (
  SELECT p_partkey, (['Test','MDM','ODI','ODM','T20','IT20','T10','The Hundred','x'])[p_partkey % 9 + 1] AS t,
    (['international','club',NULL])[p_size % 3 + 1] AS team_type FROM part),
c AS (SELECT p_partkey, t, {CLASS} AS match_class FROM p)
SELECT p_partkey, match_class,
  CASE WHEN t = 'T20' THEN 'T20' WHEN t = 'ODI' THEN 'ODI' WHEN t = 'Test' THEN 'TEST' WHEN t = 'T10' THEN 'T10'
    WHEN t = 'The Hundred' THEN 'HUNDRED' ELSE 'OTHER' END AS page_format,
  CASE WHEN t IN ('T20','IT20') THEN 'T20' WHEN t IN ('ODI','ODM') THEN 'ODI' WHEN t IN ('Test','MDM') THEN 'TEST'
    WHEN t = 'The Hundred' THEN 'HUNDRED' ELSE 'OTHER' END AS archive_format,
  CASE match_class WHEN 'TEST' THEN 'Tests' WHEN 'ODI' THEN 'ODIs' WHEN 'T20I' THEN 'T20Is' WHEN 'FIRST_CLASS' THEN 'First-class'
    WHEN 'LIST_A' THEN 'List A' WHEN 'T20' THEN 'T20s' WHEN 'T10' THEN 'T10' WHEN 'HUNDRED' THEN 'The Hundred' ELSE 'Other' END AS label,
  CAST(list_position(['TEST','ODI','T20I','FIRST_CLASS','LIST_A','T20','T10','HUNDRED','OTHER'], match_class) - 1 AS INTEGER) AS rank,
  CASE match_class WHEN 'ODI' THEN 300 WHEN 'LIST_A' THEN 300 WHEN 'T20' THEN 120 WHEN 'T20I' THEN 120 WHEN 'HUNDRED' THEN 100
    WHEN 'T10' THEN 60 ELSE 0 END AS quota,
  match_class IN ('TEST','ODI','T20I') AS international,
  match_class IN ('ODI','T20I','LIST_A','T20','T10','HUNDRED') AS limited_overs
FROM c""",
    "dismissal_rules": """
WITH p AS (
  SELECT p_partkey, (['not out','run out (x)','st A b B','lbw b C','c & b D','c E b F','hit wicket','b G','retired hurt','','?'])
    [p_partkey % 11 + 1] AS t, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS o FROM part)
SELECT p_partkey,
  CASE WHEN o IS NOT DISTINCT FROM false THEN 'NOT_OUT' WHEN t = '' AND o THEN 'OTHER' WHEN t = '' THEN 'NOT_OUT'
    WHEN t = 'not out' THEN 'NOT_OUT' WHEN t = 'run out (x)' THEN 'RUN_OUT' WHEN t = 'st A b B' THEN 'STUMPED'
    WHEN t = 'lbw b C' THEN 'LBW' WHEN t = 'c & b D' THEN 'CAUGHT_AND_BOWLED' WHEN t = 'c E b F' THEN 'CAUGHT'
    WHEN t = 'hit wicket' THEN 'HIT_WICKET' WHEN t = 'b G' THEN 'BOWLED' WHEN t = 'retired hurt' THEN 'RETIRED_OUT'
    ELSE 'OTHER' END AS kind,
  CASE t WHEN 'hit wicket' THEN 'HIT_WICKET' WHEN 'retired hurt' THEN 'RETIRED_OUT' ELSE 'OTHER' END AS token_kind
FROM p""",
    "name_normalise": r"""
SELECT p_partkey, regexp_replace(trim(lower('  ' || p_name || '   X ')), '\s+', ' ', 'g') AS name,
  regexp_replace(upper(p_type), '[^A-Z0-9]', '', 'g') AS token,
  upper(array_to_string(list_transform(list_filter(string_split(lower(trim(regexp_replace(p_name, '[^A-Za-z0-9 ]', ' ', 'g'))), ' '),
    lambda w: length(w) > 1 AND w NOT IN ('the','of','and')), lambda w: w[1]), '')) AS acronym FROM part""",
    "skip_known": """
SELECT o_orderkey, o_orderkey % 4 + 1 AS revision FROM orders
WHERE o_orderkey % 3 <> 0 OR o_orderkey % 4 + 1 > o_orderkey % 5""",
    "revision_latest": "SELECT user_id, max(event_id) AS revision, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "identity_crosswalk": """
WITH e AS (SELECT DISTINCT user_id AS u FROM events),
r AS (
  SELECT u, CASE WHEN u % 5 <> 0 THEN 'u' || u END AS player_id, ' User  ' || u AS name,
    CASE WHEN u % 2 = 0 THEN 'x' || u END AS other_id FROM e),
k AS (SELECT *, coalesce(player_id, 'name:user ' || u) AS key FROM r)
SELECT key, player_id, name, other_id,
  CASE WHEN u % 5 <> 0 AND u % 3 = 0 THEN 'own' || u WHEN u % 4 = 0 THEN 'oth' || u ELSE left(sha1(key), 16) END AS canonical_id,
  CASE WHEN u % 5 <> 0 AND u % 3 = 0 THEN 'own' WHEN u % 4 = 0 THEN 'other' ELSE 'new' END AS how FROM k""",
    "never_degrade_merge": """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 4 = 0 THEN 'N' WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""",
    "class_backfill": """
WITH m AS (
  SELECT o_orderkey, (['TEST','ODI','T20','T10','OTHER'])[o_orderkey % 5 + 1] AS f, o_orderkey % 3 = 0 AS typed,
    o_orderkey % 2 = 0 AS intl, o_orderkey % 7 < 4 AND (o_orderkey + 1) % 7 < 4 AS nat FROM orders)
SELECT o_orderkey, CASE WHEN typed THEN CASE WHEN intl THEN 'ODI' ELSE 'LIST_A' END
  WHEN f = 'TEST' THEN CASE WHEN nat THEN 'TEST' ELSE 'FIRST_CLASS' END
  WHEN f = 'ODI' THEN CASE WHEN nat THEN 'ODI' ELSE 'LIST_A' END
  WHEN f = 'T20' THEN CASE WHEN nat THEN 'T20I' ELSE 'T20' END ELSE f END AS match_class FROM m""",
    "json_path_fallback": "SELECT event_id, coalesce(props->>'$.a.b', props->>'$.key', props->>'$.k') AS value FROM events",
    "html_title_extract": r"""
SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'),
  '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '') AS title FROM pages""",
    "snapshot_latest": """
WITH n AS (
  SELECT event_type AS page_type, sha1('/u/' || user_id) AS key, max(ts) AS newest, arg_max(event_id || ':' || props, ts) AS payload
  FROM events GROUP BY ALL)
SELECT page_type, key, payload FROM n WHERE epoch((SELECT max(ts) FROM events)) - epoch(newest) <= 21600""",
    "count_by_class": VIEWS + "SELECT match_class, count(*) AS n FROM deliveries GROUP BY match_class",
    "distinct_union": VIEWS
    + "SELECT batter_id AS player_id, match_id, match_class FROM deliveries UNION SELECT bowler_id, match_id, match_class FROM deliveries",
    "null_safe_filter": VIEWS + "SELECT extra_type, count(*) AS n FROM deliveries WHERE extra_type IS DISTINCT FROM 'wides' GROUP BY extra_type",
    "edition_null_season": VIEWS + "SELECT match_id, match_date FROM matches WHERE event_name = 'League 2' AND season IS NULL",
    "semi_edition": _with(INNINGS)
    + "SELECT * FROM innings_sums WHERE match_id IN (SELECT match_id FROM matches WHERE event_name = 'League 3')",
    "anti_missing": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
}
