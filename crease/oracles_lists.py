"""DuckDB SQL of the queries of registry_lists."""

from __future__ import annotations

from crease.oracles import BATTING, BOWLING, CAREERS, FLAGS, INNINGS, LINES, LINES_ON, OVERS, PLAYERS, SQL, VIEWS, _n, _with
from crease.sources import shape
from crease.sources.teams import NATIONAL_TEAMS


def _fixed(x: str, places: int) -> str:
    """A number with so many decimals; an exact tie goes away from zero."""
    twice = f"(abs({x}) * 2e0 * 1e{places})"
    return (
        f"CASE WHEN {twice} = floor({twice}) AND {twice} % 2 = 1 THEN format('{{:.{places}f}}', sign({x}) * (floor(abs({x}) * 1e{places}) + 1) / 1e{places})"
        f" ELSE format('{{:.{places}f}}', {x}) END"
    )


X = "(CAST((p_partkey - 1000) * p_size AS DOUBLE) / 64e0)"
WIN = "(CAST(p_size % 7 AS DOUBLE) / nullif(p_size % 5 + p_size % 7, 0) * 100)"

#: Kinds of dismissal by the word of the documents.
TOKEN = """CASE dismissal_kind WHEN 'bowled' THEN 'BOWLED' WHEN 'caught' THEN 'CAUGHT' WHEN 'run out' THEN 'RUN_OUT' WHEN 'lbw' THEN 'LBW'
  WHEN 'stumped' THEN 'STUMPED' WHEN 'caught and bowled' THEN 'CAUGHT_AND_BOWLED' WHEN 'hit wicket' THEN 'HIT_WICKET' END"""

#: Performance lines: what a player does on strike and when leaving, numbered by ball.
PERFORMANCES = f"""
events_of AS (
  SELECT match_id, innings_no, match_class, match_date, batter_id AS player_id, over_no * 10000 + ball_in_over * 10 AS moment, runs_batter AS r,
    faced AS f, NULL AS gone FROM flagged
  UNION ALL
  SELECT match_id, innings_no, match_class, match_date, player_out_id, over_no * 10000 + ball_in_over * 10 + 1, NULL, NULL, {TOKEN}
  FROM flagged WHERE is_wicket),
bat_perf AS (
  SELECT match_id, innings_no, player_id, min(match_class) AS match_class, min(match_date) AS match_date,
    CAST(row_number() OVER (PARTITION BY match_id, innings_no ORDER BY min(moment)) AS INTEGER) AS batting_pos,
    {_n('coalesce(sum(r), 0)')} AS runs, {_n('count(*) FILTER (WHERE f)')} AS balls, {_n('count(*) FILTER (WHERE r = 4)')} AS fours,
    {_n('count(*) FILTER (WHERE r = 6)')} AS sixes, coalesce(arg_max(gone, moment), 'NOT_OUT') AS dismissal
  FROM events_of GROUP BY match_id, innings_no, player_id),
bowl_perf AS (
  SELECT match_id, innings_no, player_id, any_value(match_class) AS match_class, any_value(match_date) AS match_date, {_n('sum(b)')} AS balls,
    {_n('count(*) FILTER (WHERE r = 0)')} AS maidens, {_n('sum(r)')} AS runs, {_n('sum(w)')} AS wickets
  FROM (SELECT match_id, innings_no, bowler_id AS player_id, over_no, min(match_class) AS match_class, min(match_date) AS match_date,
      count(*) FILTER (WHERE legal) AS b, sum(charged) AS r, count(*) FILTER (WHERE credited) AS w FROM flagged GROUP BY ALL)
  GROUP BY ALL)"""
PERFORM = _with(FLAGS, PERFORMANCES)


def _bat_fold(key: str) -> str:
    return f"""SELECT {key}, count(*) AS innings, count(*) FILTER (WHERE dismissal = 'NOT_OUT') AS not_outs, {_n('sum(runs)')} AS runs, {_n('sum(balls)')} AS balls,
  count(*) FILTER (WHERE runs BETWEEN 50 AND 99) AS fifties, count(*) FILTER (WHERE runs > 99) AS hundreds,
  count(*) FILTER (WHERE runs = 0 AND dismissal <> 'NOT_OUT') AS zeros, {_n('sum(fours)')} AS fours, {_n('sum(sixes)')} AS sixes,
  CAST(sum(runs) AS DOUBLE) / nullif(count(*) FILTER (WHERE dismissal <> 'NOT_OUT'), 0) AS average,
  CAST(sum(runs) AS DOUBLE) / nullif(sum(balls), 0) * 100 AS strike_rate,
  max(runs) || CASE WHEN max(runs * 2 + CASE WHEN dismissal = 'NOT_OUT' THEN 1 ELSE 0 END) % 2 = 1 THEN '*' ELSE '' END AS high_score
FROM bat_perf GROUP BY {key}"""


def _bowl_fold(key: str) -> str:
    return f"""SELECT {key}, count(*) AS innings, {_n('sum(wickets)')} AS wickets, {_n('sum(runs)')} AS runs, {_n('sum(balls)')} AS balls,
  count(*) FILTER (WHERE wickets >= 5) AS five_wickets, CAST(sum(runs) AS DOUBLE) / (nullif(sum(balls), 0) / 6e0) AS economy,
  CAST(sum(runs) AS DOUBLE) / nullif(sum(wickets), 0) AS average, CAST(sum(balls) AS DOUBLE) / nullif(sum(wickets), 0) AS strike_rate,
  max(wickets * 100000 + 99999 - runs) // 100000 || '/' || 99999 - max(wickets * 100000 + 99999 - runs) % 100000 AS best
FROM bowl_perf GROUP BY {key}"""


ZERO = ["innings", "not_outs", "runs", "balls", "fifties", "hundreds", "zeros", "fours", "sixes"]
CLASS_RANK = "CAST(list_position(['TEST','ODI','T20I','FIRST_CLASS','LIST_A','T20','T10','HUNDRED','OTHER'], match_class) - 1 AS INTEGER)"

REASONS = "[" + ", ".join("''" if r.how == "maybe" else f"'{r.reason}'" for r in shape.rules()) + ", '']"
SIDES = ", ".join(f"('{side}', {'NULL' if iso is None else repr(iso)}, '{country}', '{color}')" for side, iso, country, color in NATIONAL_TEAMS)
NAMES = "[" + ", ".join(f"' {side.upper().replace(' ', '  ')}'" for side, *_ in NATIONAL_TEAMS[:18]) + "]"
TEAMS = f"""
WITH named AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey < 18 THEN {NAMES}[n_nationkey + 1] ELSE n_name END AS name FROM nation),
sides(side, iso, country, color) AS (VALUES {SIDES}),
counted AS (
  SELECT regexp_replace(lower(trim(name)), ' +', ' ', 'g') AS id, min(name) AS display_name, count(*) AS match_count
  FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN named USING (k) GROUP BY 1),
profiles AS (
  SELECT id, display_name, country, country IS NOT NULL AS is_national, 'https://flags.example/w320/' || iso || '.png' AS flag_url,
    CASE id WHEN 'nation_20' THEN 'logo-a' WHEN 'nation_22' THEN 'logo-b' END AS logo_url, color AS primary_color, match_count,
    coalesce(CASE id WHEN 'nation_20' THEN 'logo-a' WHEN 'nation_22' THEN 'logo-b' END, 'https://flags.example/w320/' || iso || '.png') AS image,
    CASE WHEN country IS NULL THEN 'League / Domestic' ELSE 'International' END AS kind_label
  FROM counted LEFT JOIN sides ON side = id)
"""

FIXTURES = """
WITH m AS (
  SELECT o_custkey AS page_id, o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr, o_custkey AS c FROM orders WHERE o_custkey % 10 <> 0),
f AS (
  SELECT page_id, CAST(k AS VARCHAR) AS match_id, CASE WHEN k % 9 <> 0 THEN 'm' || k END AS slug, 'Match ' || k AS title,
    CASE k % 3 WHEN 0 THEN 'T20' WHEN 1 THEN 'ODI' ELSE 'OTHER' END AS format,
    CASE WHEN k % 5 = 0 THEN 'ABANDONED' WHEN k % 4 = 0 THEN 'LIVE' WHEN k % 4 = 1 THEN 'COMPLETED' ELSE 'SCHEDULED' END AS state,
    CASE WHEN k % 7 = 0 THEN pr ELSE st END AS status_text, CASE k % 3 WHEN 1 THEN 'BAT' WHEN 2 THEN 'FIELD' END AS toss_decision,
    CASE WHEN k % 6 IN (0, 2) THEN true WHEN k % 6 = 1 THEN false END AS day_night, 'cup' AS series_slug,
    CASE WHEN k % 8 <> 0 THEN CAST(c AS VARCHAR) END AS series_id, k % 11 <> 0 AND k % 2 = 0 AS has_scorecard
  FROM m)
"""

ELO = """, played AS (
  SELECT match_class, team_home AS h, team_away AS a, outcome_winner AS w,
    row_number() OVER (PARTITION BY match_class ORDER BY coalesce(match_date, ''), match_id) AS n FROM matches WHERE team_home <> team_away),
replay AS (
  SELECT match_class, 0 AS n, CAST(MAP {} AS MAP(VARCHAR, DOUBLE)) AS r FROM (SELECT DISTINCT match_class FROM played)
  UNION ALL
  SELECT match_class, n, map_from_entries(list_concat(list_filter(map_entries(r), lambda e: e.key <> h AND e.key <> a),
    [struct_pack(key := h, value := rh + 32 * (s - 1 / (1 + pow(10e0, (ra - rh) / 400e0)))),
     struct_pack(key := a, value := ra - 32 * (s - 1 / (1 + pow(10e0, (ra - rh) / 400e0))))]))
  FROM (
    SELECT p.match_class, p.n, x.r, h, a, coalesce(x.r[h], 1500e0) AS rh, coalesce(x.r[a], 1500e0) AS ra,
      CASE WHEN w = h THEN 1e0 WHEN w = a THEN 0e0 ELSE 0.5e0 END AS s
    FROM replay x JOIN played p ON p.match_class = x.match_class AND p.n = x.n + 1)),
last AS (SELECT match_class, arg_max(r, n) AS r FROM replay GROUP BY match_class),
rated AS (SELECT match_class, e.key AS team, CAST(floor(e.value + 0.5) AS BIGINT) AS rating FROM (SELECT match_class, unnest(map_entries(r)) AS e FROM last)),
tally AS (
  SELECT match_class, team, count(*) AS played, count(*) FILTER (WHERE w = team) AS won, count(*) FILTER (WHERE w = other) AS lost
  FROM (SELECT match_class, h AS team, a AS other, w FROM played UNION ALL SELECT match_class, a, h, w FROM played) GROUP BY ALL)
"""
ELO_VIEWS = VIEWS.replace("WITH items", "WITH RECURSIVE items", 1)

ORACLES: dict[str, str] = {
    "number_texts": f"""
SELECT p_partkey, {_fixed(X, 1)} AS one, {_fixed(X, 2)} AS two, CASE WHEN {X} > 0 THEN '+' ELSE '' END || {_fixed(X, 3)} AS rate,
  format('{{:,}}', p_partkey * 12345) AS grouped, CASE WHEN p_size % 5 + p_size % 7 > 0 THEN {_fixed(WIN, 1)} ELSE '—' END AS win,
  CASE WHEN p_size % 3 > 0 THEN p_size || '/' || p_partkey ELSE '—' END AS figures,
  CASE WHEN p_size % 3 > 0 THEN p_size || CASE WHEN p_partkey % 2 = 0 THEN '*' ELSE '' END ELSE '—' END AS high,
  CASE WHEN p_size % 4 <> 0 THEN -1e0 ELSE CAST(p_size AS DOUBLE) END AS number,
  CASE WHEN p_size % 4 <> 1 THEN CAST(p_size AS DOUBLE) END AS maybe, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS VARCHAR) END AS any_text
FROM part""",
    "scalar_texts": r"""
WITH w AS (
  SELECT *, p_partkey AS k, list_filter(string_split(lower(trim(regexp_replace(p_name, '[^A-Za-z0-9 ]', ' ', 'g'))), ' '), lambda x: length(x) > 1) AS words,
    p_name || CASE p_partkey % 3 WHEN 0 THEN '_logo.svg' WHEN 1 THEN '.png' ELSE ' stadium.png' END AS file FROM part),
l AS (
  SELECT *, upper(array_to_string(list_transform(list_filter(words, lambda x: x NOT IN ('the', 'of', 'and')), lambda x: x[1]), '')) AS short FROM w),
s AS (
  SELECT *, CASE WHEN k % 3 = 2 THEN -100 ELSE CASE WHEN k % 3 = 0 THEN 5 ELSE 1 END + len(list_filter(words, lambda x: contains(lower(file), x)))
    + CASE WHEN length(short) > 1 AND starts_with(upper(regexp_replace(regexp_replace(file, '\.[a-z]+$', '', 'i'), '[^A-Za-z0-9]', '', 'g')), short) THEN 3 ELSE 0 END END AS points,
    1 + len(list_filter(words, lambda x: contains(lower(p_name || '.png'), x)))
    + CASE WHEN length(short) > 1 AND starts_with(upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')), short) THEN 3 ELSE 0 END AS png_points,
    5 + len(list_filter(words, lambda x: contains('a_logo.svg', x))) + CASE WHEN length(short) > 1 AND starts_with('ALOGO', short) THEN 3 ELSE 0 END AS svg_points FROM l)
SELECT p_partkey, CASE k % 3 WHEN 0 THEN 'http://a/' || p_brand WHEN 1 THEN 'https://img.example/b/' || p_brand END AS image,
  'My File+' || k || '.png' AS file, 'Q' || k AS entity, CASE WHEN k % 5 IN (0, 1) THEN true WHEN k % 5 = 2 THEN false END AS day_night,
  CASE WHEN k % 4 = 0 THEN 'logo' WHEN k % 3 = 0 THEN 'flag' END AS crest,
  CASE WHEN k % 2 = 0 THEN 'International' ELSE 'League / Domestic' END AS kind,
  CASE k % 3 WHEN 0 THEN 'Men''s cricket' WHEN 1 THEN 'Women''s cricket' END AS gender, CASE k % 4 WHEN 1 THEN 'BAT' WHEN 2 THEN 'FIELD' END AS toss,
  CASE WHEN k % 5 = 0 THEN 'ABANDONED' WHEN k % 4 = 0 THEN 'LIVE' WHEN k % 4 = 1 THEN 'COMPLETED' ELSE 'SCHEDULED' END AS state,
  CASE WHEN k % 6 = 0 THEN '-' ELSE url_encode(p_type || ' & / ' || p_size) END AS segment, CASE WHEN k % 6 <> 0 THEN p_name END AS back,
  p_name || ' x' AS plain, p_brand || CASE WHEN k % 2 = 0 THEN '|' || p_type ELSE '' END AS composite, CAST(points AS INTEGER) AS logo_points,
  CASE WHEN greatest(png_points, svg_points) >= 3 THEN CASE WHEN png_points >= svg_points THEN p_name || '.png' ELSE 'a_logo.svg' END END AS logo,
  CASE k % 6 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'TEST' ELSE 'FIRST_CLASS' END WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'ODI' ELSE 'LIST_A' END
    WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'T20I' ELSE 'T20' END WHEN 3 THEN 'T10' WHEN 4 THEN 'HUNDRED' ELSE 'OTHER' END AS class
FROM s""",
    "date_texts": """
WITH d AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day_text FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN day_text || ' 00:00:00' END AS day, day_text AS first_day,
  CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2024-02-28') AS INTEGER) AS age,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN day_text = '1997-01-01' THEN day_text ELSE '1997-01-01 – ' || day_text END AS span FROM d""",
    "match_texts": VIEWS
    + """SELECT match_id, team_home || ' vs ' || team_away AS title, coalesce(outcome_winner || ' won', 'Result —') AS result,
  concat_ws(' · ', match_date, venue, city) AS meta, toss_winner || ' won the toss and chose to ' || toss_decision AS toss FROM matches""",
    "match_tree_text": _with(INNINGS, LINES_ON, BATTING, BOWLING)
    + """, bats AS (SELECT match_id, innings_no, string_agg(player_id, ',' ORDER BY batting_pos) AS b FROM bat_lines GROUP BY ALL),
bowls AS (SELECT match_id, innings_no, string_agg(player_id, ',' ORDER BY bowling_pos) AS w FROM bowl_lines GROUP BY ALL)
SELECT match_id, string_agg(innings_no || '=' || runs || ':' || b || '/' || w, ';' ORDER BY innings_no) AS tree
FROM innings_sums JOIN bats USING (match_id, innings_no) JOIN bowls USING (match_id, innings_no) GROUP BY match_id""",
    "innings_json": _with(INNINGS)
    + "SELECT CAST(to_json(struct_pack(match_id := match_id, innings_no := innings_no, batting_team := batting_team, runs := runs,"
    " wickets := wickets, balls := balls)) AS VARCHAR) AS json FROM innings_sums",
    "edition_spans": VIEWS
    + """SELECT event_name, season, CASE WHEN min(match_date) = max(match_date) THEN min(match_date)
  ELSE min(match_date) || ' – ' || max(match_date) END AS span FROM matches GROUP BY event_name, season""",
    "date_groups": VIEWS
    + """, o AS (
  SELECT *, dense_rank() OVER (PARTITION BY event_name, season ORDER BY match_date DESC NULLS FIRST) AS date_group FROM matches)
SELECT match_id, event_name, season, CAST(date_group AS BIGINT) AS date_group FROM o""",
    "over_extents": _with(OVERS)
    + """SELECT match_id, CAST(max(n) AS INTEGER) AS max_overs, greatest(1, max(c)) AS max_cumulative, greatest(1, max(r)) AS max_runs
FROM (SELECT *, count(*) OVER (PARTITION BY match_id, innings_no) AS n FROM cum) GROUP BY match_id""",
    "innings_slice": _with(LINES, BATTING) + "SELECT * FROM bat_lines WHERE innings_no = 2",
    "batting_performances": PERFORM
    + f"SELECT * EXCLUDE (dismissal), CASE WHEN balls > 0 THEN CAST({_fixed('(CAST(runs AS DOUBLE) / balls * 100)', 2)} AS DOUBLE) END AS strike_rate, dismissal FROM bat_perf",
    "bowling_performances": PERFORM
    + f"SELECT *, balls // 6 || '.' || balls % 6 AS overs_text, CASE WHEN balls > 0 THEN CAST({_fixed('(runs / (CAST(balls AS DOUBLE) / 6e0))', 2)} AS DOUBLE) END AS economy FROM bowl_perf",
    "career_batting_fold": PERFORM + _bat_fold("player_id"),
    "career_bowling_fold": PERFORM + _bowl_fold("player_id"),
    "career_by_class": PERFORM
    + f""", seen AS (
  SELECT player_id, match_class, count(DISTINCT match_id) AS matches
  FROM (SELECT player_id, match_class, match_id FROM bat_perf UNION SELECT player_id, match_class, match_id FROM bowl_perf) GROUP BY ALL),
bats AS ({_bat_fold("player_id, match_class")}),
bowls AS ({_bowl_fold("player_id, match_class")})
SELECT s.player_id, s.match_class, matches, {", ".join(f"coalesce(b.{c}, 0) AS bat_{c}" for c in ZERO)}, b.average AS bat_average, b.strike_rate AS bat_strike_rate,
  coalesce(b.high_score, '—') AS bat_high_score, {", ".join(f"coalesce(w.{c}, 0) AS bowl_{c}" for c in ("innings", "wickets", "runs", "balls", "five_wickets"))},
  w.economy AS bowl_economy, w.average AS bowl_average, w.strike_rate AS bowl_strike_rate, coalesce(w.best, '—') AS bowl_best,
  b.player_id IS NOT NULL AS has_batting, w.player_id IS NOT NULL AS has_bowling, {CLASS_RANK.replace("match_class", "s.match_class")} AS display_order
FROM seen s LEFT JOIN bats b ON b.player_id = s.player_id AND b.match_class = s.match_class
LEFT JOIN bowls w ON w.player_id = s.player_id AND w.match_class = s.match_class""",
    "recent_form": PERFORM
    + """SELECT player_id, CAST(row_number() OVER (PARTITION BY player_id ORDER BY match_date DESC NULLS LAST, match_id, innings_no) AS INTEGER) AS place,
  match_id, innings_no, runs FROM bat_perf QUALIFY place <= 12""",
    "batted_split": PERFORM
    + """SELECT match_id, innings_no, string_agg(player_id, ',' ORDER BY batting_pos) FILTER (WHERE balls > 0 OR runs > 0 OR dismissal <> 'NOT_OUT') AS batted,
  string_agg(player_id, ',' ORDER BY batting_pos) FILTER (WHERE NOT (balls > 0 OR runs > 0 OR dismissal <> 'NOT_OUT')) AS did_not_bat
FROM bat_perf GROUP BY ALL""",
    "player_top": _with(LINES, PLAYERS)
    + """(SELECT 'career_runs' AS measure, player_id, career_runs AS n FROM career_players ORDER BY career_runs DESC, player_id LIMIT 10)
UNION ALL (SELECT 'career_wickets', player_id, career_wickets FROM career_players ORDER BY career_wickets DESC, player_id LIMIT 10)""",
    "competitions_by_volume": VIEWS
    + "SELECT event_name, count(*) AS total, coalesce(event_name, 'Other / Bilateral matches') AS name FROM matches GROUP BY event_name",
    "competition_search": VIEWS
    + "SELECT event_name, count(*) AS total, event_name AS name FROM matches WHERE event_name ILIKE '%league%' GROUP BY event_name",
    "team_profiles": TEAMS + "SELECT * FROM profiles",
    "team_list_national": TEAMS + "SELECT * FROM profiles WHERE is_national AND display_name ILIKE '%in%'",
    "team_list_leagues": TEAMS + "SELECT * FROM profiles WHERE NOT is_national",
    "match_badges": TEAMS
    + """SELECT c_custkey, ' ' || name AS team_home, CASE WHEN c_custkey % 2 = 0 THEN 'nowhere' END AS team_away, id AS home_id, image AS home_image,
  primary_color AS home_color, CAST(NULL AS VARCHAR) AS away_id, CAST(NULL AS VARCHAR) AS away_image, CAST(NULL AS VARCHAR) AS away_color
FROM customer JOIN named ON k = c_nationkey LEFT JOIN profiles ON id = regexp_replace(lower(trim(name)), ' +', ' ', 'g')""",
    "players_with_profiles": _with(LINES, PLAYERS)
    + """SELECT c.*, CASE WHEN p.player_id IS NOT NULL THEN 'photo-' || c.player_id END AS photo_url, CASE WHEN p.player_id IS NOT NULL THEN 'role' END AS role
FROM career_players c LEFT JOIN players p ON p.player_id = c.player_id AND CAST(substr(p.player_id, 2) AS INTEGER) % 3 = 0""",
    "named_leaders": _with(LINES, CAREERS, PLAYERS)
    + f""", best AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY match_class ORDER BY runs DESC, player_id) AS INTEGER) AS place FROM career_rows WHERE runs > 0 QUALIFY place <= 10)
SELECT b.match_class, place, b.player_id, c.name, format('{{:,}}', b.runs) AS value,
  b.matches || ' M · avg ' || coalesce({_fixed("b.batting_avg", 1)}, '—') AS detail FROM best b JOIN career_players c USING (player_id)""",
    "pending_players": _with(LINES, PLAYERS)
    + """SELECT * FROM career_players WHERE external_id IS NOT NULL
  AND player_id NOT IN (SELECT player_id FROM players WHERE CAST(substr(player_id, 2) AS INTEGER) % 5 = 0) ORDER BY career_runs DESC, player_id LIMIT 40""",
    "profile_propagation": VIEWS
    + """, p AS (
  SELECT player_id, CAST(substr(player_id, 2) AS INTEGER) AS i, external_id IS NOT NULL AS has FROM players)
SELECT player_id, CASE WHEN has THEN 'X' || (i // 2 * 2) END AS external_id,
  CASE WHEN has AND i // 2 % 3 <> 0 AND i < 120 THEN 'bowler' WHEN i % 2 = 0 THEN 'old' END AS role,
  CASE WHEN has AND i // 2 % 4 <> 0 AND i < 120 THEN 'left' WHEN i % 2 = 0 THEN 'right' END AS batting_style,
  CASE WHEN i % 2 = 0 THEN 'spin' END AS bowling_style FROM p WHERE i % 2 = 0 OR has""",
    "career_coverage_official": _with(LINES, CAREERS)
    + f""", cover AS (
  SELECT player_id, match_class, min(match_date) AS a, max(match_date) AS b, {_n('count(DISTINCT match_id)')} AS n FROM lines
  WHERE (strikes > 0 OR bowl_at IS NOT NULL) AND match_class <> 'TEST' GROUP BY ALL)
SELECT player_id, match_class, matches, runs, a AS first_match_date, b AS last_match_date, n AS matches_covered,
  CASE WHEN n IS NOT NULL THEN 'BALL_BY_BALL' END AS source,
  CASE WHEN n IS NOT NULL THEN 'Open ball-by-ball coverage only; not an official complete career total.' END AS coverage_note,
  CASE WHEN CAST(substr(player_id, 2) AS INTEGER) % 2 = 0 THEN runs + 100 END AS official_runs
FROM career_rows LEFT JOIN cover USING (player_id, match_class)""",
    "missing_scorecards": """SELECT o_orderkey AS match_id, true AS has_scorecard FROM orders
WHERE o_orderkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 2)""",
    "edition_squads_ordered": SQL["edition_squads"].replace("SELECT event_name, season, team, player, count(DISTINCT match_id)", ", squads AS (SELECT event_name, season, team, player, count(DISTINCT match_id)", 1)
    + """)
SELECT *, CAST(row_number() OVER (PARTITION BY event_name, season, team ORDER BY appearances DESC, runs DESC, player) AS INTEGER) AS place FROM squads""",
    "canonical_order": "SELECT o_orderkey AS match_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS start_time FROM orders",
    "elo_rankings": ELO_VIEWS
    + ELO
    + """SELECT match_class, team, t.played, won, lost, rating,
  CAST(row_number() OVER (PARTITION BY match_class ORDER BY rating DESC, won DESC, team) AS INTEGER) AS place FROM tally t JOIN rated USING (match_class, team)""",
    "elo_ratings": ELO_VIEWS
    + ELO
    + "SELECT match_class, team, t.played, won, lost, rating FROM tally t JOIN rated USING (match_class, team) WHERE t.played >= 5",
    "feed_state": """
WITH p AS (
  SELECT 'f' || user_id AS feed, 'e' || event_id % 4 AS etag, CASE WHEN event_id % 2 = 0 THEN event_type END AS m, event_id % 10 AS i, ts FROM events WHERE event_id % 3 = 0),
f AS (SELECT 'f' || range AS feed FROM range(5))
SELECT feed, coalesce(max_by(etag, ts), 'start') AS etag, coalesce(max_by(m, ts) FILTER (WHERE m IS NOT NULL), CASE WHEN any_value(f.feed) IS NOT NULL THEN 'old' END) AS last_modified,
  CAST(coalesce(sum(i), 0) + CASE WHEN any_value(f.feed) IS NOT NULL THEN 5 ELSE 0 END AS BIGINT) AS imported, count(ts) AS failed
FROM p FULL JOIN f USING (feed) GROUP BY feed""",
    "feed_totals": "SELECT CAST(sum(event_id % 10) AS BIGINT) AS imported, count(*) AS failed FROM events WHERE event_id % 3 = 0",
    "refresh_plan": """
WITH e AS (SELECT user_id AS u, max(event_id) AS m FROM events GROUP BY user_id)
SELECT 'f' || u AS feed, 'e' || m % 4 AS etag, CASE WHEN m % 3 = 0 THEN 'monday' END AS last_modified,
  CASE WHEN u % 4 <> 0 AND (m % 4 = u % 4 OR (m % 3 = 0 AND u % 2 = 0)) THEN 'not-modified' ELSE 'fetch' END AS action FROM e""",
    "ingest_plans": """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS new, o_orderkey % 4 + 1 > o_orderkey % 5 AS later FROM orders)
SELECT k AS match_id, CASE WHEN new THEN 'ingest' ELSE 'skip' END AS plain, CASE WHEN new OR later THEN 'ingest' ELSE 'skip' END AS sweep, 'ingest' AS cached,
  CASE WHEN new OR later THEN 'would-ingest' ELSE 'skip' END AS dry FROM o""",
    "due_jobs": """
WITH j AS (SELECT event_id AS job, CASE event_id % 5 WHEN 0 THEN 120 WHEN 1 THEN 3600 ELSE 86400 END AS every_seconds, ts, event_id AS i FROM events)
SELECT job, every_seconds FROM j WHERE i % 7 <> 0 AND i % 11 <> 0
  AND (i % 13 = 0 OR epoch(TIMESTAMP '2024-01-15 12:00:00') - floor(epoch(ts)) >= every_seconds)""",
    "crawl_jobs": FIXTURES
    + """SELECT 'scorecard' AS page_type, 'cup-' || series_id || '/' || slug || '-' || match_id AS params, mode, 1 AS depth, state = 'LIVE' AS force_refetch
FROM f, (VALUES ('HISTORICAL'), ('LIVE')) t(mode) WHERE has_scorecard AND slug IS NOT NULL AND series_id IS NOT NULL AND (mode = 'HISTORICAL' OR state = 'LIVE')""",
    "crawl_frontier": """
SELECT event_type AS page_type, CAST(user_id AS VARCHAR) AS params, CAST(min(event_id % 7) AS INTEGER) AS depth FROM events
GROUP BY event_type, user_id HAVING min(event_id % 7) > 0""",
    "class_batches": VIEWS + "SELECT match_class, count(*) AS n, min(match_id) AS first_key, max(match_id) AS last_key FROM matches GROUP BY match_class",
    "contract_split": """
SELECT o_orderkey, concat_ws(',', CASE WHEN NOT coalesce(o_totalprice >= 50000, false) THEN 'total' END,
  CASE WHEN o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F') THEN 'status' END, CASE WHEN coalesce(length(o_orderpriority), 0) < 6 THEN 'priority' END) AS broken FROM orders""",
    "optional_filters": VIEWS
    + """SELECT match_id, event_name, season FROM matches WHERE event_name IS NULL AND season = '2019' OR event_name = 'League 1' AND season IS NULL""",
    "fixture_pages": FIXTURES + "SELECT * FROM f",
    "pages_without_data": "SELECT DISTINCT o_custkey AS page_id FROM orders WHERE o_custkey % 10 = 0",
    "scorecard_batting_lines": """
WITH l AS (SELECT *, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey, l_extendedprice) AS p FROM lineitem)
SELECT l_orderkey AS page_id, CASE WHEN l_orderkey % 2 = 1 THEN 7 ELSE 1 END AS innings_no, CAST(p AS INTEGER) AS batting_pos, l_partkey AS source_id, 'P' || l_partkey AS name,
  CASE WHEN l_linenumber = 3 THEN 0 ELSE q END AS runs, q + 1 AS balls, CASE WHEN l_linenumber % 2 = 0 THEN q % 4 END AS fours, CAST(NULL AS INTEGER) AS sixes,
  CAST(NULL AS DOUBLE) AS strike_rate, CASE WHEN l_orderkey % 2 = 1 THEN l_linenumber % 2 = 0 END AS out,
  CASE WHEN l_linenumber % 2 = 0 THEN 'CAUGHT' ELSE 'NOT_OUT' END AS dismissal FROM l""",
    "scorecard_bowling_lines": """
WITH l AS (SELECT *, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey, l_extendedprice) AS p FROM lineitem)
SELECT l_orderkey AS page_id, CASE WHEN l_orderkey % 2 = 1 THEN 7 ELSE 1 END AS innings_no, CAST(p AS INTEGER) AS bowling_pos, l_partkey AS source_id, 'P' || l_partkey AS name,
  CAST(l_linenumber % 3 AS INTEGER) AS wickets, CASE WHEN l_orderkey % 2 = 1 THEN q ELSE q + 2 END AS runs, l_linenumber || '.0' AS overs, CAST(NULL AS INTEGER) AS balls,
  CAST(NULL AS INTEGER) AS maidens, CAST(NULL AS DOUBLE) AS economy FROM l""",
    "scorecard_innings": """SELECT DISTINCT l_orderkey AS page_id, CASE WHEN l_orderkey % 2 = 1 THEN 7 ELSE 1 END AS innings_no, 100 AS runs,
  CAST(NULL AS INTEGER) AS wickets, CAST(NULL AS VARCHAR) AS overs FROM lineitem""",
    "player_profile_pages": """
SELECT c_custkey AS page_id, CAST(c_custkey AS VARCHAR) AS external_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Land' ELSE 'Team' END AS country,
  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS role, CASE c_custkey % 4 WHEN 0 THEN 'Right hand' WHEN 1 THEN 'rhb' END AS batting_style,
  CAST(NULL AS VARCHAR) AS bowling_style FROM customer""",
    "page_urls": """
SELECT o_orderkey, 'https://site.example/series/cup-' || o_orderkey || '/match-schedule-fixtures-and-results' AS fixtures,
  'https://site.example/series/cup-' || o_custkey || '/a-v-b-' || o_orderkey || '/full-scorecard' AS scorecard,
  'https://site.example/cricketers/some-one-' || o_orderkey AS profile FROM orders""",
    "profile_bindings": """
SELECT CAST(c_custkey AS VARCHAR) AS external_id, 'Q' || c_custkey AS entity, CASE WHEN c_custkey % 2 = 0 THEN 'A ' || c_custkey || '.jpg' END AS image,
  '1990-01-01' AS born, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS birth_place, CASE WHEN c_custkey % 5 = 0 THEN 'bowler' END AS role FROM customer""",
    "image_licenses": """SELECT c_custkey || '.png' AS file, c_name AS credit, CASE WHEN c_custkey % 2 = 0 THEN 'CC BY' END AS license
FROM customer WHERE c_custkey % 5 <> 0""",
    "match_objects": """
WITH o AS (SELECT *, o_orderkey AS k FROM orders)
SELECT k AS match_id, '{"id":' || k || ',"title":"Match ' || k || '","season":' || CASE WHEN k % 2 = 0 THEN '"2024"' ELSE 'null' END || ',"statusText":"' || o_orderstatus
  || '","format":"ODI","state":"LIVE","startTime":' || CASE WHEN k % 5 <> 0 THEN strftime(o_orderdate, '"%Y-%m-%dT%H:%M:%S.000Z"') ELSE 'null' END
  || ',"series":' || CASE WHEN k % 2 = 0 THEN '{"name":"Cup","slug":"cup"}' ELSE 'null' END
  || ',"venue":' || CASE WHEN k % 3 = 0 THEN '{"name":"Ground ' || k || '","city":null}' ELSE 'null' END
  || ',"teams":[{"name":"H' || k || '","shortName":"H","score":"10/1","primaryColor":null,"logoUrl":"https://img.example/h' || k || '"}'
  || CASE WHEN k % 4 <> 0 THEN ',{"name":"A' || k || '","shortName":"A","score":null,"primaryColor":null,"logoUrl":"http://a/' || k || '"}' ELSE '' END || ']}' AS json FROM o""",
    "innings_rewrite": VIEWS
    + """SELECT match_id, innings_no, over_no, ball_in_over,
  runs_total + CASE WHEN innings_no = 2 AND CAST(substr(match_id, 2) AS INTEGER) % 3 = 0 THEN 1 ELSE 0 END AS runs_total FROM deliveries
WHERE NOT (innings_no = 2 AND CAST(substr(match_id, 2) AS INTEGER) % 3 = 0 AND over_no >= 10)""",
    "document_deliveries": VIEWS
    + """SELECT d.match_id, match_class, gender, season, event_name, venue, city, match_date, innings_no, over_no, ball_in_over, batting_team, bowling_team,
  batter_id, batter_name, bowler_id, bowler_name, non_striker_id, non_striker_name, runs_batter, runs_extras, runs_total, extra_type, is_wicket, dismissal_kind,
  player_out_id, 'Player ' || substr(player_out_id, 2) AS player_out_name, CASE WHEN dismissal_kind = 'caught' THEN bowler_name || ';Sub' END AS fielders,
  a.external_id AS batter_external, b.external_id AS bowler_external
FROM deliveries d LEFT JOIN players a ON a.player_id = batter_id LEFT JOIN players b ON b.player_id = bowler_id""",
    "document_matches": VIEWS + "SELECT *, 6 AS balls_per_over FROM matches",
    "document_innings": _with(INNINGS) + "SELECT *, balls // 6 || '.' || balls % 6 AS overs_text FROM innings_sums",
    "document_players": VIEWS
    + """, seen AS (
  SELECT batter_id AS player_id, batter_name AS name FROM deliveries UNION SELECT bowler_id, bowler_name FROM deliveries
  UNION SELECT non_striker_id, non_striker_name FROM deliveries)
SELECT s.player_id, min(s.name) AS name, any_value(p.external_id) AS external_id FROM seen s LEFT JOIN players p ON p.player_id = s.player_id GROUP BY s.player_id""",
    "document_squads": VIEWS
    + """, seen AS (
  SELECT match_id, batter_name AS name FROM deliveries UNION SELECT match_id, bowler_name FROM deliveries UNION SELECT match_id, non_striker_name FROM deliveries)
SELECT match_id, team_home AS team, name FROM seen JOIN matches USING (match_id)""",
    "crawl_closure": """
WITH RECURSIVE links AS (
  SELECT DISTINCT o_custkey AS a, o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN -10 WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS b FROM orders),
reach(c, depth) AS (
  SELECT c_custkey, 0 FROM customer WHERE c_custkey <= 2
  UNION SELECT b, depth + 1 FROM reach JOIN links ON a = c WHERE b BETWEEN 1 AND 129 AND depth < 130)
SELECT 'profile' AS page_type, CAST(c AS VARCHAR) AS params, min(depth) AS depth FROM reach GROUP BY c""",
    "career_upkeep": _with(LINES, CAREERS) + "SELECT * FROM career_rows",
    "document_rules": f"SELECT o_orderkey, ({REASONS})[CAST(o_orderkey % len({REASONS}) AS INTEGER) + 1] AS reasons FROM orders",
    "chase_split": "SELECT match_id, ball, CAST('0x' || substr(md5(match_id), 1, 8) AS BIGINT) % 1000 < 200 AS held_out FROM (" + SQL["chase_features"] + ")",
    "competition_places": VIEWS
    + """, c AS (SELECT coalesce(event_name, 'Other / Bilateral matches') AS name, count(*) AS total FROM matches GROUP BY event_name)
SELECT name, total, row_number() OVER (ORDER BY total DESC, name) AS place FROM c""",
    "team_places": TEAMS + "SELECT display_name, match_count, row_number() OVER (ORDER BY match_count DESC, display_name) AS place FROM profiles",
    "canonical_places": """SELECT o_orderkey AS match_id,
  row_number() OVER (ORDER BY CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END NULLS LAST, o_orderkey) AS place FROM orders""",
    "match_page_written": """
WITH p AS (
  SELECT o_orderkey AS match_id, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END NULLS LAST, o_orderkey) AS place FROM orders),
n AS (SELECT *, (place - 1) // 37 + 1 AS page FROM p)
SELECT match_id, place, page FROM n WHERE page = least(30, (SELECT max(page) FROM n))""",
}
