"""DuckDB SQL for the queries of the catalog. One base of common table expressions stands for the test bed."""

from __future__ import annotations

from chronolith.operators.structure import SUSPECTS
from chronolith.schema import (
    ACTIVE_BUS_FACTOR, COLD_RATIO, DECLINING_FLOOR, DECLINING_TREND, MECHANICAL_FILES, MECHANICAL_LINES, MIN_SAMPLE, OLD_AGE_DAYS, OWNERSHIP, RISK_LABELS, SUSPECT_FLOOR,
)

from chronolith.testbed import ODD_NAMES

_AUTHOR = {
    "coarse": "o_custkey % 50",
    "fine": "(CASE WHEN o_custkey % 10 < 6 THEN 0 WHEN o_custkey % 10 < 8 THEN 1 ELSE 2 + o_custkey % 48 END)",
}
_EXT = "CASE CAST(p_size AS BIGINT) % 5 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.md' WHEN 3 THEN '.lock' ELSE '' END"
_PATH = {
    "coarse": f"lower(p_type) || '/' || replace(p_brand, '#', '') || {_EXT}",
    "fine": f"lower(p_type) || '/' || (CASE WHEN p_size > 25 THEN 'y' || year(o_orderdate) || '/' ELSE '' END) || replace(p_name, ' ', '_') || '_' || (p_size % 10) || {_EXT}",
}
_REPO = "lower(replace(o_orderpriority, ' ', ''))"
_DAY = "coalesce(strftime({}, '%Y-%m-%d'), '')"
#: Extension of a test-bed path, in plain SQL.
_EXTENSION = "CASE WHEN strpos(string_split(file, '/')[-1], '.') = 0 THEN '(none)' ELSE lower('.' || string_split(string_split(file, '/')[-1], '.')[-1]) END"
_DIRNAME = "CASE WHEN strpos(file, '/') = 0 THEN '.' ELSE array_to_string(string_split(file, '/')[:-2], '/') END"


def base(kind: str = "fine", multi: bool = False, since: str = "", until: str = "", renames: bool = False) -> str:
    repo = _REPO if multi else "'(repo)'"
    path = f"{_REPO} || ':' || {_PATH[kind]}" if multi else _PATH[kind]
    window = (f" AND ts >= TIMESTAMP '{since} 00:00:00'" if since else "") + (f" AND ts <= TIMESTAMP '{until} 23:59:59'" if until else "")
    moved = """
m AS (SELECT DISTINCT file AS old, string_split(file, '/')[1] || '/y' || (CAST(substr(string_split(file, '/')[2], 2) AS INTEGER) + 1) || '/' || string_split(file, '/')[3] AS new
      FROM f0 WHERE regexp_matches(file, '/y199[56]/') AND file LIKE '%.go'),
newest AS (SELECT sha, ts, email FROM c ORDER BY ts DESC, sha DESC LIMIT 1),
e AS (SELECT m.old, m.new, n.ts AS et FROM m, newest n),
used AS (SELECT file, max(ts) AS changed FROM (SELECT file, ts FROM f0 UNION ALL SELECT new, et FROM e) GROUP BY file),
s AS (SELECT e.old, e.new FROM e LEFT JOIN used u ON u.file = e.old WHERE NOT coalesce(u.changed > e.et, false)),
k AS (SELECT s.old AS raw, coalesce(t.new, s.new) AS file FROM s LEFT JOIN s t ON t.old = s.new),
r AS (SELECT n.sha, n.email, n.ts, '(repo)' AS repo, m.new AS file, 0 AS a, 0 AS d FROM m, newest n),
f AS (SELECT x.sha, x.email, x.ts, x.repo, x.file AS raw, coalesce(k.file, x.file) AS file, x.a, x.d FROM (SELECT * FROM f0 UNION ALL SELECT * FROM r) x LEFT JOIN k ON k.raw = x.file)
""" if renames else "f AS (SELECT sha, email, ts, repo, file AS raw, file, a, d FROM f0)"
    return f"""WITH o AS (
  SELECT *, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS ts, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS sha,
         'dev' || {_AUTHOR[kind]} || '@example.com' AS email, 'Dev ' || {_AUTHOR[kind]} AS name, {repo} AS repo FROM orders),
l AS (SELECT l_orderkey, l_partkey, CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE trunc(l_quantity) END AS BIGINT) AS a,
             CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE round(l_discount * 100) END AS BIGINT) AS d FROM lineitem),
c AS (SELECT o.sha, o.repo, o.name, o.email, o.ts, o.ts + to_hours(CAST(o_orderkey % 5 AS INTEGER) - 2) AS ts_local, o_orderkey AS ord,
             CAST(coalesce(sum(l.a), 0) AS BIGINT) AS a, CAST(coalesce(sum(l.d), 0) AS BIGINT) AS d, count(l.l_orderkey) AS n
      FROM o LEFT JOIN l ON l.l_orderkey = o.o_orderkey WHERE true{window} GROUP BY ALL),
f0 AS (SELECT o.sha, o.email, o.ts, o.repo, {path} AS file, l.a, l.d
       FROM l JOIN o ON l.l_orderkey = o.o_orderkey JOIN part ON p_partkey = l.l_partkey WHERE true{window}),
{moved},
fd AS (SELECT file, email, CAST(sum(a + d) AS BIGINT) AS lines, count(*) AS touches FROM f GROUP BY file, email),
au AS (SELECT * FROM fd WHERE lines > 0)"""


def _round(x: str, k: int) -> str:
    return f"(round(({x}) * {10**k}) / {10**k}.0)"


_SUMMARY = """SELECT (SELECT count(*) FROM c) AS total_commits, (SELECT count(DISTINCT email) FROM c) AS total_devs, (SELECT count(DISTINCT file) FROM f) AS total_files,
 (SELECT CAST(coalesce(sum(a), 0) AS BIGINT) FROM c) AS total_additions, (SELECT CAST(coalesce(sum(d), 0) AS BIGINT) FROM c) AS total_deletions,
 (SELECT count(*) FROM c WHERE ord % 17 = 0) AS merge_commits, (SELECT sum(a) / count(*) FROM c) AS avg_additions, (SELECT sum(d) / count(*) FROM c) AS avg_deletions,
 (SELECT sum(n) / count(*) FROM c) AS avg_files_changed, (SELECT strftime(min(ts), '%Y-%m-%d') FROM c) AS first_commit, (SELECT strftime(max(ts), '%Y-%m-%d') FROM c) AS last_commit"""
_CONTRIBUTORS = f"""SELECT min(name) AS name, email, count(*) AS commits, CAST(sum(a) AS BIGINT) AS additions, CAST(sum(d) AS BIGINT) AS deletions,
 coalesce((SELECT count(DISTINCT file) FROM f WHERE f.email = c.email), 0) AS files_touched, count(DISTINCT CAST(ts AS DATE)) AS active_days, {_DAY.format('min(ts)')} AS first_date, {_DAY.format('max(ts)')} AS last_date
 FROM c GROUP BY email ORDER BY commits DESC, email"""
_HOTSPOTS = """SELECT file AS path, count(*) AS commits, CAST(sum(a) AS BIGINT) AS additions, CAST(sum(d) AS BIGINT) AS deletions, CAST(sum(a + d) AS BIGINT) AS churn,
 coalesce((SELECT count(*) FROM au WHERE au.file = f.file), 0) AS unique_devs FROM f GROUP BY file ORDER BY commits DESC, path"""
_DIRECTORIES = f"""SELECT dir, file_touches, churn, files, coalesce(unique_devs, 0) AS unique_devs, coalesce(bus_factor, 0) AS bus_factor FROM
 (SELECT {_DIRNAME} AS dir, count(*) AS file_touches, CAST(sum(a + d) AS BIGINT) AS churn, count(DISTINCT file) AS files FROM f GROUP BY 1) x LEFT JOIN
 (SELECT dir, count(*) AS unique_devs, count(*) FILTER (WHERE upto - lines < {OWNERSHIP} * total) AS bus_factor FROM
   (SELECT dir, email, lines, sum(lines) OVER (PARTITION BY dir ORDER BY lines DESC, email ROWS UNBOUNDED PRECEDING) AS upto, sum(lines) OVER (PARTITION BY dir) AS total FROM
     (SELECT {_DIRNAME} AS dir, email, sum(lines) AS lines FROM au GROUP BY ALL)) GROUP BY dir) y USING (dir)"""
_BUS = f"""b AS (SELECT file, count(*) FILTER (WHERE upto - lines < {OWNERSHIP} * total) AS bf, string_agg(email, ';' ORDER BY lines DESC, email) FILTER (WHERE upto - lines < {OWNERSHIP} * total) AS top_devs FROM
 (SELECT file, email, lines, sum(lines) OVER (PARTITION BY file ORDER BY lines DESC, email ROWS UNBOUNDED PRECEDING) AS upto, sum(lines) OVER (PARTITION BY file) AS total FROM au) GROUP BY file)"""
_EPOCH = "CAST(epoch({}) AS BIGINT)"
_MICRO = f"CAST(round((a + d) * exp(-(ln(2.0) / 90) * (({_EPOCH.format('(SELECT max(ts) FROM c)')} - {_EPOCH.format('ts')}) / 86400.0)) * 1e6) AS BIGINT)"
_EXTENSIONS = f"""SELECT ext, count(DISTINCT file) AS files, CAST(sum(a + d) AS BIGINT) AS churn, {_round(f'sum({_MICRO}) / 1e6', 1)} AS recent_churn,
 (SELECT count(DISTINCT au.email) FROM au WHERE {_EXTENSION.replace('file', 'au.file')} = x.ext) AS unique_devs, {_DAY.format('min(ts)')} AS first_seen, {_DAY.format('max(ts)')} AS last_seen
 FROM (SELECT *, {_EXTENSION} AS ext FROM f) x GROUP BY ext"""
_RISK = f""",
{_BUS},
z AS (SELECT max(ts) AS latest, min(ts) AS earliest, strftime(date_trunc('month', max(ts)) - INTERVAL 3 MONTH + to_days(CAST(day(max(ts)) AS INTEGER) - 1), '%Y-%m') AS cutoff FROM c),
g AS (SELECT file, sum({_MICRO}) / 1e6 AS recent, count(*) AS total_changes, min(ts) AS first, max(ts) AS last,
  sum(CASE WHEN strftime(ts, '%Y-%m') < z.cutoff THEN a + d ELSE 0 END) AS earlier, sum(CASE WHEN strftime(ts, '%Y-%m') >= z.cutoff THEN a + d ELSE 0 END) AS later FROM f, z GROUP BY file),
t AS (SELECT g.*, greatest(coalesce(b.bf, 1), 1) AS bf, CAST(floor(({_EPOCH.format('z.latest')} - {_EPOCH.format('g.first')}) / 86400.0) AS BIGINT) AS age,
  CASE WHEN strftime(z.earliest, '%Y-%m') >= z.cutoff THEN 1.0 WHEN earlier = 0 THEN (CASE WHEN later = 0 THEN 1.0 ELSE 2.0 END) WHEN later = 0 THEN 0.0 ELSE CAST(later AS DOUBLE) / CAST(earlier AS DOUBLE) END AS trend
  FROM g LEFT JOIN b USING (file), z),
u AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY age) - 1 AS age_below, rank() OVER (ORDER BY trend) - 1 AS trend_below FROM t),
w AS (SELECT (SELECT {COLD_RATIO} * (list(recent ORDER BY recent))[len(list(recent)) // 2 + 1] FROM t WHERE recent > 0) AS low,
  (SELECT CASE WHEN count(*) < {MIN_SAMPLE} THEN {OLD_AGE_DAYS} ELSE (list(age ORDER BY age))[greatest(1, (count(*) * 75 + 99) // 100)] END FROM t) AS old,
  (SELECT CASE WHEN count(*) < {MIN_SAMPLE} THEN {DECLINING_TREND} ELSE greatest({DECLINING_FLOOR}, (list(trend ORDER BY trend))[greatest(1, (count(*) * 25 + 99) // 100)]) END FROM t) AS declining),
r0 AS (SELECT u.*, CASE WHEN recent <= coalesce(w.low, 0) THEN 'cold' WHEN bf >= {ACTIVE_BUS_FACTOR} THEN 'active' WHEN age < w.old THEN 'active-core' WHEN trend < w.declining THEN 'fading-silo' ELSE 'silo' END AS label FROM u, w),
risk AS (SELECT file AS path, label, {_round('recent', 1)} AS recent_churn, {_round('recent / bf', 1)} AS risk_score, {_round('trend', 2)} AS trend, bf AS bus_factor, total_changes, age AS age_days,
  {_DAY.format('first')} AS first_change, {_DAY.format('last')} AS last_change, CAST(CASE WHEN n >= {MIN_SAMPLE} THEN age_below * 100 // n END AS INTEGER) AS age_percentile,
  CAST(CASE WHEN n >= {MIN_SAMPLE} THEN trend_below * 100 // n END AS INTEGER) AS trend_percentile FROM r0)"""
_PRIORITY = f"list_position([{', '.join(repr(x) for x in RISK_LABELS)}], label)"
_COUPLING = f""",
fp AS (SELECT sha, file, sum(a + d) AS lines FROM f GROUP BY ALL),
sz AS (SELECT sha FROM fp GROUP BY sha HAVING count(*) BETWEEN 2 AND 50 AND NOT (count(*) >= {MECHANICAL_FILES} AND sum(lines) / count(*) < {MECHANICAL_LINES})),
ch AS (SELECT file, count(DISTINCT sha) AS n FROM f GROUP BY file),
pr AS (SELECT x.file AS file_a, y.file AS file_b, count(*) AS co FROM fp x JOIN fp y ON x.sha = y.sha AND x.file < y.file WHERE x.sha IN (SELECT sha FROM sz) GROUP BY ALL)
SELECT file_a, file_b, co AS co_changes, co / least(p.n, q.n) * 100 AS coupling_pct, p.n AS changes_a, q.n AS changes_b
FROM pr JOIN ch p ON p.file = file_a JOIN ch q ON q.file = file_b WHERE co >= 5"""


def _network(least_files: int) -> str:
    return f""",
fc AS (SELECT email, count(*) AS n FROM au GROUP BY email),
pr AS (SELECT x.email AS dev_a, y.email AS dev_b, count(*) AS shared_files, CAST(sum(least(x.lines, y.lines)) AS BIGINT) AS shared_lines FROM au x JOIN au y ON x.file = y.file AND x.email < y.email GROUP BY ALL HAVING count(*) >= {least_files})
SELECT dev_a, dev_b, shared_files, shared_lines, {_round('shared_files / greatest(p.n, q.n) * 100', 1)} AS weight FROM pr JOIN fc p ON p.email = dev_a JOIN fc q ON q.email = dev_b"""


def _lens(name: str, rows: str, value: str, order: str, key_person: bool = False) -> str:
    label = "CASE WHEN top = 0 THEN 'no data' WHEN pct <= 10 THEN 'extremely concentrated' WHEN pct <= 25 THEN 'moderately concentrated' ELSE 'well distributed' END"
    if key_person:
        label += " || CASE WHEN top > 0 AND pct <= 10 THEN ', key-person dependence' ELSE '' END"
    return f"""SELECT '{name}' AS lens, top, total, pct, {label} AS label FROM (SELECT top, total, {_round('top / total * 100', 1)} AS pct FROM (
 SELECT count(*) FILTER (WHERE upto - v < {OWNERSHIP} * whole AND whole > 0) AS top, count(*) AS total FROM
 (SELECT {value} AS v, sum({value}) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS upto, sum({value}) OVER () AS whole FROM ({rows}))))"""


_PARETO = "\nUNION ALL\n".join((
    _lens("files_churn", _HOTSPOTS, "churn", "churn DESC, path"), _lens("devs_commits", _CONTRIBUTORS, "commits", "commits DESC, email", True),
    _lens("devs_churn", f"SELECT *, additions + deletions AS churn FROM ({_CONTRIBUTORS})", "churn", "churn DESC, email"), _lens("dirs_churn", _DIRECTORIES, "churn", "file_touches DESC, dir"),
))


def _tree(max_depth: int = 0) -> str:
    keep = f"WHERE depth <= {max_depth}" if max_depth else ""
    return f""",
ff AS (SELECT file, string_split(file, '/') AS parts, count(*) AS commits, CAST(sum(a + d) AS BIGINT) AS churn FROM f GROUP BY file),
dd AS (SELECT array_to_string(parts[:i], '/') AS path, i AS depth, churn FROM (SELECT parts, churn, unnest(generate_series(0, len(parts) - 1)) AS i FROM ff)),
nn AS (SELECT path, true AS is_dir, CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS commits, CAST(sum(churn) AS BIGINT) AS churn, count(*) AS files FROM dd GROUP BY path, depth
  UNION ALL SELECT file, false, CAST(len(parts) AS INTEGER), commits, churn, 1 FROM ff),
pp AS (SELECT *, CASE WHEN depth = 0 THEN NULL WHEN strpos(path, '/') = 0 THEN '' ELSE array_to_string(string_split(path, '/')[:-2], '/') END AS parent, CASE WHEN depth = 0 THEN '.' ELSE string_split(path, '/')[-1] END AS name FROM nn {keep})
SELECT path, parent, name, is_dir, depth, commits, churn, files, {f'(is_dir AND depth = {max_depth})' if max_depth else 'false'} AS truncated, CAST(0 AS BIGINT) AS hidden_children,
 CAST(row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, churn DESC, name) AS INTEGER) AS rank FROM pp"""


def _breakdown(author: str = "") -> str:
    mine = f" WHERE lower(trim(email)) = '{author}'" if author else ""
    return f"""SELECT repo, commits, additions, deletions, churn, coalesce(files, 0) AS files, active_days, unique_devs, first_date, last_date,
 {_round('commits * 100.0 / sum(commits) OVER ()', 1)} AS commits_pct, {_round('churn * 100.0 / sum(churn) OVER ()', 1)} AS churn_pct FROM
 (SELECT repo, count(*) AS commits, CAST(sum(a) AS BIGINT) AS additions, CAST(sum(d) AS BIGINT) AS deletions, CAST(sum(a + d) AS BIGINT) AS churn, count(DISTINCT CAST(ts AS DATE)) AS active_days,
   count(DISTINCT lower(trim(email))) AS unique_devs, {_DAY.format('min(ts)')} AS first_date, {_DAY.format('max(ts)')} AS last_date FROM c{mine} GROUP BY repo) x
 LEFT JOIN (SELECT string_split(file, ':')[1] AS repo, count(DISTINCT file) AS files FROM f{mine} GROUP BY 1) y USING (repo)"""


def _ranked(source: str, keys: str, item: str, k: int, name: str) -> str:
    return f"{name} AS (SELECT email, string_agg(s, ';' ORDER BY rk) FILTER (WHERE rk <= {k}) AS {name}, greatest(count(*) - {k}, 0) AS {name}_hidden FROM (SELECT email, {item} AS s, row_number() OVER (PARTITION BY email ORDER BY {keys}) AS rk FROM {source}) GROUP BY email)"


_PROFILE = f""",
ds AS (SELECT email, {_DIRNAME} AS dir, count(*) AS files FROM au GROUP BY ALL),
xs AS (SELECT email, {_EXTENSION} AS ext, count(*) AS files, CAST(sum(lines) AS BIGINT) AS churn FROM au GROUP BY ALL),
ps AS (SELECT x.email, y.email AS partner, count(*) AS sf, CAST(sum(least(x.lines, y.lines)) AS BIGINT) AS sl FROM au x JOIN au y ON x.file = y.file AND x.email <> y.email GROUP BY ALL),
ws AS (SELECT email, isodow(ts_local) - 1 AS day, hour(ts_local) AS hour, count(*) AS n FROM c GROUP BY ALL),
{_ranked('au', 'lines DESC, file', "concat_ws(':', file, touches, lines)", 10, 'top_files')},
{_ranked('c', 'a + d DESC, sha', "concat_ws(':', sha, a + d)", 10, 'top_commits')},
{_ranked('ds', 'files DESC, dir', "concat_ws(':', dir, files)", 5, 'scope')},
{_ranked('xs', 'files DESC, churn DESC, ext', "concat_ws(':', ext, files, churn)", 5, 'extensions')},
{_ranked('ps', 'sl DESC, sf DESC, partner', "concat_ws(':', partner, sf, sl)", 5, 'collaborators')},
ma AS (SELECT email, string_agg(p || ':' || n, ';' ORDER BY p) AS monthly_activity FROM (SELECT email, strftime(ts, '%Y-%m') AS p, count(*) AS n FROM c GROUP BY ALL) GROUP BY email),
wg AS (SELECT email, string_agg(concat_ws(':', day, hour, n), ';' ORDER BY day, hour) AS work_grid, {_round('sum(CASE WHEN day >= 5 THEN n ELSE 0 END) / sum(n) * 100', 1)} AS weekend_pct FROM ws GROUP BY email),
sp AS (SELECT email, CAST(sum(files * files) AS DOUBLE) / CAST(sum(files) * sum(files) AS DOUBLE) AS sp FROM ds GROUP BY email),
ct AS ({_CONTRIBUTORS})
SELECT name, email, commits, additions, deletions, additions + deletions AS lines_changed, files_touched, active_days, first_date, last_date, round(coalesce(sp, 0), 6) AS specialization,
 CASE WHEN coalesce(sp, 0) < 0.15 THEN 'broad generalist' WHEN sp < 0.35 THEN 'balanced' WHEN sp < 0.7 THEN 'focused specialist' ELSE 'narrow specialist' END AS specialist,
 ratio AS contrib_ratio, CASE WHEN ratio >= 0.8 THEN 'refactor' WHEN ratio >= 0.4 THEN 'balanced' ELSE 'growth' END AS contrib_type,
 {_round('commits / active_days', 1)} AS pace, weekend_pct, coalesce(top_files, '') AS top_files, top_commits, monthly_activity, work_grid, coalesce(scope, '') AS scope, coalesce(extensions, '') AS extensions,
 coalesce(collaborators, '') AS collaborators, coalesce(top_files_hidden, 0) AS top_files_hidden, top_commits_hidden, coalesce(scope_hidden, 0) AS scope_hidden, coalesce(extensions_hidden, 0) AS extensions_hidden, coalesce(collaborators_hidden, 0) AS collaborators_hidden
FROM (SELECT *, CASE WHEN additions > 0 THEN {_round('deletions / additions', 2)} ELSE 0.0 END AS ratio FROM ct) LEFT JOIN top_files USING (email) LEFT JOIN top_commits USING (email) LEFT JOIN scope USING (email)
 LEFT JOIN extensions USING (email) LEFT JOIN collaborators USING (email) LEFT JOIN ma USING (email) LEFT JOIN wg USING (email) LEFT JOIN sp USING (email)"""


def _activity(label: str) -> str:
    return f"{base()} SELECT {label} AS period, count(*) AS commits, CAST(sum(a) AS BIGINT) AS additions, CAST(sum(d) AS BIGINT) AS deletions FROM c GROUP BY 1 ORDER BY 1"


#: Grouping sets over commits, and the same over files, side by side.
_REPOSITORIES = f"""SELECT x.repo, x.repo IS NULL AS total, commits, devs, files, additions, deletions, additions + deletions AS churn, merges, first_commit, last_commit FROM
 (SELECT repo, count(*) AS commits, count(DISTINCT email) AS devs, CAST(sum(a) AS BIGINT) AS additions, CAST(sum(d) AS BIGINT) AS deletions, count(*) FILTER (WHERE ord % 17 = 0) AS merges,
   {_DAY.format('min(ts)')} AS first_commit, {_DAY.format('max(ts)')} AS last_commit FROM c GROUP BY GROUPING SETS ((repo), ())) x
 JOIN (SELECT repo, count(DISTINCT repo || ' ' || file) AS files FROM f GROUP BY GROUPING SETS ((repo), ())) y ON x.repo IS NOT DISTINCT FROM y.repo"""


def _diff() -> str:
    a = f"({base(since='1995-01-01', until='1997-12-31')} {_SUMMARY})"
    b = f"({base(since='1998-01-01', until='2001-12-31')} {_SUMMARY})"
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, x.{m} AS period_a, y.{m} AS period_b, y.{m} - x.{m} AS delta FROM {a} x, {b} y" for m in ("total_commits", "total_devs", "total_files", "total_additions", "total_deletions"))


def oracle_sql() -> dict[str, str]:
    fine, coarse = base(), base("coarse")
    first = {"since": "1995-01-01", "until": "1997-12-31"}
    months = ", ".join(f"count(*) FILTER (WHERE month(ts) = {m}) AS m{m:02d}" for m in range(1, 13))
    focus = "SELECT email, round(CAST(sum(files * files) AS DOUBLE) / CAST(sum(files) * sum(files) AS DOUBLE), 6) AS specialization FROM ds GROUP BY email"
    found = {
        "summary": f"{fine} {_SUMMARY}",
        "summary_window": f"{base(**first)} {_SUMMARY}",
        "contributors": f"{fine} {_CONTRIBUTORS}",
        "contributors_top10": f"{coarse} {_CONTRIBUTORS} LIMIT 10",
        "dev_emails": f"{fine} SELECT DISTINCT email FROM c",
        "dev_registry": f"{fine} SELECT sha256(lower(trim(email))) AS dev_id, min(name) AS name, min(email) AS email FROM c GROUP BY 1",
        "hotspots": f"{fine} {_HOTSPOTS}",
        "hotspots_top10": f"{coarse} {_HOTSPOTS} LIMIT 10",
        "hotspots_window": f"{base(**first)} {_HOTSPOTS}",
        "hotspots_renamed": f"{base(renames=True)} {_HOTSPOTS}",
        "directories": f"{coarse} {_DIRECTORIES}",
        "extensions": f"{fine} {_EXTENSIONS}",
        "working_patterns": f"{fine} SELECT ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(ts_local)] AS day, CAST(hour(ts_local) AS INTEGER) AS hour, count(*) AS commits FROM c GROUP BY ALL",
        "top_commits": f"""{fine} SELECT sha, name AS author, email, strftime(ts, '%Y-%m-%d') AS date, a AS additions, d AS deletions, a + d AS lines_changed, n AS files_changed,
 CASE WHEN strlen(m) > 80 THEN substr(m, 1, 77) || '...' ELSE m END AS message FROM (SELECT *, 'order ' || ord || repeat(' x', CAST(ord % 60 AS INTEGER)) AS m FROM c)""",
        "activity_grid": f"{fine} SELECT strftime(ts, '%Y') AS year, {months} FROM c GROUP BY 1",
        "busfactor": f"{fine}, {_BUS} SELECT file AS path, bf AS bus_factor, top_devs FROM b",
        "coupling": f"{coarse}{_COUPLING}",
        "dev_network": f"{coarse}{_network(5)}",
        "dev_network_loose": f"{fine}{_network(1)}",
        "churn_risk": f"{fine}{_RISK} SELECT * FROM risk",
        "churn_risk_top20": f"{fine}{_RISK} SELECT * FROM risk ORDER BY {_PRIORITY}, recent_churn DESC, bus_factor, path LIMIT 20",
        "churn_risk_labels": f"{fine}{_RISK} SELECT label, count(*) AS files FROM risk GROUP BY label",
        "profile": f"{fine}{_PROFILE}",
        "directory_focus": f"{fine}, ds AS (SELECT email, {_DIRNAME} AS dir, count(*) AS files FROM au GROUP BY ALL) {focus}",
        "pareto": f"{fine} {_PARETO}",
        "pareto_coarse": f"{coarse} {_PARETO}",
        "structure": f"{coarse}{_tree()}",
        "structure_depth1": f"{fine}{_tree(1)}",
        "repo_breakdown": f"{base(multi=True)} {_breakdown()}",
        "repo_breakdown_dev": f"{base(multi=True)} {_breakdown('dev1@example.com')}",
        "repositories": f"{base(multi=True)} {_REPOSITORIES}",
        "repositories_window": f"{base(multi=True, **first)} {_REPOSITORIES}",
        "suspects": f"""{coarse} SELECT '*.lock' AS glob, 'generic lock file' AS reason, CAST(sum(a + d) FILTER (WHERE file LIKE '%.lock') AS BIGINT) AS churn,
 string_agg(DISTINCT file, ';' ORDER BY file) FILTER (WHERE file LIKE '%.lock') AS paths, '*.lock' AS suggestions, sum(a + d) FILTER (WHERE file LIKE '%.lock') / sum(a + d) >= {SUSPECT_FLOOR} AS worth_warning FROM f""",
        "diff": _diff(),
        "ci": f"""{fine}{_RISK} SELECT file, 'busfactor' AS rule, 'Bus factor 1 (only ' || top_devs || ')' AS message, 'warning' AS level FROM b WHERE bf = 1
 UNION ALL SELECT path, 'churn-risk', 'Churn risk ' || printf('%.1f', risk_score) || ' exceeds threshold 20', 'warning' FROM risk WHERE risk_score >= 20""",
        "activity_day": _activity("strftime(ts, '%Y-%m-%d')"),
        "activity_week": _activity("printf('%04d-W%02d', isoyear(ts), week(ts))"),
        "activity_month": _activity("strftime(ts, '%Y-%m')"),
        "activity_year": _activity("strftime(ts, '%Y')"),
    }
    for name in ("summary", "summary_window", "hotspots_window", "working_patterns", "extensions", "churn_risk", "coupling", "dev_registry", "hotspots_renamed"):
        found[f"lines_{name}"] = found[name]
    found["lines_two_inputs"] = _two_inputs()
    found["lines_repositories"] = _two_repositories()
    found["coupling_split_runs"] = found["lines_coupling_split_runs"] = f"{_split_runs()}{_COUPLING}"
    for name in ("summary_window", "hotspots_window", "churn_risk", "coupling"):
        found[f"store_{name}"] = found[name]
    without = "SELECT * EXCLUDE (recent_churn) FROM"
    found["merged_contributors"], found["merged_directories"], found["merged_extensions"] = found["contributors"], found["directories"], f"{fine} {without} ({_EXTENSIONS})"
    found["merged_contributors_window"], found["merged_directories_window"] = f"{base(**first)} {_CONTRIBUTORS}", f"{base('coarse', **first)} {_DIRECTORIES}"
    found["merged_extensions_window"] = f"{base(**first)} {without} ({_EXTENSIONS})"
    found["merged_contributors_two_parts"] = f"{base(since='1995-01-01', until='2001-12-31')} {_CONTRIBUTORS}"
    found["odd_coupling"] = f"{_odd()}{_COUPLING}"
    found["odd_suspects"] = f"""{_odd()}, p AS (SELECT file, sum(a) AS churn FROM f GROUP BY file),
t AS (SELECT p.file, p.churn, s.pattern, s.reason, CASE WHEN prefix AND strpos(file, '/') > 0 THEN regexp_extract(file, '^(.*?)/?' || replace(pattern, '/*', '') || '/', 1) || '/' || pattern ELSE pattern END AS suggestion
 FROM p JOIN ({_odd_patterns()}) s ON regexp_full_match(p.file, s.rule))
 SELECT pattern AS glob, reason, CAST(sum(churn) AS BIGINT) AS churn, count(*) AS files, string_agg(DISTINCT suggestion, ';' ORDER BY suggestion) AS suggestions,
  (SELECT sum(churn) FROM t) / (SELECT sum(churn) FROM p) >= {SUSPECT_FLOOR} AS worth_warning FROM t GROUP BY pattern, reason"""
    return found


def _two_inputs() -> str:
    """repo_breakdown of two inputs, each a period of the test bed."""
    rows = " UNION ALL ".join(
        f"SELECT '{repo}' AS repo, a, d, email, ts FROM ({base(since=since, until=until)} SELECT * FROM c)"
        for repo, since, until in (("history0", "1995-01-01", "1997-12-31"), ("history1", "1998-01-01", "2001-12-31"))
    )
    files = " UNION ALL ".join(
        f"SELECT '{repo}' AS repo, file FROM ({base(since=since, until=until)} SELECT * FROM f)" for repo, since, until in (("history0", "1995-01-01", "1997-12-31"), ("history1", "1998-01-01", "2001-12-31"))
    )
    return f"""SELECT repo, commits, additions, deletions, churn, coalesce(files, 0) AS files, active_days, unique_devs, first_date, last_date,
 {_round('commits * 100.0 / sum(commits) OVER ()', 1)} AS commits_pct, {_round('churn * 100.0 / sum(churn) OVER ()', 1)} AS churn_pct FROM
 (SELECT repo, count(*) AS commits, CAST(sum(a) AS BIGINT) AS additions, CAST(sum(d) AS BIGINT) AS deletions, CAST(sum(a + d) AS BIGINT) AS churn, count(DISTINCT CAST(ts AS DATE)) AS active_days,
   count(DISTINCT email) AS unique_devs, {_DAY.format('min(ts)')} AS first_date, {_DAY.format('max(ts)')} AS last_date FROM ({rows}) GROUP BY repo)
 LEFT JOIN (SELECT repo, count(DISTINCT file) AS files FROM ({files}) GROUP BY repo) USING (repo)"""


def _two_repositories() -> str:
    """_REPOSITORIES of two inputs, each a period of the test bed."""
    periods = (("history0", "1995-01-01", "1997-12-31"), ("history1", "1998-01-01", "2001-12-31"))
    both = lambda rows: " UNION ALL ".join(f"SELECT '{repo}' AS repo, * EXCLUDE (repo) FROM ({base(since=since, until=until)} SELECT * FROM {rows})" for repo, since, until in periods)
    return f"WITH c AS ({both('c')}), f AS ({both('f')}) {_REPOSITORIES}"


def _split_runs() -> str:
    """File rows in halves of four commits; a run of one commit's neighbouring rows stands for the commit.

    Rows of one half tie in (ord, k), so the running sum takes them together (RANGE): which of them lag() saw first plays no part."""
    return f"""WITH l0 AS (SELECT l_orderkey AS k, ((l_orderkey // 4) * 2 + CAST(l_linenumber > 3 AS BIGINT)) * 4 + l_orderkey % 4 AS ord, {_PATH['coarse']} AS file,
  CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE trunc(l_quantity) END AS BIGINT) AS a, CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE round(l_discount * 100) END AS BIGINT) AS d FROM lineitem JOIN part ON p_partkey = l_partkey),
l1 AS (SELECT *, CASE WHEN k = lag(k) OVER (ORDER BY ord, k) THEN 0 ELSE 1 END AS starts FROM l0),
f AS (SELECT sum(starts) OVER (ORDER BY ord, k RANGE UNBOUNDED PRECEDING) AS sha, file, a, d FROM l1)"""


def _odd() -> str:
    """The test bed's wide commits under odd names."""
    names = ", ".join(f"'{n}'" for n in ODD_NAMES)
    return f"""WITH l0 AS (SELECT l_orderkey - l_orderkey % 32 AS k, l_partkey, l_suppkey, CAST(trunc(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_orderkey % 32 <= (l_orderkey // 32) % 24),
f AS (SELECT lpad(CAST(k AS VARCHAR), 8, '0') AS sha, (l_partkey % 5) || '/' || ([{names}])[l_suppkey % {len(ODD_NAMES)} + 1] AS file, CASE WHEN (k // 32) % 3 = 0 THEN q % 4 ELSE q END AS a, 0 AS d FROM l0)"""


def _odd_patterns() -> str:
    """(pattern, reason, rule, prefix): the patterns as regular expressions, each path by the first that fits (none of the odd names fits two but yarn.lock and the like)."""
    rules = {"segment": "(.*/)?{}/.*", "suffix": ".*{}", "name": "(.*/)?{}", "inside": "(.*/)?[^/]*{}[^/]*"}
    rows = []
    for glob, reason, kind, text in SUSPECTS:
        rule = rules[kind].format(text.replace(".", "[.]"))
        if kind == "name" and text.endswith(".lock"):
            continue  # the pattern *.lock comes first
        rows.append(f"SELECT '{glob}' AS pattern, '{reason}' AS reason, '{rule}' AS rule, {'true' if kind == 'segment' else 'false'} AS prefix")
    return " UNION ALL ".join(rows)
