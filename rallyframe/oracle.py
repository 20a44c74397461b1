"""The same queries as plain SQL, for comparison on the driver tables."""

from __future__ import annotations

_EV = """ev AS (
  SELECT event_id, user_id, event_type, value, ts, CAST(ts AS DATE) AS d FROM events
)"""

_POINTS = f"""{_EV},
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, d, event_type ORDER BY event_id) AS rn FROM ev
),
points AS (
  SELECT s.user_id, s.d, s.event_id AS serve_id, s.value AS serve_value,
         r.event_id AS receive_id, r.value AS receive_value,
         t.event_id AS set_id, t.value AS set_value,
         a.event_id AS attack_id, a.value AS attack_value, o.event_id AS outcome_id
  FROM (SELECT * FROM firsts WHERE event_type = 'view' AND rn = 1) s
  JOIN (SELECT * FROM firsts WHERE event_type = 'click' AND rn = 1) r ON s.user_id = r.user_id AND s.d = r.d
  LEFT JOIN (SELECT * FROM firsts WHERE event_type = 'signup' AND rn = 1) t ON s.user_id = t.user_id AND s.d = t.d
  LEFT JOIN (SELECT * FROM firsts WHERE event_type = 'purchase' AND rn = 1) a ON s.user_id = a.user_id AND s.d = a.d
  LEFT JOIN (SELECT * FROM firsts WHERE event_type = 'error' AND rn = 1) o ON s.user_id = o.user_id AND s.d = o.d
)"""

_ORDER_LINES = """ol AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_returnflag, o.o_custkey,
         c.c_name AS customer_name, cn.n_name AS customer_nation, c.c_acctbal AS customer_balance,
         s.s_name AS supplier_name, sn.n_name AS supplier_nation, s.s_acctbal AS supplier_balance
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  LEFT JOIN nation sn ON s.s_nationkey = sn.n_nationkey
)"""

_FLAGS = f"""{_POINTS},
banded AS (
  SELECT user_id, d, set_id, attack_id,
    CASE WHEN set_value < 10 THEN '#' WHEN set_value < 20 THEN '+' WHEN set_value < 30 THEN '!'
         WHEN set_value < 40 THEN '-' WHEN set_value < 60 THEN '/' WHEN set_value >= 60 THEN '=' END AS serve,
    CASE WHEN attack_value < 10 THEN '#' WHEN attack_value < 20 THEN '+' WHEN attack_value < 30 THEN '!'
         WHEN attack_value < 40 THEN '-' WHEN attack_value < 60 THEN '/' WHEN attack_value >= 60 THEN '=' END AS receive
  FROM points
),
flags AS (
  SELECT user_id, d, serve = '#' AS is_ace,
    (receive = '/') OR (receive IS NOT NULL AND receive = '=') AS is_overpass,
    coalesce(receive IN ('-', '!'), FALSE) AS out_of_system,
    set_id IS NULL AS no_set, attack_id IS NULL AS no_attack
  FROM banded
)"""

_USERS = f"""{_EV},
dict AS (
  SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS label FROM ev WHERE ts < TIMESTAMP '2024-01-02')
)"""

_JOINT = """joint AS (
  SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx FROM (
    SELECT l_returnflag AS label FROM lineitem UNION SELECT l_linestatus FROM lineitem
    UNION SELECT o_orderstatus FROM orders)
)"""

_HISTORY = f"""{_EV},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ev
),
hist AS (
  SELECT n.*, b.event_type AS prev_type
  FROM numbered n JOIN numbered b ON b.user_id = n.user_id AND b.rn = n.rn - 1
),
court AS (
  SELECT DISTINCT n.event_id, b.event_type AS class
  FROM numbered n JOIN numbered b ON b.user_id = n.user_id AND b.rn BETWEEN n.rn - 6 AND n.rn - 1
  WHERE b.value >= 20
),
freq AS (
  SELECT prev_type, event_type, n, n * 1.0 / sum(n) OVER (PARTITION BY prev_type) AS p FROM (
    SELECT prev_type, event_type, count(*) AS n FROM hist WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2)
),
classes AS (SELECT DISTINCT event_type AS class FROM freq),
raw AS (
  SELECT h.event_id, h.user_id, h.d, h.ts, h.value, h.event_type AS actual, c.class,
         row_number() OVER (PARTITION BY h.event_id ORDER BY c.class) - 1 AS class_index,
         coalesce(f.p, 0.0) AS p0,
         CASE WHEN court.class IS NOT NULL THEN coalesce(f.p, 0.0) ELSE 0.0 END AS p1
  FROM hist h CROSS JOIN classes c
  LEFT JOIN freq f ON f.prev_type = h.prev_type AND f.event_type = c.class
  LEFT JOIN court ON court.event_id = h.event_id AND court.class = c.class
),
masses AS (SELECT event_id, sum(p1 ORDER BY class) AS mass FROM raw GROUP BY event_id),
masked AS (
  SELECT raw.*, CASE WHEN mass > 0 THEN p1 / mass ELSE p1 END AS p
  FROM raw JOIN masses ON masses.event_id = raw.event_id
)"""

_SCORED = f"""{_HISTORY},
scored AS (
  SELECT *, top_predicted = actual AS prediction_correct, top_predicted <> actual AS chose_non_top,
    CAST(user_id % 6 + 1 AS INTEGER) AS rotation,
    CASE WHEN day(d) <= 10 THEN 'pre' WHEN day(d) <= 20 THEN 'conf1' ELSE 'conf2' END AS period
  FROM (
    SELECT event_id, any_value(user_id) AS user_id, any_value(d) AS d, any_value(ts) AS ts,
      any_value(value) AS value, any_value(actual) AS actual,
      0.0 - sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END ORDER BY class) + 0.0 AS pred_entropy,
      first(class ORDER BY p DESC, class) AS top_predicted,
      max(CASE WHEN class = actual THEN p END) AS p_actual
    FROM masked GROUP BY event_id)
)"""

_SIX = """
    avg(CAST(prediction_correct AS DOUBLE)) AS overall_accuracy,
    avg(CASE WHEN value >= 20 THEN CAST(prediction_correct AS DOUBLE) END) AS insystem_accuracy,
    avg(CAST(chose_non_top AS DOUBLE)) AS non_top_rate_all,
    avg(CASE WHEN value >= 20 THEN CAST(chose_non_top AS DOUBLE) END) AS non_top_rate_insystem,
    avg(pred_entropy) AS mean_entropy_all,
    avg(CASE WHEN value >= 20 THEN pred_entropy END) AS mean_entropy_insystem"""

_METRICS = [
    "overall_accuracy",
    "insystem_accuracy",
    "non_top_rate_all",
    "non_top_rate_insystem",
    "mean_entropy_all",
    "mean_entropy_insystem",
]

_REPORT = f"""{_SCORED},
test AS (SELECT * FROM scored WHERE ts >= TIMESTAMP '2024-01-25'),
labels AS (SELECT actual AS label FROM test UNION SELECT top_predicted FROM test),
tallies AS (
  SELECT label,
    (SELECT count(*) FROM test WHERE actual = label AND top_predicted = label) AS hits,
    (SELECT count(*) FROM test WHERE actual = label) AS support,
    (SELECT count(*) FROM test WHERE top_predicted = label) AS n_predicted
  FROM labels
),
rates AS (
  SELECT *, CASE WHEN n_predicted > 0 THEN hits * 1.0 / n_predicted ELSE 0.0 END AS "precision",
    CASE WHEN support > 0 THEN hits * 1.0 / support ELSE 0.0 END AS recall
  FROM tallies
),
report AS (
  SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall)
                 ELSE 0.0 END AS f1
  FROM rates
)"""

_SHARE = f"""{_EV},
share AS (
  SELECT user_id, event_type, n, n * 1.0 / sum(n) OVER (PARTITION BY user_id) AS share
  FROM (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2)
)"""

_EVALUATION = "substr('#+!-/=', CAST(floor(value) AS INTEGER) % 6 + 1, 1)"
_TOUCH = "event_type <> 'error'"


_SLOTS = [f"{side}_p{slot}" for side in ("recv", "opp") for slot in range(1, 7)]


def _court_slot(name: str) -> str:
    """Who stands in a slot: the user's side plays at home for even users, and always receives here."""
    slot = name[-1]
    home, visiting = (
        f"CAST(-((user_id + {slot}) % 20) AS VARCHAR)",
        f"CAST(-(100 + (event_id + {slot}) % 15) AS VARCHAR)",
    )
    first, second = (home, visiting) if name.startswith("recv") else (visiting, home)
    return f"CASE WHEN user_id % 2 = 0 THEN {first} ELSE {second} END AS {name}"


_COURT = ", ".join(_court_slot(name) for name in _SLOTS)

_FEATURES = f"""{_EV},
season AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS point_id,
    CASE WHEN user_id % 3 = 0 THEN 'pre' ELSE 'conf1' END AS period,
    substr('#+!-/=?', CAST(floor(value) AS INTEGER) % 7 + 1, 1) AS code,
    CAST(-(event_id % 40) AS VARCHAR) AS server, CAST(-(event_id % 12) AS VARCHAR) AS attacker
  FROM ev
),
focus AS MATERIALIZED (SELECT * FROM season WHERE value >= 20 AND event_type <> 'error'),
lagged AS (
  SELECT *, lag(attacker) OVER w AS before, coalesce(lag(point_id) OVER w = point_id - 1, FALSE) AS gate,
    lag(event_id) OVER w AS before_event
  FROM focus WINDOW w AS (PARTITION BY user_id, d ORDER BY event_id)
),
rows_ AS MATERIALIZED (
  SELECT *, CASE WHEN gate THEN before ELSE 'none' END AS prev_label,
    CASE WHEN gate AND before_event % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prev_point_won,
    {_COURT}
  FROM lagged
),
train AS MATERIALIZED (SELECT * FROM rows_ WHERE ts < TIMESTAMP '2024-01-25'),
servers AS (
  SELECT period, label, CAST(row_number() OVER (PARTITION BY period ORDER BY label) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT period, server AS label FROM train)),
players AS (
  SELECT period, label, CAST(row_number() OVER (PARTITION BY period ORDER BY label) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT period, unnest([{", ".join(_SLOTS)}]) AS label FROM train)),
befores AS (
  SELECT period, label, CAST(row_number() OVER (PARTITION BY period ORDER BY label) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT period, prev_label AS label FROM train)),
targets AS (
  SELECT period, label, CAST(row_number() OVER (PARTITION BY period ORDER BY label) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT period, attacker AS label FROM train)),
tops AS (
  SELECT period, attacker, event_type FROM (
    SELECT period, attacker, event_type,
      row_number() OVER (PARTITION BY period, attacker ORDER BY count(*) DESC, event_type) AS rn
    FROM train GROUP BY 1, 2, 3) WHERE rn = 1),
top_codes AS (
  SELECT period, event_type, CAST(row_number() OVER (PARTITION BY period ORDER BY event_type) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT period, event_type FROM tops))"""


def _metric_rows(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS metric, round({name}, 6) AS value FROM {source}" for name in _METRICS
    )


def _metric_by_period() -> str:
    picked = ", ".join(
        f"round(max(CASE WHEN period = '{p}' THEN value END), 6) AS {p}" for p in ("pre", "conf1", "conf2")
    )
    listed = " UNION ALL ".join(f"SELECT period, '{name}' AS metric, {name} AS value FROM by_period" for name in _METRICS)
    return f"SELECT metric, {picked} FROM ({listed}) GROUP BY metric"


_SEGMENTED = f"""{_EV},
scan AS (
  SELECT *, event_type = 'error' AS is_point,
    CASE WHEN event_id % 2 = 0 THEN '*' ELSE 'a' END AS side,
    coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER prior, 0) AS points_before,
    max(CASE WHEN event_type = 'error' THEN event_id END) OVER prior AS point_at,
    max(CASE WHEN event_type = 'view' THEN event_id END) OVER upto AS serve_at,
    max(CASE WHEN event_type IN ('click', 'signup', 'purchase') AND event_id % 2 = 0 THEN event_id END) OVER upto AS home_at,
    max(CASE WHEN event_type IN ('click', 'signup', 'purchase') AND event_id % 2 = 1 THEN event_id END) OVER upto AS away_at
  FROM ev
  WINDOW prior AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upto AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
joined AS (
  SELECT s.*, p.d AS point_d, CAST(floor(p.value) AS INTEGER) % 30 AS hp, CAST(p.event_id % 30 AS INTEGER) AS vp
  FROM scan s LEFT JOIN ev p ON p.event_id = s.point_at),
segmented AS (
SELECT joined.*, CAST(points_before + 1 AS INTEGER) AS point_id,
  CASE WHEN event_type = 'view' THEN 'Serve'
       WHEN is_point OR serve_at IS NULL OR serve_at <= coalesce(point_at, -1) THEN NULL
       WHEN event_id % 2 = serve_at % 2 THEN 'Transition'
       WHEN (CASE WHEN serve_at % 2 = 0 THEN home_at ELSE away_at END) > serve_at THEN 'Transition'
       ELSE 'Reception' END AS phase,
  CASE WHEN point_d = d THEN hp ELSE 0 END AS home_team_score,
  CASE WHEN point_d = d THEN vp ELSE 0 END AS visiting_team_score
FROM joined)"""

_SETTERS = "CAST(event_id % 6 + 1 AS INTEGER) AS home_setter_position, CAST(user_id % 6 + 1 AS INTEGER) AS visiting_setter_position"
_ON_COURT = ", ".join(
    f"CAST({shirt} AS INTEGER) AS {who}_p{slot}, "
    f"CASE WHEN {shirt} % 9 <> 0 THEN CAST(-({first} + {shirt}) AS VARCHAR) END AS {who}_player_id{slot}"
    for place, (who, first) in enumerate((("home", 1000), ("visiting", 2000)))
    for slot in range(1, 7)
    for shirt in [f"((event_id + {6 * place + slot - 1}) % 100)"]
)


def _first(name: str, test: str) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, point_id ORDER BY event_id) AS place FROM touched WHERE {test})
  WHERE place = 1)"""


_SERVE_RECEIVE = f"""{_SEGMENTED},
touched AS (
  SELECT user_id, event_id, event_type, point_id, phase, home_team_score, visiting_team_score,
    CAST(day(ts) AS INTEGER) AS set_number, {_SETTERS}, {_ON_COURT},
    CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS team, {_EVALUATION} AS code,
    (CASE WHEN event_id % 2 = 0 THEN 1000 ELSE 2000 END) + user_id % 100 AS number
  FROM segmented),
names AS (
  SELECT user_id, number, 'P' || number || '/' || (min(event_id) % 3) AS name
  FROM touched WHERE event_type <> 'error' GROUP BY user_id, number),
{_first("serve", "event_type = 'view'")},
{_first("reception", "event_type = 'click'")},
{_first("setting", "event_type = 'signup' AND phase = 'Reception'")},
{_first("attack", "event_type = 'purchase' AND phase = 'Reception'")},
{_first("outcome", "event_type = 'error'")},
assembled AS (
  SELECT s.user_id, s.point_id, s.set_number, s.team AS serving_team, r.team AS receiving_team,
    'A' AS home_team, 'B' AS visiting_team, '1' AS home_team_id, '2' AS visiting_team_id,
    s.home_setter_position, s.visiting_setter_position, {", ".join(f"s.{who}_p{k}, s.{who}_player_id{k}" for who in ("home", "visiting") for k in range(1, 7))},
    CAST(-s.number AS VARCHAR) AS server_id, sn.name AS server_name, s.code AS serve_eval_code,
    CAST(-r.number AS VARCHAR) AS receiver_id, rn.name AS receiver_name, r.code AS receive_eval_code,
    CAST(-e.number AS VARCHAR) AS setter_id, en.name AS setter_name,
    CASE WHEN e.event_id IS NOT NULL THEN 'K' || (e.event_id % 10) END AS set_code,
    CASE WHEN e.event_id IS NOT NULL THEN substr('FBCPS', CAST(e.event_id % 5 + 1 AS INTEGER), 1) END AS set_type,
    CAST(-a.number AS VARCHAR) AS attacker_id, an.name AS attacker_name,
    CASE WHEN a.event_id % 7 <> 0 THEN 'X' || (a.event_id % 10) END AS attack_code, a.code AS attack_eval_code,
    s.home_team_score AS home_score_start_of_point, s.visiting_team_score AS visiting_score_start_of_point,
    s.home_team_score - s.visiting_team_score AS score_diff, o.team AS point_won_by,
    s.code = '#' AS is_ace, r.code = '/' OR r.code = '=' AS is_overpass, r.code IN ('-', '!') AS out_of_system,
    e.event_id IS NULL AS no_set, a.event_id IS NULL AS no_attack
  FROM serve s JOIN reception r ON r.user_id = s.user_id AND r.point_id = s.point_id
  LEFT JOIN setting e ON e.user_id = s.user_id AND e.point_id = s.point_id
  LEFT JOIN attack a ON a.user_id = s.user_id AND a.point_id = s.point_id
  LEFT JOIN outcome o ON o.user_id = s.user_id AND o.point_id = s.point_id
  LEFT JOIN names sn ON sn.user_id = s.user_id AND sn.number = s.number
  LEFT JOIN names rn ON rn.user_id = s.user_id AND rn.number = r.number
  LEFT JOIN names en ON en.user_id = s.user_id AND en.number = e.number
  LEFT JOIN names an ON an.user_id = s.user_id AND an.number = a.number
  WHERE s.team <> r.team),
serve_receive AS (
  SELECT *, lag(point_won_by) OVER (PARTITION BY user_id ORDER BY point_id) = 'A' AS prev_point_won FROM assembled)"""

_UPDATED = f"""{_HISTORY},
seen AS (
  SELECT n.event_id, c.class, n.rn - 1 AS n_seen,
    coalesce(sum(CASE WHEN n.event_type = c.class THEN 1 ELSE 0 END) OVER (
      PARTITION BY n.user_id, c.class ORDER BY n.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS times
  FROM numbered n CROSS JOIN classes c
),
posterior AS (
  SELECT raw.event_id, raw.class, raw.actual, n_seen,
    CASE WHEN court.class IS NOT NULL
      THEN (CAST(10 AS DOUBLE) * p0 + times) / (CAST(10 AS DOUBLE) + n_seen) ELSE 0.0 END AS q1
  FROM raw JOIN seen ON seen.event_id = raw.event_id AND seen.class = raw.class
  LEFT JOIN court ON court.event_id = raw.event_id AND court.class = raw.class
),
weights AS (SELECT event_id, sum(q1 ORDER BY class) AS mass FROM posterior GROUP BY event_id),
updated AS (
  SELECT posterior.*, CASE WHEN mass > 0 THEN q1 / mass ELSE q1 END AS q
  FROM posterior JOIN weights ON weights.event_id = posterior.event_id
)"""

_CONFIDENCE = f"""{_SCORED},
tops AS (SELECT event_id, max(p) AS confidence, sum(p * p) AS squares FROM masked GROUP BY event_id),
cells AS (
  SELECT period, least(CAST(floor(confidence * 16384) AS BIGINT), 16383) AS cell, count(*) AS n,
    sum(confidence) AS total, sum(CASE WHEN prediction_correct THEN 1 ELSE 0 END) AS hits
  FROM scored JOIN tops ON tops.event_id = scored.event_id GROUP BY 1, 2
),
binned AS (
  SELECT *, CAST((sum(n) OVER (PARTITION BY period ORDER BY cell) - n) * 8 // sum(n) OVER (PARTITION BY period)
    AS INTEGER) AS bin
  FROM cells
),
bins AS (
  SELECT period, bin, CAST(sum(n) AS BIGINT) AS n, sum(total) / sum(n) AS mean_confidence, sum(hits) / sum(n) AS hit_rate
  FROM binned GROUP BY period, bin
)"""

SQL: dict[str, str] = {
    "q01_first_touch": f"""WITH {_EV}
SELECT user_id, CAST(d AS VARCHAR) AS d, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, d, event_type ORDER BY event_id) AS rn FROM ev)
WHERE rn = 1""",
    "q02_points": f"""WITH {_POINTS}
SELECT user_id, CAST(d AS VARCHAR) AS d, serve_id, serve_value, receive_id, receive_value, set_id, attack_id,
  outcome_id, set_id IS NULL AS no_set, attack_id IS NULL AS no_attack FROM points""",
    "q03_role_lookup": f"""WITH {_ORDER_LINES}
SELECT l_orderkey, l_linenumber, l_partkey, customer_name, customer_nation, supplier_name, supplier_nation FROM ol""",
    "q04_score_diff": f"""WITH {_POINTS}
SELECT user_id, CAST(d AS VARCHAR) AS d,
  round(CASE WHEN user_id % 3 = 0 THEN serve_value - receive_value
             WHEN user_id % 3 = 1 THEN receive_value - serve_value END, 6) AS score_diff
FROM points""",
    "q05_flags": f"""WITH {_FLAGS}
SELECT user_id, CAST(d AS VARCHAR) AS d, is_ace, is_overpass, out_of_system, no_set, no_attack FROM flags""",
    "q05_flag_rates": f"""WITH {_FLAGS}
"""
    + " UNION ALL ".join(
        f"SELECT '{flag}' AS flag, CAST(coalesce(sum(CAST({flag} AS INTEGER)), 0) AS BIGINT) AS n, "
        f"round(avg(CAST({flag} AS DOUBLE)), 6) AS rate FROM flags"
        for flag in ("is_ace", "is_overpass", "out_of_system", "no_set", "no_attack")
    ),
    "q06_side_select": f"""WITH {_ORDER_LINES}
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_returnflag = 'R' THEN customer_nation ELSE supplier_nation END AS recv_nation,
  CASE WHEN l_returnflag = 'R' THEN supplier_nation ELSE customer_nation END AS opp_nation,
  CASE WHEN l_returnflag = 'R' THEN o_custkey ELSE l_suppkey END AS recv_key,
  CASE WHEN l_returnflag = 'R' THEN l_suppkey ELSE o_custkey END AS opp_key,
  CASE WHEN l_returnflag = 'R' THEN customer_balance ELSE supplier_balance END AS recv_balance,
  CASE WHEN l_returnflag = 'R' THEN supplier_balance ELSE customer_balance END AS opp_balance
FROM ol""",
    "q07_lag_ungated": f"""WITH {_EV}
SELECT event_id, user_id, before = 'purchase' AS prev_is_purchase, coalesce(before, 'none') AS prev_actor,
  CASE WHEN before = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prev_won
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM ev)""",
    "q08_lag_gated": f"""WITH {_EV},
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS point_id FROM ev),
lagged AS (
  SELECT *, lag(point_id) OVER w AS bp, lag(event_type) OVER w AS bt FROM numbered WHERE event_type <> 'error'
  WINDOW w AS (PARTITION BY user_id, d ORDER BY event_id)),
gated AS (SELECT *, coalesce(point_id = bp + 1, FALSE) AS g FROM lagged)
SELECT event_id, user_id, CAST(d AS VARCHAR) AS d, point_id, g AS is_consecutive,
  CASE WHEN g THEN bt ELSE 'none' END AS prev_actor,
  CASE WHEN g AND bt = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prev_won
FROM gated""",
    "q09_share": f"""WITH {_SHARE}
SELECT user_id, event_type, n, round(share, 6) AS share FROM share""",
    "q10_top_code": f"""WITH {_SHARE}
SELECT user_id, event_type, round(share, 6) AS share FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM share)
WHERE rn = 1""",
    "q11_label_encode": """SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS idx
FROM (SELECT DISTINCT p_brand FROM part)""",
    "q12_encode_unseen": f"""WITH {_USERS}
SELECT event_id, user_id, coalesce(idx, -1) AS user_enc
FROM ev LEFT JOIN dict ON dict.label = CAST(user_id AS VARCHAR)""",
    "q13_joint_dictionary": f"""WITH {_JOINT} SELECT label, idx FROM joint""",
    "q13_joint_encode": f"""WITH {_JOINT}
SELECT l_orderkey, l_linenumber, l_partkey, a.idx AS l_returnflag_enc, b.idx AS l_linestatus_enc
FROM lineitem JOIN joint a ON a.label = l_returnflag JOIN joint b ON b.label = l_linestatus""",
    "q14_target_encode": f"""WITH {_USERS}
SELECT event_id, user_id, idx AS target FROM ev JOIN dict ON dict.label = CAST(user_id AS VARCHAR)""",
    "q15_code_map": """SELECT o_orderkey, o_orderpriority,
  CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
       WHEN '5-LOW' THEN 5 END AS INTEGER) AS priority_number
FROM orders""",
    "q15_unmapped": """SELECT o_orderpriority, count(*) AS n FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') GROUP BY 1""",
    "q16_value_counts": """SELECT 'event_type' AS source, event_type AS value, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2""",
    "q16_distinct_days": f"""WITH {_EV} SELECT DISTINCT CAST(d AS VARCHAR) AS d FROM ev""",
    "q17_period_split": f"""WITH {_EV}
SELECT CAST(floor(date_diff('day', DATE '2024-01-01', d) / 7.0) AS INTEGER) AS week,
  CASE WHEN ts < TIMESTAMP '2024-01-25' THEN 'train' ELSE 'test' END AS split,
  count(*) AS n_rows, count(DISTINCT user_id) AS n_users
FROM ev GROUP BY 1, 2""",
    "q18_split_by_set": f"""WITH {_EV}
SELECT event_id, CASE WHEN day(d) <= 20 THEN 'train' WHEN day(d) = 21 THEN 'test' ELSE 'hold_out' END AS part
FROM ev WHERE day(d) BETWEEN 1 AND 22""",
    "q19_attack_profile": f"""WITH {_EV},
top AS (
  SELECT user_id, event_type FROM (
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn
    FROM ev WHERE ts < TIMESTAMP '2024-01-25' GROUP BY user_id, event_type) WHERE rn = 1),
ranked AS (
  SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT event_type FROM top))
SELECT ev.event_id, ev.user_id, ranked.idx AS top_enc
FROM ev LEFT JOIN top ON ev.user_id = top.user_id LEFT JOIN ranked ON top.event_type = ranked.event_type""",
    "q20_unseen": f"""WITH {_EV}
SELECT DISTINCT user_id FROM ev WHERE user_id NOT IN (SELECT user_id FROM ev WHERE ts < TIMESTAMP '2024-01-02')""",
    "q21_union": """SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-25' THEN 'train' ELSE 'test' END AS split, value
FROM events""",
    "q21_label_union": """SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02'
UNION SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-25'""",
    "q49_forest": f"""WITH {_FEATURES},
full_ AS (
  SELECT r.event_id, prev_label, attacker, e.ts FROM rows_ r JOIN ev e ON e.event_id = r.event_id WHERE code <> '?'),
learned AS (SELECT * FROM full_ WHERE ts < TIMESTAMP '2024-01-25'),
later AS (SELECT * FROM full_ WHERE ts >= TIMESTAMP '2024-01-25' AND attacker IN (SELECT attacker FROM learned)),
shares_ AS (
  SELECT prev_label, attacker, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY prev_label) AS p
  FROM learned GROUP BY 1, 2),
losses AS (
  SELECT -ln(greatest(least(coalesce(p, 0.0), 1.0::DOUBLE - 2.220446049250313e-16), 2.220446049250313e-16)) AS loss
  FROM later LEFT JOIN shares_ ON shares_.prev_label = later.prev_label AND shares_.attacker = later.attacker
  WHERE later.prev_label IN (SELECT prev_label FROM learned))
SELECT (SELECT CAST(count(*) AS INTEGER) FROM learned) AS n_train, (SELECT count(*) FROM later) AS n_test,
  0::BIGINT AS n_bad_sum, 16 AS n_features, (SELECT CAST(count(DISTINCT attacker) AS INTEGER) FROM learned) AS n_classes,
  round(avg(loss), 6) AS frequency_log_loss, TRUE AS forest_is_better
FROM losses""",
    "q50_many_classes": f"""WITH {_EV},
numbered AS (
  SELECT *, CAST(user_id AS VARCHAR) AS usr, row_number() OVER (PARTITION BY d ORDER BY event_id) AS rn FROM ev),
share AS (
  SELECT event_type, usr, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY event_type) AS p FROM numbered
  WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2),
court AS (
  SELECT DISTINCT n.event_id, n.event_type, b.usr
  FROM numbered n JOIN numbered b ON b.d = n.d AND b.rn BETWEEN n.rn - 6 AND n.rn - 1),
kept AS (
  SELECT event_id, court.usr, p FROM court
  JOIN share ON share.event_type = court.event_type AND share.usr = court.usr),
masses AS (SELECT event_id, sum(p ORDER BY usr) AS mass FROM kept GROUP BY event_id),
scaled AS (SELECT kept.event_id, usr, p / mass AS p FROM kept JOIN masses ON masses.event_id = kept.event_id),
tops AS (
  SELECT event_id, 0.0 - sum(p * ln(p) ORDER BY usr) + 0.0 AS pred_entropy, first(usr ORDER BY p DESC, usr) AS best
  FROM scaled GROUP BY event_id),
picked AS (
  SELECT n.event_id, n.usr, coalesce(pred_entropy, 0.0) AS pred_entropy,
    coalesce(best, (SELECT min(usr) FROM share)) AS top_predicted, coalesce(s.p, 0.0) AS p_actual
  FROM numbered n LEFT JOIN tops ON tops.event_id = n.event_id
  LEFT JOIN scaled s ON s.event_id = n.event_id AND s.usr = n.usr
  WHERE n.event_type IN (SELECT event_type FROM share))
SELECT event_id, round(pred_entropy, 6) AS pred_entropy, top_predicted, top_predicted = usr AS prediction_correct,
  round(p_actual, 6) AS p_actual FROM picked""",
    "q46_bayes_updated": f"""WITH {_UPDATED}
SELECT event_id, any_value(n_seen) AS n_seen, round(max(CASE WHEN class = actual THEN q END), 6) AS p_actual,
  round(0.0 - sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0.0 END ORDER BY class) + 0.0, 6) AS pred_entropy,
  first(class ORDER BY q DESC, class) AS top_predicted
FROM updated GROUP BY event_id""",
    "q47_reliability": f"""WITH {_CONFIDENCE}
SELECT period, bin, n, round(mean_confidence, 6) AS mean_confidence, round(hit_rate, 6) AS hit_rate FROM bins""",
    "q47_brier": f"""WITH {_CONFIDENCE},
means AS (
  SELECT period, count(*) AS n, avg(squares - 2 * coalesce(p_actual, 0.0) + 1) AS brier
  FROM scored JOIN tops ON tops.event_id = scored.event_id GROUP BY period),
errors AS (SELECT period, sum(n * abs(mean_confidence - hit_rate)) / sum(n) AS gap FROM bins GROUP BY period)
SELECT means.period, n, round(brier, 6) AS brier, round(gap, 6) AS calibration_error
FROM means JOIN errors ON errors.period = means.period""",
    "q48_live_scoring": f"""WITH {_SCORED}
SELECT scored.event_id, prev_type, round(pred_entropy, 6) AS pred_entropy, top_predicted, prediction_correct
FROM scored JOIN hist ON hist.event_id = scored.event_id""",
    "q22_frequency_model": f"""WITH {_HISTORY} SELECT prev_type, event_type, n, round(p, 6) AS p FROM freq""",
    "q23_masked": f"""WITH {_HISTORY} SELECT event_id, class, round(p, 6) AS p FROM masked""",
    "q24_scored": f"""WITH {_SCORED}
SELECT event_id, round(pred_entropy, 6) + 0.0 AS pred_entropy, top_predicted, prediction_correct, chose_non_top
FROM scored""",
    "q25_summary": f"""WITH {_SCORED}, summary AS (SELECT {_SIX} FROM scored)
{_metric_rows("summary")}""",
    "q26_by_rotation": f"""WITH {_SCORED}
SELECT CAST(r.rotation AS INTEGER) AS rotation, round(avg(pred_entropy), 6) AS mean_entropy,
  round(avg(CAST(chose_non_top AS DOUBLE)), 6) AS non_top_rate
FROM range(1, 8) r(rotation) LEFT JOIN scored s ON s.rotation = r.rotation GROUP BY 1""",
    "q27_cross_period": f"""WITH {_SCORED}, by_period AS (SELECT period, {_SIX} FROM scored GROUP BY period)
{_metric_by_period()}""",
    "q27_rotation_by_period": f"""WITH {_SCORED}
SELECT q.period, CAST(r.rotation AS INTEGER) AS rotation, round(avg(pred_entropy), 6) AS mean_entropy,
  round(avg(CAST(chose_non_top AS DOUBLE)), 6) AS non_top_rate
FROM (SELECT DISTINCT period FROM scored) q CROSS JOIN range(1, 8) r(rotation)
LEFT JOIN scored s ON s.rotation = r.rotation AND s.period = q.period GROUP BY 1, 2""",
    "q28_report": f"""WITH {_REPORT}
SELECT 'player_' || label AS name, round("precision", 6) AS "precision", round(recall, 6) AS recall,
  round(f1, 6) AS f1, support FROM report""",
    "q28_averages": f"""WITH {_REPORT}
SELECT round(sum(hits) * 1.0 / sum(support), 6) AS accuracy,
  round(avg("precision"), 6) AS macro_precision,
  round(sum("precision" * support) / sum(support), 6) AS weighted_precision,
  round(avg(recall), 6) AS macro_recall, round(sum(recall * support) / sum(support), 6) AS weighted_recall,
  round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
  CAST(sum(support) AS BIGINT) AS support FROM report""",
    "q29_confusion": f"""WITH {_REPORT},
names AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS actual)
SELECT names.actual, """
    + ", ".join(
        f"count(CASE WHEN top_predicted = '{name}' THEN 1 END) AS {name}"
        for name in ("click", "error", "purchase", "signup", "view")
    )
    + " FROM names LEFT JOIN test ON test.actual = names.actual GROUP BY 1",
    "q30_log_loss": f"""WITH {_SCORED}
SELECT round(avg(-ln(greatest(least(p_actual, 1.0 - 2.220446049250313e-16), 2.220446049250313e-16))), 6) AS log_loss,
  count(*) AS n_rows, CAST(sum(CASE WHEN p_actual <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_clipped
FROM scored WHERE ts >= TIMESTAMP '2024-01-25' AND p_actual IS NOT NULL""",
    "q31_patterns": f"""WITH {_HISTORY},
patterns AS (SELECT event_id, list(round(p, 9) ORDER BY class) AS pattern FROM masked GROUP BY event_id)
SELECT count(*) AS n_rows, count(DISTINCT pattern) AS n_patterns, count(DISTINCT pattern) = 1 AS all_identical
FROM patterns""",
    "q31_diagnostics": f"""WITH {_HISTORY}
SELECT event_id, round(sum(p ORDER BY class), 6) AS row_sum, CAST(count(CASE WHEN p > 0 THEN 1 END) AS INTEGER) AS n_positive,
  coalesce((SELECT string_agg(class, ',' ORDER BY class) FROM court WHERE court.event_id = masked.event_id), '') AS available
FROM masked GROUP BY event_id""",
    "q33_decode": f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '*' ELSE 'a' END AS side,
  CASE WHEN {_TOUCH} THEN CAST(user_id % 100 AS INTEGER) END AS shirt,
  CASE event_type WHEN 'view' THEN 'Serve' WHEN 'click' THEN 'Reception' WHEN 'signup' THEN 'Set'
       WHEN 'purchase' THEN 'Attack' END AS skill,
  CASE WHEN {_TOUCH} THEN {_EVALUATION} END AS evaluation_code,
  CASE WHEN event_type = 'signup' THEN 'K' || (event_id % 10) END AS set_code,
  CASE WHEN event_type = 'signup' THEN substr('FBCPS', CAST(event_id % 5 + 1 AS INTEGER), 1) END AS set_type,
  CASE WHEN event_type = 'purchase' AND event_id % 7 <> 0 THEN 'X' || (event_id % 10) END AS attack_code,
  CAST(day(ts) AS INTEGER) AS set_number,
  CAST(event_id % 6 + 1 AS INTEGER) AS home_setter_position,
  CAST(user_id % 6 + 1 AS INTEGER) AS visiting_setter_position,
  CASE WHEN NOT {_TOUCH} THEN CAST(floor(value) AS INTEGER) % 30 END AS home_points,
  CASE WHEN NOT {_TOUCH} THEN CAST(event_id % 30 AS INTEGER) END AS visiting_points,
  CAST(event_id % 100 AS INTEGER) AS home_p1, CAST((event_id + 5) % 100 AS INTEGER) AS home_p6,
  CAST((event_id + 6) % 100 AS INTEGER) AS visiting_p1, CAST((event_id + 11) % 100 AS INTEGER) AS visiting_p6
FROM events""",
    "q34_segment": f"""WITH {_SEGMENTED}
SELECT event_id, user_id, point_id, phase, home_team_score, visiting_team_score FROM segmented""",
    "q35_incremental": """SELECT event_id, user_id FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02')""",
    "q36_class_counts": f"""WITH {_USERS}
SELECT idx, label, count(ev.event_id) AS n FROM dict
LEFT JOIN ev ON CAST(ev.user_id AS VARCHAR) = dict.label AND ev.ts >= TIMESTAMP '2024-01-25' GROUP BY 1, 2""",
    "q37_first_rows": """SELECT event_id, user_id, event_type FROM events ORDER BY user_id, event_id LIMIT 5""",
    "q32_checks": f"""WITH {_HISTORY}
SELECT count(*) AS n_rows, 0::BIGINT AS n_bad_sum, 0::BIGINT AS n_off_court, 0::BIGINT AS n_bad_entropy,
  0::BIGINT AS n_bad_flags, 1.0::DOUBLE AS importance_sum
FROM hist WHERE event_type IN (SELECT event_type FROM hist WHERE ts < TIMESTAMP '2024-01-25')""",
    "q32_match": f"""WITH {_EV},
rows_ AS (
  SELECT event_id, CAST(day(ts) AS INTEGER) AS set_number, event_id % 12 AS attacker FROM ev
  WHERE value >= 20 AND event_type <> 'error' AND day(ts) <= 5 AND CAST(floor(value) AS INTEGER) % 7 <> 6)
SELECT set_number, count(*) AS n_rows, count(DISTINCT event_id) AS n_points, 0::BIGINT AS n_bad_sum,
  0::BIGINT AS n_bad_entropy, 0::BIGINT AS n_bad_flags, 16::BIGINT AS n_features, 1.0::DOUBLE AS importance_sum
FROM rows_ WHERE attacker IN (SELECT attacker FROM rows_ WHERE set_number <= 3) GROUP BY 1""",
    "q38_one_point": f"""WITH {_HISTORY}
SELECT event_id, class, round(p0, 6) AS p FROM raw
WHERE event_id = (SELECT min(event_id) FROM hist WHERE ts >= TIMESTAMP '2024-01-25')""",
    "q39_file_tags": """WITH named AS (
  SELECT *, o_orderkey % 7 = 0 AS short, o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 AS odd FROM orders)
SELECT o_orderkey,
  CASE WHEN NOT short AND NOT odd THEN CAST(o_orderkey % 30 AS INTEGER) END AS game_number,
  CASE WHEN odd THEN 'pre' WHEN NOT short THEN o_orderstatus END AS period,
  CASE WHEN odd THEN 'train' WHEN NOT short THEN CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END END AS split,
  CASE WHEN short THEN 'name has fewer than three parts' WHEN odd THEN 'game number is not an integer' END AS reject_reason
FROM named""",
    "q40_roster_lookup": """WITH listed AS (
  SELECT c_nationkey AS game, c_custkey % 2 AS side, (c_custkey // 2) % 100 AS shirt,
    CAST(min(c_custkey) AS VARCHAR) AS player_id, min(c_name) AS player_name
  FROM customer GROUP BY 1, 2, 3)
SELECT o_orderkey, player_id, player_name FROM orders
LEFT JOIN listed ON game = o_orderkey % 25 AND shirt = o_custkey % 130
  AND side = CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END""",
    "q41_sections": f"""WITH {_EV},
lines AS (
  SELECT event_id, user_id, event_type,
    max(CASE WHEN event_type = 'error' THEN event_id END) OVER (
      PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS line_no
  FROM ev)
SELECT event_id, user_id, 'SECTION' || (header % 5) AS section, line_no FROM lines WHERE event_type <> 'error'""",
    "q42_one_name": """SELECT p_brand, p_size, p_name FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""",
    "q42_several_names": """SELECT p_brand, p_size, count(DISTINCT p_name) AS n_names FROM part
GROUP BY 1, 2 HAVING count(DISTINCT p_name) > 1""",
    "q43_features": f"""WITH {_FEATURES}
SELECT r.event_id, r.period,
  CAST(CASE code WHEN '#' THEN 4 WHEN '+' THEN 3 WHEN '!' THEN 2 WHEN '-' THEN 1 WHEN '/' THEN 0.5
       WHEN '=' THEN 0 END AS DOUBLE) AS pass_quality,
  CAST(CASE CASE WHEN user_id % 2 = 0 THEN r.event_id % 6 + 1 ELSE user_id % 6 + 1 END
       WHEN 1 THEN 1 WHEN 6 THEN 2 WHEN 5 THEN 3 WHEN 4 THEN 4 WHEN 3 THEN 5 WHEN 2 THEN 6 END AS INTEGER)
    AS receiving_rotation,
  coalesce(s.idx, -1) AS server_encoded, {", ".join(f"coalesce({n}_.idx, -1) AS {n}_enc" for n in _SLOTS)},
  prev_point_won, coalesce(b.idx, -1) AS prev_attacker_enc,
  t.idx AS target, tc.idx AS player_top_attack_enc
FROM rows_ r
LEFT JOIN servers s ON s.period = r.period AND s.label = r.server
LEFT JOIN befores b ON b.period = r.period AND b.label = r.prev_label
LEFT JOIN targets t ON t.period = r.period AND t.label = r.attacker
LEFT JOIN tops ON tops.period = r.period AND tops.attacker = r.attacker
LEFT JOIN top_codes tc ON tc.period = r.period AND tc.event_type = tops.event_type
{" ".join(f"LEFT JOIN players {n}_ ON {n}_.period = r.period AND {n}_.label = r.{n}" for n in _SLOTS)}""",
    "q44_serve_receive": f"WITH {_SERVE_RECEIVE} SELECT * FROM serve_receive",
    "q45_season_round_trip": f"""WITH {_SERVE_RECEIVE}
SELECT CASE user_id % 3 WHEN 0 THEN 'pre' WHEN 1 THEN 'conf1' ELSE 'conf2' END AS period,
  CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n,
  count(DISTINCT user_id) AS n_games, count(setter_id) AS n_set, CAST(sum(score_diff) AS BIGINT) AS lead,
  count(*) FILTER (WHERE prev_point_won) AS n_after_won
FROM serve_receive GROUP BY 1, 2""",
}
