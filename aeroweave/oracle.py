"""SQL equivalents of the registered queries, written straight against the tables.

They use brute force wherever the engine prunes or iterates: full self-joins for pairs, hat
functions for the grid, a recursive walk for the search and for trajectories.
"""

from __future__ import annotations

from .fixtures import GROUP_SECONDS
from .plans.search import SHUFFLE_PRIME, sweep_factor
from .queries import HUB_BOX, SHUFFLE_SEED, SWEEP_METRES
from .schemas import (
    BANK_ANGLES,
    DECISION_PERIOD_S,
    ENCOUNTER_CUTS,
    GRAVITY,
    MAX_SWEEPS,
    METRES_PER_DEGREE,
    N_ACTIONS,
    N_JOINT,
    RANGE_LIMIT_M,
)

_AXES = ("x", "y", "bearing", "v_own", "v_int")
_STATE = ("lat", "lon", "heading", "speed")
_GRID_SIZE = 5445


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + CAST(0 AS DOUBLE)"


def _reports(box: int = 5001) -> str:
    half = box // 2
    return f"""reports AS (
  SELECT CAST(CAST(floor(epoch_us(ts) / {GROUP_SECONDS * 1_000_000}.0) AS BIGINT) AS VARCHAR) AS conflict_id,
    'F' || user_id AS flight_id, user_id AS ord,
    CAST((event_id * 7919) % {box} - {half} AS DOUBLE) AS lat,
    CAST((event_id * 104729) % {box} - {half} AS DOUBLE) AS lon,
    CAST((event_id * 31) % 6283 AS DOUBLE) / CAST(1000 AS DOUBLE) AS heading,
    10 + CAST((event_id * 13) % 1001 AS DOUBLE) / CAST(100 AS DOUBLE) AS speed,
    epoch_us(ts) AS event_us, event_id AS seq
  FROM events)"""


REPORTS = _reports()

FLIGHTS = """flights AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY conflict_id, flight_id ORDER BY event_us DESC, seq DESC) AS rn
    FROM reports)
  WHERE rn = 1)"""

HUB = """flights AS (
  SELECT CASE WHEN seq % 3 = 0 THEN 'hub' ELSE 'g' || CAST(floor(seq / 8.0) AS BIGINT) END AS conflict_id,
    'E' || seq AS flight_id, seq AS ord, lat, lon, heading, speed
  FROM reports)"""

ROSTER = """roster AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY conflict_id) AS n,
    row_number() OVER (PARTITION BY conflict_id ORDER BY ord) AS pos FROM flights)
  WHERE n > 1)"""

ALL_PAIRS = f"""all_pairs AS (
  SELECT *, abs(x) > {RANGE_LIMIT_M} OR abs(y) > {RANGE_LIMIT_M} AS terminal FROM (
    SELECT o.conflict_id, o.flight_id AS own_id, o.ord AS own_ord, o.pos AS own_pos,
      i.flight_id AS intr_id, i.ord AS intr_ord, i.pos AS intr_pos,
      (i.lat - o.lat) * cos(o.heading) + (i.lon - o.lon) * sin(o.heading) AS x,
      -(i.lat - o.lat) * sin(o.heading) + (i.lon - o.lon) * cos(o.heading) AS y,
      i.heading - o.heading AS bearing, o.speed AS v_own, i.speed AS v_int
    FROM roster o JOIN roster i ON o.conflict_id = i.conflict_id AND o.ord <> i.ord))"""

NEAR = "near AS (SELECT *, row_number() OVER () AS pid FROM all_pairs WHERE NOT terminal)"


def _axis_table(dim: int) -> str:
    cuts = ENCOUNTER_CUTS[dim]
    rows = ", ".join(
        f"({i}, {'NULL' if i == 0 else cuts[i - 1]}::DOUBLE, {c}::DOUBLE, "
        f"{'NULL' if i == len(cuts) - 1 else cuts[i + 1]}::DOUBLE)"
        for i, c in enumerate(cuts)
    )
    return f"ax{dim} AS (SELECT * FROM (VALUES {rows}) t(i, below, cut, above))"


AXES = ",\n".join(_axis_table(d) for d in range(5))


def _clamped(dim: int, source: str = "p") -> str:
    cuts = ENCOUNTER_CUTS[dim]
    return f"greatest(least({source}.{_AXES[dim]}, {cuts[-1]}::DOUBLE), {cuts[0]}::DOUBLE)"


def _hat(dim: int) -> str:
    t, a = f"t{dim}", f"a{dim}"
    return (
        f"CASE WHEN {t} = {a}.cut THEN 1.0::DOUBLE"
        f" WHEN {t} < {a}.cut THEN 1 - ({a}.cut - {t}) / ({a}.cut - {a}.below)"
        f" ELSE 1 - ({t} - {a}.cut) / ({a}.above - {a}.cut) END"
    )


def _vertices(points: str, key: str) -> str:
    """Grid points with a positive hat-function weight, per row of ``points``."""
    strides, s = [], 1
    for cuts in ENCOUNTER_CUTS:
        strides.append(s)
        s *= len(cuts)
    clamp = ", ".join(f"{_clamped(d)} AS t{d}" for d in range(5))
    joins = " ".join(
        f"JOIN ax{d} a{d} ON t{d} = a{d}.cut OR (t{d} > a{d}.below AND t{d} < a{d}.cut)"
        f" OR (t{d} < a{d}.above AND t{d} > a{d}.cut)"
        for d in range(5)
    )
    idx = " + ".join(f"a{d}.i * {strides[d]}" for d in range(5))
    weight = " * ".join(f"({_hat(d)})" for d in range(5))
    return f"""vertices AS (
  SELECT {key}, CAST({idx} AS INTEGER) AS state_idx, {weight} AS w
  FROM (SELECT p.{key}, {clamp} FROM {points} p) c {joins})"""


def _utility(joint: str) -> str:
    return f"((v.state_idx * 37 + {joint} * 101) % 1024) / CAST(1024 AS DOUBLE) - 1"


_SUMS = ", ".join(f"sum(v.w * ({_utility(str(j))})) AS q{j}" for j in range(N_JOINT))
PAIR_Q = f"""pair_q AS (
  SELECT n.*, {", ".join(f"s.q{j}" for j in range(N_JOINT))}
  FROM near n JOIN (SELECT pid, {_SUMS} FROM vertices v GROUP BY pid) s USING (pid))"""

PAIRS = (REPORTS, FLIGHTS, ROSTER, ALL_PAIRS, NEAR)
UTILITIES = (*PAIRS, AXES, _vertices("near", "pid"), PAIR_Q)

FAR = """far AS (
  SELECT conflict_id, own_ord AS ord, count(*) FILTER (terminal) AS n_terminal
  FROM all_pairs GROUP BY ALL)"""


def _constant(action: int) -> str:
    return "0.0::DOUBLE" if action == N_ACTIONS - 1 else "-0.5::DOUBLE"


def _worst(intr_action: str) -> str:
    """Minimum over intruders; ``intr_action`` is the SQL of an intruder's action."""
    cases = []
    for a in range(N_ACTIONS):
        pick = " ".join(f"WHEN {c} THEN q{a * N_ACTIONS + c}" for c in range(N_ACTIONS))
        cases.append(f"min(CASE {intr_action} {pick} END) AS w{a}")
    folded = ", ".join(
        f"CASE WHEN n_terminal > 0 THEN least(coalesce(w{a}, 1e300), {_constant(a)}) ELSE w{a} END AS u{a}"
        for a in range(N_ACTIONS)
    )
    return f"""worst AS (
  SELECT r.conflict_id, r.flight_id, r.ord, r.lat, r.lon, r.heading, r.speed, {folded}
  FROM roster r JOIN far USING (conflict_id, ord)
  LEFT JOIN (SELECT conflict_id, own_ord AS ord, {", ".join(cases)} FROM pair_q GROUP BY ALL) m
    USING (conflict_id, ord))"""


_U = ", ".join(f"u{a}" for a in range(N_ACTIONS))
BEST = f"""best AS (
  SELECT *, CAST(list_position([{_U}], greatest({_U})) - 1 AS INTEGER) AS action_idx,
    greatest({_U}) AS util FROM worst)"""
CLEAR_BEST = (*UTILITIES, FAR, _worst(str(N_ACTIONS - 1)), BEST)

_BANKS = "[" + ", ".join(f"{b}::DOUBLE" for b in BANK_ANGLES) + "]"


def _turn(bank: str, speed: str) -> str:
    return (
        f"CASE WHEN {bank} = -1 THEN 0 WHEN {speed} = 0 THEN NULL"
        f" ELSE {GRAVITY}::DOUBLE * tan({bank}) / {speed} END"
    )


_WRAP_PI = "(2 * pi())"


def _wrap(expr: str) -> str:
    return f"(({expr}) - {_WRAP_PI} * floor(({expr}) / {_WRAP_PI}))"


# --- the search: one row per group, one aircraft per recursion step ----------------------------

def _walk(groups: str, joined: str, pairs: str, far: str) -> str:
    """One aircraft per recursion step; ``joined`` finds what the one whose turn it is sees."""
    return f"""own_info AS (
  SELECT r.conflict_id, r.pos, coalesce(f.n_terminal, 0) > 0 AS far,
    list({{'k': q.intr_pos, 'q': [{", ".join(f"q.q{j}" for j in range(N_JOINT))}]}})
      FILTER (q.pid IS NOT NULL) AS pairs
  FROM roster r LEFT JOIN far f USING (conflict_id, ord)
  LEFT JOIN pair_q q ON q.conflict_id = r.conflict_id AND q.own_ord = r.ord
  GROUP BY ALL),
walk AS (
  SELECT conflict_id, max(n) AS n, CAST(1 AS BIGINT) AS pos, 1 AS sweep,
    list_transform(range(max(n)), lambda x: {N_ACTIONS - 1}) AS cur,
    list_transform(range(max(n)), lambda x: CAST(0 AS HUGEINT)) AS util,
    list_transform(range(max(n)), lambda x: {N_ACTIONS - 1}) AS best,
    CAST(NULL AS HUGEINT) AS best_total, FALSE AS improving, FALSE AS done
  FROM {groups} GROUP BY conflict_id
  UNION ALL
  SELECT conflict_id, n, CASE WHEN pos = n THEN 1 ELSE pos + 1 END,
    CASE WHEN pos = n AND moved THEN sweep + 1 ELSE sweep END,
    new_cur, new_util,
    CASE WHEN better THEN new_cur ELSE best END,
    CASE WHEN better THEN total ELSE best_total END,
    CASE WHEN pos = n THEN FALSE ELSE moved END,
    pos = n AND (NOT moved OR sweep = 100)
  FROM (
    SELECT *, improving OR better AS moved FROM (
      SELECT *, (sweep > 1 OR pos = n) AND (best_total IS NULL OR total > best_total) AS better FROM (
        SELECT *, list_sum(new_util) AS total FROM (
          SELECT *, list_transform(cur, lambda x, i: CASE WHEN i = pos THEN act ELSE x END) AS new_cur,
            list_transform(util, lambda x, i: CASE WHEN i = pos THEN
              CAST(round_even(m[act + 1] * 1e12, 0) AS HUGEINT) ELSE x END) AS new_util
          FROM (
            SELECT *, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS act FROM (
              SELECT w.*, list_transform(range({N_ACTIONS}), lambda a: least(
                coalesce(list_min(list_transform({pairs}, lambda p: p.q[a * {N_ACTIONS} + w.cur[p.k] + 1])), 1e300),
                CASE WHEN {far} THEN CASE WHEN a = {N_ACTIONS - 1} THEN 0.0 ELSE -0.5 END ELSE 1e300 END)) AS m
              FROM walk w {joined}
              WHERE NOT w.done)))))))"""


SEARCH = _walk("roster", "JOIN own_info o ON o.conflict_id = w.conflict_id AND o.pos = w.pos", "o.pairs", "o.far")

RESOLVED = f"""resolved AS (
  SELECT r.*, CAST(w.best[r.pos] AS INTEGER) AS action_idx, {_BANKS}[w.best[r.pos] + 1] AS bank,
    CAST(w.best_total AS DOUBLE) / 1e12 AS joint_util, CAST(w.sweep AS INTEGER) AS n_iter,
    w.sweep = 100 AS hit_cap
  FROM walk w JOIN roster r USING (conflict_id) WHERE w.done)"""


def _rounds(factors: str) -> str:
    """The search in sets: each recursion step lets all aircraft answer again, until a sweep's answers stand.

    An aircraft answers the new actions of those before it in the sweep and the old ones of the others, which only
    the sequential sweep satisfies. ``factors`` is the SQL of a list that orders each sweep, NULL for the order of ``ord``.
    """
    seen = "CASE WHEN (i.p, i.ord) < (w.p, w.ord) THEN i.x ELSE i.prev END"
    lowest = ", ".join(
        f"min(CASE {seen} {' '.join(f'WHEN {c} THEN q.q{a * N_ACTIONS + c}' for c in range(N_ACTIONS))} END) AS w{a}"
        for a in range(N_ACTIONS)
    )
    folded = ", ".join(
        f"least(coalesce(w{a}, 1e300), CASE WHEN far THEN {_constant(a)} ELSE 1e300 END)" for a in range(N_ACTIONS)
    )
    place = f"coalesce(r * {factors}[{{sweep}} + 1] % {SHUFFLE_PRIME}, 0)"
    return f"""walk AS (
  SELECT conflict_id, ord, n_terminal > 0 AS far, r, {place.format(sweep=0)} AS p, 0 AS sweep,
    {N_ACTIONS - 1} AS prev, {N_ACTIONS - 1} AS x, CAST(0 AS HUGEINT) AS u_prev, CAST(0 AS HUGEINT) AS u,
    {N_ACTIONS - 1} AS best, CAST(NULL AS HUGEINT) AS best_total, FALSE AS done
  FROM (SELECT *, {_ORDER_HASH} AS r FROM roster JOIN far USING (conflict_id, ord))
  UNION ALL
  SELECT conflict_id, ord, far, r, CASE WHEN stands THEN {place.format(sweep='(sweep + 1)')} ELSE p END,
    CASE WHEN stands THEN sweep + 1 ELSE sweep END,
    CASE WHEN stands THEN answer ELSE prev END, answer,
    CASE WHEN stands THEN value ELSE u_prev END, value,
    CASE WHEN better AND pos <= peak_pos THEN answer WHEN better THEN prev ELSE best END,
    CASE WHEN better THEN peak ELSE best_total END,
    stands AND (NOT better OR sweep + 1 = 100)
  FROM (
    SELECT *, stands AND (best_total IS NULL OR peak > best_total) AS better,
      CASE WHEN sweep = 0 THEN n ELSE min(pos) FILTER (after = peak) OVER grp END AS peak_pos
    FROM (
      SELECT *, max(CASE WHEN sweep > 0 OR pos = n THEN after END) OVER grp AS peak
      FROM (
        SELECT *, NOT bool_or(answer <> x) OVER grp AS stands, count(*) OVER grp AS n, row_number() OVER turn AS pos,
          sum(u_prev) OVER grp + sum(value - u_prev) OVER (turn ROWS UNBOUNDED PRECEDING) AS after
        FROM (
          SELECT * EXCLUDE (m), CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS answer,
            CAST(round_even(list_max(m) * 1e12, 0) AS HUGEINT) AS value
          FROM (
            SELECT w.*, [{folded}] AS m
            FROM walk w LEFT JOIN (
              SELECT w.conflict_id, w.ord, {lowest}
              FROM walk w JOIN pair_q q ON q.conflict_id = w.conflict_id AND q.own_ord = w.ord
                JOIN walk i ON i.conflict_id = q.conflict_id AND i.ord = q.intr_ord
              GROUP BY ALL) low ON low.conflict_id = w.conflict_id AND low.ord = w.ord
            WHERE NOT w.done))
        WINDOW grp AS (PARTITION BY conflict_id), turn AS (PARTITION BY conflict_id ORDER BY p, ord))
      WINDOW grp AS (PARTITION BY conflict_id))
    WINDOW grp AS (PARTITION BY conflict_id))),
resolved AS (
  SELECT conflict_id, flight_id, ord, CAST(best AS INTEGER) AS action_idx, {_BANKS}[best + 1] AS bank,
    CAST(best_total AS DOUBLE) / 1e12 AS joint_util, CAST(sweep AS INTEGER) AS n_iter, sweep = 100 AS hit_cap
  FROM walk JOIN roster USING (conflict_id, ord) WHERE done)"""


_ORDER_HASH = f"""CAST('0x' || substr(md5('{SHUFFLE_SEED}|order|' || conflict_id || '|' || ord), 1, 13) AS BIGINT)
    % {SHUFFLE_PRIME - 1} + 1"""
_FACTORS = "[" + ", ".join(f"{sweep_factor(SHUFFLE_SEED, s)}::BIGINT" for s in range(MAX_SWEEPS + 1)) + "]"

RESOLVE = "WITH RECURSIVE " + ",\n".join((*UTILITIES, FAR, SEARCH, RESOLVED)) + "\n"

_RESOLUTION = f"""SELECT conflict_id, flight_id, ord, action_idx, {_r('bank')} AS bank,
  {_r('joint_util')} AS joint_util, n_iter, hit_cap FROM resolved"""

_ADVISORY = f"""SELECT conflict_id, flight_id, bank = -1 AS clear_of_conflict,
  {_r('lat')} AS lat, {_r('lon')} AS lon, {_r('speed')} AS speed, {_r('heading')} AS heading,
  CAST({DECISION_PERIOD_S} AS DOUBLE) AS period_s, {_r(_turn('bank', 'speed'))} AS turn_rate
"""

BANKED = f"banked AS (SELECT *, {_BANKS}[action_idx + 1] AS bank FROM best)"
ADVISED = f"""advised AS (
  SELECT f.conflict_id, f.flight_id, f.ord, f.lat, f.lon, f.heading, f.speed,
    CASE WHEN b.ord IS NOT NULL THEN bank = -1 END AS clear_of_conflict,
    {_turn('bank', 'b.speed')} AS turn_rate,
    CASE WHEN b.ord IS NOT NULL THEN {DECISION_PERIOD_S} END AS period_s
  FROM flights f LEFT JOIN (SELECT * FROM banked WHERE ord % 2 = 0) b
    ON b.conflict_id = f.conflict_id AND b.flight_id = f.flight_id)"""
ADVISED_CTES = (*CLEAR_BEST, BANKED, ADVISED)


def _step(dt: str, rate: str) -> dict[str, str]:
    reached = f"(heading + ({rate}) * {dt})"
    mean = {  # velocity over the step: the average along the arc, or the constant one
        "lat": (f"(sin({reached}) - sin(heading)) / ({rate})", f"cos(heading) * {dt}"),
        "lon": (f"(cos(heading) - cos({reached})) / ({rate})", f"sin(heading) * {dt}"),
    }
    moved = {
        axis: f"{axis} + CASE WHEN ({rate}) = 0 THEN speed * {ahead} ELSE abs(speed) * ({arc}) END"
        for axis, (arc, ahead) in mean.items()
    }
    return {**moved, "heading": _wrap(f"CASE WHEN ({rate}) = 0 THEN heading ELSE {reached} END"), "speed": "speed"}


def _moved(dt: str, rate: str) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in _step(dt, rate).items())


_RATE = "(CASE WHEN clear_of_conflict IS NULL OR clear_of_conflict THEN 0 ELSE coalesce(turn_rate, 0) END)"
_ROUNDED_STATE = ", ".join(f"{_r(c)} AS {c}" for c in _STATE)


def _noise(expr_key: str, label: str, start: int) -> str:
    return (
        f"((CAST('0x' || substr(md5('123456|{label}|' || {expr_key}), {start}, 13) AS BIGINT) + 0.5::DOUBLE)"
        f" / {16**13}::DOUBLE)"
    )


def _gaussian(key: str, label: str, sd: str) -> str:
    return (
        f"({sd} * sqrt(-2 * ln({_noise(key, label, 1)})) * cos(2 * pi() * {_noise(key, label, 14)}))"
    )


_STEP_KEY = "conflict_id || '|' || flight_id || '|' || (step + 1)"
NOISY_PATH = f"""path AS (
  SELECT conflict_id, flight_id, 0 AS step, {", ".join(_STATE)}, clear_of_conflict, turn_rate FROM advised
  UNION ALL
  SELECT conflict_id, flight_id, step + 1, lat + d_lat, lon + d_lon, {_wrap('heading + d_heading')},
    speed + d_speed, clear_of_conflict, turn_rate
  FROM (
    SELECT conflict_id, flight_id, step, {_moved('5', 'rate')}, clear_of_conflict, turn_rate,
      d_lat, d_lon, d_heading, d_speed
    FROM (
      SELECT *, CASE WHEN clear_of_conflict IS NULL OR clear_of_conflict
          THEN radians(5) * {_noise(_STEP_KEY, 'turn_clear', 1)}
          ELSE coalesce(turn_rate, 0) + {_gaussian(_STEP_KEY, 'turn_conflict', 'radians(1)')} END AS rate,
        {_gaussian(_STEP_KEY, 'lat', '10')} AS d_lat, {_gaussian(_STEP_KEY, 'lon', '10')} AS d_lon,
        {_gaussian(_STEP_KEY, 'heading', 'radians(10)')} AS d_heading,
        {_gaussian(_STEP_KEY, 'speed', '1')} AS d_speed
      FROM path WHERE step < 10)))"""


POINTS = """points AS (
  SELECT seq AS event_id, seq AS pid,
    CASE WHEN seq % 5 = 0 THEN lat - CAST(CAST(lat AS BIGINT) % 400 AS DOUBLE) ELSE lat / 1.1::DOUBLE END AS x,
    lon / 1.1::DOUBLE AS y, CASE WHEN seq % 7 = 0 THEN 1.5708::DOUBLE ELSE heading - 2 END AS bearing,
    speed / 1.1::DOUBLE AS v_own,
    CASE WHEN seq % 3 = 0 THEN 15.0::DOUBLE ELSE speed * 1.3::DOUBLE / 1.1::DOUBLE END AS v_int
  FROM reports)"""


def _bracket_columns() -> str:
    out = []
    for d, cuts in enumerate(ENCOUNTER_CUTS):
        t, last = f"p.{_AXES[d]}", len(cuts) - 1
        arr = "[" + ", ".join(f"{c}::DOUBLE" for c in cuts) + "]"
        below = f"len(list_filter({arr}, lambda c: c < {t}))"
        exact = f"({t} <= {cuts[0]} OR {t} >= {cuts[-1]} OR list_contains({arr}, {t}))"
        hi = f"CASE WHEN {t} <= {cuts[0]} THEN 0 WHEN {t} >= {cuts[-1]} THEN {last} ELSE {below} END"
        lo = f"(CASE WHEN {exact} THEN {hi} ELSE {below} - 1 END)"
        part = f"(({t} - {arr}[{below}]) / ({arr}[{below} + 1] - {arr}[{below}]))"
        out += [
            f"CAST({lo} AS INTEGER) AS lo_{d}",
            f"CAST({hi} AS INTEGER) AS hi_{d}",
            f"CASE WHEN {exact} THEN 1.0::DOUBLE ELSE {_r('1 - ' + part)} END AS w_lo_{d}",
            f"CASE WHEN {exact} THEN 0.0::DOUBLE ELSE {_r(part)} END AS w_hi_{d}",
        ]
    return ", ".join(out)


def _decoded() -> str:
    out, stride = [], 1
    for d, cuts in enumerate(ENCOUNTER_CUTS):
        arr = "[" + ", ".join(f"{c}::DOUBLE" for c in cuts) + "]"
        out.append(
            f"CASE WHEN idx >= 0 AND idx < {_GRID_SIZE} THEN {arr}[idx // {stride} % {len(cuts)} + 1] END AS c{d}"
        )
        stride *= len(cuts)
    return ", ".join(out)


def _interpolated() -> str:
    """x + 2y + 3z + ... is multilinear, so interpolation returns it at the clamped point."""
    return " + ".join(f"{d + 1} * {_clamped(d)}" for d in range(5))


_WIDE = ", ".join(f"{_r(f'q{j}')} AS q{j}" for j in range(N_JOINT))
_UTILS = ", ".join(f"{_r(f'u{a}')} AS u{a}" for a in range(N_ACTIONS))
_METRES = "[" + ", ".join(f"{m}::DOUBLE" for m in SWEEP_METRES) + "]"

# Unmoved aircraft meet once per scenario, under its name; the moved one meets the others once per cell, under the cell's.
SWEPT = f"""cell AS (
  SELECT '/' || ix || '/' || iy AS name, {_METRES}[ix + 1] AS lat, {_METRES}[iy + 1] AS lon,
    CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy
  FROM range({len(SWEEP_METRES)}) a(ix), range({len(SWEEP_METRES)}) b(iy)),
scenario AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY conflict_id) AS n,
    row_number() OVER (PARTITION BY conflict_id ORDER BY ord) AS pos FROM flights0)
  WHERE n > 1),
placed AS (
  SELECT conflict_id, ord, pos, lat, lon, heading, speed, '' AS name FROM scenario WHERE pos > 1
  UNION ALL
  SELECT conflict_id, ord, pos, c.lat, c.lon, heading, speed, name FROM scenario s, cell c WHERE pos = 1),
swept AS (
  SELECT s.conflict_id || name AS conflict_id, s.conflict_id AS scenario_id, ix, iy, flight_id, ord, pos, n
  FROM scenario s, cell),
roster AS (
  SELECT conflict_id, ord, pos, n FROM swept UNION ALL SELECT conflict_id, ord, pos, n FROM scenario),
all_pairs AS (
  SELECT *, abs(x) > {RANGE_LIMIT_M} OR abs(y) > {RANGE_LIMIT_M} AS terminal FROM (
    SELECT o.conflict_id || o.name || i.name AS conflict_id, o.ord AS own_ord, i.pos AS intr_pos,
      (i.lat - o.lat) * cos(o.heading) + (i.lon - o.lon) * sin(o.heading) AS x,
      -(i.lat - o.lat) * sin(o.heading) + (i.lon - o.lon) * cos(o.heading) AS y,
      i.heading - o.heading AS bearing, o.speed AS v_own, i.speed AS v_int
    FROM placed o JOIN placed i ON o.conflict_id = i.conflict_id AND o.ord <> i.ord))"""
SWEPT_SEARCH = _walk(
    "swept",
    """JOIN own_info o ON o.conflict_id = w.conflict_id AND o.pos = w.pos
                JOIN own_info s ON s.conflict_id = split_part(w.conflict_id, '/', 1) AND s.pos = w.pos""",
    "list_concat(o.pairs, s.pairs)",
    "o.far OR s.far",
)

_CODED = _with(
    REPORTS,
    f"""coded AS (SELECT seq AS event_id, heading, CASE WHEN seq % 50 = 0 THEN 0 ELSE speed END AS speed,
  seq % {N_ACTIONS} AS own, seq * 7 % {N_ACTIONS} AS intr FROM reports)""",
    f"valued AS (SELECT *, {_BANKS}[own + 1] AS bank FROM coded)",
)
_SCALARS = {
    "joint_idx": f"CAST(own * {N_ACTIONS} + intr AS INTEGER)",
    "bank": _r("bank", 9),
    "turn_rate": _r(_turn("bank", "speed"), 9),
    "wrapped": _r(_wrap("heading * 3 - 9"), 9),
}


def _scalar(*names: str) -> str:
    return _CODED + f"SELECT event_id, {', '.join(f'{_SCALARS[n]} AS {n}' for n in names)} FROM valued"


_POSITIONS = f"""SELECT 'fid-' || event_id AS gufi, CAST(event_id % 360 AS DOUBLE) AS heading,
  lon, lat, CAST(10 + event_id % 90 AS DOUBLE) AS speed, epoch_us(ts) AS received_us,
  epoch_us(ts) AS measured_us, {_r(f'lon * {METRES_PER_DEGREE}', 3)} AS x_m,
  {_r(f'lat * {METRES_PER_DEGREE}', 3)} AS y_m
FROM (SELECT *, CAST((event_id * 7919) % 36001 - 18000 AS DOUBLE) / 100 AS lon,
  CAST((event_id * 104729) % 18001 - 9000 AS DOUBLE) / 100 AS lat FROM events)"""

_OPERATIONS = """SELECT 'N' || o_orderkey AS flight_number, o_orderkey % 2 = 0 AS unmanned,
  'type ' || (o_orderkey % 7) AS aircraft_type, 'contact ' || o_custkey AS primary_contact_name,
  o_orderpriority AS aircraft_comments, epoch_us(o_orderdate) AS submit_us, epoch_us(o_orderdate) AS begin_us,
  epoch_us(o_orderdate) + 86400000000 AS end_us, CAST(o_orderkey % 4 + 2 AS INTEGER) AS n_points,
  CAST(1 + o_orderkey % 100 AS DOUBLE) / 4 AS lon1, CAST(2 + o_orderkey % 80 AS DOUBLE) / 8 AS lat1,
  CAST(50 + o_orderkey % 10 AS DOUBLE) AS min_altitude, CAST(150 + o_orderkey % 10 AS DOUBLE) AS max_altitude
FROM orders WHERE o_orderkey % 11 <> 0"""

_MESSAGES = """SELECT 'fid-' || event_id AS gufi,
  CAST(event_id % 40 AS INTEGER) AS message_id FROM events"""


ORACLES: dict[str, str] = {
    "latest_state": _with(REPORTS, FLIGHTS)
    + f"""SELECT conflict_id, flight_id, ord, lat, lon, {_r('heading')} AS heading, {_r('speed')} AS speed,
  event_us, seq FROM flights""",
    "filter_multi": _with(REPORTS, FLIGHTS, ROSTER) + "SELECT conflict_id, flight_id, ord FROM roster",
    "encode_flight_record": _with(REPORTS, FLIGHTS, ROSTER)
    + f"SELECT conflict_id, CAST(1 AS INTEGER) AS n_parts, flight_id, {_ROUNDED_STATE} FROM roster",
    "assemble_conflict": _with(REPORTS, FLIGHTS, ROSTER)
    + """SELECT conflict_id, CAST(0 AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS n_records,
  string_agg(flight_id, ',' ORDER BY ord) AS ids, TRUE AS ends_with_comma
FROM roster GROUP BY conflict_id""",
    "split_conflict_groups": _with(
        REPORTS,
        FLIGHTS,
        ROSTER,
        """groups AS (
  SELECT conflict_id, CAST(conflict_id AS BIGINT) // 12 AS hour, CAST(count(*) AS INTEGER) AS n_records,
    arg_min(flight_id, ord) AS first_id FROM roster GROUP BY conflict_id)""",
    )
    + """SELECT CASE WHEN count(*) OVER w = 1 THEN CAST(hour AS VARCHAR)
    ELSE hour || '-' || (row_number() OVER (PARTITION BY hour ORDER BY conflict_id) - 1) END AS conflict_id,
  n_records, first_id FROM groups WINDOW w AS (PARTITION BY hour)""",
    "decode_conflict_group": _with(
        REPORTS,
        FLIGHTS,
        ROSTER,
        """groups AS (
  SELECT *, count(*) OVER (PARTITION BY hour) AS n_groups,
    row_number() OVER (PARTITION BY hour ORDER BY conflict_id) - 1 AS g
  FROM (SELECT DISTINCT conflict_id, CAST(conflict_id AS BIGINT) // 12 AS hour FROM roster))""",
    )
    + f"""SELECT CASE WHEN n_groups = 1 THEN CAST(hour AS VARCHAR) ELSE hour || '-' || g END AS conflict_id,
  flight_id, pos - 1 AS ord, {_ROUNDED_STATE} FROM roster JOIN groups USING (conflict_id)""",
    "conflict_rejects": _with(REPORTS, FLIGHTS)
    + """SELECT conflict_id, flight_id || CASE ord % 4 WHEN 0 THEN '%1%2%3' WHEN 1 THEN '%1%x%3%4'
  ELSE '%1%NaN%3%4' END AS record FROM flights WHERE ord % 4 <> 3""",
    "encode_status": _with(REPORTS, FLIGHTS)
    + f"""SELECT conflict_id, flight_id, {_r('lat / 3', 3)} AS lat, {_r('lon / 7', 3)} AS lon,
  {_r('heading', 3)} AS heading, {_r('speed / 3', 3)} AS speed,
  TRUE AS lat_short, TRUE AS lon_short, TRUE AS speed_short, TRUE AS heading_short FROM flights""",
    "decode_status": _with(REPORTS)
    + f"SELECT seq AS event_id, flight_id, {_ROUNDED_STATE} FROM reports WHERE seq % 10 < 7",
    "status_rejects": "SELECT event_id FROM events WHERE event_id % 10 >= 7",
    "read_positions_xml": _POSITIONS,
    "read_positions_xml_files": _POSITIONS + " WHERE event_id % 10 <> 7",
    "position_rejects": "SELECT 'fid-' || event_id AS gufi FROM events WHERE event_id % 10 = 7",
    "read_operations_xml": _OPERATIONS,
    "read_operations_xml_files": _OPERATIONS + " AND o_orderkey % 10 <> 7",
    "operation_rejects": "SELECT 'N' || o_orderkey AS flight_number FROM orders WHERE o_orderkey % 11 = 0",
    "operation_file_rejects": "SELECT 'N' || o_orderkey AS flight_number FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 10 = 7",
    "read_operation_messages_xml": _MESSAGES,
    "read_operation_messages_xml_files": _MESSAGES + " WHERE event_id % 10 <> 7",
    "operation_message_rejects": "SELECT 'fid-' || event_id AS gufi FROM events WHERE event_id % 10 = 7",
    "load_utility": f"""SELECT row_number() OVER (ORDER BY event_id) - 1 AS state_idx,
  CAST((event_id * 37) % 1024 AS DOUBLE) / 1024 - 1 AS u_first,
  CAST((event_id * 37 + {(N_JOINT - 1) * 101}) % 1024 AS DOUBLE) / 1024 - 1 AS u_last,
  {_r(f"list_sum(list_transform(range({N_JOINT}), lambda j: CAST((event_id * 37 + j * 101) % 1024 AS DOUBLE) / 1024 - 1))")}
    AS u_sum FROM events""",
    "scalar_functions": _scalar(*_SCALARS),
    "joint_action_index": _scalar("joint_idx"),
    "action_value": _scalar("bank"),
    "turn_rate": _scalar("turn_rate"),
    "wrap_angle": _scalar("wrapped"),
    "grid_bracket": _with(REPORTS, POINTS) + f"SELECT event_id, {_bracket_columns()} FROM points p",
    "grid_interpolants": _with(REPORTS, POINTS, AXES, _vertices("points", "event_id"))
    + f"SELECT event_id, state_idx, {_r('w')} AS w FROM vertices",
    "grid_interpolate": _with(REPORTS, POINTS)
    + f"SELECT event_id, {_r(_interpolated())} AS value FROM points p",
    "grid_decode": f"""SELECT event_id, CAST(idx AS INTEGER) AS state_idx, {_decoded()}
FROM (SELECT event_id, event_id * 31 % {_GRID_SIZE + 7} - 3 AS idx FROM events)""",
    "grid_points": f"""SELECT event_id, CAST(idx AS INTEGER) AS state_idx, {_decoded()}
FROM (SELECT event_id, event_id * 31 % {_GRID_SIZE + 7} - 3 AS idx FROM events)
WHERE idx >= 0 AND idx < {_GRID_SIZE}""",
    "ordered_pairs": _with(REPORTS, FLIGHTS, ROSTER, ALL_PAIRS)
    + """SELECT conflict_id, own_id AS flight_id, own_ord AS ord, count(*) AS n_pairs,
  count(*) FILTER (NOT terminal) AS n_in_range, count(*) FILTER (terminal) AS n_terminal
FROM all_pairs GROUP BY ALL""",
    "in_range_pairs": _with(*PAIRS)
    + f"""SELECT conflict_id, own_id, own_ord, intr_id, intr_ord,
  {", ".join(f"{_r(c)} AS {c}" for c in _AXES)} FROM near""",
    "hub_in_range_pairs": _with(_reports(HUB_BOX), HUB, ROSTER, ALL_PAIRS)
    + f"""SELECT conflict_id, own_ord, intr_ord, {", ".join(f"{_r(c)} AS {c}" for c in _AXES[:3])}
FROM all_pairs WHERE NOT terminal""",
    "relative_state": _with(
        REPORTS,
        """days AS (SELECT *, row_number() OVER (
    PARTITION BY flight_id, event_us // 86400000000 ORDER BY event_us, seq) AS rn,
    event_us // 86400000000 AS day FROM reports)""",
        """seen AS (SELECT i.seq AS event_id,
    (i.lat - o.lat) * cos(o.heading) + (i.lon - o.lon) * sin(o.heading) AS x,
    (i.lon - o.lon) * cos(o.heading) - (i.lat - o.lat) * sin(o.heading) AS y,
    i.heading - o.heading AS bearing, o.speed AS v_own, i.speed AS v_int
  FROM days i JOIN days o ON o.flight_id = i.flight_id AND o.day = i.day AND o.rn = 1)""",
    )
    + f"""SELECT event_id, {", ".join(f"{_r(c)} AS {c}" for c in _AXES)},
  abs(x) > 2000 OR abs(y) > 2000 AS is_terminal, {_r(_wrap('bearing'))} AS wrapped FROM seen""",
    **dict.fromkeys(
        ("pair_utility", "pair_utility_by_join", "pair_utility_by_brick"),
        _with(*UTILITIES) + f"SELECT conflict_id, own_ord, intr_ord, {_WIDE} FROM pair_q",
    ),
    "worst_case": _with(*UTILITIES, FAR, _worst(f"intr_ord % {N_ACTIONS}"))
    + f"SELECT conflict_id, flight_id, ord, {_UTILS} FROM worst",
    "best_response": _with(*CLEAR_BEST)
    + f"SELECT conflict_id, flight_id, ord, {_UTILS}, action_idx, {_r('util')} AS util FROM best",
    "maxmin": _with(_reports(HUB_BOX), HUB, *CLEAR_BEST[2:])
    + f"SELECT conflict_id, ord, action_idx, {_r('util')} AS util FROM best",
    "joint_utility": _with(*CLEAR_BEST)
    + f"SELECT conflict_id, {_r('sum(util)')} AS joint_util, count(*) AS n_aircraft FROM best GROUP BY ALL",
    **dict.fromkeys(
        ("resolve_conflicts", "resolve_distributed"),
        RESOLVE + _RESOLUTION,
    ),
    "resolve_hub": "WITH RECURSIVE "
    + ",\n".join((_reports(HUB_BOX), HUB, *UTILITIES[2:], FAR, _rounds("CAST(NULL AS BIGINT[])")))
    + "\n"
    + _RESOLUTION,
    "resolve_shuffled": "WITH RECURSIVE " + ",\n".join((*UTILITIES, FAR, _rounds(_FACTORS))) + "\n" + _RESOLUTION,
    "default_policy": RESOLVE + "SELECT conflict_id, flight_id, ord, action_idx FROM resolved",
    "function_policy": _with(REPORTS, FLIGHTS, ROSTER)
    + f"""SELECT conflict_id, flight_id, ord, CAST((pos - 1) % {N_ACTIONS} AS INTEGER) AS action_idx,
  {_r(f'{_BANKS}[(pos - 1) % {N_ACTIONS} + 1]')} AS bank FROM roster""",
    "streamed_policy": _with(
        REPORTS,
        FLIGHTS,
        ROSTER,
        """steps AS (SELECT *, CASE WHEN pos = 1 THEN 0 WHEN speed > lag(speed) OVER w THEN 2 ELSE 1 END AS step FROM roster
  WINDOW w AS (PARTITION BY conflict_id ORDER BY ord))""",
        f"""turned AS (SELECT *, CAST(sum(step) OVER (PARTITION BY conflict_id ORDER BY ord) % {N_ACTIONS} AS INTEGER) AS action_idx
  FROM steps)""",
    )
    + f"SELECT conflict_id, flight_id, ord, action_idx, {_r(f'{_BANKS}[action_idx + 1]')} AS bank FROM turned",
    "advise": RESOLVE + _ADVISORY + "FROM resolved",
    "advise_stream": RESOLVE + _ADVISORY + "FROM resolved",
    "policy_sweep": "WITH RECURSIVE "
    + ",\n".join(
        (
            REPORTS,
            FLIGHTS.replace("flights AS", "flights0 AS", 1),
            SWEPT,
            NEAR,
            *UTILITIES[len(PAIRS) :],
            FAR,
            SWEPT_SEARCH,
            RESOLVED.replace("JOIN roster r", "JOIN swept r", 1),
        )
    )
    + "\n"
    + f"""SELECT scenario_id, ix, iy, flight_id, ord, action_idx,
  {_r('CASE WHEN bank = -1 THEN 0.05::DOUBLE ELSE bank END')} AS shade FROM resolved""",
    "encode_advisories": _with(*CLEAR_BEST)
    + f"""SELECT conflict_id, CAST(0 AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS n_advisories,
  string_agg(flight_id, ',' ORDER BY ord) AS ids,
  string_agg(CASE WHEN action_idx = {N_ACTIONS - 1} THEN 'true' ELSE 'false' END, ',' ORDER BY ord) AS flags
FROM best GROUP BY conflict_id""",
    "decode_advisories": _with(*CLEAR_BEST, BANKED) + _ADVISORY + "FROM banked",
    "decode_advisory": _with(REPORTS)
    + f"""SELECT seq AS event_id, flight_id, seq % 2 = 0 AS clear_of_conflict, {_r('lat')} AS lat,
  {_r('lon')} AS lon, {_r('speed')} AS speed, {_r('heading')} AS heading, CAST(5 AS DOUBLE) AS period_s,
  {_r('CAST(seq % 7 AS DOUBLE) / 40')} AS turn_rate FROM reports WHERE seq % 10 <> 3""",
    "advisory_rejects": "SELECT event_id FROM events WHERE event_id % 10 = 3",
    "apply_advisories": _with(*ADVISED_CTES)
    + f"""SELECT conflict_id, flight_id, CAST(clear_of_conflict AS VARCHAR) AS clear_of_conflict,
  {_r('turn_rate')} AS turn_rate, CAST(period_s AS DOUBLE) AS period_s FROM advised""",
    "unmatched_advisories": _with(REPORTS, FLIGHTS, ROSTER)
    + "SELECT conflict_id, flight_id FROM roster WHERE ord % 2 <> 0",
    "project_straight": _with(REPORTS)
    + f"SELECT seq AS event_id, {_ROUNDED_STATE} FROM (SELECT seq, {_moved('5', '0::DOUBLE')} FROM reports)",
    "project_turn": _with(REPORTS)
    + f"""SELECT seq AS event_id, {_ROUNDED_STATE}
FROM (SELECT seq, {_moved('5', '((seq % 9 - 4 + 0.5) / 20.0)::DOUBLE')} FROM reports)""",
    "project_state": _with(*ADVISED_CTES)
    + f"""SELECT conflict_id, flight_id, {_ROUNDED_STATE}
FROM (SELECT conflict_id, flight_id, {_moved('5', _RATE)} FROM advised)""",
    "rollout": "WITH RECURSIVE "
    + ",\n".join(
        (
            *ADVISED_CTES,
            f"""path AS (
  SELECT conflict_id, flight_id, 0 AS step, {", ".join(_STATE)}, clear_of_conflict, turn_rate FROM advised
  UNION ALL
  SELECT conflict_id, flight_id, step + 1, {_moved('5', _RATE)}, clear_of_conflict, turn_rate
  FROM path WHERE step < 10)""",
        )
    )
    + f"\nSELECT conflict_id, flight_id, step, {_ROUNDED_STATE} FROM path WHERE step > 0",
    "rollout_noise": "WITH RECURSIVE "
    + ",\n".join((*ADVISED_CTES, NOISY_PATH))
    + f"""\nSELECT conflict_id, flight_id, step, {", ".join(f"{_r(c, 3)} AS {c}" for c in _STATE)}
FROM path WHERE step > 0""",
    "with_noise": _with(REPORTS)
    + f"""SELECT seq AS event_id, {_r(
        f"lat + 10 * sqrt(-2 * ln({_noise('seq', 'lat', 1)})) * cos(2 * pi() * {_noise('seq', 'lat', 14)})"
    )} AS lat, {_r(f"speed + 5 * {_noise('seq', 'speed', 1)}")} AS speed FROM reports""",
    "apply_advisories_stream": _with(
        REPORTS,
        """issued AS (SELECT flight_id, seq, event_us - CASE WHEN seq % 3 = 0 THEN 2000000 ELSE 60000000 END AS issued_us
  FROM reports WHERE seq % 3 < 2)""",
    )
    + f"""SELECT r.seq AS event_id, coalesce(a.seq, -1) AS advisory_id, {_r('CAST(a.seq % 7 AS DOUBLE) / 40')} AS turn_rate
FROM reports r LEFT JOIN issued a ON a.flight_id = r.flight_id AND issued_us <= event_us AND issued_us > event_us - 5000000""",
    "ingest_stream": _with(REPORTS, FLIGHTS)
    + f"""SELECT CAST(CAST(conflict_id AS BIGINT) * {GROUP_SECONDS * 1000} AS VARCHAR) AS conflict_id,
  flight_id, {_ROUNDED_STATE} FROM flights""",
}
