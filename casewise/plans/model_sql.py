"""SQL counterparts of models, lookups and predictions; states are '|'-joined text."""

from __future__ import annotations

from casewise.plans.registry import CASES, POSITIONS

ALL_TRAIN = "evs AS (SELECT *, TRUE AS train FROM ev)"
SPLIT = [
    CASES,
    "ranked AS (SELECT *, row_number() OVER (ORDER BY case_seq) AS r, count(*) OVER () AS n FROM cases)",
    "evs AS (SELECT ev.*, r <= floor(n * 0.7) AS train FROM ev JOIN ranked USING (case_id))",
    "tev AS (SELECT case_id, case_seq, pos, activity, ts FROM evs WHERE NOT train UNION ALL "
    "SELECT DISTINCT case_id, case_seq, case_len, '__stop__', CAST(NULL AS TIMESTAMP) FROM evs WHERE NOT train)",
]


def base(log: str, *, split: bool = False) -> list[str]:
    return [log, POSITIONS, *(SPLIT if split else [ALL_TRAIN])]


def over(frame: str) -> str:
    return f"OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN {frame})"


def state(kind: tuple, *, after: bool = False) -> str:
    """State before (or after) the event as text."""
    end = "CURRENT ROW" if after else "1 PRECEDING"
    every = over(f"UNBOUNDED PRECEDING AND {end}")
    if kind[0] == "ngram":
        if kind[1] == 0:
            return "''"
        start = kind[1] - 1 if after else kind[1]
        return f"coalesce(string_agg(activity, '|') {over(f'{start} PRECEDING AND {end}')}, '')"
    if kind[0] == "fpt":
        return f"coalesce(string_agg(activity, '|') {every}, '')"
    if kind[0] == "bag":
        return f"coalesce(array_to_string(list_sort(list_distinct(list(activity) {every})), '|'), '')"
    if kind[0] == "parikh":
        cap = kind[1] or 1_000_000
        parts = [f"least(count(*) FILTER (activity = '{a}') {every}, {cap})" for a in ("F", "O", "P")]
        return "concat_ws(',', " + ", ".join(parts) + ")"
    raise ValueError(kind)


def initial(kind: tuple) -> str:
    return "0,0,0" if kind[0] == "parikh" else ""


def model(kind: tuple, p: str = "", gate: int = 1, stop: bool = True) -> list[str]:
    """CTEs <p>tr, <p>freq, <p>vis, <p>probs, <p>pred of a model trained on the train events."""
    s0 = initial(kind)
    return [
        f"{p}tr AS (SELECT *, {state(kind)} AS s, {state(kind, after=True)} AS n FROM evs WHERE train)",
        f"{p}freq AS (SELECT s, activity, n, count(*) AS f FROM {p}tr GROUP BY ALL)",
        f"{p}vis AS (SELECT s, CAST(sum(c) AS BIGINT) AS visits FROM (SELECT n AS s, count(*) AS c FROM {p}tr GROUP BY 1 "
        f"UNION ALL SELECT '{s0}', count(DISTINCT case_id) FROM {p}tr) GROUP BY s)",
        f"{p}dep AS (SELECT v.s, v.visits, coalesce(d.f, 0) AS dep FROM {p}vis v LEFT JOIN "
        f"(SELECT s, sum(f) AS f FROM {p}freq GROUP BY s) d ON v.s = d.s)",
        f"{p}probs AS (SELECT v.s, v.visits, f.activity, f.f / v.visits AS p FROM {p}dep v JOIN {p}freq f ON v.s = f.s "
        f"WHERE v.visits >= {gate} UNION ALL SELECT s, visits, '__stop__', (visits - dep) / visits FROM {p}dep WHERE visits >= {gate})",
        *ranks(p),
    ]


def ranks(p: str = "", source: str = "probs", key: str = "s") -> list[str]:
    return [
        f"{p}rk AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(p, 12) DESC, activity) AS rk "
        f"FROM {p}{source} WHERE p > 0)",
        f"{p}pred AS (SELECT {key}, max(activity) FILTER (rk = 1) AS a1, max(activity) FILTER (rk = 2) AS a2, "
        f"max(activity) FILTER (rk = 3) AS a3, max(p) FILTER (rk = 1) AS p1 FROM {p}rk GROUP BY {key})",
    ]


def access(kind: tuple, p: str = "") -> str:
    w = kind[1]
    return (
        f"{p}acc AS (SELECT DISTINCT array_to_string(list_slice(string_split(n, '|'), 1, k), '|') AS s FROM "
        f"(SELECT DISTINCT n FROM {p}tr) CROSS JOIN range(1, {w} + 1) g(k) WHERE len(string_split(n, '|')) >= k "
        "UNION SELECT '')"
    )


def lookup(kind: tuple, p: str = "") -> list[str]:
    """CTE <p>look: every test position with its known state ``s`` (null if none)."""
    if kind[0] == "ngram" and kind[1] > 0:
        w = kind[1]
        cols = ", ".join(
            f"string_agg(activity, '|') {over(f'{k} PRECEDING AND 1 PRECEDING')} AS s{k}" for k in range(1, w + 1)
        )
        joins = " ".join(f"LEFT JOIN {p}acc a{k} ON t.s{k} = a{k}.s" for k in range(1, w + 1))
        best = "coalesce(" + ", ".join(f"a{k}.s" for k in range(w, 0, -1)) + ", NULL)"
        return [
            access(kind, p),
            f"{p}cand AS (SELECT *, {cols} FROM tev)",
            f"{p}look AS (SELECT t.case_id, t.case_seq, t.pos, t.activity, t.ts, CASE WHEN t.pos = 0 THEN '' ELSE {best} END AS s "
            f"FROM {p}cand t {joins})",
        ]
    return [
        f"{p}raw AS (SELECT *, {state(kind)} AS rs FROM tev)",
        f"{p}hit AS (SELECT t.*, CASE WHEN f.s IS NULL THEN 0 ELSE 1 END AS hit FROM {p}raw t LEFT JOIN {p}freq f "
        f"ON t.rs = f.s AND t.activity = f.activity)",
        f"{p}look AS (SELECT case_id, case_seq, pos, activity, ts, CASE WHEN coalesce(min(hit) "
        f"{over('UNBOUNDED PRECEDING AND 1 PRECEDING')}, 1) = 1 THEN rs END AS s FROM {p}hit)",
    ]


def scored(kind: tuple, p: str = "", gate: int = 1) -> list[str]:
    """CTE <p>sc: test positions with known state and prediction a1, a2, a3, p1."""
    return [
        *model(kind, p, gate),
        *lookup(kind, p),
        f"{p}sc AS (SELECT l.*, q.a1, q.a2, q.a3, q.p1 FROM {p}look l LEFT JOIN {p}pred q ON l.s = q.s)",
    ]


OUTCOMES = (
    "count(*) AS total, count(*) FILTER (a1 = activity) AS correct, count(*) FILTER (a1 <> activity) AS wrong, "
    "count(*) FILTER (a1 IS NULL) AS empty, count(*) FILTER (a1 = activity) AS top1, "
    "count(*) FILTER (a1 = activity OR a2 = activity) AS top2, "
    "count(*) FILTER (a1 = activity OR a2 = activity OR a3 = activity) AS top3"
)
