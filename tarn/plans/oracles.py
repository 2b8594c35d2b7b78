"""Parts of the queries' SQL counterparts that several share."""

from __future__ import annotations

from ..operators import stats

#: The normal tail by Simpson's rule, as the engine has no error function.
_TAIL = "2 * 0.3989422804014327 * list_sum(list_transform(range(2001), lambda q: CASE WHEN q IN (0, 2000) THEN 1 WHEN q % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z + q * 0.006, 2) / 2))) * 0.006 / 3"


def bootstrap_sql(keys: list[str], source: str, value: str, draws: int, seed: str | None = None) -> str:
    """CTEs v, s, means and ci: AG12's draws, as plain SQL. source has the keys and the value; seed: the text that seeds a group, else of its keys."""
    k = ", ".join(keys)
    text = seed or " || '|' || ".join(f"coalesce({c}::varchar, '')" for c in keys)
    fifth = lambda x: f"((({x}) * ({x}) % {stats.PRIME}) * (({x}) * ({x}) % {stats.PRIME}) % {stats.PRIME} * ({x}) % {stats.PRIME})"
    return f""", v AS (SELECT {k}, ({value})::double AS x FROM {source} WHERE ({value}) IS NOT NULL), s AS (SELECT {k}, count(*) AS n, avg(x) AS mean, list_sort(list(x)) AS xs, ('0x' || substr(sha256({text}), 1, 8))::bigint AS seed FROM v GROUP BY {k}),
 d0 AS (SELECT {k}, n, xs, i, unnest(range(n)) AS j, seed FROM s, range({draws}) r(i)), d1 AS (SELECT {k}, n, xs, i, j, (seed + i * 1000003 + j * 7919 + 12345) % {stats.PRIME} AS a FROM d0),
 d2 AS (SELECT {k}, n, xs, i, ({fifth('a')} + i * 31 + j * 17 + 1) % {stats.PRIME} AS b FROM d1), means AS (SELECT {k}, i, avg(xs[({fifth('b')} % n) + 1]) AS mean FROM d2 GROUP BY {k}, i),
 ci AS (SELECT {k}, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM means GROUP BY {k})"""


def exact_p_sql(tests: str) -> str:
    """A CTE p over tests: the exact distribution of W by a recursion over ranks for n <= 50 without ties, else the normal tail."""
    return f""", ways(n, s, c) AS (SELECT 0::bigint, 0::bigint, 1::double UNION ALL SELECT n, s, sum(c) FROM (SELECT n + 1 AS n, unnest([s, s + n + 1]) AS s, c / 2 AS c FROM ways WHERE n < 50) GROUP BY 1, 2),
 p AS (SELECT t.*, CASE WHEN n <= 50 AND ties = 0 THEN least(1.0, 2 * (SELECT sum(c) FROM ways WHERE ways.n = t.n AND s <= t.w)) ELSE {_TAIL} END AS p FROM {tests} t)"""
