"""DuckDB SQL for the bonus number of 26: its signals, their evaluation and the live choice."""

KEYS = ("sFreq", "sRecency", "sDow", "sOverdue", "sFollower")
W25, W80 = 0.5 ** (1 / 25), 0.5 ** (1 / 80)

SIGNALS = f""", b0 as (select (row_number() over (order by t) - 1)::bigint as s, t, dow, special from draws where special between 1 and 26),
b1 as materialized (select *, lag(special) over (order by s) as p from (select * from b0 union all select (select count(*) from b0), nx.t, nx.dow, null from nx)),
bd as (select b1.*, v.n, (special = v.n)::int as hit from b1 cross join (select unnest(range(1, 27))::int as n) v),
bc as materialized (select *, coalesce(sum(hit) over w, 0)::bigint as c, max(case when hit = 1 then s end) over w as seen, min(case when hit = 1 then s end) over w as first, coalesce(sum(hit) over (partition by n, dow order by s rows between unbounded preceding and 1 preceding), 0) as cd,
  coalesce(sum(hit) over (partition by n, p order by s rows between unbounded preceding and 1 preceding), 0) as cp, count(special) over (partition by n, dow order by s rows between unbounded preceding and 1 preceding) as nd, count(special) over (partition by n, p order by s rows between unbounded preceding and 1 preceding) as np,
  coalesce(sum({1 - W25!r} * hit * power({W25!r}, -s)) over w, 0) * power({W25!r}, s - 1) as ew from bd window w as (partition by n order by s rows between unbounded preceding and 1 preceding)),
bs as materialized (select s, t, n, hit, c, coalesce(s - seen, s) as since, (c + 10 / 26.0) / (s + 10) as "sFreq", ew as "sRecency", (cd + 12 * (c + 10 / 26.0) / (s + 10)) / (nd + 12) as "sDow",
  least(3.0, coalesce(s - seen, s) / greatest(1.0, case when c >= 2 then (seen - first) / (c - 1)::double else 26.0 end)) as "sOverdue", case when p is not null then (cp + 8 * (c + 10 / 26.0) / (s + 10)) / (np + 8) else (c + 10 / 26.0) / (s + 10) end as "sFollower" from bc)"""

_long = " union all ".join(f"select s, t, n, hit, '{k}' as key, case when stddev_pop(\"{k}\") over (partition by s) > 1e-12 then (\"{k}\" - avg(\"{k}\") over (partition by s)) / stddev_pop(\"{k}\") over (partition by s) else 0 end as z from bs where hit is null or t >= 30" for k in KEYS)
CHANCE = 3 / 26
EVALUATED = (
    SIGNALS
    + f""", bl as materialized ({_long}),
bh as materialized (select s, key, sum(hit)::double as h, row_number() over (partition by key order by s) - 1 as i from (select *, row_number() over (partition by s, key order by z desc, n) as r from bl where hit is not null) where r <= 3 group by s, key),
bx as (select s, key, i, h from bh union all select max(s) + 1, key, count(*), null from bh group by key),
bk as materialized (select s, key, i, case when i = 0 then 0.0 else least(power({W80!r}, i - 1) * sum((h - {CHANCE!r}) * case when i = 0 then 1.0 else {1 - W80!r} end * power({W80!r}, -i)) over w, sum(h) over w / i - {CHANCE!r}) end as skill from bx window w as (partition by key order by i rows between unbounded preceding and 1 preceding)),
bw as materialized (select s, key, case when total > 0 and best > 0 then trust * raw / total + (1 - trust) / 5.0 else 1 / 5.0 end as weight from (select *, sum(raw) over (partition by s) as total, greatest(0, least(1, (best / (sqrt({max(0.05, CHANCE)!r}) / sqrt(greatest(1, i))) - 2.0) / 2.5)) as trust
  from (select *, power(greatest(0, skill - 0.35 * best), 2) as raw from (select *, max(skill) over (partition by s) as best from bk)))),
br as materialized (select s, t, n, hit, row_number() over (partition by s order by round(sum(weight * z), 12) desc, n) as r from bl join bw using (s, key) group by s, t, n, hit),
rr as materialized (select r as x, (sum(hit) + 25 / 26.0) / (count(*) + 25) as v, sum(hit)::bigint as hits, count(*) as m from br where hit is not null group by r),
ra as materialized (select a.x as a, b.x as b, (select avg(v) from rr c where c.x between a.x and b.x) as m from rr a join rr b on b.x >= a.x),
rf as materialized (select x, min(top) as fit from (select a.x as a, b.x, max(q.m) as top from rr a join rr b on b.x >= a.x join ra q on q.a = a.x and q.b >= b.x group by 1, 2) group by x) """
)


def queries(ahead: str) -> dict[str, tuple[str, str]]:
    """Name: tables beside those of the base, and the query. ahead: the table of the draw to come."""
    r = ", ".join(f'round("{k}", 6) as "{k}"' for k in KEYS)
    return {
        "bonus_signals": (ahead + SIGNALS, f"select 'main' as game, n, {r} from bs where hit is null"),
        "bonus_backtest": (ahead + EVALUATED, f"select 'main' as game, key, round(avg(h), 6) as mean_hits, count(*) as evaluated, round(avg(h) - {CHANCE!r}, 6) as skill, round(max(weight), 6) as weight from bh join (select key, weight from bw where s = (select max(s) from bw)) using (key) group by key"),
        "bonus_ranks": (ahead + EVALUATED, "select 'main' as game, x::int as rank, hits, m as evaluated, round(v, 6) as rate, round(fit, 6) as fit from rr join rf using (x)"),
        "bonus_points": (ahead + EVALUATED, "select 'main' as game, t, max((r = 1)::int * hit)::bigint as top1, max((r <= 3)::int * hit)::bigint as top3, array_to_string(list(n order by r)[1:3], '-') as picks from br where hit is not null group by t"),
        "bonus_picks": (ahead + EVALUATED, "select 'main' as game, r::int as place, n, round(coalesce(fit, 1 / 26.0), 6) as probability, c as count, since from br join bs using (s, n) left join rf on rf.x = r where br.hit is null and r <= 4"),
    }
