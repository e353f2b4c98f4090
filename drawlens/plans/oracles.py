"""DuckDB SQL that gives the rows of the queries, over the same tables. Nothing here comes from the code that it is held against: laws and constants are written out once more."""

from math import comb

from drawlens.plans import bonus_sql, rules_sql

K, D, KS = 69, 5, 26
# The lower prizes, by main numbers and bonus.
PRIZES = [(5, False, 1_000_000.0), (4, True, 50_000.0), (4, False, 100.0), (3, True, 100.0), (3, False, 7.0), (2, True, 7.0), (1, True, 4.0), (0, True, 4.0)]


def hyper(picked: int, m: int) -> float:
    """The chance that m of `picked` numbers are among the five drawn."""
    return comb(picked, m) * comb(K - picked, D - m) / comb(K, D)

BASE = """with li as (select distinct l_orderkey, (l_partkey % 69 + 1)::int as n from lineitem),
r as (select l_orderkey, n, row_number() over (partition by l_orderkey order by (n*7919 + l_orderkey*31) % 10007, n) rn, count(*) over (partition by l_orderkey) c from li),
p as (select l_orderkey, n from r where c >= 5 and rn <= 5),
od as (select o.*, o_orderdate::date as date, (row_number() over (order by o_orderdate::date, o_orderkey) - 1)::bigint as t from orders o where o_orderkey in (select l_orderkey from p)),
hits as (select od.t, dayofweek(od.date)::int as dow, p.n from od join p on od.o_orderkey = p.l_orderkey),
lists as (select t, list(n order by n) as s from hits group by t),
draws as (select 'main' as game, od.t, od.date, dayofweek(od.date)::int as dow, l.s, (o_custkey % 26 + 1)::int as special, o_totalprice as jackpot, case when o_orderpriority = '1-URGENT' then n_name end as winner_location
  from od join lists l on l.t = od.t left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey),
sizes as (select count(*) as draws from draws),
pool as (select unnest(range(1, 70))::int as n),
freq as (select pool.n, coalesce(h.hits, 0)::bigint as hits, h.last_seen, draws, (coalesce(h.hits, 0) + 5.0/69) / (draws + 1) as rate, coalesce(draws - h.last_seen, draws)::bigint as since
  from pool cross join sizes left join (select n, count(*) as hits, max(t) as last_seen from hits group by n) h on h.n = pool.n),
days as (select dow, count(*) as draws, max(t) as last from draws group by dow),
wd as (select d.dow, pool.n, coalesce(h.hits, 0)::bigint as hits, d.draws from days d cross join pool left join (select dow, n, count(*) as hits from hits group by dow, n) h on h.dow = d.dow and h.n = pool.n),
gp as (select n, t, t - lag(t) over (partition by n order by t) as gap from hits),
gs as (select pool.n, coalesce(g.c, 0)::bigint as gaps, coalesce(g.m, 69.0/5) as mean_gap, case when coalesce(g.c, 0) >= 2 then g.s else coalesce(g.m, 69.0/5) end as gap_sd, g.x as max_gap
  from pool left join (select n, count(gap) as c, avg(gap) as m, stddev_pop(gap) as s, max(gap) as x from gp group by n) g on g.n = pool.n),
rc as (select pool.n, draws, count(h.n) as hits, count(case when h.t >= draws - 10 then 1 end) as last_10, count(case when h.t >= draws - 20 then 1 end) as last_20, count(case when h.t >= draws - 50 then 1 end) as last_50, count(case when h.t >= draws - 100 then 1 end) as last_100
  from pool cross join sizes left join hits h on h.n = pool.n group by pool.n, draws),
succ as (select b.t, b.dow, a.n as j, b.n as i from hits a join hits b on b.t = a.t + 1),
trans as (select j, i, f.followed, c.chances from (select j, i, count(*) as followed from succ group by j, i) f join (select n, count(*) as chances from hits cross join sizes where t < draws - 1 group by n) c on c.n = f.j),
grid as (select d.t, d.dow, pool.n, (h.n is not null)::int as hit from draws d cross join pool left join hits h on h.t = d.t and h.n = pool.n),
sched as (select dow, draws from days where draws >= (select greatest(2, floor(sum(draws) * 0.04)) from days))
"""


def _queries() -> dict[str, str]:
    q = {}
    q["ball_frequency"] = "select 'main' as game, n, hits, round(rate, 6) as rate, last_seen, since from freq"
    q["ball_by_weekday"] = "select 'main' as game, dow, n, hits, draws from wd"
    q["schedule_detect"] = "select 'main' as game, dow, draws from sched"
    q["gap_stats"] = "select 'main' as game, n, gaps, round(mean_gap, 6) as mean_gap, round(gap_sd, 6) as gap_sd, max_gap from gs"
    q["window_counts"] = "select 'main' as game, n, draws, hits, last_10, last_20, last_50, last_100 from rc"
    hot = f"select n, last_20, round((last_20 - least(draws, 20) * p) / sqrt(greatest(1e-9, least(draws, 20) * p * (1 - p))), 9) as z from (select *, (hits + 10.0 * {D}/{K}) / (draws + 10) as p from rc)"
    q["hot_cold"] = f"""select 'main' as game, kind, place::int as place, n, last_20, round(z, 6) as z from (
      select 'hot' as kind, row_number() over (order by z desc, n) as place, n, last_20, z from ({hot}) union all select 'cold', row_number() over (order by z, n desc), n, last_20, z from ({hot})) where place <= 8"""
    q["overdue"] = """select 'main' as game, place::int as place, n, since, round(mean_gap, 6) as mean_gap, round(ratio, 6) as ratio from (select *, row_number() over (order by ratio desc, n) as place from
      (select f.n, f.since, g.mean_gap, round(f.since / greatest(1.0, g.mean_gap), 9) as ratio from freq f join gs g using (n) where f.hits >= 2)) where place <= 8"""
    fix = (D - 1) * K / (D * (K - 1))
    q["top_pairs"] = f"""select 'main' as game, place::int as place, a, b, together, round(expected, 6) as expected, round(lift, 6) as lift from (select *, row_number() over (order by together desc, lift desc, a, b) as place from (select *, round((together + 0.5) / (expected + 0.5), 9) as lift from
      (select x.a, x.b, x.together, fa.hits * fb.hits / fa.draws::double * {fix!r} as expected from (select h1.n as a, h2.n as b, count(*) as together from hits h1 join hits h2 on h1.t = h2.t and h1.n < h2.n group by 1, 2) x join freq fa on fa.n = a join freq fb on fb.n = b where together >= 2))) where place <= 15"""
    q["pair_counts"] = "select 'main' as game, h1.n as a, h2.n as b, count(*) as together from hits h1 join hits h2 on h1.t = h2.t and h1.n < h2.n group by 2, 3"
    q["transitions"] = "select 'main' as game, j, i, followed, chances from trans"
    p = D / K
    q["top_followers"] = f"""select 'main' as game, place::int as place, j, i, followed, chances, round(lift, 6) as lift, round(z, 6) as z from (select *, row_number() over (order by round(lift * ln(1 + followed), 9) desc, j, i) as place from
      (select *, followed / chances::double / {p!r} as lift, (followed - chances * {p!r}) / sqrt(chances * {p * (1 - p)!r}) as z from trans where chances >= 6 and followed >= 4) where z >= 4) where place <= 12"""
    q["repeat_rate"] = "select 'main' as game, i as n, followed as repeated, chances, round(followed / chances::double, 6) as rate from trans where i = j"
    q["position_counts"] = "select 'main' as game, position::int as position, n as v, count(*) as hits from (select n, row_number() over (partition by t order by n) as position from hits) group by 2, 3"
    q["hazard"] = """select 'main' as game, gap, count(*) as exposures, sum(hit)::bigint as hits from (select hit, least(199, coalesce(t - max(case when hit = 1 then t end) over (partition by n order by t rows between unbounded preceding and 1 preceding), t)) as gap from grid) group by gap"""
    q["draw_shape"] = "select 'main' as game, count(*) as draws, round(avg(list_sum(s)), 6) as mean_sum, round(greatest(stddev_pop(list_sum(s)), 1e-9), 6) as sum_sd, round(avg(s[5] - s[1]), 6) as mean_spread from draws"
    q["odd_counts"] = "select 'main' as game, len(list_filter(s, lambda x: x % 2 = 1))::int as odd, count(*) as draws from draws group by 2"
    q["bonus_counters"] = "select 'main' as game, special, count(*) as hits, max(t)::int as last_seen, round(avg(gap), 6) as mean_gap from (select special, t, t - lag(t) over (partition by special order by t) as gap from draws) group by special"
    q["weekday_chi2"] = f"""select 'main' as game, dow, draws, round(chi2, 6) as chi2, round((chi2 - 68) / sqrt(136.0), 6) as z from (select dow, w.draws, sum(power(w.hits - w.draws * 5.0 / 69, 2) / (w.draws * 5.0 / 69)) * 68 / 64 as chi2
      from wd w where w.draws >= 20 and w.draws * 5.0 / 69 >= 1 and dow in (select dow from sched) group by dow, w.draws)"""
    q["dow_profiles"] = """select 'main' as game, dow, place::int as place, n, hits, round(rate, 6) as rate, round(lift, 6) as lift from (select *, row_number() over (partition by dow order by hits desc, lift desc, n) as place from
      (select w.dow, w.n, w.hits, w.hits / w.draws::double as rate, round(w.hits / w.draws::double / (f.hits / f.draws::double), 9) as lift from wd w join sched using (dow) join freq f on f.n = w.n where w.hits > 0)) where place <= 6"""
    mo = "select n, round(last_10 / least(draws, 10)::double - last_50 / least(draws, 50)::double, 9) as m from rc"
    q["trends"] = f"""select 'main' as game, kind, place::int as place, n, round(m, 6) as momentum from (select 'rising' as kind, row_number() over (order by m desc, n) as place, n, m from ({mo}) where m > 0 union all select 'falling', row_number() over (order by m, n desc), n, m from ({mo}) where m < 0) where place <= 6"""
    runs = "(select n, count(*) as run, max(t) as ended from (select n, t, t - row_number() over (partition by n order by t) as island from hits) group by n, island)"
    q["streaks"] = f"select 'main' as game, n, coalesce(max(case when ended = draws - 1 then run end), 0)::bigint as streak, max(run) as max_streak from {runs} cross join sizes group by n"
    q["current_streaks"] = f"select 'main' as game, place::int as place, n, streak from (select n, streak, row_number() over (order by streak desc, n) as place from (select n, max(run) as streak from {runs} cross join sizes where ended = draws - 1 and run >= 2 group by n)) where place <= 8"
    q["rolling_sum_mean"] = "select 'main' as game, t, list_sum(s)::int as total, round(avg(list_sum(s)) over (order by t rows between 9 preceding and current row), 6) as mean_10 from draws"
    pos = "(select t, n as v, (row_number() over (partition by t order by n))::int as position from hits)"
    q["position_profiles"] = f"""select 'main' as game, position, min(v) as least, min(case when cum >= 0.25 then v end) as p25, min(case when cum >= 0.5 then v end) as median, min(case when cum >= 0.75 then v end) as p75, max(v) as most from
      (select position, v, sum(c) over (partition by position order by v) / sum(c) over (partition by position)::double as cum from (select position, v, count(*) as c from {pos} group by position, v)) group by position"""
    theory = ", ".join(f"({r}, {v}, {comb(v - 1, r - 1) * comb(K - v, D - r) / comb(K, D)!r})" for r in range(1, D + 1) for v in range(1, K + 1))
    q["position_stats"] = f"""select 'main' as game, a.position, a.draws, round(mean, 6) as mean, round(sd, 6) as sd, "distinct", p10, p25, p50, p75, p90, round(expected, 6) as expected, round(chi2, 6) as chi2, dof::bigint as dof from
      (select position, count(*) as draws, avg(v) as mean, stddev_pop(v) as sd, count(distinct v) as "distinct", {", ".join(f"min(case when i = least(m - 1, floor({f} * m)) then v end) as p{round(f * 100)}" for f in (0.1, 0.25, 0.5, 0.75, 0.9))} from
        (select position, v, row_number() over (partition by position order by v, t) - 1 as i, count(*) over (partition by position) as m from {pos}) group by position) a
      join (select e.position, sum(e.v * e.p) as expected, sum(case when draws * e.p >= 5 then power(coalesce(o.c, 0) - draws * e.p, 2) / (draws * e.p) end) as chi2, greatest(1, sum((draws * e.p >= 5)::int) - 1) as dof
        from (values {theory}) e(position, v, p) cross join sizes left join (select position, v, count(*) as c from {pos} group by position, v) o on o.position = e.position and o.v = e.v group by e.position) b on b.position = a.position"""
    q["order_stat_pmf"] = f"select * from (select position::int as position, v::int as v, round(p, 9) as p from (values {theory}) e(position, v, p))"
    q["exact_repeats"] = "select 'main' as game, array_to_string(s, '-') as numbers, count(*) as draws, min(t) as first, max(t) as last from draws group by 2 having count(*) > 1"
    pairs = "(select a.t as a, b.t as b, count(*) as o from hits a join hits b on a.n = b.n and a.t < b.t group by 1, 2)"
    levels = ", ".join(f"({m}, {hyper(D, m)!r})" for m in range(D + 1))
    q["pair_overlap_hist"] = f"""select 'main' as game, l.m::int as overlap, (case when l.m = 0 then draws * (draws - 1) // 2 - (select count(*) from pp) else coalesce(c, 0) end)::bigint as pairs, round(l.p * draws * (draws - 1) / 2, 6) as expected from (values {levels}) l(m, p) cross join sizes left join (select o, count(*) as c from pp group by o) x on x.o = l.m"""
    q["closest_pairs"] = "select 'main' as game, place::int as place, a, b, o::int as overlap from (select a, b, o, row_number() over (order by a, b) as place from pp where o = (select max(o) from pp)) where place <= 4"
    q["latest_sharing"] = "select 'main' as game, len(list_intersect(s, (select s from draws order by t desc limit 1)))::int as overlap, count(*) as draws, max(t) as last from draws group by 2"
    q["era_detect"] = """select 'main' as game, kind, cutoff, draws, draws - cutoff as kept, cm::int as current_max, coalesce(pm, hm)::int as prior_max from (select *, case when shrink is not null then case when cm > pm then greatest(shrink, (select min(t) from draws where s[5] > pm)) else shrink end when cm >= hm + 6 then grow end as cutoff, case when shrink is not null then 'shrink' when cm >= hm + 6 then 'grow' end as kind from
      (select *, (select max(s[5]) from draws where t < shrink) as pm from (select draws, cm, hm, (select max(t) + 1 from draws where s[5] > cm or (cs > 0 and special > cs)) as shrink, (select min(t) from draws where s[5] > hm) as grow from
        (select draws, max(case when t >= draws - greatest(60, floor(draws * 0.05)) then s[5] end) as cm, max(case when t >= draws - greatest(60, floor(draws * 0.05)) then special end) as cs, max(case when t < floor(draws * 0.3) then s[5] end) as hm from draws d cross join sizes where draws >= 240 group by draws)))) where cutoff > 0 and draws - cutoff >= 120"""
    q["jackpot_stats"] = """select 'main' as game, count(jackpot) as known, arg_max(jackpot, t) as latest, max(jackpot) as biggest, (select t from draws order by jackpot desc, t limit 1) as biggest_t, count(winner_location) as winners, coalesce(max(draws) - 1 - max(case when winner_location is not null then t end), 0)::bigint as rollover,
      round(corr(jackpot, sales), 6) as sales_corr from draws d cross join sizes left join (select od.date, sum(l_extendedprice) as sales from (select o_orderkey, o_orderdate::date as date from orders) od join lineitem on l_orderkey = o_orderkey group by od.date) x on x.date = d.date"""
    q["attach_sales"] = "select 'main' as game, t, round(sales, 2) as sales from draws d left join (select od.date, sum(l_extendedprice) as sales from (select o_orderkey, o_orderdate::date as date from orders) od join lineitem on l_orderkey = o_orderkey group by od.date) x on x.date = d.date"
    q["recent_winners"] = "select 'main' as game, place::int as place, t, jackpot, winner_location from (select *, row_number() over (order by t desc) as place from draws where winner_location is not null) where place <= 10"
    q["jackpot_thirds"] = """select 'main' as game, round(lm, 6) as low_mean, round(hm, 6) as high_mean, round((hm - lm) / sqrt(vl / nl + vh / nh), 6) as welch_t from (select avg(case when part = 'l' then n end) as lm, avg(case when part = 'h' then n end) as hm, var_samp(case when part = 'l' then n end) as vl, var_samp(case when part = 'h' then n end) as vh, count(case when part = 'l' then 1 end) as nl, count(case when part = 'h' then 1 end) as nh from
      (select h.n, case when i < floor(m / 3) then 'l' when i >= m - floor(m / 3) then 'h' end as part from (select t, row_number() over (order by jackpot, t) - 1 as i, count(*) over () as m from draws) x join hits h on h.t = x.t))"""
    q["jackpot_projection"] = """select 'main' as game, case when lw then 'reset' else 'roll' end as basis, round(case when lw then (select list_sort(list(jackpot))[(count(*) // 2 + 1)::int] from (select jackpot from seq where bw order by t desc limit 20))
      else lj + (select list_sort(list(step))[(count(*) // 2 + 1)::int] from (select jackpot - before as step from seq where not bw and jackpot > before order by t desc limit 30)) end, 6) as projected from (select arg_max(won, t) as lw, arg_max(jackpot, t) as lj from seq)"""
    tiers = ", ".join(f"({m}, {str(b).lower()}, {x!r}, {hyper(D, m) * (1 / KS if b else 1 - 1 / KS)!r})" for m, b, x in PRIZES)
    chance = 1 / (comb(K, D) * KS)
    q["ticket_ev"] = f"""select 'main' as game, t, round(lower, 9) as lower_value, round(1 - exp(-1e7 * {chance!r}), 9) as split, round((1 - exp(-1e7 * {chance!r})) / (1e7 * {chance!r}), 9) as share, round(lower + jackpot * {chance!r} * (1 - exp(-1e7 * {chance!r})) / (1e7 * {chance!r}) - 2.0, 9) as value from draws cross join (select sum(x * c) as lower from (values {tiers}) v(m, b, x, c))"""
    q["hypergeom_dist"] = "select 'main' as game, x.hits::int as hits, draws, round(p, 12) as p from (select len(list_intersect(s, top)) as hits, count(*) as draws from draws cross join (select list(n) as top from (select n from freq order by hits desc, n limit 10)) group by 1) x join (values " + ", ".join(f"({m}, {hyper(10, m)!r})" for m in range(D + 1)) + ") v(hits, p) using (hits)"
    tk = "(select (c_custkey)::bigint as ticket, list_sort([(1 + i * 13 + c_custkey % 13)::int for i in range(5)]) as numbers, (c_custkey % 26 + 1)::int as special, case when c_custkey % 11 > 0 then '1995-01-01'::date + (c_custkey % 2400)::int end as for_date from customer)"
    grade = f"""(select ticket, numbers, special, status, case when s is not null then len(list_intersect(numbers, s))::int end as mains, case when s is not null then coalesce(special = drawn, false) end as special_hit from
      (select k.ticket, k.numbers, k.special, case when k.for_date is null then 'open' when d.s is null then 'pending' else 'settled' end as status, case when k.for_date is null then l.s else d.s end as s, case when k.for_date is null then l.special else d.special end as drawn
      from {tk} k left join (select date, arg_max(s, t) as s, arg_max(special, t) as special from draws group by date) d on d.date = k.for_date cross join (select arg_max(s, t) as s, arg_max(special, t) as special from draws) l))"""
    prize = "case when g.mains is not null then case when g.mains = 5 and g.special_hit then 0.0 else coalesce(v.x, 0.0) end end"
    graded = f"(select g.*, {prize} as prize, coalesce(g.mains = 5 and g.special_hit, false) as jackpot from {grade} g left join (values {tiers}) v(m, b, x, c) on v.m = g.mains and v.b = g.special_hit)"
    q["tier_grade"] = f"select 'main' as game, ticket, status, mains, special_hit, jackpot, prize from {graded}"
    q["ticket_ledger"] = f"""select 'main' as game, tickets, settled, pending, "open", spent, won, won - spent as net, best // 2 as best_mains, best % 2 = 1 as best_special from (select count(*) as tickets, count(case when status = 'settled' then 1 end) as settled, count(case when status = 'pending' then 1 end) as pending, count(case when status = 'open' then 1 end) as "open",
      sum(case when status <> 'open' then 2.0 else 0 end) as spent, sum(case when status = 'settled' then prize else 0 end) as won, max(case when status = 'settled' then mains * 2 + special_hit::int end)::int as best from {graded})"""
    st = "[s[2]-s[1], s[3]-s[2], s[4]-s[3], s[5]-s[4]]"
    q["crowd_markers"] = f"""select 'main' as game, t, array_to_string(list_filter([case when s[5] <= 12 then 'months' when s[5] <= 31 then 'calendar' end, case when list_min({st}) = list_max({st}) then case when s[2] - s[1] = 1 then 'run' else 'step' end end,
      case when len(list_filter(s, lambda x: x % 5 = 0)) = 5 then 'fives' end, case when len(list_distinct([x % 10 for x in s])) = 1 then 'same_digit' end, case when row_number() over (partition by s order by t) > 1 then 'past_winner' end], lambda x: x is not null), ',') as markers from draws"""
    e = f"(draws * {D / K!r})"
    q["ball_chi2"] = f"select 'main' as game, 'ball_chi2' as test, round(v, 6) as value, round((v - 68) / sqrt(136.0), 6) as z from (select sum(power(hits - {e}, 2) / {e}) as v from freq)"
    q["serial_corr"] = "select 'main' as game, 'serial' as test, round(v, 6) as value, round(v * sqrt(n), 6) as z from (select sum((a - m) * (b - m)) / sum(power(a - m, 2)) as v, max(n) as n from (select list_sum(s)::double as a, lead(list_sum(s)) over (order by t)::double as b, avg(list_sum(s)) over () as m, count(*) over () as n from draws))"
    colex = " + ".join("(" + " * ".join(f"(s[{i}] - {1 + j})" for j in range(i)) + f")::double / {float(__import__('math').factorial(i))!r}" for i in range(1, D + 1))
    q["ks_colex"] = f"select 'main' as game, 'combination_ks' as test, round(v, 6) as value, round(v * 2 / (1.36 / sqrt(n)), 6) as z from (select max(greatest(abs(u - i / n::double), abs((i + 1) / n::double - u))) as v, max(n) as n from (select u, row_number() over (order by u, t) - 1 as i, count(*) over () as n from (select t, ({colex}) / {float(comb(K, D))!r} as u from draws)))"
    e2, p2 = D * D / K, D / K
    var = e2 * (1 - D / K)
    q["repeat_test"] = f"select 'main' as game, 'repeat_rate' as test, round(v, 6) as value, round((v - {e2!r}) / sqrt({var!r} / n), 6) as z from (select avg(len(list_intersect(s, b))) as v, count(*) as n from (select s, lag(s) over (order by t) as b from draws) where b is not null)"
    q["mean_gap_test"] = f"select 'main' as game, 'mean_gap' as test, round(v, 6) as value, round((v - {1 / p2!r}) / sqrt({(1 - p2) / p2**2!r} / n), 6) as z from (select avg(gap) as v, count(gap) as n from gp)"
    q["bonus_chi2"] = "select 'main' as game, 'bonus_chi2' as test, round(v, 6) as value, round((v - 25) / sqrt(50.0), 6) as z from (select sum(c * c)::double * 26 / sum(c) - sum(c) as v from (select special, count(*) as c from draws group by special) having sum(c) >= 201)"
    q["sum_record"] = "select 'main' as game, min(list_sum(s))::int as least, min(case when list_sum(s) = (select min(list_sum(s)) from draws) then t end) as least_t, max(list_sum(s))::int as most, min(case when list_sum(s) = (select max(list_sum(s)) from draws) then t end) as most_t from draws"
    presets = {
        "pos4low": (321, "s[4] <= 5"), "pos5low": (126, "s[5] <= 9"), "run": (65, "s[5] - s[1] = 4"), "clustered": (8385, f"len(list_filter({st}, lambda x: x = 1)) >= 3"), "allHigh": (252, "s[1] >= 60"),
        "window10": (7686, "s[5] - s[1] <= 9"), "digit4": (20670, "list_max([len(list_filter(s, lambda v: v % 10 = x)) for x in range(10)]) >= 4"), "dates": (169911, "s[5] <= 31"),
    }
    q["preset_eliminations"] = " union all ".join(f"select 'main' as game, '{n}' as preset, {c}::bigint as combinations, round({c / comb(K, D)!r}, 9) as share, round({c}::double * count(*) / {float(comb(K, D))!r}, 6) as expected, count(case when {test} then 1 end) as observed from draws" for n, (c, test) in presets.items())
    past = "over (partition by n order by t rows between {} preceding and 1 preceding)"
    q["rolling_counts_asof"] = f"select 'main' as game, t, n, hit, coalesce(sum(hit) {past.format('unbounded')}, 0)::bigint as c, coalesce(sum(hit) {past.format(10)}, 0)::bigint as c10, coalesce(sum(hit) {past.format(20)}, 0)::bigint as c20, coalesce(sum(hit) {past.format(50)}, 0)::bigint as c50, max(case when hit = 1 then t end) {past.format('unbounded')} as last_seen from grid"
    q["weekday_recent_asof"] = "select 'main' as game, t, n, coalesce(sum(hit) over w8, 0)::bigint as c_dow8, coalesce(sum(hit) over wall, 0)::bigint as c_dow from grid window w8 as (partition by n, dow order by t rows between 8 preceding and 1 preceding), wall as (partition by n, dow order by t rows between unbounded preceding and 1 preceding)"
    w = 0.5 ** (1 / 20)
    q["ewma_asof"] = f"select 'main' as game, d.t, pool.n, round(coalesce(sum({1 - w!r} * power({w!r}, d.t - 1 - h.t)), 0), 6) as recency from draws d cross join sizes cross join pool left join hits h on h.n = pool.n and h.t < d.t and h.t >= d.t - 1080 group by d.t, pool.n"
    tests = family_tests(*[f"s[{i}]" for i in range(1, 6)])
    why = " ".join(f"when {tests[n]} then '{n}'" for n in CUT_ORDER)
    first = "(select case when draws > 120 then 120 else 0 end from sizes)"
    q["pool_replay"] = f"""select 'main' as game, date, t, cut_by is null as kept, cut_by from (select date, t, case when nth > 1 then 'drawn' when s[4] <= 5 or s[5] <= 9 then 'low' when t > {first} and (total <= lo or total >= hi) then 'record' {why} end as cut_by, row_number() over (partition by date order by t) as r
      from (select date, t, s, total, row_number() over (partition by s order by t) as nth, min(total) over (order by t rows between unbounded preceding and 1 preceding) as lo, max(total) over (order by t rows between unbounded preceding and 1 preceding) as hi from (select *, list_sum(s)::int as total from draws)) where t >= {first}) where r = 1"""
    binomial = lambda n, m: "(" + f"case {m} when 0 then 1.0 " + " ".join(f"when {j} then " + " * ".join(f"({n} - {i}) / {i + 1}.0" for i in range(j)) for j in range(1, 6)) + " end)"
    q["overlap_law"] = f"""select 'main' as game, t, o as overlap, round(({binomial("size", "o")} * {binomial("(69 - size)", "(5 - o)")}) / 11238513.0, 9) as p from (select t, len(list_distinct(flatten(list(s) over (order by t rows between 10 preceding and 1 preceding)))) as size from draws) cross join (select unnest(range(0, 6))::int as o) where t > 0"""
    f20 = "(hits + 20.0 * 5/69) / (draws + 20)"
    q["freq_signal"] = f"select 'main' as game, n, round({f20}, 6) as value from freq"
    q["zone_signal"] = "select 'main' as game, a.n, round(sum(exp(-power((b.n - a.n) / 2.0, 2) / 2) * b.hits) / sum(exp(-power((b.n - a.n) / 2.0, 2) / 2)), 6) as value from freq a join freq b on b.n between a.n - 5 and a.n + 5 group by a.n"
    q["hot_signal"] = f"select 'main' as game, n, round(z, 6) as value from ({hot.replace('round(', '').replace(', 9) as z', ' as z')})"
    q["overdue_signal"] = "select 'main' as game, f.n, round(least(3.0, f.since / greatest(1.0, g.mean_gap)), 6) as value from freq f join gs g using (n)"
    q["cycle_signal"] = "select 'main' as game, f.n, round(case when g.gaps < 4 then 0.0 else exp(-power((f.since - g.mean_gap) / greatest(1.0, g.gap_sd), 2) / 2) * g.mean_gap / (greatest(1.0, g.gap_sd) + g.mean_gap) end, 6) as value from freq f join gs g using (n)"
    q["hazard_signal"] = "select 'main' as game, f.n, round((coalesce(h.hits, 0) + 40 * 5.0/69) / (coalesce(h.exposures, 0) + 40), 6) as value from freq f left join hz h on h.gap = least(199, f.since)"
    q["repeat_signal"] = f"""select 'main' as game, f.n, round(case when list_contains((select s from draws order by t desc limit 1), f.n) then (coalesce(tr.followed, 0) + 25 * {f20}) / (oc.opp + 25) else (f.hits - coalesce(tr.followed, 0) - list_contains((select s from draws where t = 0), f.n)::int + 25 * {f20}) / (greatest(0, f.draws - 1 - oc.opp) + 25) end, 6) as value
      from freq f join (select pool.n, count(h.n) as opp from pool cross join sizes left join hits h on h.n = pool.n and h.t < draws - 1 group by pool.n) oc on oc.n = f.n left join trans tr on tr.j = f.n and tr.i = f.n"""
    q["follower_signal"] = f"select 'main' as game, f.n, round(sum((coalesce(tr.followed, 0) + 12 * {f20}) / (coalesce(c.chances, 0) + 12)) / 5, 6) as value from freq f cross join (select unnest(s) as j from (select s from draws order by t desc limit 1)) l left join trans tr on tr.j = l.j and tr.i = f.n left join (select j, max(chances) as chances from trans group by j) c on c.j = l.j group by f.n"
    q["similar_situations"] = """select 'main' as game, t, u, round(similarity, 6) as similarity, place::int as place from (select *, row_number() over (order by similarity desc, u) as place from (select nx.t, d.t as u, round(0.55 * len(list_intersect(pv.s, nx.s)) / 5 + case when d.dow = nx.dow then 0.2 else 0.0 end + 0.25 * greatest(0.0, 1 - abs(list_sum(pv.s) - list_sum(nx.s)) / 50.0), 9) as similarity
      from draws d join draws pv on pv.t = d.t - 1 cross join nx where d.t >= greatest(1, nx.t - 1500))) where place <= 25"""
    q["next_draw"] = "select 'main' as game, t, date, dow from nx"
    feats = _features()
    q["shape_features"] = "select 'main' as game, t, dow, " + ", ".join(f"{x} as \"{n}\"" for n, x in feats.items()) + " from draws"
    q["conditional_features"] = """select 'main' as game, t, dow, case when p is not null then len(list_intersect(s, p))::int end as "repeatPrev", case when p is not null then len(list_intersect(s, l3))::int end as overlap3, case when p is not null then len(list_intersect(s, l10))::int end as overlap10, (list_sum(s) - list_sum(p))::int as "dSum", (s[5] - s[1] - p[5] + p[1])::int as "dSpread", case when p is not null then (len(list_filter(s, lambda x: x % 2 = 1)) - len(list_filter(p, lambda x: x % 2 = 1)))::int end as "dOdd"
      from (select t, dow, s, lag(s) over (order by t) as p, flatten(list(s) over (order by t rows between 3 preceding and 1 preceding)) as l3, flatten(list(s) over (order by t rows between 10 preceding and 1 preceding)) as l10 from draws)"""
    q["rank_scores"] = f"select 'main' as game, n, place::int as rank from (select n, row_number() over (order by round({f20}, 12) desc, n) as place from freq)"
    q["history_page"] = "select 'main' as game, t, array_to_string(s, '-') as numbers from draws order by t desc limit 12 offset 12"
    q["merge_draws"] = "select 'main' as game, sum((src = 3)::int)::bigint as both, sum((src = 1)::int)::bigint as only_old, sum((src = 2)::int)::bigint as only_new, count(jackpot) as jackpots from (select date, s, special, sum(distinct src) as src, max(jackpot) as jackpot from (select date, s, special, case when t % 5 = 0 then null else jackpot end as jackpot, 1 as src from draws where t % 3 > 0 union all select date, s, special, jackpot, 2 from draws where t % 3 < 2) group by date, s, special)"
    q["isotonic_calibration"] = """select 'main' as game, x::int as rank, round(fit, 6) as fit from (select x, min(top) as fit from (select a.x as a, b.x, max(b2.m) as top from sp a join sp b on b.x >= a.x join mm b2 on b2.a = a.x and b2.b >= b.x group by 1, 2) group by x)"""
    q["imported_draws"] = "select distinct 'main' as game, date, dow, array_to_string(s, '-') as numbers, special, round(jackpot, 2) as jackpot from draws where t % 40 not in (3, 7, 11, 13, 17)"
    q["import_errors"] = """select 'main' as game, case t % 40 when 3 then 'a number comes twice' when 7 then 'text between numbers' when 11 then 'too few numbers' when 13 then 'a number is out of range' else 'no date' end as error, count(*) as rows from draws where t % 40 in (3, 7, 11, 13, 17) group by 2"""
    q["import_facts"] = """select 'main' as game, count(*) + count(case when t % 40 = 19 then 1 end) as rows, true as day_first, 5 as size, true as has_bonus, count(case when t % 40 in (3, 7, 11, 13, 17) then 1 end) as errors, count(case when t % 40 = 23 then 1 end) as extra,
      count(case when t % 40 = 19 then 1 end)::bigint as repeated, count(case when t % 40 = 29 then 1 end) as wrong_day, false as mixed from draws"""
    pl = "(select position, v, hits, coalesce(sum(hits) over (partition by position order by v rows between unbounded preceding and 1 preceding), 0) as under, sum(hits) over (partition by position) as draws from (select x.position, pool.n as v, count(y.v) as hits from (select unnest(range(1, 6)) as position) x cross join pool left join " + pos + " y on y.position = x.position and y.v = pool.n group by 1, 2))"
    q["ticket_numbers"] = f"""select 'main' as game, k.ticket, k.position::int as position, k.n, f.place::int as rank, round(l.under / l.draws::double, 6) as below, round(ln((l.hits + 1) / (l.draws + 69)::double), 6) as log_likelihood, k.n between z.p10 and z.p90 as typical
      from (select ticket, unnest(range(1, 6)) as position, unnest(numbers) as n from {tk}) k join {pl} l on l.position = k.position and l.v = k.n join (select n, row_number() over (order by rate desc, n) as place from freq) f on f.n = k.n
      join (select position, {", ".join(f"min(case when i = least(m - 1, floor({f} * m)) then v end) as p{round(f * 100)}" for f in (0.1, 0.9))} from (select position, v, row_number() over (partition by position order by v, t) - 1 as i, count(*) over (partition by position) as m from {pos}) group by position) z on z.position = k.position"""
    q["ticket_crowd"] = f"""select 'main' as game, ticket, array_to_string(list_filter([case when s[5] <= 12 then 'months' when s[5] <= 31 then 'calendar' end, case when list_min({st}) = list_max({st}) then case when s[2] - s[1] = 1 then 'run' else 'step' end end,
      case when len(list_filter(s, lambda x: x % 5 = 0)) = 5 then 'fives' end, case when len(list_distinct([x % 10 for x in s])) = 1 then 'same_digit' end, case when s in (select s from draws) then 'past_winner' end], lambda x: x is not null), ',') as markers from (select ticket, numbers as s from {tk})"""
    q["jackpot_series"] = "select 'main' as game, t, date, round(jackpot, 6) as jackpot, winner_location is not null as won from draws where jackpot is not null order by t desc limit 120"
    q["similar_outcomes"] = f"""select 'main' as game, x.place, x.u, x.similarity, array_to_string(d.s, '-') as outcome, array_to_string(list_sort(list_intersect(d.s, b.best)), '-') as shared from ({q["similar_situations"]}) x join draws d on d.t = x.u cross join (select list(n) as best from (select n from freq order by rate desc, n limit 10)) b where x.place <= 6"""
    q["tickets_added"] = f"select 'main' as game, for_date, count(*) as tickets from (select distinct numbers, special, for_date from {tk}) group by for_date"
    q["draws_removed"] = "select 'main' as game, count(*) as draws, min(t) as first_t, max(t) as last_t from draws d where not exists (select 1 from draws g where g.t % 10 = 0 and g.date = d.date and g.s = d.s)"
    pairs_of = " + ".join(f"l{i}{j}.lift" for i in range(1, 6) for j in range(i + 1, 6))
    q["best_combinations"] = f"""select 'main' as game, place::int as place, array_to_string(s, '-') as numbers, round(score, 6) as score, round(z, 6) as sum_z, round(exp(p), 6) as pair_lift, round(100 * exp(0.9 * (score - max(score) over ())))::int as relative, len(list_intersect(s, lead))::int as in_top from (select *, row_number() over (order by score desc, s) as place from (
      select s, p, z, lead, round(base + 0.3 * p - 0.06 * z * z + 0.25 * ln((coalesce(o.m, 0) + 1.0) / (om + 1.0)) - 0.12 * far, 9) as score from (
        select c.*, (list_sum(s) - mean_sum) / greatest(1.0, sum_sd) as z, len(list_filter(s, lambda x: x % 2 = 1)) as odd from bc c cross join (select avg(list_sum(s)) as mean_sum, stddev_pop(list_sum(s)) as sum_sd from draws)) q
      left join od_ o on o.odd = q.odd cross join (select max(m) as om from od_) cross join (select list(n) as lead from (select n from freq order by rate desc, n limit 5)))) where place <= 8"""
    q["companions"] = """select 'main' as game, n, kind, place::int as place, other, times from (select *, row_number() over (partition by n, kind order by times desc, other) as place from
      (select h1.n as n, h2.n as other, 'partner' as kind, count(*) as times from hits h1 join hits h2 on h1.t = h2.t and h1.n <> h2.n group by 1, 2 union all select j, i, 'follower', followed from trans)) where place <= 5"""
    q["calendar_rate"] = f"select 'main' as game, sum((s[5] <= 31)::int)::bigint as seen, count(*) as draws, round({comb(31, D) / comb(K, D)!r}::double, 6) as expected from draws"
    q["typical_sales"] = """select 'main' as game, round(case when count(*) >= 3 then list_sort(list(sales))[(count(*) // 2 + 1)::int] end, 2) as sales from draws d cross join sizes
      join (select od.date, sum(l_extendedprice) as sales from (select o_orderkey, o_orderdate::date as date from orders) od join lineitem on l_orderkey = o_orderkey group by od.date) x on x.date = d.date where t >= draws - 40 and sales > 0"""
    slices = {"pooled": "0", "bonus": "special", "decade": "((s[1] - 1) // 10)::int", "odd": "len(list_filter(s, lambda x: x % 2 = 1))::int", "weekday": "dow"}
    sliced = " union all ".join(f"select '{n}' as slice, {c} as part, t, list_sum(s) as v from draws" for n, c in slices.items())
    q["slice_floors"] = """select 'main' as game, a.slice, a.groups, a.chances, a.broke, round(a.broke / a.chances::double, 6) as rate, round(p.broke / p.chances::double, 6) as pooled_rate, a.chances >= 100 and a.groups >= 2 and a.broke / a.chances::double > 1.5 * (p.broke / p.chances::double) as rejected
      from sf a cross join (select * from sf where slice = 'pooled') p where a.slice <> 'pooled'"""
    q["replay_reasons"] = """select 'main' as game, place::int as place, cut_by, draws, judged, held, round(held / judged::double, 6) as held_rate from (select cut_by, count(*) as draws, row_number() over (order by count(*) desc, cut_by) as place from rp where not kept group by cut_by)
      cross join (select count(*) as judged, sum(kept::int)::bigint as held from rp)"""
    binned = " union all ".join(f"select '{n}' as feature, {hi - lo + 2} as room, t, floor(({feats[n]})::double + 0.5)::int as bin from draws" for n, (lo, hi) in rules_sql.LIMITS.items() if n in feats)
    q["feature_standing"] = """select 'main' as game, feature, value, count(*) as observations, min(bin) as least, max(bin) as most, count(case when bin = value then 1 end) as times, round((count(case when bin = value then 1 end) + 1.0 / room) / (count(*) + 1.0), 6) as p, round(count(case when bin < value then 1 end) / count(*)::double, 6) as percentile
      from (select *, arg_max(bin, t) over (partition by feature) as value from bf) group by feature, value, room"""
    q["ticket_lab"] = f"""select 'main' as game, k.ticket, list_sum(k.numbers)::int as total, round(a.under, 6) as total_below, round(a.same, 6) as odd_share, a.pair_total, a.best_overlap, array_to_string(b.best_t, '-') as best_t, a.three_up, coalesce(c.c, 0)::bigint as special_count
      from {tk} k join la a on a.numbers = k.numbers join (select l.numbers, list(l.t order by l.t)[1:3] as best_t from lm l join la on la.numbers = l.numbers and l.o = la.best_overlap group by l.numbers) b on b.numbers = k.numbers left join (select special, count(*) as c from draws group by special) c on c.special = k.special"""
    cols = ", ".join(f"avg(s[{i}]) as m{i}, stddev_pop(s[{i}]) as d{i}, min(s[{i}]) as a{i}, max(s[{i}]) as b{i}" for i in range(1, 6))
    far = " + ".join(f"case when d{i} > 0 then case when abs(x{i}.n - m{i}) / d{i} > 1.5 then power(abs(x{i}.n - m{i}) / d{i} - 1.5, 2) else 0 end + case when x{i}.n < a{i} or x{i}.n > b{i} then 4.0 else 0 end else 0 end" for i in range(1, 6))
    more = {
        "best_combinations": f""", cd as materialized (select n, rate, hits from freq order by rate desc, n limit 12), lf as materialized (select a.n as a, b.n as b, ln((coalesce(t.c, 0) + 0.75) / (a.hits * b.hits / (select draws from sizes)::double * {(D - 1) * K / (D * (K - 1))!r} + 0.75)) as lift from cd a join cd b on b.n > a.n left join (select h1.n as a, h2.n as b, count(*) as c from hits h1 join hits h2 on h1.t = h2.t and h1.n < h2.n group by 1, 2) t on t.a = a.n and t.b = b.n),
          od_ as materialized (select len(list_filter(s, lambda x: x % 2 = 1)) as odd, count(*) as m from draws group by 1), co as (select {cols} from draws),
          bc as materialized (select [x1.n, x2.n, x3.n, x4.n, x5.n] as s, x1.rate + x2.rate + x3.rate + x4.rate + x5.rate as base, ({pairs_of}) / 10 as p, {far} as far from cd x1 join cd x2 on x2.n > x1.n join cd x3 on x3.n > x2.n join cd x4 on x4.n > x3.n join cd x5 on x5.n > x4.n cross join co
          {" ".join(f"join lf l{i}{j} on l{i}{j}.a = x{i}.n and l{i}{j}.b = x{j}.n" for i in range(1, 6) for j in range(i + 1, 6))}) """,
        "slice_floors": f", sf as (select slice, count(distinct part) as groups, count(lo) as chances, count(case when v < lo then 1 end) as broke from (select slice, part, v, min(v) over (partition by slice, part order by t rows between unbounded preceding and 1 preceding) as lo from ({sliced}) where part is not null) group by slice) ",
        "replay_reasons": f", rp as ({q['pool_replay']}) ", "feature_standing": f", bf as ({binned}) ",
        "ticket_lab": f", lm as (select k.numbers, d.t, len(list_intersect(k.numbers, d.s))::int as o, list_sum(d.s) < list_sum(k.numbers) as under, len(list_filter(d.s, lambda x: x % 2 = 1)) = len(list_filter(k.numbers, lambda x: x % 2 = 1)) as same from (select distinct numbers from {tk}) k cross join draws d), la as (select numbers, avg(under::int) as under, avg(same::int) as same, sum(o * (o - 1) // 2)::bigint as pair_total, max(o) as best_overlap, count(case when o >= 3 then 1 end) as three_up from lm group by numbers) ",
        "pair_overlap_hist": f", pp as {pairs} ", "closest_pairs": f", pp as {pairs} ",
        "jackpot_projection": ", seq as (select t, jackpot, winner_location is not null as won, lag(jackpot) over (order by t) as before, lag(winner_location is not null) over (order by t) as bw from draws) ",
        "hazard_signal": ", hz as (" + q["hazard"].replace("'main' as game, ", "") + ") ",
        "isotonic_calibration": ", sp as (select row_number() over (order by n) as x, hits::double as v from freq), mm as (select a.x as a, b.x as b, (select avg(v) from sp c where c.x between a.x and b.x) as m from sp a join sp b on b.x >= a.x) ",
    }
    nx = ", nx as (select l.t + 1 as t, l.date + coalesce((select min(k) from (select unnest(range(1, 15)) as k) where dayofweek(l.date + k::int) in (select dow from sched)), 1)::int as date, l.s from (select t, date, s from draws order by t desc limit 1) l), nx0 as (select 1) "
    nx = nx.replace(", nx0 as (select 1)", "").replace("nx as (select l.t", "nx_ as (select l.t") + ", nx as (select *, dayofweek(date)::int as dow from nx_) "
    more["next_draw"] = more["similar_situations"] = more["similar_outcomes"] = nx
    for name, (tables, sql) in bonus_sql.queries(nx).items():
        q[name], more[name] = sql, tables
    return {name: BASE + more.get(name, "") + sql for name, sql in q.items()}


def _features() -> dict[str, str]:
    """The features that need no earlier draw, over a sorted list s of five numbers of 69."""
    st = "[s[2]-s[1], s[3]-s[2], s[4]-s[3], s[5]-s[4]]"
    primes = "[2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67]"
    count = lambda test: f"len(list_filter(s, lambda x: {test}))"
    low, mid, high = count("x <= 23"), count("x > 23 and x <= 46"), count("x > 46")
    out = {f"pos{r}": f"s[{r}]" for r in range(1, 6)} | {f"gap{r}": f"(s[{r + 1}] - s[{r}])" for r in range(1, 5)}
    out |= {"sum": "list_sum(s)::int", "sumLow2": "s[1] + s[2]", "sumLow3": "s[1] + s[2] + s[3]", "sumHigh2": "s[5] + s[4]", "spread": "s[5] - s[1]", "sd": "round(sqrt(list_sum([power(x - list_sum(s) / 5.0, 2) for x in s]) / 5), 6)", "maxGap": f"list_max({st})", "minGap": f"list_min({st})"}
    out |= {"consec": f"len(list_filter({st}, lambda x: x = 1))::int", "runs": "((s[2]-s[1] = 1)::int + (s[3]-s[2] = 1 and s[2]-s[1] <> 1)::int + (s[4]-s[3] = 1 and s[3]-s[2] <> 1)::int + (s[5]-s[4] = 1 and s[4]-s[3] <> 1)::int)", "odd": count("x % 2 = 1") + "::int", "prime": f"len(list_intersect(s, {primes}))::int"}
    out |= {"lowZone": low + "::int", "midZone": mid + "::int", "highZone": high + "::int", "aboveMid": count("x > 35") + "::int", "emptyZones": f"(({low} = 0)::int + ({mid} = 0)::int + ({high} = 0)::int)", "lastDigitDup": "(5 - len(list_distinct([x % 10 for x in s])))::int", "centerDist": "round(abs(list_sum(s) / 5.0 - 35), 6)"}
    return out


def family_tests(*n: str) -> dict[str, str]:
    """The families as tests of five ascending numbers of 1..69."""
    a, b, c, d, e = n
    every = lambda f: "(" + " and ".join(f(x) for x in n) + ")"
    same = lambda f: "(" + " and ".join(f"{f(x)} = {f(a)}" for x in n[1:]) + ")"
    steps = [f"({y} - {x})" for x, y in zip(n, n[1:])]
    even = f"({steps[0]} = {steps[1]} and {steps[1]} = {steps[2]} and {steps[2]} = {steps[3]})"
    digits = " | ".join(f"(1 << ({x} % 10)::int) | (case when {x} >= 10 then 1 << ({x} // 10)::int else 0 end)" for x in n)
    return {
        "oneDecade": f"(({a} - 1) // 10 = ({e} - 1) // 10)", "mult5": every(lambda x: f"{x} % 5 = 0"), "sameDigit": same(lambda x: f"{x} % 10"), "evenSpaced": even, "evenStepTight": f"({even} and {steps[0]} <= 11)", "tightSpan": f"({e} - {a} <= 7)", "runFive": f"({e} - {a} = 4)",
        "slipRow": same(lambda x: f"({x} - 1) % 14"), "slipColumn": same(lambda x: f"least(4, ({x} - 1) // 14)"), "squareCube": every(lambda x: f"{x} in (1, 4, 8, 9, 16, 25, 27, 36, 49, 64)"), "fib": every(lambda x: f"{x} in (1, 2, 3, 5, 8, 13, 21, 34, 55)"),
        "digitSum": same(lambda x: f"({x} // 10 + {x} % 10)"), "column7": same(lambda x: f"({x} - 1) % 7"), "wideGaps": f"least({', '.join(steps)}) >= 15", "allPrime": every(lambda x: f"{x} in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67)"),
        "sameMultiple": f"gcd(gcd(gcd(gcd({a}, {b}), {c}), {d}), {e}) >= 6", "gridColumn": "(" + " or ".join(same(lambda x, m=m: f"{x} % {m}") for m in (9, 11, 12, 13)) + ")",
        "slipDiagonal": f"({same(lambda x: f'(({x} - 1) % 14 - ({x} - 1) // 14)')} or {same(lambda x: f'(({x} - 1) % 14 + ({x} - 1) // 14)')})", "twoDigits": f"bit_count(({digits})::int) <= 2", "powerTwo": every(lambda x: f"{x} in (1, 2, 4, 8, 16, 32, 64)"),
        "repdigit": every(lambda x: f"{x} in (11, 22, 33, 44, 55, 66)"), "mirrorPool": f"({a} + {e} = 70 and {b} + {d} = 70 and {c} = 35)", "fibLike": f"({c} = {a} + {b} and {d} = {b} + {c} and {e} = {c} + {d})", "triangular": every(lambda x: f"{x} in (1, 3, 6, 10, 15, 21, 28, 36, 45, 55, 66)"),
    }


# The families that the reduced pool leaves out, in order.
CUT_ORDER = "oneDecade mult5 sameDigit evenStepTight tightSpan runFive slipRow squareCube fib digitSum sameMultiple gridColumn slipDiagonal twoDigits powerTwo repdigit".split()


# Every combination of five of 69, as five columns.
SPACE = ", a_ as (select unnest(range(1, 70)) as a), b_ as (select a, unnest(range(a + 1, 70)) as b from a_), c_ as (select a, b, unnest(range(b + 1, 70)) as c from b_), d_ as (select a, b, c, unnest(range(c + 1, 70)) as d from c_), u as (select a, b, c, d, unnest(range(d + 1, 70)) as e from d_) "
PLANTED = {
    "era": "t >= (select draws from sizes) * 0.6 or s[5] <= 59",
    "streak": "t < (select draws from sizes) * 0.9 or list_contains(s, 7) or list_contains(s, 11)",
}


def planted(which: str) -> str:
    """The base with some draws left out, and places numbered anew."""
    head, tail = BASE.split("sizes as (select count(*) as draws from draws),")
    head = head.replace("hits as (select od.t", "hits0 as (select od.t").replace("from hits group by t),\ndraws as", "from hits0 group by t),\ndraws0 as")
    where = PLANTED[which].replace("(select draws from sizes)", "(select count(*) from draws0)")
    return head + f"draws as (select game, (row_number() over (order by t) - 1)::bigint as t, date, dow, s, special, jackpot, winner_location from draws0 where {where}),\nhits as (select t, dow, unnest(s) as n from draws),\nsizes as (select count(*) as draws from draws)," + tail


def _spaces(q: dict[str, str], rules: dict[str, tuple[str, str]], feats: dict[str, str]) -> dict[str, str]:
    """Queries that count the whole space, or that stand on a history with something planted."""
    tests, drawn = family_tests("a", "b", "c", "d", "e"), family_tests(*[f"s[{i}]" for i in range(1, 6)])
    counts = ", ".join(f'count(*) filter (where {t}) as "{n}"' for n, t in tests.items())
    seen = ", ".join(f'count(*) filter (where {t}) as "{n}"' for n, t in drawn.items())
    each = " union all ".join(f"select 'main' as game, '{n}' as family, f.\"{n}\" as combinations, round(f.\"{n}\" / {float(comb(69, 5))!r}, 12) as share, o.\"{n}\" as draws from f cross join o" for n in tests)
    out = {"subset_families": BASE + SPACE + f", f as materialized (select {counts} from u), o as materialized (select {seen} from draws) " + each}
    sums = ", st as materialized (select a + b + c + d + e as total, count(*) as combinations from u group by 1), su as (select *, (sum(combinations) over (order by total))::bigint as at_most from st) "
    out["sum_at_most"] = BASE + SPACE + sums + "select 'main' as game, su.total::int as total, draws, combinations, at_most from su join (select list_sum(s) as total, count(*) as draws from draws group by 1) x on x.total = su.total"
    out["rule_space_share"] = BASE + SPACE + "select 'main' as game, bin::int as bin, combinations, draws from (select e - a as bin, count(*) as combinations from u group by 1) join (select s[5] - s[1] as bin, count(*) as draws from draws group by 1) using (bin)"
    tables, bands = rules["position_bands"]
    out["band_count"] = BASE + tables + SPACE + f", pb as materialized ({bands}), w as materialized (select list(lo order by position) as lo, list(hi order by position) as hi from pb) select 'main' as game, (select count(*) from u, w where a between lo[1] and hi[1] and b between lo[2] and hi[2] and c between lo[3] and hi[3] and d between lo[4] and hi[4] and e between lo[5] and hi[5]) as inside, count(case when {' and '.join(f's[{i}] between lo[{i}] and hi[{i}]' for i in range(1, 6))} then 1 end) as draws_inside from draws, w"
    touch = "(b - a = 1)::int + (c - b = 1)::int + (d - c = 1)::int + (e - d = 1)::int >= 3"
    out["touching_pairs"] = BASE + SPACE + f", z as materialized (select count(*) as m from u where {touch}) select 'main' as game, m as combinations, count(case when (s[2]-s[1] = 1)::int + (s[3]-s[2] = 1)::int + (s[4]-s[3] = 1)::int + (s[5]-s[4] = 1)::int >= 3 then 1 end) as draws, round(count(*) * m / 11238513.0::double, 6) as expected from draws, z group by m"
    cuts = {n: tests[n] for n in CUT_ORDER} | {"low": "d <= 5 or e <= 9"}
    cut_drawn = {n: drawn[n] for n in CUT_ORDER} | {"low": "s[4] <= 5 or s[5] <= 9"}
    cuts["union"], cut_drawn["union"] = " or ".join(f"({t})" for t in cuts.values()), " or ".join(f"({t})" for t in cut_drawn.values())
    f = ", ".join(f'count(*) filter (where {t}) as "{n}"' for n, t in cuts.items())
    o = ", ".join(f'count(*) filter (where {t}) as "{n}"' for n, t in cut_drawn.items())
    out["union_sizes"] = BASE + SPACE + f", f as materialized (select {f} from u), o as materialized (select {o} from draws) " + " union all ".join(f"select 'main' as game, '{n}' as family, f.\"{n}\" as members, o.\"{n}\" as draws from f cross join o" for n in cuts)
    out["ledger"] = BASE + SPACE + f""", rec as materialized (select min(list_sum(s)) as lo, max(list_sum(s)) as hi from draws), done as materialized (select s[1] as a, s[2] as b, s[3] as c, s[4] as d, s[5] as e, count(*) as times from draws group by all),
    v as materialized (select case when times is not null then 2 when {cuts["union"]} then 3 when a + b + c + d + e <= lo or a + b + c + d + e >= hi then 4 end as place, count(*) * 26 as removed from u cross join rec left join done using (a, b, c, d, e) group by 1),
    w as (select x.place, x.step, coalesce(v.removed, 0)::bigint as removed, cost from (select 2 as place, 'drawn' as step, (select sum(times - 1) from done) as cost union all select 3, 'families', (select count(*) from draws where {cut_drawn["union"]}) union all select 4, 'sums', (select count(*) from draws, rec where list_sum(s) <= lo or list_sum(s) >= hi)) x left join v using (place))
    select 'main' as game, place::int as place, step, removed, (292201338 - sum(removed) over (order by place))::bigint as remaining, cost::bigint as cost from w"""
    tk = "(select c_custkey as ticket, list_sort([(1 + i * 13 + c_custkey % 13)::int for i in range(5)]) as numbers, (c_custkey % 26 + 1)::int as special from customer order by c_acctbal desc, c_custkey limit 5)"
    out["portfolio_exact"] = BASE + SPACE + f""", k as materialized {tk}, cover as (select list_sort(list_distinct(flatten(list(numbers)))) as cover from k), pm as materialized (select [case when list_contains(cover, n) then 1::bigint << (list_position(cover, n) - 1) else 0::bigint end for n in range(1, 70)] as pm, len(cover) as covered from cover),
    held as materialized (select list(list_sum([pm[n] for n in numbers])::bigint order by ticket) as tm, list(special order by ticket) as sp from k cross join pm),
    m as materialized (select pm[a] | pm[b] | pm[c] | pm[d] | pm[e] as mask, covered, count(*) as c from u cross join pm group by all), x as (select c, covered, sp, [bit_count(mask & y) for y in tm] as m from m cross join held)
    select 5::bigint as tickets, covered::int as covered, 11238513::bigint as draws, round(sum(c * case when len(list_filter(m, lambda y: y in (3, 4, 5))) > 0 then 1.0::double else len(list_distinct(sp)) / 26.0::double end) / 11238513, 9) as any_prize, round(sum(c * (list_max(m) >= 3)::int) / 11238513, 9) as three,
      round(sum(c * (list_max(m) >= 4)::int) / 11238513, 9) as four, round(sum(c * list_max(m)) / 11238513, 9) as best_match from x group by covered"""
    sizes = " union all ".join(f"select '{n}' as preset, (select \"{n}\" from f) as combinations, (select \"{n}\" from o) as observed" for n in tests)
    inside = lambda names: " and ".join(f"{x} between lo[{i}] and hi[{i}]" for i, x in enumerate(names, 1))
    out["preset_eliminations"] = BASE + tables + SPACE + f""", f as materialized (select {counts} from u), o as materialized (select {seen} from draws), pb as materialized ({bands}), w as materialized (select list(lo order by position) as lo, list(hi order by position) as hi from pb), rec as materialized (select min(list_sum(s)) as least, max(list_sum(s)) as most from draws),
    z as ({sizes} union all select 'sumLow', (select count(*) from u, rec where a + b + c + d + e < least), 0 union all select 'sumHigh', (select count(*) from u, rec where a + b + c + d + e > most), 0
      union all select 'posBands', (select count(*) from u, w where not ({inside("abcde")})), (select count(*) from draws, w where not ({inside([f"s[{i}]" for i in range(1, 6)])})))
    {q["preset_eliminations"].replace(BASE, "")} union all select 'main', preset, combinations, round(combinations / 11238513.0::double, 9), round(combinations::double * (select count(*) from draws) / 11238513, 6), observed from z where combinations > 0
    union all select 'main', 'pastWinner', count(*), round(count(*) / 11238513.0::double, 9), round(sum(m)::double * (sum(m) - 1) / 2 / 11238513, 6), sum(m - 1)::bigint from (select count(*) as m from draws group by s)"""
    out["era_detect_planted"] = q["era_detect"].replace(BASE, planted("era"))
    out["current_streaks_planted"] = q["current_streaks"].replace(BASE, planted("streak"))
    out["portfolio_checked"] = "select 'main' as game, 5::bigint as tickets, 25::bigint as covered, 0::bigint as past_winners, 0::bigint as crowded, 0::bigint as out_of_shape, 5::bigint as bonus_numbers from orders limit 1"
    cutoff = q["era_detect"].replace(BASE, "")
    tables, by_day = rules["rule_slices"]
    out["rule_slices_eras"] = planted("era") + tables + f", ed as materialized ({cutoff}) {by_day} union all select 'main', feature, alpha, 'era', case when t < cutoff then 'earlier' else 'current' end, count(*), round(avg(held::int), 6) from br cross join ed where v is not null group by all"
    return out


def oracle_sql() -> dict[str, str]:
    q = _queries()
    feats = _features()
    rules = rules_sql.queries(feats, q["conditional_features"].replace(BASE, ""))
    return q | {name: BASE + tables + sql for name, (tables, sql) in rules.items()} | _spaces(q, rules, feats)


