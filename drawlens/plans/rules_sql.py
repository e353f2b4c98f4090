"""DuckDB SQL for the rules of a history of five numbers of 1..69, written from their definitions: every band is read off the whole histogram of the draws before."""

# The least and the most that each feature can be at 5 of 69.
LIMITS = {
    "pos1": (1, 65), "pos2": (2, 66), "pos3": (3, 67), "pos4": (4, 68), "pos5": (5, 69), "gap1": (1, 65), "gap2": (1, 65), "gap3": (1, 65), "gap4": (1, 65),
    "sum": (15, 335), "sumLow2": (3, 137), "sumLow3": (6, 204), "sumHigh2": (3, 137), "spread": (4, 68), "sd": (0, 69), "maxGap": (1, 65), "minGap": (1, 17),
    "consec": (0, 4), "runs": (0, 2), "odd": (0, 5), "prime": (0, 5), "lowZone": (0, 5), "midZone": (0, 5), "highZone": (0, 5), "aboveMid": (0, 5), "emptyZones": (0, 2), "lastDigitDup": (0, 4), "centerDist": (0, 69),
    "repeatPrev": (0, 5), "overlap3": (0, 5), "overlap10": (0, 5), "dSum": (-335, 335), "dSpread": (-69, 69), "dOdd": (-5, 5),
}
PARTS = {0.0005: 5, 0.002: 20, 0.01: 100, 0.03: 300}  # fixed values: the tails, and their parts of 10,000
LATER = ("repeatPrev", "overlap3", "overlap10", "dSum", "dSpread", "dOdd")


def values(features: dict[str, str], conditional: str) -> str:
    """vals: a row for each draw and feature, and one without a value for the draw to come."""
    first = " union all ".join(f"select '{n}' as feature, {lo} as base, {hi} as top, {hi - lo + 2} as room, t as n, t, dow, ({features[n]})::double as v from draws" for n, (lo, hi) in LIMITS.items() if n in features)
    more = " union all ".join(f"select '{n}', {lo}, {hi}, {hi - lo + 2}, t - 1, t, dow, \"{n}\"::double from cf where t > 0" for n, (lo, hi) in LIMITS.items() if n in LATER)
    return f""", cf as materialized ({conditional}), v0 as materialized ({first} union all {more}),
    vals as materialized (select *, floor(v + 0.5)::int - base as x from v0 union all select feature, base, top, room, max(n) + 1, max(t) + 1, null, null, null from v0 group by all)"""


def steps() -> str:
    """st: the bands before each draw from the 121st on, in four pairs of columns."""
    ends = ", ".join(
        f"min(case when 10000 * (c * room + b + 1) > {a} * (n + 1) * room then b end) as a{i}, min(case when 10000 * (c * room + b + 1) >= {10000 - a} * (n + 1) * room then b end) as b{i}" for i, a in enumerate(PARTS.values())
    )
    pairs = ", ".join(f"greatest(base, least(base + a{i}, base + b{i}))::int as lo{i}, least(top, greatest(base + a{i}, base + b{i}))::int as hi{i}" for i in range(len(PARTS)))
    return f""", g as (select *, coalesce(sum((x <= b)::int) over (partition by feature, b order by n rows between unbounded preceding and 1 preceding), 0)::bigint as c from vals cross join (select unnest(range(0, 673)) as b) where b < room),
    st0 as materialized (select feature, base, top, t, dow, v, {ends} from g where t >= 120 group by feature, base, top, t, dow, v),
    st as materialized (select feature, base, top, t, dow, v, {pairs} from st0),
    br as materialized ({" union all ".join(f"select feature, base, top, {a!r}::double as alpha, t, dow, v, lo{i} as lo, hi{i} as hi, v >= lo{i} and v <= hi{i} as held from st" for i, a in enumerate(PARTS))})"""


def universe(features: dict[str, str]) -> str:
    """u: the sampled combinations, and space, how many have each value of each feature."""
    each = " union all ".join(f"select '{n}' as feature, id, ({c})::double as v from u" for n, c in features.items())
    return f""", u as materialized (select id, list(n order by n) as s from (select id, n, row_number() over (partition by id order by md5('1:' || id || ':' || n), n) as r from (select unnest(range(0, 8000)) as id) cross join pool) where r <= 5 group by id),
    uv as materialized ({each}), space as materialized (select feature, floor(v + 0.5)::int as bin, count(*) as c from uv group by all)"""


def ways(n: str, k: int) -> str:
    """C(n, k) as a DOUBLE."""
    return "(" + (" * ".join(f"greatest({n} - {i}, 0)" for i in range(k)) or "1") + ")::double / " + repr(float(__import__("math").factorial(k)))


def rules() -> str:
    """sh: the share of each rule, and ru: the rules."""
    law = " + ".join(f"case when {o} between lo and hi then {ways('m', o)} * {ways('(69 - m)', 5 - o)} / 11238513.0 else 0 end" for o in range(6))
    theory = " union all ".join(f"select 'pos{r}' as feature, x as value, {ways('(x - 1)', r - 1)} * {ways('(69 - x)', 5 - r)} / 11238513.0 as p from (select unnest(range(1, 70)) as x)" for r in range(1, 6))
    late = ", ".join(f"sum(case when draws - t <= {w} then held::int else 0 end) / least({w}, count(*))::double as recent_{w}" for w in (50, 100, 250))
    return f""", pr as (select t, lag(s) over (order by t) as p, len(list_distinct(flatten(list(s) over (order by t rows between 3 preceding and 1 preceding)))) as m3, len(list_distinct(flatten(list(s) over (order by t rows between 10 preceding and 1 preceding)))) as m10 from draws),
    asked as (select feature, alpha, feature as other, lo, hi, count(*) as times from br where v is not null and feature not in {LATER} group by all
      union all select feature, alpha, case feature when 'dSum' then 'sum' when 'dSpread' then 'spread' else 'odd' end, lo + q, hi + q, count(*) from (select br.*, case feature when 'dSum' then list_sum(p) when 'dSpread' then p[5] - p[1] else len(list_filter(p, lambda y: y % 2 = 1)) end as q from br join pr on pr.t = br.t where v is not null and feature in ('dSum', 'dSpread', 'dOdd')) group by all),
    sizes_of as (select other, lo, hi, sum(c) as c from (select distinct other, lo, hi from asked) z join space on space.feature = z.other and bin between lo and hi group by all),
    sh as materialized (select feature, alpha, sum(times * share) / sum(times) as share from (
      select feature, alpha, times, coalesce(c, 0) / 8000.0 as share from asked left join sizes_of using (other, lo, hi)
      union all select feature, alpha, count(*), {law} from (select br.*, case feature when 'repeatPrev' then 5 when 'overlap3' then m3 else m10 end as m from br join pr on pr.t = br.t where v is not null and feature in ('repeatPrev', 'overlap3', 'overlap10')) group by feature, alpha, lo, hi, m) group by all),
    fin as (select feature, alpha, base, top, lo, hi, t as draws from br where v is null and t >= 160),
    sta as (select b.feature, b.alpha, count(*) as steps, sum(held::int) as kept, {late}, avg(case when t - 120 < (draws - 120) / 2.0 then held::int end) as first_half, coalesce(avg(case when t - 120 >= (draws - 120) / 2.0 then held::int end), 0) as second_half from br b join fin on fin.feature = b.feature and fin.alpha = b.alpha where v is not null group by all),
    th as (select f.feature, f.alpha, sum(p) as theory from fin f join ({theory}) y on y.feature = f.feature and y.value between f.lo and f.hi group by all),
    se as (select feature, floor(min(v) + 0.5)::int as observed_min, floor(max(v) + 0.5)::int as observed_max from vals group by feature),
    r0 as (select fin.*, steps, kept / steps::double as survival, kept / steps::double as p, recent_50, recent_100, recent_250, first_half, second_half - first_half as stability, share, (kept / steps::double - share) / sqrt(greatest(1e-12, share * (1 - share) / steps)) as edge_z, theory, observed_min, observed_max
      from fin join sta using (feature, alpha) join sh using (feature, alpha) join se using (feature) left join th using (feature, alpha)),
    ru as materialized (select *, edge_z >= 2 as proven, not ((lo <= base and hi >= top) or 1 - share < 0.001) and feature not in {LATER} as usable, case when (lo <= base and hi >= top) or 1 - share < 0.001 then 'typical' when share < 0.02 then 'ultra_rare' when edge_z >= 2 then 'historically_rare' else 'unsupported' end as tier,
      greatest(0, (p + 1.9208 / steps - 1.96 * sqrt(p * (1 - p) / steps + 0.9604 / (steps::double * steps))) / (1 + 3.8416 / steps)) as low, least(1, (p + 1.9208 / steps + 1.96 * sqrt(p * (1 - p) / steps + 0.9604 / (steps::double * steps))) / (1 + 3.8416 / steps)) as high from r0)"""


def queries(features: dict[str, str], conditional: str) -> dict[str, tuple[str, str]]:
    """Name: tables beside those of the base, and the query."""
    tested = values(features, conditional) + steps()
    priced = tested + universe(features) + rules()
    r = lambda *names: ", ".join(f"round({n}, 6) as {n}" for n in names)
    out = {}
    out["constraint_rules"] = (
        priced,
        f"""select 'main' as game, (row_number() over (order by usable desc, round(edge_z, 9) desc, feature, alpha))::int as place, feature, alpha, lo, hi, observed_min, observed_max, steps, {r("survival", "low", "high", "recent_50", "recent_100", "recent_250", "first_half", "stability", "share", "edge_z", "theory")}, tier, usable, proven from ru""",
    )
    out["rule_slices"] = (tested, "select 'main' as game, feature, alpha, 'weekday' as slice, dow::varchar as part, count(*) as draws, round(avg(held::int), 6) as survival from br where v is not null group by all")
    out["position_bands"] = (
        values(features, conditional),
        """select 'main' as game, substr(feature, 4)::int as position, greatest(base, least(a0, b0))::int as lo, least(top, greatest(a0, b0))::int as hi, least(a1, b1)::int as p25, least(a2, b2)::int as median, greatest(a1, b1)::int as p75 from (
        select feature, base, top, """
        + ", ".join(f"min(case when 10000 * (c * room + b + 1) > {a} * (m + 1) * room then base + b end) as a{i}, min(case when 10000 * (c * room + b + 1) >= {10000 - a} * (m + 1) * room then base + b end) as b{i}" for i, a in enumerate((20, 2500, 5000)))
        + """ from (select feature, base, top, room, b, count(v) as m, sum((x <= b)::int) as c from vals cross join (select unnest(range(0, 70)) as b) where feature like 'pos%' and b < room group by all) group by feature, base, top)""",
    )
    stride = "greatest(1, floor(n / 450.0 + 0.5), floor(n * depth / 3000.0 + 0.5))"
    out["rule_frontier"] = (
        priced
        + f""", ch as (select * from (select feature, alpha, row_number() over (order by round(share, 9), feature, alpha) as place from ru where usable) where place <= 12),
    sx as materialized (select place, feature, lo, hi, t, t - 120 as step, n, depth from br join ch using (feature, alpha) cross join (select max(t) - 119 as n from br where v is not null) cross join (select max(place) as depth from ch) where v is not null),
    sy as materialized (select place, feature, lo, hi, t, case when step < n // 2 then 'a' else 'b' end as half from sx where (step - case when step < n // 2 then 0 else n // 2 end) % {stride}::bigint = 0),
    iv as materialized (select feature, lo, hi, list(v >= lo and v <= hi order by id) as ok from (select distinct feature, lo, hi from sy) z join uv using (feature) group by all),
    pf as (select place, t, half, list(ok) over (partition by t order by place rows between unbounded preceding and current row) as oks from sy join iv using (feature, lo, hi)),
    pc as (select place, t, half, len(list_filter(range(1, 8001), lambda i: list_bool_and([o[i] for o in oks]))) / 8000.0 as share from pf),
    ks as (select t, min(case when not held then place end) as out from br join ch using (feature, alpha) where v is not null group by t),
    po as (select place as rules, avg(share) as share, (select count(case when out is null or out > place then 1 end) / count(*)::double from ks) as survival from pc group by place union all select 0, 1.0, 1.0)""",
        """select 'main' as game, rules::int as rules, round(share, 6) as share, round(survival, 6) as survival, exists (select 1 from po q where q.survival >= po.survival and q.share < po.share) as dominated from po""",
    )
    return out
