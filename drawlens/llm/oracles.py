"""DuckDB SQL for the queries of this package."""

from drawlens.llm.sharding import MULTIPLIER


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def op8(shards: int = 16, blocks: int = 512) -> str:
    steps = []
    for i in range(1, shards + 2):
        steps.append(
            f"""s{i} as (select * replace (case when j < {shards + 1} then (k * {MULTIPLIER}::hugeint + 1) % 18446744073709551616::hugeint else k end as k),
                case when j < {shards + 1} then j else b17 end as c17, case when j < {shards} then j else b16 end as c16 from t{i - 1}),
            t{i} as (select rid, doc_id, k, {"k // 4294967296" if i == 1 else "mix"} as mix, c16 as b16, c17 as b17,
                case when j < {shards + 1} then floor((j + 1)::double * (2147483648.0::double / (((k // 8589934592) + 1)::double)))::bigint else j end as j from s{i})"""
        )
    table = "[" + ", ".join(map(str, _crc_table())) + "]"
    return f"""with d as materialized (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
    t0 as (select rid, doc_id, (coalesce(doc_id, -1)::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint as k, 0::hugeint as mix, 0::bigint as b16, 0::bigint as b17, 0::bigint as j from d),
    {", ".join(steps)},
    x as (select rid, hex(encode(text)) as hexed from d),
    c as (select rid, xor(list_reduce([('0x' || substr(hexed, 2 * i - 1, 2))::ubigint for i in range(1, length(hexed) // 2 + 1)],
        lambda a, x: xor({table}[((xor(a, x) & 255) + 1)::bigint]::ubigint, a >> 8), 4294967295::ubigint), 4294967295::ubigint)::bigint as text_crc32 from x),
    r as (select d.doc_id, (octet_length(encode(d.text)) + 1)::bigint as size, coalesce(c.text_crc32, 0)::bigint as text_crc32, t.b16::int as shard, t.b17::int as grown_shard, (t.mix * {blocks} // 4294967296)::int as blk
        from d join t{shards + 1} t using (rid) join c using (rid))
    select doc_id, size, text_crc32, 'key' as law, shard, (row_number() over (partition by shard order by blk, doc_id, text_crc32) - 1)::bigint as slot, grown_shard from r"""


def op10() -> str:
    order = "3.0 * source_size / w, source nulls last"
    return rf"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(concat(coalesce(doc_id::varchar, ''), '|', md5(coalesce(text, '')))) as h from documents),
    s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place, count(*) over () as n from d group by source),
    w as (select *, case place % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w from s),
    l as (select *, ((sum(source_size) over ())::double - coalesce((sum(3.0 * source_size) over (order by {order} rows between unbounded preceding and 1 preceding))::double, 0)) / sum(w) over (order by {order} rows between current row and unbounded following) as level from w),
    f as (select *, (select level from l where level * w <= 3.0 * source_size order by 3.0 * source_size / w limit 1) as final from l),
    g as (select *, coalesce(least(final * w, (3.0 * source_size)::double), (3.0 * source_size)::double) as target, case when n > 1 then place::double / (n - 1) - 0.5 else 0.0 end as slope from f),
    x as (select d.doc_id, d.size, g.source_size, g.target, g.slope, (sum(d.size) over (partition by d.source order by d.h, d.doc_id rows between unbounded preceding and current row) - d.size)::bigint as first from d join g on d.source is not distinct from g.source),
    y as (select *, {" + ".join(f"greatest(0, least(size, round(target)::bigint - {k} * source_size - first))" for k in range(3))} as taken, least(1.0::double, first / greatest(target, 1.0::double)) as share from x)
    select doc_id, size, source_size, target, taken::bigint as taken, case when taken > 0 then round(case when abs(slope) < 1e-9 then share else 2 * share / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) end, 9) end as position from y"""


def op11() -> str:
    blanks = "concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))"
    return f"""with d as materialized (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    x as (select rid, doc_id, unnest(range(1, len(lines) + 1)) as i, unnest(lines) as line from d),
    k as materialized (select *, translate(trim(line, {blanks}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from x),
    o as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
    m as (select rid, doc_id, i, line, owner is not null and owner <> doc_id as lost from k left join o using (key))
    select doc_id, count(*) as n_lines, count(case when lost then 1 end) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not lost), '')) as kept_sha256 from m group by rid, doc_id"""


def op12() -> str:
    h = lambda i: f"('0x' || substr(h, {1 + 8 * i}, 8))::bigint"
    return rf"""with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || doc_id) as h from documents),
    c as (select *, len(u) as n, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or {h(2)} % 100 >= 50 then 'plain' when {h(3)} % 100 < 80 then 'spm' else 'psm' end as form,
        least({h(0)} % (len(u) + 1), {h(1)} % (len(u) + 1)) as lo, greatest({h(0)} % (len(u) + 1), {h(1)} % (len(u) + 1)) as hi from d),
    p as (select *, array_to_string(u[1:lo], '') as a, array_to_string(u[lo + 1:hi], '') as m, array_to_string(u[hi + 1:n], '') as z from c)
    select doc_id, n::bigint as n, form, case when form <> 'plain' then length(a) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
        sha256(case form when 'plain' then text when 'psm' then '<P>' || a || '<S>' || z || '<M>' || m else '<S>' || z || '<P>' || a || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from p"""


def op13(k: int = 8, dims: int = 64, rounds: int = 10) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} as materialized (select rid, min(d * {k} + c) // {k} as distance, (min(d * {k} + c) % {k})::int as cluster from
                (select v.rid, c.c, list_sum([(v.q[i] - c.q[i]) * (v.q[i] - c.q[i]) for i in range(1, {dims + 1})])::hugeint as d from v cross join c{r} c) group by rid)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} as materialized (select c.c, coalesce(n.q, c.q) as q from c{r} c left join (select cluster, list(x order by i) as q from (select a.cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as x
                from (select v.rid, unnest(range(1, {dims + 1})) as i, unnest(v.q) as x from v) y join a{r} a on a.rid = y.rid group by a.cluster, i) group by cluster) n on n.cluster = c.c)"""
            )
    return f"""with v as materialized (select row_number() over () as rid, vec_id, [floor(1024 * x::double)::hugeint for x in embedding] as q from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims}),
    c0 as materialized (select (row_number() over (order by sha256('3:' || vec_id), q) - 1)::int as c, q from v order by sha256('3:' || vec_id), q limit {k}), {", ".join(steps)}
    select v.vec_id, a.cluster, a.distance::bigint as distance, (sum(a.distance) over (partition by a.cluster))::bigint as cluster_inertia, (sum(a.distance) over ())::bigint as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
    from v join a{rounds} a using (rid) join c{rounds} c on c.c = a.cluster"""
