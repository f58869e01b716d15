"""DuckDB SQL that gives the same rows as the queries of the same name."""

from __future__ import annotations

_IDX = "cast(floor((date_diff('day', date '1970-01-01', cast(date_trunc('week', {d}) as date)) + 719163) / 7) as bigint)"


def _cal(d: str) -> str:
    return f"""{_IDX.format(d=d)} as week_idx, cast(isoyear({d}) as integer) as iso_year, cast(weekofyear({d}) as integer) as iso_week,
  cast(least(weekofyear({d}), 52) as integer) as wk52, cast(isoyear({d}) - case when weekofyear({d}) < 27 then 1 else 0 end as integer) as season"""


_PANEL = f"""w as (select o_orderpriority as series_id, cast(date_trunc('week', o_orderdate) as date) as monday,
    round(cast(sum(cast(o_totalprice as decimal(18,2))) as double) / 1000, 3) as y from orders group by 1, 2),
panel as (select series_id, {_cal("monday")}, y from w where y > 0),
growth as (select * from (select *, case when lead(week_idx) over s = week_idx + 1 then ln(lead(y) over s / y) end as growth from panel window s as (partition by series_id order by week_idx)) where growth is not null),
lasts as (select series_id, max(season) as last from panel group by 1),
prof as (select g.series_id, s0, wk52, median(growth) as growth, count(*) as n from growth g join lasts using (series_id), unnest(generate_series(season + 1, last)) as t(s0)
  where season <> 1997 and season < last group by 1, 2, 3 having count(*) >= 3),
clim as (select g.series_id, s0, wk52, median(ln(greatest(y, 1.0))) as level, count(*) as n from panel g join lasts using (series_id), unnest(generate_series(season + 1, last)) as t(s0)
  where season <> 1997 and season < last group by 1, 2, 3 having count(*) >= 3),
origins as (select series_id, week_idx as origin_idx, season as s0, iso_year, iso_week, y from (select *, dense_rank() over (partition by series_id order by season) as seen from panel) where seen >= 4 and season <> 1997),
tgt0 as (select *, cast(h as integer) as horizon, origin_idx + h as target_idx, date '1970-01-01' + cast((origin_idx + h) * 7 + 1 - 719163 as integer) as day,
    date '1970-01-01' + cast((origin_idx + h - 1) * 7 + 1 - 719163 as integer) as day0 from origins, unnest(generate_series(1, 10)) as t(h)),
tgt as (select *, cast(isoyear(day) as integer) as t_year, cast(weekofyear(day) as integer) as t_week, cast(least(weekofyear(day0), 52) as integer) as step_wk from tgt0),
ma as (select series_id, week_idx as origin_idx, avg(y) over (partition by series_id order by week_idx rows between 3 preceding and current row) as ma4 from panel),
m_persistence as (select series_id, origin_idx, horizon, ln(greatest(y, 1.0)) as lp from tgt),
m_legacy as (select t.series_id, t.origin_idx, horizon, ln(greatest(case when a.y > 0 then 0.5 * ma4 + 0.5 * a.y * (t.y / coalesce(b.y, a.y)) else ma4 * 0.92 end, 1.0)) as lp
  from tgt t join ma using (series_id, origin_idx) left join panel a on a.series_id = t.series_id and a.iso_year = t_year - 1 and a.iso_week = t_week
  left join panel b on b.series_id = t.series_id and b.iso_year = t.iso_year - 1 and b.iso_week = t.iso_week),
m_seasonal_naive as (select t.series_id, t.origin_idx, horizon, ln(greatest(t.y, 1.0)) + coalesce(ln(a.y / b.y), 0) as lp
  from tgt t left join panel a on a.series_id = t.series_id and a.iso_year = t_year - 1 and a.iso_week = least(t_week, 52)
  left join panel b on b.series_id = t.series_id and b.iso_year = t.iso_year - 1 and b.iso_week = least(t.iso_week, 52)),
m_profile as (select t.series_id, t.origin_idx, horizon, ln(greatest(y, 1.0)) + sum(coalesce(growth, 0)) over (partition by t.series_id, t.origin_idx order by horizon) as lp
  from tgt t left join prof p on p.series_id = t.series_id and p.s0 = t.s0 and p.wk52 = t.step_wk),
grown as (select * from (select series_id, week_idx, ln(y / lag(y) over s) as own, lag(wk52) over s as wk_before, lag(week_idx) over s as idx_before from panel window s as (partition by series_id order by week_idx)) where idx_before = week_idx - 1),
pace as (select o.series_id, o.origin_idx, avg(own - p.growth) as anomaly from origins o join grown g on g.series_id = o.series_id and g.week_idx between o.origin_idx - 1 and o.origin_idx
  join prof p on p.series_id = o.series_id and p.s0 = o.s0 and p.wk52 = g.wk_before group by 1, 2),
m_profile_momentum as (select m.series_id, m.origin_idx, horizon, lp + coalesce(anomaly, 0) * 1.5 * (1 - pow(0.6, horizon)) as lp from m_profile m left join pace using (series_id, origin_idx)),
above as (select o.series_id, o.origin_idx, 0.7 * max(case when q.week_idx = o.origin_idx then ln(greatest(q.y, 1.0)) - level end) + 0.3 * avg(ln(greatest(q.y, 1.0)) - level) as a0
  from origins o join panel q on q.series_id = o.series_id and q.week_idx between o.origin_idx - 1 and o.origin_idx join clim c on c.series_id = o.series_id and c.s0 = o.s0 and c.wk52 = q.wk52 group by 1, 2),
climbed as (select t.series_id, t.origin_idx, horizon, a0, y, last_value(level + a0 * pow(0.92, horizon) ignore nulls) over (partition by t.series_id, t.origin_idx order by horizon) as v
  from tgt t left join clim c on c.series_id = t.series_id and c.s0 = t.s0 and c.wk52 = least(t_week, 52) left join above u on u.series_id = t.series_id and u.origin_idx = t.origin_idx),
m_clim_anomaly as (select k.series_id, k.origin_idx, k.horizon, case when a0 is null then m.lp else coalesce(v, ln(greatest(y, 1.0))) end as lp
  from climbed k join m_profile m on m.series_id = k.series_id and m.origin_idx = k.origin_idx and m.horizon = k.horizon),
res as (select f.model, f.series_id, f.origin_idx, o.s0, o.iso_week, horizon, lp - ln(a.y) as err, ln(a.y / o.y) as chg, lp - ln(o.y) as pchg
  from (select 'persistence' as model, * from m_persistence union all select 'legacy', * from m_legacy union all select 'seasonal_naive', * from m_seasonal_naive union all select 'profile', * from m_profile union all select 'profile_momentum', * from m_profile_momentum union all select 'clim_anomaly', * from m_clim_anomaly) f
  join panel a on a.series_id = f.series_id and a.week_idx = origin_idx + horizon join origins o on o.series_id = f.series_id and o.origin_idx = f.origin_idx),
tq as (select model, horizon, quantile_cont(err, 0.1) as q10, quantile_cont(err, 0.25) as q25, quantile_cont(err, 0.75) as q75, quantile_cont(err, 0.9) as q90 from res where s0 between 1998 and 1999 and horizon <= 8 group by 1, 2),
splits as (select *, case when iso_week between 34 and 48 then 'autumn' when iso_week >= 49 or iso_week <= 10 then 'winter' when iso_week between 11 and 26 then 'spring' else 'summer' end as own_phase,
  abs(err) as e from res, unnest(['all', case when s0 between 1998 and 1999 then 'tune' when s0 between 2000 and 2001 then 'holdout' end]) as t(split) where split is not null and horizon <= 8),
spread as (select b.*, phase from splits b, unnest([own_phase, '*']) as t(phase)),
summary as (select split, phase, s.model, s.horizon, count(*) as n, (exp(avg(e)) - 1) * 100 as mean_pct, (exp(avg(err)) - 1) * 100 as bias_pct,
  avg(case when abs(chg) > ln(1.05) then case when (pchg > 0) = (chg > 0) then 1.0 else 0.0 end end) * 100 as dir,
  avg(case when err between q25 and q75 then 1.0 else 0.0 end) * 100 as cov50, avg(case when err between q10 and q90 then 1.0 else 0.0 end) * 100 as cov80,
  (exp(list_sort(list(e))[count(*) // 2 + 1]) - 1) * 100 as mae_pct
  from spread s left join tq on tq.model = s.model and tq.horizon = s.horizon group by 1, 2, 3, 4)"""

_SECOND = f"""sw as (select o_orderpriority as series_id, cast(date_trunc('week', l_shipdate) as date) as monday, cast(sum(cast(l_quantity as decimal(18,2))) as double) as y from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
second as (select series_id, {_cal("monday")}, y from sw)"""

_HOLS = """ys as (select cast(y as integer) as y from generate_series(1993, 2003) as t(y)),
ep0 as (select y, y % 19 + 1 as golden, 3 * (y // 100 + 1) // 4 - 12 as solar, (8 * (y // 100 + 1) + 5) // 25 - 5 as lunar from ys),
ep1 as (select y, golden, ((11 * golden + 20 + lunar - solar) % 30 + 30) % 30 as epact from ep0),
ep2 as (select y, 44 - case when epact = 24 or (epact = 25 and golden > 11) then epact + 1 else epact end as march from ep1),
ep3 as (select y, make_date(y::bigint, 3, 1) + cast(case when march < 21 then march + 30 else march end - 1 as integer) as full_moon from ep2),
easter as (select y, full_moon + cast(7 - isodow(full_moon) % 7 as integer) as day from ep3),
hd as (
  select y, make_date(y::bigint, m::bigint, d::bigint) as day, wd, ht, lab, rk from ys, (values (12, 27, false, 'xmas1', 'Vánoce', 1), (1, 1, true, 'xmas2', 'Nový rok', 2), (12, 24, true, 'minor', 'Štědrý den', 3),
    (10, 28, true, 'autumn', '28. října a podzimní prázdniny', 4), (5, 1, true, 'minor', '1. května', 7), (5, 8, true, 'minor', '8. května', 7), (9, 28, true, 'minor', '28. září', 7), (11, 17, true, 'minor', '17. listopadu', 7),
    (7, 5, true, 'minor', '5. července', 7), (7, 6, true, 'minor', '6. července', 7)) as v(m, d, wd, ht, lab, rk)
  union all select y, day - 2, false, 'goodfri', 'Velký pátek', 5 from easter union all select y, day + 1, false, 'eastermon', 'Velikonoční pondělí', 6 from easter),
hw as (select *, IDX as week_idx from hd where not wd or isodow(day) <= 5),
hb as (select * from (select *, rank() over (partition by week_idx order by y, rk) as r from hw) where r = 1),
cal as (select week_idx, min(ht) as htype, case when count(*) = 2 and bool_or(lab = '5. července') then '5.–6. července' else string_agg(lab, ' a ' order by day) end as hlabel from hb group by 1)""".replace("IDX", _IDX.format(d="day"))

_OCC = """mk as (select panel.*, ln(y) as z, htype from panel left join cal using (week_idx)),
nb as (select m.series_id, m.week_idx, m.season, m.htype, m.z,
    (select max(a.week_idx) from mk a where a.series_id = m.series_id and a.htype is null and a.week_idx between m.week_idx - 3 and m.week_idx - 1) as lo,
    (select min(a.week_idx) from mk a where a.series_id = m.series_id and a.htype is null and a.week_idx between m.week_idx + 1 and m.week_idx + 3) as hi
  from mk m where m.htype is not null and m.season <> 1997),
occ as (select nb.series_id, nb.week_idx, nb.season, nb.htype, nb.z - (a.z + (b.z - a.z) * (nb.week_idx - lo) / (hi - lo)) as diff, hi as known_at
  from nb join mk a on a.series_id = nb.series_id and a.week_idx = lo join mk b on b.series_id = nb.series_id and b.week_idx = hi),
eff as (select * from (select series_id, version, htype, case when htype in ('autumn', 'xmas1', 'xmas2', 'eastermon') and count(*) filter (season >= 1999) >= 2 then median(diff) filter (season >= 1999) when count(*) >= 2 then median(diff) end as effect
  from occ join (select distinct series_id, known_at as version from occ) v using (series_id) where known_at <= version group by 1, 2, 3) where effect is not null)"""

_KNOWN = """ver as (select o.series_id, o.origin_idx, o.s0, coalesce((select max(known_at) from occ k where k.series_id = o.series_id and k.known_at <= o.origin_idx), -1) as version from origins o),
ch as (select * from (select series_id, season, wk52, htype, case when lag(week_idx) over s = week_idx - 1 then z - lag(z) over s end as change, case when lag(week_idx) over s = week_idx - 1 then lag(htype) over s end as before
  from mk window s as (partition by series_id order by week_idx)) where change is not null and season <> 1997),
hp as (select v.series_id, v.s0, v.version, (c.wk52 + 51 + d) % 52 + 1 as wk52, median(change - coalesce(e1.effect, 0) + coalesce(e2.effect, 0)) as growth
  from (select distinct series_id, s0, version from ver) v join ch c on c.series_id = v.series_id and c.season < v.s0
  left join eff e1 on e1.series_id = v.series_id and e1.version = v.version and e1.htype = c.htype left join eff e2 on e2.series_id = v.series_id and e2.version = v.version and e2.htype = c.before,
  unnest([-1, 0, 1]) as t(d) group by 1, 2, 3, 4),
tk as (select t.series_id, t.origin_idx, t.s0, t.horizon, t.t_week, v.version, m.z, m.z - coalesce(e0.effect, 0) as x0, coalesce(e1.effect, 0) as t_effect
  from tgt t join ver v on v.series_id = t.series_id and v.origin_idx = t.origin_idx join mk m on m.series_id = t.series_id and m.week_idx = t.origin_idx left join cal tc on tc.week_idx = t.target_idx
  left join eff e0 on e0.series_id = t.series_id and e0.version = v.version and e0.htype = m.htype left join eff e1 on e1.series_id = t.series_id and e1.version = v.version and e1.htype = tc.htype),
m_holiday_profile as (select k.series_id, k.origin_idx, k.horizon, x0 + sum(coalesce(growth, 0)) over (partition by k.series_id, k.origin_idx order by k.horizon) + t_effect as lp
  from tk k left join hp g on g.series_id = k.series_id and g.s0 = k.s0 and g.version = k.version and g.wk52 = least(k.t_week, 52))"""
_ALIGN = """am as (select series_id, week_idx, season, z, htype from mk where season <> 1997),
ss as (select distinct series_id, season as s from am),
al0 as (select m.*, cast(s0 as integer) as s0, s, cast(floor((3 - date_diff('day', make_date(s, 7, 1), make_date(s0::integer, 7, 1))) / 7) as bigint) as shift from am m join ss using (series_id), unnest(generate_series(season, season + 2)) as t(s0) where s < s0),
al as (select a.series_id, a.s0, a.s, a.week_idx, a.season, shift, a.z - b.z as d, a.htype as t_now, b.htype as t_then from al0 a left join am b on b.series_id = a.series_id and b.week_idx = a.week_idx + shift)"""
_ANALOG = """pr as (select v.series_id, v.origin_idx, v.s0, a.s, a.shift, v.origin_idx - a.week_idx as j, a.d, a.d - coalesce(e1.effect, 0) + coalesce(e2.effect, 0) as r
  from ver v join al a on a.series_id = v.series_id and a.s0 = v.s0 and a.week_idx between v.origin_idx - 103 and v.origin_idx
  left join eff e1 on e1.series_id = v.series_id and e1.version = v.version and e1.htype = a.t_now left join eff e2 on e2.series_id = v.series_id and e2.version = v.version and e2.htype = a.t_then),
aw0 as (select series_id, origin_idx, s0, s, shift, count(d) as n_long, avg(r) as o_long, max(r) filter (j = 0) as d_now, count(d) filter (j <= 5) as n_win,
    sum(pow(0.7, j) * r) filter (j <= 5) / sum(pow(0.7, j)) filter (j <= 5 and d is not null) as o_win, sum(pow(0.7, j) * r * r) filter (j <= 5) / sum(pow(0.7, j)) filter (j <= 5 and d is not null) as sq
  from pr group by 1, 2, 3, 4, 5 having count(*) filter (j = 0) > 0),
aw1 as (select *, case when n_win >= 3 then 1 when n_long >= 13 then 2 end as kind from aw0 a
  where exists (select 1 from am b where b.series_id = a.series_id and b.week_idx between a.origin_idx + a.shift + 1 and a.origin_idx + a.shift + 10)),
aw2 as (select *, case when kind = 1 then greatest(sq - o_win * o_win, 0) else 0 end as d2 from (select *, min(kind) over (partition by series_id, origin_idx) as best from aw1 where kind is not null) where kind = best),
aw3 as (select *, coalesce(d_now, case when kind = 1 then o_win else coalesce(o_long, o_win) end) as o_now, exp(-d2 / 0.125) as w0, row_number() over (partition by series_id, origin_idx order by d2, s) as n from aw2),
aw as (select a.series_id, a.origin_idx, a.s0, a.s, a.shift, a.d2, a.o_now, coalesce(a.o_long, a.o_win) as o_long, case when sum(w0) over (partition by a.series_id, a.origin_idx) > 0 then w0 else 1.0 end as w, k.x0, k.version
  from aw3 a join tk k on k.series_id = a.series_id and k.origin_idx = a.origin_idx and k.horizon = 1 where n <= 30),
av as (select a.series_id, a.origin_idx, cast(h as integer) as horizon, sum(w * (b.z - coalesce(e.effect, 0) + o_long + (o_now - o_long) * pow(0.8, h))) / sum(w) as v
  from aw a, unnest(generate_series(1, 10)) as t(h), am b left join eff e on e.series_id = b.series_id and e.version = a.version and e.htype = b.htype
  where b.series_id = a.series_id and b.week_idx = a.origin_idx + h + a.shift group by 1, 2, 3),
m_analog as (select k.series_id, k.origin_idx, k.horizon, coalesce(last_value(v ignore nulls) over (partition by k.series_id, k.origin_idx order by k.horizon), x0) + t_effect as lp
  from tk k left join av on av.series_id = k.series_id and av.origin_idx = k.origin_idx and av.horizon = k.horizon),
points as (select a.series_id, a.origin_idx, a.horizon, wt * a.lp + (1 - wt) * b.lp as lp
  from (select *, [0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0][least(horizon, 7)] as wt from m_analog) a join m_holiday_profile b on b.series_id = a.series_id and b.origin_idx = a.origin_idx and b.horizon = a.horizon)"""
_POOL = """bres as (select f.series_id, f.origin_idx, o.s0, o.iso_week, horizon, lp - ln(a.y) as err from points f join panel a on a.series_id = f.series_id and a.week_idx = origin_idx + horizon
  join origins o on o.series_id = f.series_id and o.origin_idx = f.origin_idx),
latest as (select * from origins qualify row_number() over (partition by series_id order by origin_idx desc) between LATEST),
pn as (select r.series_id, l.origin_idx as t_idx, horizon, err, r.s0, least(abs(least(r.iso_week, 52) - least(l.iso_week, 52)), 52 - abs(least(r.iso_week, 52) - least(l.iso_week, 52))) <= 6 as near
  from bres r join latest l using (series_id) where r.origin_idx + horizon <= l.origin_idx),
pool as (select series_id, t_idx, horizon, err, case when s0 >= 2000 then 3.0 else 1.0 end as w
  from (select *, count(*) filter (near) over (partition by series_id, t_idx, horizon) as n_near from pn) where near or n_near < 20)"""

_BLEND = f"{_PANEL}, {_HOLS}, {_OCC}, {_KNOWN}, {_ALIGN}, {_ANALOG}"


def _pool(latest: str = "1 and 1") -> str:
    return _POOL.replace("LATEST", latest)


def _at(pool: str, name: str) -> str:
    """Places of weighted errors, in name."""
    key = "partition by series_id, t_idx, horizon"
    return f"""{name}0 as (select *, (sum(w) over ({key} order by err, w rows unbounded preceding) - w / 2) / sum(w) over ({key}) as pos from {pool}),
{name} as (select *, lead(pos) over o as pos2, lead(err) over o as v2, row_number() over o as n from {name}0 window o as ({key} order by pos))"""


def _quantile(q: float, digits: int | None = 6) -> str:
    x = f"max(coalesce(case when pos < {q} and {q} <= pos2 then err + (v2 - err) * ({q} - pos) / (pos2 - pos) end, case when n = 1 and pos >= {q} then err end, case when pos2 is null and pos < {q} then err end))"
    return x if digits is None else f"round({x}, {digits})"


_WIDE = f"""{_at("pool", "mq")}, med as (select series_id, t_idx, horizon, {_quantile(0.5, None)} as med from mq group by 1, 2, 3),
wide as (select series_id, t_idx, horizon, med + 1.15 * (err - med) as err, w from pool join med using (series_id, t_idx, horizon))"""
_CHANCES = """chances as (select p.series_id, p.t_idx, p.horizon, """ + ", ".join(f"round_even(sum(case when lp - err >= ln({t}) then w else 0 end) / sum(w), 3) as p_{k}" for k, t in enumerate((750.0, 1000.0, 1500.0), 1)) + """
  from wide p join points f on f.series_id = p.series_id and f.origin_idx = p.t_idx and f.horizon = p.horizon group by 1, 2, 3)"""
_FORECAST = f"""{_at("wide", "wq")}, fq as (select series_id, t_idx, horizon, {", ".join(f"{_quantile(q, None)} as e_{n}" for n, q in (("q10", 0.9), ("q25", 0.75), ("median", 0.5), ("q75", 0.25), ("q90", 0.1)))} from wq group by 1, 2, 3),
forecast as (select q.series_id, q.t_idx as origin_idx, q.horizon, q.t_idx + q.horizon as week_idx, format('{{}}-W{{:02d}}', isoyear(day), weekofyear(day)) as week, cast(day as varchar) as monday,
  {", ".join(f"cast(round_even(exp(lp - e_{n}), 0) as bigint) as {n}" for n in ("q10", "q25", "median", "q75", "q90"))}, cast(round_even(exp(lp), 0) as bigint) as point, p_1, p_2, p_3, hlabel as holiday
  from fq q join (select *, date '1970-01-01' + cast((origin_idx + horizon) * 7 + 1 - 719163 as integer) as day from points) f on f.series_id = q.series_id and f.origin_idx = q.t_idx and f.horizon = q.horizon
  join chances c on c.series_id = q.series_id and c.t_idx = q.t_idx and c.horizon = q.horizon left join cal on cal.week_idx = q.t_idx + q.horizon)"""

_FACTS = """f2 as (select f.*, htype, last_value(case when htype is null then q75 end ignore nulls) over (partition by series_id, origin_idx order by f.week_idx rows between unbounded preceding and 1 preceding) as lo,
    first_value(case when htype is null then q75 end ignore nulls) over (partition by series_id, origin_idx order by f.week_idx rows between 1 following and unbounded following) as hi from forecast f left join cal using (week_idx)),
now as (select *, row_number() over (partition by series_id order by week_idx desc) as k from panel qualify k = 1),
planned as (select s.series_id, s.week_idx, s.y, s.iso_week, greatest(s.y, case when htype is null then cast(q75 as double) else sqrt(coalesce(lo, hi) * coalesce(hi, lo)) end) as planned
  from now s left join f2 on f2.series_id = s.series_id and f2.origin_idx = s.week_idx and f2.horizon = 2),
pl as (select p.series_id, y, row_number() over (partition by p.series_id order by p.week_idx desc) as k from panel p left join cal using (week_idx) where htype is null qualify k <= 4),
cl as (select series_id, max(y) filter (k = 1) as a, max(y) filter (k = 2) as b, max(y) filter (k = 3) as c, max(y) filter (k = 4) as d from pl group by 1),
soon as (select series_id, avg(median) as soon from f2 where horizon <= 4 and htype is null group by 1),
tr0 as (select n.series_id, n.y, soon, case when d is not null then 0.5 * ln((a + b) / (c + d)) end as g, coalesce(ln(a / b) <= 0.02 and ln(b / c) <= 0.02, false) as down from now n left join cl using (series_id) left join soon using (series_id)),
tr as (select series_id, case when g >= 0.10 then 'rising fast' when g >= 0.03 then 'rising' when g <= -0.10 and down then 'falling fast' when g <= -0.03 and down then 'falling' else 'stable' end as trend5,
  coalesce(g >= 0.10, false) as fast, coalesce(g >= 0.03, false) or coalesce(soon > 1.05 * y, false) as rising, coalesce(g <= -0.03 and down, false) as falling from tr0),
pk as (select series_id, season, max(y) as peak, arg_max(week_idx, y) as peak_idx from panel group by 1, 2),
ph as (select n.series_id, n.iso_week, case when n.iso_week between 33 and 47 then 'autumn' when n.iso_week between 22 and 32 then 'summer' when n.iso_week between 11 and 16 and rising then 'winter_pre' when n.iso_week between 11 and 21 then 'spring'
    when peak >= 1000 and n.week_idx - peak_idx >= 3 and n.y <= 0.85 * peak and falling then 'winter_post' else 'winter_pre' end as plan_phase
  from now n join pk on pk.series_id = n.series_id and pk.season = n.season join tr on tr.series_id = n.series_id)"""

#: Facts of all weeks, for two delays.
_VINTAGES = f"""{_BLEND}, {_pool("1 and 99999")}, {_WIDE}, {_CHANCES}, {_FORECAST}, {_SECOND},
pw as (select p.*, htype, lead(p.week_idx) over (partition by p.series_id order by p.week_idx) as next_idx from panel p left join cal using (week_idx)),
kn as (select w.*, unnest(generate_series(week_idx, least(coalesce(next_idx, week_idx + 1) - 1, week_idx + 3))) as known_idx from pw w),
vt as (select kn.*, known_idx + delay as today_idx, cast(delay as integer) as delay, (select list(a.y order by a.week_idx desc) from pw a where a.series_id = kn.series_id and a.htype is null and a.week_idx <= kn.week_idx) as c,
    (select max(a.y) from panel a where a.series_id = kn.series_id and a.season = kn.season and a.week_idx <= kn.week_idx) as peak from kn, unnest([1, 2]) as t(delay)),
vp as (select vt.*, (select min(a.week_idx) from panel a where a.series_id = vt.series_id and a.season = vt.season and a.week_idx <= vt.week_idx and a.y = peak) as peak_idx, date '1970-01-01' + cast(today_idx * 7 + 1 - 719163 as integer) as day from vt),
fc as (select f.*, c.htype as tt from forecast f left join cal c using (week_idx)),
sd as (select v.series_id, v.today_idx, v.delay, avg(f.median) filter (f.week_idx - today_idx between 1 and 4 and tt is null) as soon, max(f.q75) filter (f.week_idx - today_idx = 2) as q, max(tt) filter (f.week_idx - today_idx = 2) as q_type,
    arg_max(f.q75, f.week_idx) filter (f.week_idx - today_idx < 2 and tt is null) as lo, arg_min(f.q75, f.week_idx) filter (f.week_idx - today_idx > 2 and tt is null) as hi,
    max(p_1) filter (f.week_idx - today_idx between 1 and 4) as p_yellow, max(p_2) filter (f.week_idx - today_idx between 1 and 4) as p_amber, max(p_3) filter (f.week_idx - today_idx between 1 and 4) as p_red
  from vp v join fc f on f.series_id = v.series_id and f.origin_idx = v.week_idx group by 1, 2, 3),
sg0 as (select sec.*, htype, lag(y) over (partition by series_id order by week_idx) as prev from second sec left join cal using (week_idx)),
sg as (select series_id, week_idx, coalesce(y >= 25 and y >= 1.5 * (select a.y from sg0 a where a.series_id = sg0.series_id and a.htype is null and a.week_idx <= sg0.week_idx - 2 order by a.week_idx desc limit 1) and y >= prev, false) as signal from sg0),
vf as (select v.series_id, v.today_idx, v.delay, v.week_idx, v.y, greatest(v.y, case when q_type is null then cast(q as double) else sqrt(coalesce(lo, hi) * coalesce(hi, lo)) end) as planned, c[1] as plain_y, cast(weekofyear(day) as integer) as iso_week, peak, peak_idx, soon,
    case when len(c) >= 4 then 0.5 * ln((c[1] + c[2]) / (c[3] + c[4])) end as g, len(c) >= 4 and ln(c[1] / c[2]) <= 0.02 and ln(c[2] / c[3]) <= 0.02 as down, coalesce(signal, false) as signal, v.htype is not null as on_holiday, p_yellow, p_amber, p_red
  from vp v left join sd using (series_id, today_idx, delay) left join sg on sg.series_id = v.series_id and sg.week_idx = v.week_idx),
vg as (select *, coalesce(g >= 0.10, false) as fast, coalesce(g >= 0.03, false) or coalesce(soon > 1.05 * y, false) as rising, coalesce(g <= -0.03 and down, false) as falling,
    case when planned >= 1500 then 'red' when planned >= 1000 then 'amber' when planned >= 750 then 'yellow' else 'green' end as planned_band, case when y >= 1500 then 'red' when y >= 1000 then 'amber' when y >= 750 then 'yellow' else 'green' end as band from vf),
vh as (select *, case when iso_week between 33 and 47 then 'autumn' when iso_week between 22 and 32 then 'summer' when iso_week between 11 and 16 and rising then 'winter_pre' when iso_week between 11 and 21 then 'spring'
    when peak >= 1000 and week_idx - peak_idx >= 3 and y <= 0.85 * peak and falling then 'winter_post' else 'winter_pre' end as plan_phase from vg),
vin as (select *, y >= 1500 and (rising or plan_phase = 'winter_pre') as crisis from vh)"""
_LEVELS = f"""gr as (select o_orderpriority as series_id, {_IDX.format(d="o_orderdate")} as week_idx, {", ".join(f"round(cast(sum(case when o_custkey % 5 = {k} then cast(o_totalprice as decimal(18,2)) else 0 end) as double) / 200, 3) as g{k}" for k in range(5))} from orders group by 1, 2),
ix as (select p.*, htype, 0.114 * g2 + 0.636 * g3 + 0.25 * g4 as ind from panel p left join gr using (series_id, week_idx) left join cal using (week_idx)),
bs as (select a.series_id, a.week_idx, median(s.y) as base, median(s.ind) as base_ind from ix a join ix s on s.series_id = a.series_id and s.iso_week between 27 and 34 and s.iso_year between a.iso_year - 2 and a.iso_year and s.week_idx <= a.week_idx group by 1, 2),
sh0 as (select a.series_id, a.week_idx, (select list(b.ind / b.y order by b.week_idx desc) from ix b where b.series_id = a.series_id and b.htype is null and b.week_idx <= a.week_idx) as r from ix a),
sh as (select series_id, week_idx, base, least(1.5, greatest(0.5, greatest(r[1], r[2]) * base / base_ind)) as share from sh0 join bs using (series_id, week_idx)),
vw as (select v.*, greatest(case planned_band when 'red' then 3 when 'amber' then 2 when 'yellow' then 1 else 0 end, case when signal or y >= 1500 then 3 else 0 end, case when plan_phase = 'autumn' then 1 else 0 end) as want,
    falling and not on_holiday and (plan_phase in ('spring', 'winter_post') or (plan_phase = 'summer' and iso_week <= 32)) as may, 100 * (0.75 + 0.25 * (planned / base * share)) as low, 100 * (0.55 + 0.45 * (planned / base * share)) as high
  from vin v left join sh using (series_id, week_idx)),
dy as (select series_id, today_idx, max(want) as raw, bool_and(may) as down, bool_or(crisis) as crisis, max(low) as low, max(high) as high from vw group by 1, 2),
hd8 as (select *, max(raw) over b as held, max(low) over b as held_low, max(high) over b as held_high, row_number() over (partition by series_id order by today_idx) as n from dy window b as (partition by series_id order by today_idx range between 8 preceding and 1 preceding)),
lv as (select series_id, n, today_idx, raw, held, raw as level, crisis, low, high from hd8 where n = 1
  union all select d.series_id, d.n, d.today_idx, d.raw, d.held, case when d.raw >= level then d.raw when d.down then greatest(d.raw, level - 1) else greatest(d.raw, least(level, d.held)) end, d.crisis,
    case when lv.low is null or d.low >= lv.low then d.low when d.low is null then lv.low when d.down then (d.low + lv.low) / 2 else greatest(d.low, least(lv.low, held_low)) end,
    case when lv.high is null or d.high >= lv.high then d.high when d.high is null then lv.high when d.down then (d.high + lv.high) / 2 else greatest(d.high, least(lv.high, held_high)) end
  from hd8 d join lv on lv.series_id = d.series_id and d.n = lv.n + 1)"""

_NOW = _VINTAGES.replace("unnest([1, 2])", "unnest([0])") + """,
q as (select *, row_number() over (partition by series_id order by week_idx) as n from vin where today_idx = week_idx),
wn as (select *, greatest(case planned_band when 'red' then 3 when 'amber' then 2 when 'yellow' then 1 else 0 end, case when signal or y >= 1500 then 3 else 0 end, case when plan_phase = 'autumn' then 1 else 0 end) as want,
  falling and not on_holiday and (plan_phase in ('spring', 'winter_post') or plan_phase = 'summer' and iso_week <= 32) as may from q),
l as (select series_id, n, week_idx, want as level from wn where n = 1
  union all select w.series_id, w.n, w.week_idx, case when want >= level then want when may then greatest(want, level - 1) else level end from wn w join l on l.series_id = w.series_id and w.n = l.n + 1)"""

_REPORTS = """rp as (select series_id, week_idx, iso_year, iso_week, round_even(y, 0) as value, case when lag(week_idx) over s = week_idx - 1 then lag(y) over s end as prev
  from panel window s as (partition by series_id order by week_idx)),
reports as (select *, round_even((value / (prev * case when week_idx % 5 = 0 then 1.1 else 1.0 end) - 1) * 100, 2) as change_pct from rp)"""
_REVISED = """n as (select *, case when lead(week_idx) over s = week_idx + 1 then lead(value) over s / (1 + lead(change_pct) over s / 100) end as implied,
    case when lead(week_idx) over s = week_idx + 1 then (lead(value) over s + 5) / (1 + lead(change_pct) over s / 100) end as implied2 from {t} window s as (partition by series_id order by week_idx)),
r as (select *, coalesce(abs(implied / value - 1) > 0.02, false) {also} as revised, date '1970-01-01' + cast((week_idx + 1) * 7 + 1 - 719163 as integer) as by_day from n)"""

_MODEL = "with {p} select series_id, origin_idx, horizon, round(lp, 6) as lp from {m}"
_HIST = """official as (select series_id, week_idx, round(y, 0) as value, cast(null as varchar) as note from panel where week_idx % 7 <> 3 and season >= 1996),
other as (select series_id, week_idx, round(y * 1.2, 0) as value from second),
stored as (select series_id, week_idx, round(y + 1, 0) as value, case when week_idx % 14 < 7 then 'revised' end as note from panel where week_idx % 7 in (2, 3) and season >= 1997),
f as (select series_id, min(week_idx) as first_idx from official group by 1),
every as (select *, 'official' as source, 2 as rk from official union all select *, 'official', case when note is not null then 1 else 3 end from stored
  union all select o.series_id, week_idx, value, case when week_idx >= first_idx then 'official report missing' end, 'scaled', 4 from other o left join f using (series_id)),
merged as (select series_id, week_idx, value, source, note from every qualify row_number() over (partition by series_id, week_idx order by rk) = 1)"""

ORACLES: dict[str, str] = {
    "iso_calendar": f"""with d as (select distinct cast(o_orderdate as date) as day from orders), c as (select day, {_cal("day")} from d)
select cast(day as varchar) as day, week_idx, iso_year, iso_week, wk52, season, cast(cast(date_trunc('week', day) as date) as varchar) as monday, cast(cast(date_trunc('week', day) as date) + 7 as varchar) as next_monday,
  cast(weekofyear(make_date(iso_year::bigint, 12, 28)) as integer) as n_weeks,
  case when iso_week between 34 and 48 then 'autumn' when iso_week >= 49 or iso_week <= 10 then 'winter' when iso_week between 11 and 26 then 'spring' else 'summer' end as phase,
  format('{{}}-W{{:02d}}', iso_year, iso_week) as week from c""",
    "holiday_calendar": f"with {_PANEL}, {_HOLS} select distinct week_idx, iso_year, iso_week, htype, hlabel from panel left join cal using (week_idx)",
    "label_holidays": f"with {_PANEL}, {_HOLS} select series_id, week_idx, y, htype, hlabel from panel left join cal using (week_idx)",
    "load_history": f"with {_PANEL} select iso_year, iso_week, count(*) as n, cast(sum(cast(y as decimal(18,3))) as double) as value from panel group by 1, 2",
    "load_week_map": f"with {_PANEL} select iso_year, iso_week, count(*) as n, cast(sum(cast(y as decimal(18,3))) as double) as value from panel group by 1, 2",
    "case_rates": f"""with r as (select {_cal("o_orderdate")}, l_quantity as c, l_extendedprice as p, l_returnflag = 'R' as s from lineitem join orders on l_orderkey = o_orderkey where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'))
select iso_year, iso_week, round(cast(sum(c) as double) / cast(sum(p) as double) * 1e5, 4) as rate, round(cast(sum(c) filter (s) as double) / cast(sum(p) filter (s) as double) * 1e5, 4) as sub_rate from r group by 1, 2 having sum(p) >= 1e5""",
    "merge_sources": f"with {_PANEL}, {_SECOND}, {_HIST} select * from merged",
    "source_counts": f"with {_PANEL}, {_SECOND}, {_HIST} select source, count(*) as n from merged group by 1",
    "new_reports": f"""with {_PANEL}, t as (select series_id, week_idx, week_idx + case when week_idx % 13 = 5 then 3 else 0 end as told_idx from panel),
d as (select *, date '1970-01-01' + cast(told_idx * 7 + 1 - 719163 as integer) as day from t)
select d.series_id, 'https://example.org/' || d.week_idx || '/wp-content/uploads/' || strftime(day + 9, '%Y/%m/') || format('{{:02d}}_tyden.pdf', weekofyear(day)) as url
from d left join panel o on o.series_id = d.series_id and o.week_idx = told_idx and o.week_idx % 7 <> 3 and o.season >= 1996 where o.week_idx is null""",
    "calibration_ratio": f"""with {_PANEL}, {_SECOND}, r as (select p.series_id, p.season, cast(least(4, ceil(p.iso_week / 13.0)) as integer) as quarter, p.y / s.y as r from panel p join second s using (series_id, week_idx) where s.y > 0)
select series_id, season, quarter, round(median(r), 6) as ratio, round(stddev_samp(r), 6) as spread, count(*) as n from r group by grouping sets ((series_id), (series_id, season), (series_id, quarter))""",
    "history_entries": f"""with {_PANEL} select series_id, week_idx, format('{{}}-W{{:02d}}', iso_year, iso_week) as week, iso_year, iso_week, cast(date '1970-01-01' + cast(week_idx * 7 + 1 - 719163 as integer) as varchar) as monday,
  cast(round_even(y, 0) as integer) as value, round_even(y / 7, 1) as sub_value, 'official' as source from panel""",
    "fill_gaps": f"""with {_PANEL}, {_HOLS}, h as (select series_id, week_idx, y from panel where week_idx % 11 <> 5),
n as (select series_id, week_idx, y, lead(week_idx) over s as nx, lead(y) over s as b from h window s as (partition by series_id order by week_idx))
select series_id, week_idx, round(y, 4) as value, 'official' as source, cast(null as varchar) as note from h
union all select series_id, week_idx + 1, round_even(sqrt(y * b), 0), 'interpolated', 'no report, from the weeks beside it' from n where nx = week_idx + 2 and week_idx + 1 not in (select week_idx from cal)""",
    "plausibility_gate": f"""with recursive {_PANEL}, r as (select series_id, week_idx, case when week_idx % 9 = 4 then y * 5 else y end as y, row_number() over (partition by series_id order by week_idx) as n from panel),
g as (select series_id, n, week_idx, y, true as accepted from r where n = 1
  union all select r.series_id, r.n, r.week_idx, r.y, not (g.accepted and r.week_idx = g.week_idx + 1 and not (r.y / g.y between 0.4 and 2.5)) from g join r on r.series_id = g.series_id and r.n = g.n + 1)
select series_id, week_idx, round(y, 6) as y, accepted from g""",
    "parse_reports": f"""with {_PANEL}, {_REPORTS}, v as (select *, cast(value as bigint) as n, week_idx % 6 <> 0 and cast(value as bigint) // 10 >= 20 as ok from reports)
select series_id, week_idx, case when ok then iso_year end as year, case when ok then iso_week end as week, case when ok then value end as value, case when ok then cast(n // 10 as double) end as sub_value,
  case when ok then value + 20 end as first_group, case when ok then coalesce(change_pct, 0) end as change_pct from v""",
    "apply_revisions": f"""with {_PANEL}, {_REPORTS}, {_REVISED.format(t="reports", also="")}
select series_id, week_idx, value, case when revised then round_even(implied, 0) else value end as value_revised, revised, case when revised then round_even(implied2, 0) else value + 5 end as second_group,
  case when revised then 'revised by the report of ' || format('{{}}-W{{:02d}}', isoyear(by_day), weekofyear(by_day)) || ', before ' || cast(cast(value as bigint) as varchar) end as note from r""",
    "stream_ingest": f"""with {_PANEL}, {_REPORTS}, st as (select series_id, week_idx, case when week_idx % 4 = 1 then value + 1 else value end as value, change_pct from reports), {_REVISED.format(t="st", also="")}
select series_id, week_idx, case when revised then round_even(implied, 0) else value end as value, 'official' as source from r""",
    "history_violations": f"""with {_PANEL}, h0 as (select series_id, week_idx, week_idx % 40 = 0 as off_day, y as value, case when week_idx % 60 = 0 then 'other' else 'official' end as source from panel),
h as (select * from h0 union all select * from h0 where week_idx % 80 = 3),
c as (select *, count(*) over (partition by series_id, week_idx) as n, coalesce(lag(week_idx) over s = week_idx - 1 and source = 'official' and lag(source) over s = 'official' and not (value / lag(value) over s between 0.4 and 2.5), false) as jump
  from h window s as (partition by series_id order by week_idx))
select series_id, week_idx, problem from c, unnest([case when n > 1 then 'duplicate' end, case when source not in ('official', 'scaled', 'interpolated') then 'source' end, case when off_day then 'monday' end,
  case when not (value between 1 and 1e9) then 'value' end, case when jump then 'jump' end]) as t(problem) where problem is not null""",
    "holiday_profile": f"with {_PANEL}, {_HOLS}, {_OCC}, {_KNOWN} select series_id, s0, version, wk52, round(growth, 6) as growth from hp",
    "model_holiday_profile": f"with {_PANEL}, {_HOLS}, {_OCC}, {_KNOWN} select series_id, origin_idx, horizon, round(lp, 6) as lp from m_holiday_profile",
    "analog_align": f"with {_PANEL}, {_HOLS}, {_OCC}, {_ALIGN} select series_id, s0, s, week_idx, season, shift, round(d, 6) as d, t_now, t_then from al",
    "analog_weights": f"""with {_PANEL}, {_HOLS}, {_OCC}, {_KNOWN}, {_ALIGN}, {_ANALOG}
select series_id, origin_idx, s0, s, shift, round(d2, 6) + 0 as d2, round(o_now, 6) + 0 as o_now, round(o_long, 6) + 0 as o_long, round(w, 6) as w, round(x0, 6) + 0 as x0 from aw""",
    "model_analog": f"with {_PANEL}, {_HOLS}, {_OCC}, {_KNOWN}, {_ALIGN}, {_ANALOG} select series_id, origin_idx, horizon, round(lp, 6) as lp from m_analog",
    # two horizons more, counted from the last week with a value
    "late_forecast": f"""with {_PANEL}, {_HOLS}, {_OCC}, {_KNOWN}, {_ALIGN}, {_ANALOG},
late as (select a.series_id, a.origin_idx + late as origin_idx, cast(a.horizon - late as integer) as horizon, [0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0][least(a.horizon - late, 7)] as wt, a.lp as lp_a, b.lp as lp_b
  from m_analog a join m_holiday_profile b on b.series_id = a.series_id and b.origin_idx = a.origin_idx and b.horizon = a.horizon
  join (select series_id, max(week_idx) as origin_idx from panel group by 1) l on l.series_id = a.series_id and l.origin_idx = a.origin_idx, unnest([1, 2]) as t(late) where a.horizon - late between 1 and 10)
select series_id, origin_idx, horizon, round(wt * lp_a + (1 - wt) * lp_b, 6) as lp from late""".replace("generate_series(1, 10)", "generate_series(1, 12)").replace("a.shift + 10", "a.shift + 12"),
    "point_forecast": f"with {_PANEL}, {_HOLS}, {_OCC}, {_KNOWN}, {_ALIGN}, {_ANALOG} select series_id, origin_idx, horizon, round(lp, 6) as lp from points",
    "phase_pool": f"with {_BLEND}, {_pool()} select series_id, t_idx, horizon, round(err, 6) as err, w from pool",
    "weighted_quantile": f"with {_BLEND}, {_pool()}, {_at('pool', 'pq')} select series_id, t_idx, horizon, {_quantile(0.1)} as q10, {_quantile(0.5)} as q50, {_quantile(0.9)} as q90 from pq group by 1, 2, 3",
    "widened_pool": f"with {_BLEND}, {_pool()}, {_WIDE} select series_id, t_idx, horizon, round(err, 6) as err, w from wide",
    "exceedance_prob": f"with {_BLEND}, {_pool()}, {_WIDE}, {_CHANCES} select * from chances",
    "make_forecast": f"with {_BLEND}, {_pool()}, {_WIDE}, {_CHANCES}, {_FORECAST} select * from forecast",
    "forecast_past": f"with {_BLEND}, {_pool('2 and 9')}, {_WIDE}, {_CHANCES}, {_FORECAST} select * from forecast",
    "forecast_violations": f"""with {_BLEND}, {_pool('2 and 9')}, {_WIDE}, {_CHANCES}, {_FORECAST},
bad as (select * replace (case when origin_idx % 3 = 0 and horizon = 4 then q90 + 1 else q10 end as q10, case when origin_idx % 5 = 2 and horizon = 2 then p_1 + 0.1 else p_3 end as p_3) from forecast where not (origin_idx % 4 = 1 and horizon = 7)),
a as (select series_id, origin_idx, count(*) as n, max(week_idx) - min(week_idx) + 1 as span, bool_and(q10 <= q25 and q25 <= median and median <= q75 and q75 <= q90) as ok, bool_and(p_1 >= p_2 and p_2 >= p_3) as mono from bad group by 1, 2)
select series_id, origin_idx, problem from a, unnest([case when n <> 10 or span <> n then 'rows' end, case when not ok then 'quantiles' end, case when not mono then 'probabilities' end]) as t(problem) where problem is not null""",
    "skill_summary": f"""with {_BLEND}, {_pool()}, both_ as (select 'blend' as model, series_id, origin_idx, s0, horizon, err from bres union all select model, series_id, origin_idx, s0, horizon, err from res where model = 'legacy'),
k as (select model, series_id, horizon, round_even((exp(list_sort(list(abs(err)))[count(*) // 2 + 1]) - 1) * 100, 1) as pct, count(distinct origin_idx) as n_origins, count(distinct s0) as n_seasons
  from (select *, max(s0) over (partition by model, series_id) as running from both_) where s0 >= 2000 and s0 <> running group by 1, 2, 3)
select a.series_id, a.horizon, a.pct as mdae_pct, a.n_origins, a.n_seasons, b.pct as legacy_pct from k a left join k b on b.model = 'legacy' and b.series_id = a.series_id and b.horizon = a.horizon where a.model = 'blend'""",
    "planned_value": f"with {_BLEND}, {_pool()}, {_WIDE}, {_CHANCES}, {_FORECAST}, {_FACTS} select series_id, week_idx, round(planned, 6) as planned, case when planned >= 1500 then 'red' when planned >= 1000 then 'amber' when planned >= 750 then 'yellow' else 'green' end as planned_band from planned",
    "trend_class": f"with {_BLEND}, {_pool()}, {_WIDE}, {_CHANCES}, {_FORECAST}, {_FACTS} select * from tr",
    "planning_phase": f"with {_BLEND}, {_pool()}, {_WIDE}, {_CHANCES}, {_FORECAST}, {_FACTS} select * from ph",
    "history_document": f"""with {_PANEL} select series_id, cast(count(*) as integer) as n, '[' || string_agg('{{"week_idx":' || week_idx || ',"week":"' || format('{{}}-W{{:02d}}', iso_year, iso_week) || '","value":' || cast(round_even(y, 0) as bigint) || '}}', ',' order by week_idx) || ']' as document from panel group by 1""",
    "capacity_level": f"""with recursive {_NOW} select series_id, week_idx, level from l""",
    "situation": f"""with recursive {_NOW}, st as (select q.*, level from q join l using (series_id, week_idx))
select series_id, week_idx, planned_band, plan_phase, level, case
  when signal and y < 1500 and plan_phase not in ('spring', 'winter_post') then 'S6'
  when plan_phase = 'winter_post' and (planned_band = 'red' and not rising or planned_band = 'amber' and falling) then 'S10'
  when planned_band = 'red' then case when plain_y >= 1500 then 'S9' else 'S9a' end
  when on_holiday and not rising and not falling then 'S12'
  when plan_phase = 'summer' and (fast or rising and planned_band <> 'green') then 'S14'
  when falling and plan_phase not in ('autumn', 'winter_pre') then 'S11'
  when planned_band = 'amber' and plan_phase = 'winter_pre' then case when rising or p_red >= 0.30 then 'S7' else 'S8' end
  when planned_band = 'amber' and plan_phase = 'autumn' and rising then case when band in ('amber', 'red') then 'S4' else 'S4a' end
  when planned_band = 'yellow' and plan_phase in ('autumn', 'winter_pre') and (rising or p_amber >= 0.50) then case when band = 'green' and not rising then 'S3a' else 'S3' end
  when planned_band = 'green' and plan_phase = 'autumn' and (rising or p_yellow >= 0.30) then 'S2'
  when planned_band in ('amber', 'yellow') and plan_phase in ('winter_post', 'spring') then 'S8j'
  when planned_band = 'amber' and plan_phase = 'autumn' or planned_band = 'yellow' and plan_phase in ('autumn', 'winter_pre') then 'S5'
  when (planned_band = 'green' or planned_band = 'yellow' and plan_phase = 'summer') and level >= 1 then 'S1b' else 'S1' end as situation from st""",
    "capacity_pct": f"""with recursive {_NOW}, {_LEVELS.split("vw as (")[0].rstrip().rstrip(",")},
z as (select q.series_id, planned, base, share from q join sh using (series_id, week_idx) qualify row_number() over (partition by q.series_id order by q.week_idx desc) = 1)
select series_id, round(base, 6) as base, greatest(100.0, round_even((0.75 + 0.25 * (planned / base * share)) * 100 / 5, 0) * 5) as low_pct, greatest(100.0, round_even((0.55 + 0.45 * (planned / base * share)) * 100 / 5, 0) * 5) as high_pct from z""",
    "report_intake": f"""with recursive {_PANEL}, {_REPORTS},
t0 as (select series_id, week_idx, week_idx + case when week_idx % 13 = 5 then 3 else 0 end as told_idx, value * case when week_idx % 9 = 4 then 5 else 1 end as v, change_pct from reports),
off as (select series_id, week_idx, round_even(y, 0) as v from panel where week_idx % 7 = 3),
t1 as (select t.*, o.week_idx is not null as known from t0 t left join off o on o.series_id = t.series_id and o.week_idx = told_idx),
t2 as (select t.*, case when known then 'known' when week_idx % 6 = 0 or v < 200 then 'unreadable' when week_idx % 13 = 5 then 'other week' end as status from (select * from t1 qualify row_number() over (partition by series_id, told_idx order by week_idx) >= 1) t),
st as (select series_id, week_idx, 0 as kind, v, true as official from off union all select series_id, week_idx, 0, round_even(y * 1.1, 0), false from panel where week_idx % 4 = 1 and week_idx % 7 <> 3
  union all select series_id, week_idx, 1, v, true from t2 where status is null),
so as (select *, row_number() over (partition by series_id order by week_idx, kind) as n from st),
fo as (select series_id, n, week_idx as idx, kind, v as now_v, official as now_off, cast(null as bigint) as b_idx, cast(null as double) as b_v, case when kind = 1 then 'accepted' end as said from so where n = 1
  union all select series_id, n, week_idx, kind, case when kind = 0 or verdict = 'accepted' then v when same then now_v end, case when kind = 0 then official when verdict = 'accepted' then true else same and now_off end, p_idx, p_v, case when kind = 1 then verdict end
  from (select *, case when same and now_off then 'known' when p_idx = week_idx - 1 and p_v is not null and not (v / p_v between 0.4 and 2.5) then 'implausible' else 'accepted' end as verdict
    from (select s.*, f.idx = s.week_idx as same, f.now_v, f.now_off, case when f.idx = s.week_idx then f.b_idx else f.idx end as p_idx, case when f.idx = s.week_idx then f.b_v else f.now_v end as p_v
      from fo f join so s on s.series_id = f.series_id and s.n = f.n + 1)))
select series_id, idx as week_idx, t.v as value, t.change_pct, said as status from fo join t2 t using (series_id) where kind = 1 and t.week_idx = idx and t.status is null
union all select series_id, case when status = 'other week' then week_idx else told_idx end, case when status = 'other week' then v end, case when status = 'other week' then change_pct end, status from t2 where status is not null""",
    "stream_revisions": f"""with {_PANEL}, {_REPORTS}, again as (select * replace (value + case when week_idx % 4 = 1 then 1 else 0 end as value) from reports), {_REVISED.format(t="again", also="")}
select series_id, week_idx, value as old, round_even(implied, 0) as new, round_even(implied2, 0) as second_group, 'revised by the report of ' || format('{{}}-W{{:02d}}', isoyear(by_day), weekofyear(by_day)) || ', before ' || cast(value as bigint) as note from r where revised""",
    "stream_panel": f"""select event_type as series_id, {_IDX.format(d="ts")} as week_idx, count(*) as n, round(cast(sum(cast(coalesce(value, 0) as decimal(28,6))) as double), 6) as total from events where ts is not null group by 1, 2""",
    "stream_alerts": f"""with {_PANEL}, r as (select series_id, week_idx, lead(week_idx) over (partition by series_id order by week_idx) as nxt, (select max(week_idx) + 6 from panel) as clock from panel where week_idx % 40 > 6),
a as (select *, date '1970-01-01' + cast((week_idx + 4) * 7 + 1 - 719163 as integer) as due, date '1970-01-01' + cast(nxt * 7 + 9 - 719163 as integer) as came, date '1970-01-01' + cast(clock * 7 + 9 - 719163 as integer) as upto from r),
b as (select * from a where coalesce(came, upto) > due)
select series_id, week_idx as last_idx, strftime(due, '%Y-%m-%d 00:00:00') as at, 'alert' as kind from b
union all select series_id, nxt, strftime(came, '%Y-%m-%d 00:00:00'), 'withdrawn' from b where nxt is not null""",
    "merge_files": f"""with {_PANEL}, c0 as (select {_IDX.format(d="o_orderdate")} as week_idx, o_orderpriority as g, l_quantity as q, l_extendedprice as e, l_returnflag = 'R' as r from lineitem join orders on l_orderkey = o_orderkey),
c1 as (select week_idx, sum(q) as a, sum(e) as b, sum(q) filter (r) as c, sum(e) filter (r) as d from c0 where g <> '4-NOT SPECIFIED' and not (week_idx % 17 = 0 and g = '1-URGENT') and not (week_idx % 19 = 0 and g = '2-HIGH') group by 1),
o as (select 'all' as series_id, week_idx, avg(round(y * 1.5, 1)) as value, avg(round(y / 9, 1)) as sub_value from panel where week_idx % 3 > 0 and week_idx % 10 <> 5 group by 2),
e as (select 'all' as series_id, week_idx, a / b * 1e5 * 1.2 as value, case when c > 0 then c / d * 1e5 * 1.163 end as sub_value from c1 where b >= 1e5)
select series_id, week_idx, round(value, 4) as value, round(sub_value, 4) as sub_value, 'official' as source, cast(null as varchar) as note from o
union all select series_id, week_idx, round(value, 4), round(sub_value, 4), 'scaled', case when week_idx >= (select min(week_idx) from o) then 'official report missing' end from e where week_idx not in (select week_idx from o)""",
    "file_rejects": f"""with {_PANEL}, c0 as (select distinct {_IDX.format(d="o_orderdate")} as week_idx, o_orderpriority as g from lineitem join orders on l_orderkey = o_orderkey)
select 'cases' as kind, 'cells' as reason, count(*) as n from c0 where week_idx % 17 = 0 and g = '1-URGENT' union all select 'cases', 'no such week', count(*) from c0 where week_idx % 19 = 0 and g = '2-HIGH'
union all select 'official', 'no value', count(*) from panel where week_idx % 3 > 0 and week_idx % 10 = 5 union all select 'official', 'no list', 1""",
    "kept_forecasts": f"with {_PANEL}, {_HOLS}, {_OCC}, {_KNOWN}, {_ALIGN}, {_ANALOG} select series_id, origin_idx, horizon, round(lp, 6) as lp from points",
    "vintages": f"""with {_VINTAGES} select series_id, today_idx, delay, week_idx, round(y, 6) as y, round(planned, 6) as planned, planned_band, band, round(plain_y, 6) as plain_y, iso_week, plan_phase, fast, rising, falling, signal, on_holiday, crisis, p_yellow, p_amber, p_red from vin""",
    "capacity_replay": f"""with recursive {_VINTAGES}, {_LEVELS}
select series_id, today_idx, raw, held, level, crisis, case when low is not null then greatest(100.0, round_even(round(low / 5, 9), 0) * 5) end as low_pct, case when high is not null then greatest(100.0, round_even(round(high / 5, 9), 0) * 5) end as high_pct from lv""",
    "current_state": f"""with {_PANEL}, {_HOLS}, {_SECOND}, l as (select p.series_id, p.week_idx, y, htype, hlabel, row_number() over (partition by p.series_id order by p.week_idx desc) as n from panel p left join cal using (week_idx) qualify n <= 8),
c as (select series_id, y, row_number() over (partition by series_id order by n) as k from l where htype is null),
x as (select series_id, max(y) filter (k = 1) as x0, max(y) filter (k = 2) as x1, max(y) filter (k = 3) as x2, max(y) filter (k = 4) as x3 from c group by 1),
s as (select series_id, max(week_idx) as week_idx, max(y) filter (n = 1) as y, max(y) filter (n = 2) as y1, max(y) filter (n = 3) as y2, max(hlabel) filter (n = 1) as holiday from l group by 1)
select s.series_id, s.week_idx, s.y, case when s.y >= 1500 then 'red' when s.y >= 1000 then 'amber' when s.y >= 750 then 'yellow' else 'green' end as band, round_even((s.y / y1 - 1) * 100, 1) as change_1w_pct, round_even((s.y / y2 - 1) * 100, 1) as change_2w_pct,
  case when x3 is null then 'stable' when 0.5 * ln((x0 + x1) / (x2 + x3)) >= 0.03 then 'rising' when 0.5 * ln((x0 + x1) / (x2 + x3)) <= -0.03 and ln(x0 / x1) <= 0.02 and ln(x1 / x2) <= 0.02 then 'falling' else 'stable' end as trend, holiday, round(e.y, 1) as sub_value, 'official' as source, 'https://example.org/' || s.week_idx as url
from s left join x using (series_id) left join second e on e.series_id = s.series_id and e.week_idx = s.week_idx""",
    "changed_rows": f"""with {_PANEL}, a as (select series_id, week_idx, round_even(y, 0) + case when week_idx % 50 = 0 then 1 else 0 end as value from panel), b as (select series_id, week_idx, round_even(y, 0) as value from panel where week_idx % 70 <> 1)
select *, 'new' as side from (select * from a except all select * from b) union all select *, 'old' from (select * from b except all select * from a)""",
    "staleness": f"""with {_PANEL}, m as (select max(week_idx) + 3 as today from panel)
select series_id, max(week_idx) as last_idx, any_value(today) - max(week_idx) as weeks_behind, any_value(today) - max(week_idx) >= 4 as alert from panel, m where series_id <> '5-LOW' or season < 2000 group by 1""",
    "season_peak": f"with {_PANEL} select series_id, season, y as peak, week_idx as peak_idx from panel qualify row_number() over (partition by series_id, season order by y desc, week_idx) = 1",
    "seasonal_change_stats": f"""with {_PANEL}, c as (select series_id, wk52, case when lag(week_idx) over s = week_idx - 1 then y / lag(y) over s - 1 end as chg from panel window s as (partition by series_id order by week_idx))
select series_id, wk52, round(median(chg) * 100, 6) as median_pct, round(avg(case when chg > 0 then 1.0 else 0.0 end), 6) as share_rising, count(*) as n from c where chg is not null group by 1, 2""",
    "extract_links": r"""with h as (select page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) as hs from pages),
l as (select page_id, cast(i - 1 as integer) as pos, split_part(hs[i], '#', 1) as u from h, unnest(generate_series(1, len(hs))) as t(i)),
a as (select page_id, pos, case when starts_with(u, 'http') then u else 'https://example.org' || u end as url from l)
select page_id, url, min(pos) as pos from a where regexp_matches(url, '(?i)^https?://') group by 1, 2""",
    "url_week": """with d as (select distinct cast(o_orderdate as date) as d from orders)
select cast(d as varchar) as d, cast(case when month(d) = 1 and weekofyear(d) >= 50 then year(d) - 1 when month(d) = 12 and weekofyear(d) <= 2 then year(d) + 1 else year(d) end as integer) as year, cast(weekofyear(d) as integer) as week from d""",
    "weekly_growth": f"with {_PANEL} select series_id, week_idx, round(growth, 6) as growth from growth",
    "growth_profile": f"with {_PANEL} select series_id, cast(s0 as integer) as s0, wk52, round(growth, 6) as growth, n from prof",
    "level_climatology": f"with {_PANEL} select series_id, cast(s0 as integer) as s0, wk52, round(level, 6) as level, n from clim",
    "holiday_occurrences": f"with {_PANEL}, {_HOLS}, {_OCC} select series_id, week_idx, season, htype, round(diff, 6) as diff, known_at from occ",
    "holiday_effects": f"with {_PANEL}, {_HOLS}, {_OCC} select series_id, version, htype, round(effect, 6) as effect from eff",
    "adjusted_series": f"""with {_PANEL}, {_HOLS}, {_OCC}, lv as (select series_id, max(version) as version from eff group by 1)
select m.series_id, week_idx, round(z, 6) as z, m.htype, round(z - coalesce(effect, 0), 6) as adjusted from mk m left join lv using (series_id) left join eff on eff.series_id = m.series_id and eff.version = lv.version and eff.htype = m.htype""",
    "rolling_origins": f"with {_PANEL} select * from origins",
    **{f"model_{m}": _MODEL.format(p=_PANEL, m=f"m_{m}") for m in ("persistence", "legacy", "seasonal_naive", "profile", "profile_momentum", "clim_anomaly")},
    "backtest_residuals": f"with {_PANEL} select model, series_id, origin_idx, s0, iso_week, horizon, round(err, 6) as err, round(chg, 6) as chg, round(pchg, 6) as pchg from res",
    "residual_quantiles": f"""with {_PANEL} select model, horizon, round(quantile_cont(err, 0.1), 6) as q10, round(quantile_cont(err, 0.25), 6) as q25, round(quantile_cont(err, 0.5), 6) as q50, round(quantile_cont(err, 0.75), 6) as q75, round(quantile_cont(err, 0.9), 6) as q90 from res group by 1, 2""",
    "backtest_summary": f"with {_PANEL} select split, phase, model, horizon, n, round(mean_pct, 4) as mean_pct, round(bias_pct, 4) as bias_pct, round(dir, 4) as dir, round(cov50, 4) as cov50, round(cov80, 4) as cov80, round(mae_pct, 4) as mae_pct from summary",
    "interval_coverage": f"with {_PANEL} select split, model, horizon, round(cov50, 4) as cov50, round(cov80, 4) as cov80 from summary where phase = '*'",
    "model_score": f"""with {_PANEL} select split, model, round(avg(mae_pct), 4) as score, round(avg(dir) filter (horizon <= 4), 4) as dir1_4, round(avg(cov50), 4) as cov50, round(avg(cov80), 4) as cov80 from summary where phase = '*' group by 1, 2""",
    "early_signal": f"""with {_SECOND}, {_HOLS}, s as (select sec.*, htype from second sec left join cal using (week_idx)),
b as (select series_id, week_idx, y, lag(y) over (partition by series_id order by week_idx) as prev,
  (select a.y from s a where a.series_id = s.series_id and a.htype is null and a.week_idx <= s.week_idx - 2 order by a.week_idx desc limit 1) as base from s)
select series_id, week_idx, coalesce(y >= 25 and y >= 1.5 * base and y >= prev, false) as signal from b""",
}
ORACLES["published_products"] = f"""with {_PANEL}, u as (select 'history' as "table", cast(season as varchar) as part, count(*) as rows, case when season = 2000 then 2 else 1 end as version from panel group by season
union all select 'current', series_id, 1, 1 from (select distinct series_id from panel)
union all select 'forecast', series_id, 10, 1 from (select distinct series_id from origins)
union all select 'forecast_past', series_id, 10 * count(*), 1 from (select * from origins qualify row_number() over (partition by series_id order by origin_idx desc) between 2 and 9) group by series_id
union all select 'model', series_id, count(*), 1 from ({ORACLES["skill_summary"]}) group by series_id)
select "table", part, cast(rows as bigint) as rows, cast(version as bigint) as version from u"""
