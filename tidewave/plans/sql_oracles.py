"""DuckDB SQL for the signal queries, from the same tap literals as the operators use."""

from __future__ import annotations

import numpy as np

EVENTS = "select user_id, ts, value as v from events"
LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"
#: (user_id, n, nn, v) and (l_suppkey, n, nn, raw, rx, ry, rz)
EV = f"ev as materialized (select user_id, (row_number() over w - 1)::int as n, (count(*) over (partition by user_id))::int as nn, v from ({EVENTS}) window w as (partition by user_id order by ts))"
LI = f"""li as materialized (select l_suppkey, (row_number() over w - 1)::int as n, (count(*) over (partition by l_suppkey))::int as nn,
  l_extendedprice / 1000 as raw, l_extendedprice / 2000 + l_quantity / 10 as low, l_quantity as rx, l_discount as ry, l_tax as rz from lineitem window w as (partition by l_suppkey order by {LINE_ORDER}))"""


def rounded(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def values(table: str, columns: str, rows) -> str:
    return f"{table}({columns}) as (values {', '.join('(' + ', '.join(repr(float(x)) if isinstance(x, (float, np.floating)) else str(int(x)) for x in r) + ')' for r in rows)})"


def moving_average(half: int) -> str:
    return f"""with {EV}, p as (
  select user_id, n, n as pos, v from ev union all select user_id, n, -n, v from ev where n between 1 and {half}
  union all select user_id, n, 2 * (nn - 1) - n, v from ev where n < nn - 1 and n >= nn - 1 - {half}
), m as (select user_id, n, pos, avg(v) over (partition by user_id order by pos rows between {half} preceding and {half} following) as v from p)
select user_id, n, {rounded('v')} as v from m where pos = n"""


def moving_median(half: int) -> str:
    return f"""with {EV}, p as (
  select user_id, n as pos, v from ev
  union all select user_id, k, 0.0 from (select distinct user_id from ev), (select unnest(range(-{half}, 0))::int as k)
  union all select user_id, (nn + k)::int, 0.0 from (select distinct user_id, nn from ev), (select unnest(range({half}))::int as k)
), m as (select user_id, pos, median(v) over (partition by user_id order by pos rows between {half} preceding and {half} following) as v from p)
select m.user_id, m.pos as n, {rounded('m.v')} as v from m join ev on m.user_id = ev.user_id and m.pos = ev.n"""


def fir_causal(numtaps: int, cutoff: float, fs: float) -> str:
    """The taps too are made in SQL: a sinc under a Hamming window, scaled to sum to one."""
    x = f"(k - {(numtaps - 1) / 2})"
    return f"""with {EV}, sinc as (select k, case when {x} = 0 then 1.0 else sin(pi() * {2 * cutoff / fs} * {x}) / (pi() * {2 * cutoff / fs} * {x}) end * (0.54 - 0.46 * cos(2 * pi() * k / {numtaps - 1})) as t from (select unnest(range({numtaps})) as k)),
taps as (select k, t / sum(t) over () as t from sinc)
select a.user_id, a.n, {rounded('sum(t * b.v)')} as v from ev a join taps on true join ev b on b.user_id = a.user_id and b.n = a.n - k group by a.user_id, a.n"""


def fir_zero_phase(taps) -> str:
    taps = np.asarray(taps)
    reach = taps.size - 1
    both = np.convolve(taps, taps[::-1])
    return f"""with {EV}, e as (select user_id, min_by(v, n) as a, max_by(v, n) as b, max(nn) as nn from ev group by user_id), x as (
  select user_id, n as at, v from ev
  union all select ev.user_id, -n, 2 * a - v from ev join e using (user_id) where n between 1 and {reach}
  union all select ev.user_id, 2 * (ev.nn - 1) - n, 2 * b - v from ev join e using (user_id) where n < ev.nn - 1 and n >= ev.nn - 1 - {reach}
), {values('taps', 'k, t', zip(range(-reach, reach + 1), both, strict=True))}
select ev.user_id, ev.n, {rounded('sum(t * x.v)')} as v from ev join taps on true join x on x.user_id = ev.user_id and x.at = ev.n + k group by ev.user_id, ev.n"""


def iir_causal(sos) -> str:
    b0, b1, b2, _, a1, a2 = (float(x) for x in sos[0])
    return f"""with recursive {EV}, f as (
  select user_id, n, v as x0, 0.0::double as x1, {b0!r} * v as y0, 0.0::double as y1 from ev where n = 0
  union all select ev.user_id, ev.n, ev.v, f.x0, {b0!r} * ev.v + {b1!r} * f.x0 + {b2!r} * f.x1 - ({a1!r}) * f.y0 - ({a2!r}) * f.y1, f.y0 from f join ev on ev.user_id = f.user_id and ev.n = f.n + 1
) select user_id, n, {rounded('y0')} as v from f"""


def iir_zero_phase(sos, pad: int) -> str:
    """One section, forward then backward over the signal extended oddly by ``pad`` samples, each pass from its steady state."""
    b0, b1, b2, _, a1, a2 = (float(x) for x in sos[0])
    g = (b0 + b1 + b2) / (1 + a1 + a2)
    z1 = b2 - a2 * g
    z0 = b1 - a1 * g + z1

    def passed(name: str, source: str) -> str:
        return f"""{name} as (
  select user_id, i, m, x, {b0!r} * x + {z0!r} * x as y, ({b1!r}) * x - ({a1!r}) * ({b0!r} * x + {z0!r} * x) + {z1!r} * x as s, ({b2!r}) * x - ({a2!r}) * ({b0!r} * x + {z0!r} * x) as t from {source} where i = 0
  union all select e.user_id, e.i, e.m, e.x, {b0!r} * e.x + {name}.s, ({b1!r}) * e.x - ({a1!r}) * ({b0!r} * e.x + {name}.s) + {name}.t, ({b2!r}) * e.x - ({a2!r}) * ({b0!r} * e.x + {name}.s)
  from {name} join {source} e on e.user_id = {name}.user_id and e.i = {name}.i + 1)"""

    return f"""with recursive {EV}, q as (select user_id, min_by(v, n) as a, max_by(v, n) as b from ev group by user_id), ext as materialized (
  select user_id, n + {pad} as i, nn + {2 * pad} as m, v as x from ev
  union all select ev.user_id, {pad} - n, nn + {2 * pad}, 2 * a - v from ev join q using (user_id) where n between 1 and {pad}
  union all select ev.user_id, 2 * (nn - 1) - n + {pad}, nn + {2 * pad}, 2 * b - v from ev join q using (user_id) where n < nn - 1 and n >= nn - 1 - {pad}
), {passed('fw', 'ext')}, back as materialized (select user_id, m - 1 - i as i, m, y as x from fw), {passed('bw', 'back')}
select user_id, (m - 1 - i - {pad})::int as n, {rounded('y')} as v from bw where m - 1 - i between {pad} and m - {pad} - 1"""


def _dwt(lo, hi, source: str = "ev") -> str:
    """Tables a and d: one level, half-sample symmetric."""
    f = len(lo)
    part = lambda name, taps: f"""{name} as materialized (select o.user_id, o.i, sum(t * x.v) as c from o join (select * from {name}_taps) tt on true join {source} x on x.user_id = o.user_id
    and x.n = case when (2 * o.i + 1 - k + 4 * o.nn) % (2 * o.nn) < o.nn then (2 * o.i + 1 - k + 4 * o.nn) % (2 * o.nn) else 2 * o.nn - 1 - (2 * o.i + 1 - k + 4 * o.nn) % (2 * o.nn) end group by o.user_id, o.i)"""  # noqa: E731
    return f"""o as (select distinct user_id, nn, unnest(range((nn + {f - 1}) // 2))::int as i from {source}),
{values('a_taps', 'k, t', enumerate(lo))}, {values('d_taps', 'k, t', enumerate(hi))}, {part('a', lo)}, {part('d', hi)}"""


def dwt_analysis(lo, hi) -> str:
    return f"with {EV}, {_dwt(lo, hi)} select user_id, 1 as level, 'a' as band, i, {rounded('c')} as c from a union all select user_id, 1, 'd', i, {rounded('c')} from d"


def wavelet(lo, hi, rl, rh, kind: str) -> str:
    """kind: denoise (soft), baseline or identity."""
    f = len(lo)
    a = "select user_id, i, 0.0 as c from a" if kind == "baseline" else "select user_id, i, c from a"
    d = "select user_id, i, c from d"
    if kind == "denoise":
        d = "select d.user_id, i, case when c = 0 then 0.0 else c * greatest(0.0, 1 - t / abs(c)) end as c from d join (select d.user_id, median(abs(c)) / 0.6745 * sqrt(2 * ln(max(nn))) as t from d join (select distinct user_id, nn from ev) using (user_id) group by 1) th on d.user_id = th.user_id"
    rec = lambda src, taps: f"select ev.user_id, ev.n, t * x.c as c from ev join {taps} on true join ({src}) x on x.user_id = ev.user_id and 2 * x.i = ev.n + {f - 2} - k"
    return f"""with {EV}, {_dwt(lo, hi)}, {values('rl_taps', 'k, t', enumerate(rl))}, {values('rh_taps', 'k, t', enumerate(rh))}
select user_id, n, {rounded('sum(c)')} as v from ({rec(a, 'rl_taps')} union all {rec(d, 'rh_taps')}) group by user_id, n"""


def lms(mu: float) -> str:
    """Order 1, three channels; the raw signal drives its own weights."""
    return f"""with recursive {LI}, f as (
  select l_suppkey, n, raw as clean, 2 * {mu} * raw * rx as wx, 2 * {mu} * raw * ry as wy, 2 * {mu} * raw * rz as wz from li where n = 0
  union all select li.l_suppkey, li.n, raw - (wx * rx + wy * ry + wz * rz), wx + 2 * {mu} * (raw - (wx * rx + wy * ry + wz * rz)) * rx, wy + 2 * {mu} * (raw - (wx * rx + wy * ry + wz * rz)) * ry, wz + 2 * {mu} * (raw - (wx * rx + wy * ry + wz * rz)) * rz
  from f join li on li.l_suppkey = f.l_suppkey and li.n = f.n + 1
) select l_suppkey, n, {rounded('clean')} as clean from f"""


def blms(mu: float, block: int) -> str:
    """Order 1, magnitude of the references."""
    return f"""with recursive {LI}, s as materialized (select *, sqrt(rx * rx + ry * ry + rz * rz) as u from li), f as (
  select l_suppkey, n, raw as clean, 0.0::double as w, raw * u as acc from s where n = 0
  union all select s.l_suppkey, s.n,
    raw - u * case when s.n % {block} = 0 then w + {mu} / {block} * acc else w end,
    case when s.n % {block} = 0 then w + {mu} / {block} * acc else w end,
    case when s.n % {block} = 0 then 0.0 else acc end + u * (raw - u * case when s.n % {block} = 0 then w + {mu} / {block} * acc else w end)
  from f join s on s.l_suppkey = f.l_suppkey and s.n = f.n + 1
) select l_suppkey, n, {rounded('clean')} as clean from f"""


def rls(lam: float) -> str:
    """Order 1, magnitude of the references: weight and inverse power are numbers."""
    return f"""with recursive {LI}, s as materialized (select *, sqrt(rx * rx + ry * ry + rz * rz) as u from li), f as (
  select l_suppkey, n, raw as clean, u / ({lam} + u * u) * raw as w, (1 - u / ({lam} + u * u) * u) / {lam} as p from s where n = 0
  union all select s.l_suppkey, s.n, raw - w * u, w + p * u / ({lam} + u * p * u) * (raw - w * u), (p - p * u / ({lam} + u * p * u) * (p * u)) / {lam}
  from f join s on s.l_suppkey = f.l_suppkey and s.n = f.n + 1
) select l_suppkey, n, {rounded('clean')} as clean from f"""


def _lattice0(x: str, eps: float) -> str:
    """Order 0 at alpha 0, beta 1 has a closed form: q counts x^2 1.5 times, the ladder is a running regression."""
    run = "(partition by l_suppkey order by n rows unbounded preceding)"
    return f"sum(raw * {x}) over {run} / ({eps} + 1.0 * sum({x} * {x}) over {run} + 0.5 * sum({x} * {x}) over {run}) * {x}"


def gall(eps: float) -> str:
    return f"with {LI}, y as (select *, {_lattice0('rx', eps)} as y from li) select l_suppkey, n, {rounded('raw - y')} as err, {rounded('y')} as y from y"


def gall_freeze(k1: float, h1: float, h2: float) -> str:
    """Order 1 at alpha 0: bt0 is this sample (the first stage has no delay), f1 = b1 = x (1 - k1)."""
    return f"with {LI} select l_suppkey, n, {rounded(f'raw - rx * {h1!r} - (rx - {k1!r} * rx) * {h2!r}')} as err, {rounded(f'rx * {h1!r} + (rx - {k1!r} * rx) * {h2!r}')} as y from li"


PEAKS = f"peaks as (select user_id, (row_number() over (partition by user_id order by n) - 1)::int as peak_no, n as r from (select e.user_id, e.event_type, (row_number() over (partition by e.user_id order by e.ts) - 1)::int as n from events e) where event_type = 'purchase')"
BOUNDS = f"""{EV}, {PEAKS}, b0 as (
  select p.user_id, peak_no, r, lead(r) over w as nxt, nn from peaks p join (select distinct user_id, nn from ev) using (user_id) window w as (partition by user_id order by peak_no)
), b1 as (select *, least(nn, (r + nxt) // 2) as e, greatest(0, r - (nxt - r) // 2) as first from b0 where nxt is not null),
b2 as (select user_id, peak_no, coalesce(lag(e) over (partition by user_id order by peak_no), first) as s, e from b1),
bounds as materialized (select user_id, (row_number() over (partition by user_id order by peak_no) - 1)::int as cycle, s::int as s, e::int as e from b2 where e > s)"""


def scc_bounds(limit: int) -> str:
    return f'with {BOUNDS} select user_id, cycle, s as "start", e as "end" from bounds where cycle < {limit}'


def _kernel(m: str, i: str, src: str, n: str) -> str:
    """Weight of sample ``src`` of ``n`` for sample ``i`` of ``m``: a Dirichlet sum, with the term at half the rate."""
    x = f"({i} / {m}::double - {src} / {n}::double)"
    least = f"least({n}, {m})"
    h = f"(({least} - 1) // 2)"
    cosines = f"(case when abs(sin(pi() * {x})) < 1e-12 then {h}::double else (sin(pi() * {x} * (2 * {h} + 1)) / sin(pi() * {x}) - 1) / 2 end)"
    half = f"(case when {least} % 2 = 1 then 0.0 when {m} > {n} then cos(pi() * {least} * {x}) else 2 * cos(pi() * {least} * {src} / {n}::double) * (case when {i} % 2 = 0 then 1 else -1 end) end)"
    return f"(case when {n} = {m} then (case when {i} = {src} then 1.0 else 0.0 end) else (1 + 2 * {cosines} + {half}) / {n} end)"


def fourier_resample(target: int) -> str:
    return f"""with {EV} select o.user_id, o.i as n, {rounded('sum(' + _kernel(str(target), 'o.i', 'ev.n', 'ev.nn') + ' * ev.v)')} as v
from (select distinct user_id, unnest(range({target}))::int as i from ev) o join ev on ev.user_id = o.user_id group by o.user_id, o.i"""


def scc_preprocess(target: int, limit: int, shortest: int) -> str:
    return f"""with {BOUNDS}, cyc as (select *, e - s as len from bounds where cycle < {limit}),
y as materialized (select c.user_id, c.cycle, o.i, sum({_kernel(str(target), 'o.i', '(ev.n - c.s)', 'c.len')} * ev.v) as v
  from cyc c join (select unnest(range({target}))::int as i) o on true join ev on ev.user_id = c.user_id and ev.n >= c.s and ev.n < c.e where c.len >= {shortest} group by 1, 2, 3),
g as (select user_id, min(v) as lo, max(v) as hi from y group by user_id),
z as (select g.user_id, lo, hi, u.cycle, p.i from g join (select unnest(range({limit}))::int as cycle) u on true join (select unnest(range({target}))::int as i) p on true)
select z.user_id, z.cycle, z.i, {rounded('coalesce((y.v - lo) / case when hi > lo then hi - lo else 1.0 end, 0.0)')} as v, case when c.len >= {shortest} then c.len else 0 end::int as orig_len
from z left join y using (user_id, cycle, i) left join cyc c on c.user_id = z.user_id and c.cycle = z.cycle"""


def scc_postprocess(limit: int, shortest: int) -> str:
    """Upsampled and back is the signal itself: the valid cycles, one after the other."""
    return f"""with {BOUNDS}, cyc as (select * from bounds where cycle < {limit} and e - s >= {shortest})
select ev.user_id, (row_number() over (partition by ev.user_id order by ev.n) - 1)::int as n, {rounded('ev.v')} as v from cyc c join ev on ev.user_id = c.user_id and ev.n >= c.s and ev.n < c.e"""


def stft(size: int, hop: int, n_freq: int, n_frames: int) -> str:
    w = f"(0.5 - 0.5 * cos(2 * pi() * k / {size}))"
    return f"""with x as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as n from embeddings),
z as (select x.vec_id, f.f, t.t, sum(x.v * {w} * cos(2 * pi() * f.f * k / {size})) / {size / 2} as re, -sum(x.v * {w} * sin(2 * pi() * f.f * k / {size})) / {size / 2} as im
  from (select *, null from x) x join (select unnest(range({n_frames}))::int as t) t on true join (select unnest(range({n_freq}))::int as f) f on true
  join (select unnest(range({size}))::int as k) k on x.n = t.t * {hop} + k - {size // 2} group by 1, 2, 3),
s as (select vec_id, avg(re) as mr, stddev_pop(re) + 1e-8 as sr, avg(im) as mi, stddev_pop(im) + 1e-8 as si from z group by vec_id)
select z.vec_id, (f * {n_frames} + t)::int as pos, {rounded('(re - mr) / sr')} as re, {rounded('(im - mi) / si')} as im from z join s using (vec_id)"""


def _lattice1(eps: float, x: str, tag: str) -> str:
    """Order 1 at alpha 0, beta 1: stage 0 has no delay, so each power is a running sum. Tables ``tag``1 to ``tag``3; the last has err and y."""
    run = "(partition by l_suppkey order by n rows unbounded preceding)"
    return f"""{tag}1 as (select l_suppkey, n, raw, {x} as x, {eps} + 2 * sum({x} * {x}) over {run} as q0, sum({x} * {x}) over {run} as d1, sum(raw * {x}) over {run} as c1 from li),
{tag}2 as (select *, x - d1 / q0 * x as b1, raw - c1 / q0 * x as e1 from {tag}1),
{tag}3 as (select l_suppkey, n, raw, c1 / q0 * x + h2 * b1 as y, e1 - h2 * b1 as err from (select *, sum(e1 * b1) over {run} / ({eps} + sum(b1 * b1) over {run} / 2) as h2 from {tag}2))"""


def gall_one(eps: float) -> str:
    return f"with {LI}, {_lattice1(eps, 'rx', 'x')} select l_suppkey, n, {rounded('err')} as err, {rounded('y')} as y from x3"


def hybrid(eps: float, lam: float) -> str:
    """Three order-1 lattices and the Kalman fusion; the correlation matrix is symmetric, so six numbers of it travel."""
    axes = "xyz"
    names = ["xx", "xy", "xz", "yy", "yz", "zz"]
    k = lambda a, b: "k" + "".join(sorted(a + b))
    pi = lambda a: "(" + " + ".join(f"{k(a, b)} * s.u{b}" for b in axes) + ")"
    noise = "(" + " + ".join(f"w{a} * s.u{a}" for a in axes) + ")"
    den = f"({lam} + " + " + ".join(f"s.u{a} * {pi(a)}" for a in axes) + ")"
    start = "select l_suppkey, -1 as n, 0.0::double as clean, 0.0::double as y_total, " + ", ".join(f"1.0::double / 3 as w{a}" for a in axes) + ", " + ", ".join(f"{float(n[0] == n[1])}::double as k{n}" for n in names) + " from (select distinct l_suppkey from li)"
    step = f"select s.l_suppkey, s.n, s.raw - {noise}, {noise}, " + ", ".join(f"w{a} + {pi(a)} / {den} * (s.raw - {noise})" for a in axes) + ", " + ", ".join(f"(k{n} - {pi(n[0])} * {pi(n[1])} / {den}) / {lam}" for n in names) + " from f join s on s.l_suppkey = f.l_suppkey and s.n = f.n + 1"
    lattices = ", ".join(_lattice1(eps, f"r{a}", a) for a in axes)
    return f"""with recursive {LI}, {lattices}, s as materialized (select l_suppkey, n, x3.raw, x3.y as ux, y3.y as uy, z3.y as uz from x3 join y3 using (l_suppkey, n) join z3 using (l_suppkey, n)),
f as ({start} union all {step}) select l_suppkey, n, {', '.join(f"{rounded(c, 4)} as {c}" for c in ('clean', 'y_total', 'wx', 'wy', 'wz'))} from f where n >= 0"""


def dwt_layer(lo, hi) -> str:
    """Reversed taps at stride 2 over 64 values with zeros around them."""
    pad = (len(lo) - 2) // 2
    taps = lambda name, t: values(name, "k, t", enumerate(t[::-1]))
    part = lambda band, t: f"select o.vec_id, '{band}' as band, o.i, {rounded('sum(t * coalesce(x.v, 0))')} as c from (select vec_id, unnest(range(32))::int as i from embeddings) o join {t} on true left join x on x.vec_id = o.vec_id and x.n = 2 * o.i + k - {pad} group by o.vec_id, o.i"
    return f"with x as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as n from embeddings), {taps('l', lo)}, {taps('h', hi)} {part('low', 'l')} union all {part('high', 'h')}"


def idwt_layer(rl, rh) -> str:
    """The first 32 values as low and the others as high coefficients, up through reversed taps."""
    pad = (len(rl) - 2) // 2
    return f"""with x as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as n from embeddings), {values('l', 'k, t', enumerate(rl[::-1]))}, {values('h', 'k, t', enumerate(rh[::-1]))},
c as (select vec_id, (2 * n + k - {pad})::int as i, v * t as v from x join l on true where n < 32 union all select vec_id, (2 * (n - 32) + k - {pad})::int, v * t from x join h on true where n >= 32)
select vec_id, i, {rounded('sum(v)')} as v from c where i between 0 and 63 group by vec_id, i"""


def second_order(cutoff: float, fs: float, damping: int = 2) -> str:
    """Low-pass of order 2, causal: 1 / (s^2 + sqrt(damping) s + 1), 2 for Butterworth and 3 for Bessel; the coefficients come from the
    tangent of half the angle, in SQL."""
    c = f"(select c, 1 / (1 + sqrt({damping}) * c + c * c) as g from (select tan(pi() * {cutoff} / {fs}) as c))"
    return f"""with recursive {EV}, k as (select c * c * g as b, 2 * (c * c - 1) * g as a1, (1 - sqrt({damping}) * c + c * c) * g as a2 from {c}), f as (
  select user_id, n, v as x0, 0.0::double as x1, b * v as y0, 0.0::double as y1 from ev, k where n = 0
  union all select ev.user_id, ev.n, ev.v, f.x0, b * (ev.v + 2 * f.x0 + f.x1) - a1 * f.y0 - a2 * f.y1, f.y0 from f join ev on ev.user_id = f.user_id and ev.n = f.n + 1 join k on true
) select user_id, n, {rounded('y0')} as v from f"""


def cascade(sos) -> str:
    """Any number of sections, causal: each has two numbers of state."""
    states = [f"{c}{i}" for i in range(len(sos)) for c in "st"]
    inner, value = "select ev.user_id, ev.n, ev.v as v0, " + ", ".join(f"f.{x}" for x in states) + " from f join ev on ev.user_id = f.user_id and ev.n = f.n + 1", "v0"
    for i, (b0, *_) in enumerate(sos):
        inner, value = f"select *, {float(b0)!r} * {value} + s{i} as v{i + 1} from ({inner})", f"v{i + 1}"
    step = ", ".join(f"({float(b1)!r}) * v{i} - ({float(a1)!r}) * v{i + 1} + t{i}, ({float(b2)!r}) * v{i} - ({float(a2)!r}) * v{i + 1}" for i, (_, b1, b2, _, a1, a2) in enumerate(sos))
    return f"""with recursive {EV}, f as (
  select distinct user_id, -1 as n, 0.0::double as y, {', '.join(f'0.0::double as {x}' for x in states)} from ev
  union all select user_id, n, {value}, {step} from ({inner})
) select user_id, n, {rounded('y')} as v from f where n >= 0"""


def _lags(names, order: int) -> str:
    return "[" + ", ".join(f"lag({c}, {i}) over w" if i else c for c in names for i in range(order)) + "]"


def _recursion(order: int, state: str, step: str, digits: int) -> str:
    """Rows ``r`` with regressors u of three channels; ``step`` gives clean and the new state from a row of r with the old state."""
    return f"""with recursive {LI}, r as materialized (select *, {_lags(('rx', 'ry', 'rz'), order)} as u from li window w as (partition by l_suppkey order by n)), f as (
  select distinct l_suppkey, {order - 2} as n, 0.0::double as clean, {state} from li
  union all {step}
) select l_suppkey, n, {rounded('clean', digits)} as clean from f where n > {order - 2} union all select l_suppkey, n, {rounded('raw', digits)} from li where n <= {order - 2}"""


def lms_taps(mu: float, order: int, digits: int) -> str:
    step = f"""select l_suppkey, n, raw - y, list_transform(list_zip(w, u), lambda p: p[1] + 2 * {mu} * (low - y) * p[2])
  from (select r.l_suppkey, r.n, raw, low, u, w, list_dot_product(w, u) as y from f join r on r.l_suppkey = f.l_suppkey and r.n = f.n + 1)"""
    return _recursion(order, f"list_transform(range({3 * order}), lambda i: 0.0::double) as w", step, digits)


def rls_taps(lam: float, order: int, digits: int) -> str:
    m = 3 * order
    one = f"select r.l_suppkey, r.n, raw - list_dot_product(w, u) as clean, w, p, u, list_transform(p, lambda row: list_dot_product(row, u)) as pu from f join r on r.l_suppkey = f.l_suppkey and r.n = f.n + 1"
    step = f"""select l_suppkey, n, clean, list_transform(list_zip(w, pu), lambda x: x[1] + x[2] / den * clean), list_transform(p, lambda row, i: list_transform(row, lambda x, j: (x - pu[i] * pu[j] / den) / {lam}))
  from (select *, {lam} + list_dot_product(u, pu) as den from ({one}))"""
    state = f"list_transform(range({m}), lambda i: 0.0::double) as w, list_transform(range({m}), lambda i: list_transform(range({m}), lambda j: (i = j)::int::double)) as p"
    return _recursion(order, state, step, digits)


def blms_taps(mu: float, block: int, order: int, digits: int) -> str:
    """``acc`` sums the block's products; the weights move when the next block begins."""
    step = f"""select l_suppkey, n, raw - y, w, list_transform(list_zip(acc, u), lambda p: p[1] + p[2] * (raw - y))
  from (select *, list_dot_product(w, u) as y from (select r.l_suppkey, r.n, raw, u, case when (r.n - {order - 1}) % {block} = 0 then list_transform(list_zip(w, acc), lambda p: p[1] + {mu} / {block} * p[2]) else w end as w,
    case when (r.n - {order - 1}) % {block} = 0 then list_transform(acc, lambda x: 0.0::double) else acc end as acc from f join r on r.l_suppkey = f.l_suppkey and r.n = f.n + 1))"""
    zeros = f"list_transform(range({3 * order}), lambda i: 0.0::double)"
    return _recursion(order, f"{zeros} as w, {zeros} as acc", step, digits)


def _laguerre(order: int, beta: float, alpha: float, eps: float) -> str:
    """The learning lattice of any order as a recursion ``f``: err, y, and of each stage reflection k and ladder h."""
    m = range(order + 1)
    state = [*(f"b{i}" for i in m), *(f"c{i}" for i in range(order)), *(f"q{i}" for i in m), *(f"d{i}" for i in range(order)), *(f"j{i}" for i in m)]
    start = ", ".join(f"{eps if x[0] == 'q' else 0.0}::double as {x}" for x in state)
    rows = "select li.l_suppkey, li.n, li.raw, li.rx, " + ", ".join(f"f.{x} as o{x}" for x in state) + " from f join li on li.l_suppkey = f.l_suppkey and li.n = f.n + 1"

    def more(columns: str) -> None:
        nonlocal rows
        rows = f"select *, {columns} from ({rows})"

    more(f"{alpha} * ob0 + sqrt(1 - {alpha} * {alpha}) * rx as f0")
    more(f"f0 as b0, {beta} * oq0 + f0 * f0 as p0")
    for i in range(order):
        more(f"{'b0' if i == 0 else f'ob{i}'} + {alpha} * (oc{i} - b{i}) as c{i}")
        more(f"{beta} * {'p0' if i == 0 else f'oq{i}'} + (f{i} * f{i} + c{i} * c{i}) / 2 as q{i}, {beta} * od{i} + f{i} * c{i} as d{i}")
        more(f"d{i} / q{i} as k{i + 1}")
        more(f"f{i} - k{i + 1} * c{i} as f{i + 1}, c{i} - k{i + 1} * f{i} as b{i + 1}")
    more(f"{beta} * {'p0' if order == 0 else f'oq{order}'} + f{order} * f{order} / 2 as q{order}, raw as e0, 0.0 as y0")
    for i in m:
        more(f"{beta} * oj{i} + e{i} * b{i} as j{i}")
        more(f"j{i} / q{i} as h{i + 1}")
        more(f"e{i} - h{i + 1} * b{i} as e{i + 1}, y{i} + h{i + 1} * b{i} as y{i + 1}")
    found = [*(f"k{i}" for i in range(1, order + 1)), *(f"h{i}" for i in range(1, order + 2))]
    return f"""with recursive {LI}, f as (
  select distinct l_suppkey, -1 as n, 0.0::double as err, 0.0::double as y, {', '.join(f'0.0::double as {x}' for x in found)}, {start} from li
  union all select l_suppkey, n, e{order + 1}, y{order + 1}, {', '.join(found)}, {', '.join(state)} from ({rows}))"""


def laguerre(order: int, beta: float, alpha: float, eps: float, digits: int) -> str:
    return f"{_laguerre(order, beta, alpha, eps)} select l_suppkey, n, {rounded('err', digits)} as err, {rounded('y', digits)} as y from f where n >= 0"


def laguerre_coefficients(order: int, beta: float, alpha: float, eps: float, digits: int) -> str:
    """The state after the last sample, one row per coefficient."""
    each = [f"select l_suppkey, {i} as n, {f'h{i}' if i else '0.0'} as h, {'null' if i > order else f'k{i}' if i else '0.0'} as k from z" for i in range(order + 2)]
    return f"{_laguerre(order, beta, alpha, eps)}, z as (select f.* from f join (select l_suppkey, max(n) as n from li group by 1) using (l_suppkey, n)) select l_suppkey, n, {rounded('h', digits)} as h, {rounded('k', digits)} as k from ({' union all '.join(each)})"


def regressor(order: int) -> str:
    return f"with {LI}, u as (select l_suppkey, n, {_lags(('rx', 'ry'), order)} as u from li window w as (partition by l_suppkey order by n)) select l_suppkey, n, (generate_subscripts(u, 1) - 1)::int as i, unnest(u) as x from u where n >= {order - 1}"


def _levels(lo, hi, levels: int) -> str:
    """Tables x0 (the signal) to x``levels`` (approximations) and d1 to d``levels`` (details): (user_id, n, nn, v)."""
    f = len(lo)
    parts = ["x0 as materialized (select user_id, n, nn, v from ev)", values("lo_taps", "k, t", enumerate(lo)), values("hi_taps", "k, t", enumerate(hi))]
    for lev in range(1, levels + 1):
        src = f"x{lev - 1}"
        parts.append(f"o{lev} as (select user_id, max(nn) as m, unnest(range((max(nn) + {f - 1}) // 2))::int as i, (max(nn) + {f - 1}) // 2 as nn from {src} group by user_id)")
        for name, taps in (("x", "lo_taps"), ("d", "hi_taps")):
            at = f"(2 * o.i + 1 - k + {2 * f} * o.m)"  # mirrored at both ends, half a sample out
            parts.append(f"{name}{lev} as materialized (select o.user_id, o.i as n, o.nn, sum(t * s.v) as v from o{lev} o join {taps} on true join {src} s on s.user_id = o.user_id and s.n = case when {at} % (2 * o.m) < o.m then {at} % (2 * o.m) else 2 * o.m - 1 - {at} % (2 * o.m) end group by 1, 2, 3)")
    return ", ".join(parts)


def deep_analysis(lo, hi, levels: int) -> str:
    bands = [f"select user_id, {levels} as level, 'a' as band, n as i, {rounded('v')} as c from x{levels}"] + [f"select user_id, {lev}, 'd', n, {rounded('v')} from d{lev}" for lev in range(levels, 0, -1)]
    return f"with {EV}, {_levels(lo, hi, levels)} {' union all '.join(bands)}"


def deep_denoise(lo, hi, rl, rh, levels: int, mode: str) -> str:
    """Details of all levels by one threshold from the finest ones, hard or garrote, and back."""
    kept = {"hard": "case when abs(v) < t then 0.0 else v end", "garrote": "case when abs(v) < t then 0.0 else v - t * t / v end"}[mode]
    threshold = "th as (select user_id, median(abs(d1.v)) / 0.6745 * sqrt(2 * ln(max(ev.nn))) as t from d1 join (select distinct user_id, nn from ev) ev using (user_id) group by 1)"
    return _back(lo, hi, rl, rh, levels, [threshold], [f"select d.user_id, d.n, {kept} as v from d{lev} d join th using (user_id)" for lev in range(1, levels + 1)])


def deep_synthesis(lo, hi, rl, rh, factors) -> str:
    """The way back from details multiplied by a factor at each level."""
    return _back(lo, hi, rl, rh, len(factors), [], [f"select user_id, n, {float(x)!r} * v as v from d{lev}" for lev, x in enumerate(factors, 1)])


def _back(lo, hi, rl, rh, levels: int, more: list[str], details: list[str]) -> str:
    """Down ``levels`` levels and back; ``details`` are queries for the details of each level, from the finest."""
    f = len(lo)
    parts = [_levels(lo, hi, levels), values("rl_taps", "k, t", enumerate(rl)), values("rh_taps", "k, t", enumerate(rh)), *more]
    low = f"x{levels}"
    for lev in range(levels, 0, -1):
        parts.append(f"t{lev} as ({details[lev - 1]})")
        size = f"select user_id, max(nn) as nn from x{lev - 1} group by user_id"
        part = lambda src, taps: f"select o.user_id, o.n, k.t * s.v as v from o join {taps} k on true join {src} s on s.user_id = o.user_id and 2 * s.n = o.n + {f - 2} - k.k"
        parts.append(f"r{lev} as materialized (with o as (select user_id, unnest(range(nn))::int as n from ({size})) select user_id, n, sum(v) as v from ({part(low, 'rl_taps')} union all {part(f't{lev}', 'rh_taps')}) group by 1, 2)")
        low = f"r{lev}"
    return f"with {EV}, {', '.join(parts)} select user_id, n, {rounded('v')} as v from r1"


def cropped_istft(size: int, hop: int, n_freq: int, n_frames: int, length: int) -> str:
    """The spectrum of the first ``n_frames`` frames and ``n_freq`` waves, and back: half a frame of zeros at both ends, frames added and divided
    by the power of all windows, also those of frames left out."""
    w = f"(0.5 - 0.5 * cos(2 * pi() * k / {size}))"
    frames = -(-length // hop) + 1
    return f"""with x as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as n from embeddings),
k as (select unnest(range({size}))::int as k), t as (select unnest(range({n_frames}))::int as t), f as (select unnest(range({n_freq}))::int as f),
z as materialized (select x.vec_id, f, t, sum(v * {w} * cos(2 * pi() * f * k / {size})) as re, -sum(v * {w} * sin(2 * pi() * f * k / {size})) as im from x join k on true join t on x.n = t * {hop} + k - {size // 2} join f on true group by 1, 2, 3),
y as (select vec_id, t * {hop} + k - {size // 2} as n, sum({w} / {size} * case when f = 0 or 2 * f = {size} then 1 else 2 end * (re * cos(2 * pi() * f * k / {size}) - im * sin(2 * pi() * f * k / {size}))) as v from z join k on true group by 1, 2),
p as (select a.t * {hop} + k - {size // 2} as n, sum({w} * {w}) as p from (select unnest(range({frames}))::int as t) a join k on true group by 1)
select vec_id, n::int as n, {rounded('coalesce(y.v / case when p > 1e-10 then p else 1 end, 0.0)')} as v from x left join y using (vec_id, n) left join p using (n)"""


def thresholds(limit: float) -> str:
    """All modes on the distance of a value from 50."""
    c = "(value - 50)"
    kinds = {
        "soft": f"case when {c} = 0 then 0.0 else {c} * greatest(0.0, 1 - {limit} / abs({c})) end",
        "hard": f"case when abs({c}) < {limit} then 0.0 else {c} end",
        "garrote": f"case when abs({c}) < {limit} then 0.0 else {c} - {limit} * {limit} / {c} end",
        "greater": f"case when {c} < {limit} then 0.0 else {c} end",
        "less": f"case when {c} > {limit} then 0.0 else {c} end",
    }
    return "select event_id, " + ", ".join(f"{rounded(x)} as {k}" for k, x in kinds.items()) + " from events"
