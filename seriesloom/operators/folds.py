"""Sequential smoothers as scans, so that one long series is shared between tasks.

Every smoother here has an associative form: a run of rows acts on the state as one small element,
and two neighbouring runs combine into one. A series is cut into chunks (time buckets) and blocks
(at most ``BLOCK`` rows); elements of blocks are combined per chunk and per series to give the state
at the start of each block, and each block is then replayed row by row from that state. No array
holds more rows than a block.

EWMA, Holt and the running position are affine maps of their state. The Kalman filter uses the
five-part element of Sarkka and Garcia-Fernandez, "Temporal Parallelization of Bayesian Smoothers"
(2021), for a two-dimensional state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.ordering import CHUNK, SeriesOrder, previous
from seriesloom.operators.windows import elapsed_days

BLOCK = 256

# Expressions below are Spark SQL text: each is parsed once, and ``let`` names a value inside one.


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def pack(**fields: str | float) -> str:
    parts = [f"'{k}', {num(v)}" for k, v in fields.items()]
    return f"named_struct({', '.join(parts)})"


def num(value: str | float) -> str:
    return value if isinstance(value, str) else f"{float(value)!r}D"


@dataclass(frozen=True)
class Smoother:
    """SQL text builders; ``x`` names a row with ``x.first``, ``x.dt`` and the inputs ``x.in.*``.

    ``lift(x)`` gives the element of a row, ``combine(p, q)`` of two neighbouring runs, ``apply(e)``
    the state after the run ``e`` from the start of the series, ``step(s, x)`` the state after one
    more row. The first row of a series has ``x.first`` and must not look at the state.
    """

    lift: Callable[[str], str]
    combine: Callable[[str, str], str]
    apply: Callable[[str], str]
    step: Callable[[str, str], str]
    outputs: tuple[str, ...]


def _fold(smoother: Smoother, items: str, element: Callable[[str], str]) -> str:
    rest = f"slice({items}, 2, greatest(size({items}) - 1, 0))"
    merge = let("e", element("x"), smoother.combine("a", "e"))
    return f"aggregate({rest}, {element(items + '[0]')}, (a, x) -> {merge})"


def _prefixes(smoother: Smoother, items: str) -> str:
    """Exclusive prefix element of each entry of ``items`` (NULL for the first)."""
    rest = f"slice({items}, 2, greatest(size({items}) - 1, 0))"
    none = f"if(false, {items}[0].el, NULL)"
    start = f"named_struct('acc', {items}[0].el, 'out', array({none}))"
    merge = (
        f"named_struct('acc', {let('e', 'x.el', smoother.combine('a.acc', 'e'))}, "
        "'out', concat(a.out, array(a.acc)))"
    )
    return f"aggregate({rest}, {start}, (a, x) -> {merge}, a -> a.out)"


def scan(
    df: DataFrame, by: SeriesOrder, smoother: Smoother, inputs: Sequence[str], block: int = BLOCK
) -> DataFrame:
    """Append ``smoother.outputs`` to every row of ``df``."""
    time, keys = by.order[0], list(by.keys)
    payload = [c for c in df.columns if c not in keys]
    rows = previous(df, by, {"__t1": (time, 1)}, keep_chunk=True)
    blocks = (
        rows.select(
            *keys,
            CHUNK,
            F.row_number().over(by.window()).alias("n"),
            elapsed_days(time, "__t1").alias("dt"),
            F.col("__t1").isNull().alias("first"),
            F.struct(*[F.col(c).cast("double").alias(c) for c in inputs]).alias("in"),
            F.struct(*payload).alias("row"),
        )
        .withColumn("__block", F.floor((F.col("n") - 1) / block))
        .groupBy(*keys, CHUNK, "__block")
        .agg(F.sort_array(F.collect_list(F.struct("n", "dt", "first", "in", "row"))).alias("xs"))
    )
    elements = blocks.select(
        *keys, CHUNK, "__block", F.expr(_fold(smoother, "xs", smoother.lift)).alias("el")
    )
    chunks = (
        elements.groupBy(*keys, CHUNK)
        .agg(F.sort_array(F.collect_list(F.struct("__block", "el"))).alias("parts"))
        .withColumn("el", F.expr(_fold(smoother, "parts", lambda p: f"{p}.el")))
    )
    entry = (
        chunks.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(CHUNK, "el"))).alias("parts"))
        .selectExpr(*keys, f"parts.{CHUNK} AS c", f"{_prefixes(smoother, 'parts')} AS pre")
        .selectExpr(*keys, "zip_with(c, pre, (c, pre) -> named_struct('c', c, 'pre', pre)) AS z")
        .select(*keys, F.explode("z").alias("z"))
        .select(*keys, F.col("z.c").alias(CHUNK), F.col("z.pre").alias("before"))
    )
    starts = (
        chunks.selectExpr(
            *keys, CHUNK, "parts.__block AS b", f"{_prefixes(smoother, 'parts')} AS pre"
        )
        .selectExpr(
            *keys, CHUNK, "zip_with(b, pre, (b, pre) -> named_struct('b', b, 'pre', pre)) AS z"
        )
        .select(*keys, CHUNK, F.explode("z").alias("z"))
        .join(entry, [*keys, CHUNK])
        .selectExpr(
            *keys,
            CHUNK,
            "z.b AS __block",
            "CASE WHEN before IS NULL THEN z.pre WHEN z.pre IS NULL THEN before "
            f"ELSE {let('e', 'z.pre', smoother.combine('before', 'e'))} END AS prefix",
        )
    )
    kept = pack(**{o: f"s.{o}" for o in smoother.outputs})
    empty = "array<struct<" + ",".join(f"{o}:double" for o in smoother.outputs) + ">>"
    merge = let(
        "s",
        smoother.step("a.s", "x"),
        f"named_struct('s', s, 'out', concat(a.out, array({kept})))",
    )
    replay = (
        f"aggregate(xs, named_struct('s', if(prefix IS NULL, NULL, {smoother.apply('prefix')}), "
        f"'out', CAST(array() AS {empty})), (a, x) -> {merge}, a -> a.out)"
    )
    return (
        blocks.join(starts, [*keys, CHUNK, "__block"])
        .selectExpr(*keys, "xs.row AS row", f"{replay} AS out")
        .selectExpr(*keys, "zip_with(row, out, (r, o) -> named_struct('row', r, 'out', o)) AS z")
        .select(*keys, F.explode("z").alias("z"))
        .select(
            *[F.col(c) if c in keys else F.col(f"z.row.{c}").alias(c) for c in df.columns],
            *[F.col(f"z.out.{o}").alias(o) for o in smoother.outputs],
        )
    )


# --- affine smoothers -------------------------------------------------------------------------


def ewma(value: str, alpha: float = 0.5, output: str = "ewma") -> Smoother:
    """Exponentially weighted mean, not scaled by elapsed time."""
    keep, take = num(1.0 - alpha), num(alpha)

    def lift(x):
        v = f"{x}.in.{value}"
        return f"if({x}.first, {pack(a=0, b=v)}, {pack(a=keep, b=f'{take} * {v}')})"

    def step(s, x):
        v = f"{x}.in.{value}"
        return pack(**{output: f"if({x}.first, {v}, {take} * {v} + {keep} * {s}.{output})"})

    return Smoother(
        lift=lift,
        combine=lambda p, q: pack(a=f"{q}.a * {p}.a", b=f"{q}.a * {p}.b + {q}.b"),
        apply=lambda e: pack(**{output: f"{e}.b"}),
        step=step,
        outputs=(output,),
    )


def running_position(value: str, gain: float = 0.5, output: str = "position") -> Smoother:
    """Fixed-gain position ``(1 - gain) m + gain x``, started at the first value."""
    return ewma(value, gain, output)


def holt(value: str, alpha: float = 0.5, beta: float = 0.2) -> Smoother:
    """Level and trend, the trend per elapsed day; starts at (first value, 0)."""
    al, be, ka, kb = num(alpha), num(beta), num(1 - alpha), num(1 - beta)

    def lift(x):
        v, dt = f"{x}.in.{value}", f"{x}.dt"
        start = pack(m00=0, m01=0, m10=0, m11=0, b0=v, b1=0)
        row = pack(
            m00=1 - alpha,
            m01=f"{ka} * {dt}",
            m10=f"{num(-alpha * beta)} / {dt}",
            m11=1 - alpha * beta,
            b0=f"{al} * {v}",
            b1=f"{num(alpha * beta)} * {v} / {dt}",
        )
        return f"if({x}.first, {start}, {row})"

    def combine(p, q):
        cell = lambda i, j: f"{q}.m{i}0 * {p}.m0{j} + {q}.m{i}1 * {p}.m1{j}"
        side = lambda i: f"{q}.m{i}0 * {p}.b0 + {q}.m{i}1 * {p}.b1 + {q}.b{i}"
        return pack(
            m00=cell(0, 0), m01=cell(0, 1), m10=cell(1, 0), m11=cell(1, 1), b0=side(0), b1=side(1)
        )

    def step(s, x):
        v, dt = f"{x}.in.{value}", f"{x}.dt"
        moved = let(
            "u",
            f"{al} * {v} + {ka} * ({s}.level + {s}.trend * {dt})",
            pack(level="u", trend=f"{be} * ((u - {s}.level) / {dt}) + {kb} * {s}.trend"),
        )
        return f"if({x}.first, {pack(level=v, trend=0)}, {moved})"

    return Smoother(
        lift, combine, lambda e: pack(level=f"{e}.b0", trend=f"{e}.b1"), step, ("level", "trend")
    )


# --- local linear Kalman filter ---------------------------------------------------------------


def kalman(
    value: str,
    variance: str,
    level_sd: float,
    trend_sd: float,
    initial_trend: float = 0.0,
    initial_trend_sd: float = 8.0,
    start_variance: str | None = None,
) -> Smoother:
    """Level and trend; process variances grow with elapsed days.

    ``variance`` names the column with each row's measurement variance. The first measurement
    initialises the level with that variance. Where ``start_variance`` names another column, the
    first measurement initialises with that one and is then applied once more as an update.
    """
    q0, q1 = num(level_sd**2), num(trend_sd**2)

    def first_variance(x):
        r = f"{x}.in.{variance}"
        if start_variance is None:
            return r
        p = f"{x}.in.{start_variance}"
        return f"({p} - {p} / ({p} + {r}) * {p})"

    def lift(x):
        v, r, dt = f"{x}.in.{value}", f"{x}.in.{variance}", f"{x}.dt"
        start = pack(
            a00=0, a01=0, a10=0, a11=0, b0=v, b1=initial_trend,
            c00=first_variance(x), c01=0, c11=initial_trend_sd**2,
            n0=0, n1=0, j00=0, j01=0, j11=0,
        )
        row = pack(
            a00="1 - k.g", a01=f"(1 - k.g) * {dt}", a10=0, a11=1, b0=f"k.g * {v}", b1=0,
            c00=f"(1 - k.g) * {q0} * {dt}", c01=0, c11=f"{q1} * {dt}",
            n0=f"{v} / k.s", n1=f"{dt} * {v} / k.s",
            j00="1 / k.s", j01=f"{dt} / k.s", j11=f"{dt} * {dt} / k.s",
        )
        gain = pack(s="s", g=f"{q0} * {dt} / s")
        return (
            f"if({x}.first, {start}, "
            + let("s", f"{q0} * {dt} + {r}", let("k", gain, row))
            + ")"
        )

    def combine(p, q):
        # t = I + C_p J_q and m = its inverse; g = A_q m, h = A_p' m'; d = g C_p, u = h J_q.
        t = pack(
            t00=f"1 + {p}.c00 * {q}.j00 + {p}.c01 * {q}.j01",
            t01=f"{p}.c00 * {q}.j01 + {p}.c01 * {q}.j11",
            t10=f"{p}.c01 * {q}.j00 + {p}.c11 * {q}.j01",
            t11=f"1 + {p}.c01 * {q}.j01 + {p}.c11 * {q}.j11",
        )
        m = pack(m00="t.t11 / z", m01="-t.t01 / z", m10="-t.t10 / z", m11="t.t00 / z")
        w = pack(
            g00=f"{q}.a00 * m.m00 + {q}.a01 * m.m10",
            g01=f"{q}.a00 * m.m01 + {q}.a01 * m.m11",
            g10=f"{q}.a10 * m.m00 + {q}.a11 * m.m10",
            g11=f"{q}.a10 * m.m01 + {q}.a11 * m.m11",
            h00=f"{p}.a00 * m.m00 + {p}.a10 * m.m01",
            h01=f"{p}.a00 * m.m10 + {p}.a10 * m.m11",
            h10=f"{p}.a01 * m.m00 + {p}.a11 * m.m01",
            h11=f"{p}.a01 * m.m10 + {p}.a11 * m.m11",
            x0=f"{p}.b0 + {p}.c00 * {q}.n0 + {p}.c01 * {q}.n1",
            x1=f"{p}.b1 + {p}.c01 * {q}.n0 + {p}.c11 * {q}.n1",
            y0=f"{q}.n0 - {q}.j00 * {p}.b0 - {q}.j01 * {p}.b1",
            y1=f"{q}.n1 - {q}.j01 * {p}.b0 - {q}.j11 * {p}.b1",
        )
        du = pack(
            d00=f"w.g00 * {p}.c00 + w.g01 * {p}.c01",
            d01=f"w.g00 * {p}.c01 + w.g01 * {p}.c11",
            d10=f"w.g10 * {p}.c00 + w.g11 * {p}.c01",
            d11=f"w.g10 * {p}.c01 + w.g11 * {p}.c11",
            u00=f"w.h00 * {q}.j00 + w.h01 * {q}.j01",
            u01=f"w.h00 * {q}.j01 + w.h01 * {q}.j11",
            u10=f"w.h10 * {q}.j00 + w.h11 * {q}.j01",
            u11=f"w.h10 * {q}.j01 + w.h11 * {q}.j11",
        )
        done = pack(
            a00=f"w.g00 * {p}.a00 + w.g01 * {p}.a10",
            a01=f"w.g00 * {p}.a01 + w.g01 * {p}.a11",
            a10=f"w.g10 * {p}.a00 + w.g11 * {p}.a10",
            a11=f"w.g10 * {p}.a01 + w.g11 * {p}.a11",
            b0=f"w.g00 * w.x0 + w.g01 * w.x1 + {q}.b0",
            b1=f"w.g10 * w.x0 + w.g11 * w.x1 + {q}.b1",
            c00=f"d.d00 * {q}.a00 + d.d01 * {q}.a01 + {q}.c00",
            c01=f"d.d00 * {q}.a10 + d.d01 * {q}.a11 + {q}.c01",
            c11=f"d.d10 * {q}.a10 + d.d11 * {q}.a11 + {q}.c11",
            n0=f"w.h00 * w.y0 + w.h01 * w.y1 + {p}.n0",
            n1=f"w.h10 * w.y0 + w.h11 * w.y1 + {p}.n1",
            j00=f"d.u00 * {p}.a00 + d.u01 * {p}.a10 + {p}.j00",
            j01=f"d.u00 * {p}.a01 + d.u01 * {p}.a11 + {p}.j01",
            j11=f"d.u10 * {p}.a01 + d.u11 * {p}.a11 + {p}.j11",
        )
        body = let("m", m, let("w", w, let("d", du, done)))
        return let("t", t, let("z", "t.t00 * t.t11 - t.t01 * t.t10", body))

    def step(s, x):
        v, r, dt = f"{x}.in.{value}", f"{x}.in.{variance}", f"{x}.dt"
        start = pack(
            level=v, trend=initial_trend,
            p00=first_variance(x), p01=0, p11=initial_trend_sd**2,
        )
        ahead = pack(
            level=f"{s}.level + {dt} * {s}.trend",
            p00=f"{s}.p00 + 2 * {dt} * {s}.p01 + {dt} * {dt} * {s}.p11 + {q0} * {dt}",
            p01=f"{s}.p01 + {dt} * {s}.p11",
            p11=f"{s}.p11 + {q1} * {dt}",
        )
        gain = pack(
            g0=f"h.p00 / (h.p00 + {r})", g1=f"h.p01 / (h.p00 + {r})", gap=f"{v} - h.level"
        )
        update = pack(
            level="h.level + k.g0 * k.gap",
            trend=f"{s}.trend + k.g1 * k.gap",
            p00="h.p00 - k.g0 * h.p00",
            p01="h.p01 - k.g0 * h.p01",
            p11="h.p11 - k.g1 * h.p01",
        )
        return f"if({x}.first, {start}, {let('h', ahead, let('k', gain, update))})"

    return Smoother(
        lift,
        combine,
        lambda e: pack(
            level=f"{e}.b0", trend=f"{e}.b1", p00=f"{e}.c00", p01=f"{e}.c01", p11=f"{e}.c11"
        ),
        step,
        ("level", "trend", "p00", "p01", "p11"),
    )
