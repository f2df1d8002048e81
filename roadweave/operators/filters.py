"""Zero-phase Butterworth filters over telemetry, in Arrow batches of bounded chunks of a clip."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadweave.functions.storage import spread, stored
from roadweave.operators.scans import BLOCK as BLOCK_ROWS
from roadweave.operators.scans import haloed, numbered
from roadweave.operators.timeseries import CLIP, TIME, window_scores


def sections(fs: float, low: float | None, high: float | None, order: int) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a Butterworth filter: band if both cutoffs, high-pass if ``low``, low-pass if ``high``.

    Cutoffs are held below 0.98 of half the sample rate. Prototype poles on the left half circle, the
    frequencies pre-warped, shifted to the band, mapped by the bilinear transform; conjugate poles make a section.
    """
    top = 0.98 * fs / 2
    warp = lambda f: 2 * fs * math.tan(math.pi * min(f, top) / fs)
    poles = [np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    if low is not None and high is not None:
        w1, w2 = warp(low), warp(high)
        width, mid = w2 - w1, math.sqrt(w1 * w2)
        moved = []
        for p in poles:
            half = p * width / 2
            root = np.sqrt(half * half - mid * mid + 0j)
            moved += [half + root, half - root]
        zeros = [0.0] * order
    elif high is not None:
        moved, zeros, mid = [p * warp(high) for p in poles], [], 0.0
    else:
        moved, zeros, mid = [warp(low) / p for p in poles], [0.0] * order, math.inf
    z_poles = [(2 * fs + p) / (2 * fs - p) for p in moved]
    z_zeros = [1.0 if z == 0.0 else -1.0 for z in zeros] + [-1.0] * (len(moved) - len(zeros))
    upper = sorted([p for p in z_poles if p.imag > 1e-12], key=abs)
    real = sorted([p.real for p in z_poles if abs(p.imag) <= 1e-12])
    pairs = [(p, p.conjugate()) for p in upper] + [(real[i], real[i + 1] if i + 1 < len(real) else 0.0) for i in range(0, len(real), 2)]
    ones, minus = z_zeros.count(1.0), z_zeros.count(-1.0)
    out = []
    for i, (p, q) in enumerate(pairs):
        single = i == len(pairs) - 1 and len(real) % 2 == 1
        if ones and minus and not single:
            zs, ones, minus = (1.0, -1.0), ones - 1, minus - 1
        elif single:
            zs, ones, minus = ((1.0,), ones - 1, minus) if ones else ((-1.0,), ones, minus - 1)
        elif ones >= 2:
            zs, ones = (1.0, 1.0), ones - 2
        else:
            zs, minus = (-1.0, -1.0), minus - 2
        b = np.poly(zs) if len(zs) == 2 else np.append(np.poly(zs), 0.0)
        out.append([*np.real(b), 1.0, -(p + q).real, (p * q).real])
    sos = np.array(out)
    # Unit gain at the band's middle, at zero, or at half the sample rate.
    at = 2 * math.atan(mid / (2 * fs)) if mid not in (0.0, math.inf) else (0.0 if mid == 0.0 else math.pi)
    z = np.exp(-1j * at * np.arange(3))
    gain = np.prod([abs((s[:3] @ z) / (s[3:] @ z)) for s in sos])
    sos[0, :3] /= gain
    return sos


def _steady(sos: np.ndarray) -> np.ndarray:
    """Section states that a constant input of 1 settles at."""
    out, level = np.zeros((len(sos), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        out[i, 1] = level * (b2 - a2 * gain)
        out[i, 0] = level * (b1 - a1 * gain) + out[i, 1]
        level *= gain
    return out


def _steps(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sections one after another over rows of ``x`` (samples x signals), and the states (section, 2, signal) after them."""
    state, out = state.copy(), np.empty_like(x)
    for t in range(len(x)):
        v = x[t]
        for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            y = b0 * v + state[i, 0]
            state[i, 0] = b1 * v - a1 * y + state[i, 1]
            state[i, 1] = b2 * v - a2 * y
            v = y
        out[t] = v
    return out, state


#: Samples of a block: what a block gives is a matrix times its samples plus one times the states before it.
BLOCK = 128


def _run(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter over rows of ``x``, from the first row's steady state, a block of samples at a time."""
    k, n = x.shape[1], 2 * len(sos)
    state = _steady(sos)[:, :, None] * x[0]
    whole = len(x) // BLOCK * BLOCK
    if whole < 4 * BLOCK:
        return _steps(sos, x, state)[0]
    from_x, state_x = _steps(sos, np.eye(BLOCK), np.zeros((len(sos), 2, BLOCK)))
    from_s, state_s = _steps(sos, np.zeros((BLOCK, n)), np.eye(n).reshape(len(sos), 2, n))
    state_x, state_s, flat = state_x.reshape(n, BLOCK), state_s.reshape(n, n), state.reshape(n, k)
    out = np.empty_like(x)
    for at in range(0, whole, BLOCK):
        part = x[at : at + BLOCK]
        out[at : at + BLOCK] = from_x @ part + from_s @ flat
        flat = state_x @ part + state_s @ flat
    out[whole:] = _steps(sos, x[whole:], flat.reshape(len(sos), 2, k))[0]
    return out


def zero_phase(x: np.ndarray, sos: np.ndarray, ends: tuple[bool, bool] = (True, True)) -> np.ndarray:
    """Filtered forward and backward; true ends get an odd extension. Signals that are too short come back unchanged."""
    pad = 3 * (2 * len(sos) + 1)
    if len(x) <= pad:
        return x
    front = 2 * x[0] - x[pad:0:-1] if ends[0] else x[:0]
    back = 2 * x[-1] - x[-2 : -pad - 2 : -1] if ends[1] else x[:0]
    y = _run(sos, np.concatenate([front, x, back]))
    y = _run(sos, y[::-1])[::-1]
    return y[len(front) : len(front) + len(x)]


def halo_of(sos: np.ndarray, tolerance: float = 1e-9) -> int:
    """Samples after which a filter has forgotten where it began."""
    radius = max(abs(r) for s in sos for r in np.roots(s[3:]))
    return int(math.ceil(math.log(tolerance) / math.log(min(max(radius, 1e-6), 1 - 1e-9))))


def _chunked(df: DataFrame, halo: int, clip: str, time: str) -> DataFrame:
    """Chunks of at least ten halos of a clip's samples by number, with a halo of the neighbours' samples; one long clip is many tasks."""
    return haloed(numbered(df, [clip], [time]), max(10 * halo, BLOCK_ROWS), halo, halo)


def _samples(chunk: pa.Table, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, tuple[bool, bool]]:
    """The order of a chunk's samples, their values in it (null is 0), and whether the chunk begins and ends the clip."""
    number = chunk.column("_i").to_numpy()
    order = np.argsort(number, kind="stable")
    x = np.stack([chunk.column(c).combine_chunks().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)[order] for c in columns], 1)
    return order, x, (number[order[0]] == 0, number[order[-1]] == chunk.column("_n")[0].as_py() - 1)


def _clean(y: np.ndarray) -> np.ndarray:
    if not np.isfinite(y).all():
        raise ValueError("the filter gave values that are not finite")
    return y


#: A filter: low and high cutoff (None where there is none) and order; without cutoffs values stay.
Setting = tuple[float | None, float | None, int]


def _bank(fs: float, settings: Sequence[Setting]) -> list[np.ndarray | None]:
    return [None if low is None and high is None else sections(fs, low, high, order) for low, high, order in settings]


def filtered_bank(df: DataFrame, columns: Sequence[str], fs: float, settings: Sequence[Setting], suffixes: Sequence[str], clip: str = CLIP, time: str = TIME) -> DataFrame:
    """``df`` plus each column filtered by each setting (column and suffix), all in one pass. Null samples count as 0.

    Only true clip ends are extended.
    """
    bank = _bank(fs, settings)
    names, made = df.columns, [f"{c}{s}" for s in suffixes for c in columns]
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in made]])

    def run(chunk: pa.Table) -> pa.Table:
        order, x, ends = _samples(chunk, columns)
        out = chunk.select(names)
        for sos, suffix in zip(bank, suffixes, strict=True):
            y = x if sos is None else _clean(zero_phase(x, sos, ends))
            for j, c in enumerate(columns):
                placed = np.empty(len(y))
                placed[order] = y[:, j]
                out = out.append_column(f"{c}{suffix}", pa.array(placed) if sos is not None else chunk.column(c).cast(pa.float64()))
        return out.filter(chunk.column("_own"))

    halo = max((halo_of(sos) for sos in bank if sos is not None), default=0)
    return _chunked(df, halo, clip, time).groupBy(clip, "_block").applyInArrow(run, schema)


def filtered(df: DataFrame, columns: Sequence[str], fs: float, low: float | None = None, high: float | None = None, order: int = 4, suffix: str = "_bpf", clip: str = CLIP, time: str = TIME) -> DataFrame:
    """``df`` plus filtered columns; without cutoffs they are copies."""
    if low is None and high is None:
        return df.withColumns({f"{c}{suffix}": F.col(c) for c in columns})
    return filtered_bank(df, columns, fs, [(low, high, order)], [suffix], clip, time)


def _above(chunk: pa.Table, columns: Sequence[str], bank: Sequence[np.ndarray | None], widths: Sequence[int], least: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each setting (its number) and width: the chunk's own samples (their places, in time order) with a score above ``least``, and their |scores|."""
    order, x, ends = _samples(chunk, columns)
    own = chunk.column("_own").to_numpy()[order]
    for number, sos in enumerate(bank):
        y = x if sos is None else _clean(zero_phase(x, sos, ends))
        per_column = [window_scores(y[:, j], np.ones(len(y), bool), widths) for j in range(len(columns))]
        for k, width in enumerate(widths):
            scores = np.abs(np.nan_to_num(np.stack([c[k] for c in per_column], 1)))
            high = np.flatnonzero(own & (scores.max(1) > least))
            yield number, width, order[high], scores[high]


def _halo(bank: Sequence[np.ndarray | None], widths: Sequence[int]) -> int:
    return max((halo_of(sos) for sos in bank if sos is not None), default=0) + max(widths)


def bank_scores(df: DataFrame, columns: Sequence[str], fs: float, settings: Sequence[Setting], widths: Sequence[int], least: float, clip: str = CLIP, time: str = TIME) -> DataFrame:
    """clip, time, setting (its number), width, _z0, _z1, ...: |rolling z| of the filtered columns, where one of them is above ``least``.

    Filters, windows and the threshold are one pass over chunks whose halos hold both a filter's memory
    and half a window; only what passes the threshold leaves a task.
    """
    bank = _bank(fs, settings)
    kept = df.select(clip, time, *columns)
    z = [f"_z{j}" for j in range(len(columns))]
    schema = T.StructType([*kept.select(clip, time).schema.fields, T.StructField("setting", T.IntegerType()), T.StructField("width", T.IntegerType()), *[T.StructField(name, T.DoubleType()) for name in z]])
    arrow = to_arrow_schema(schema)

    def run(chunk: pa.Table) -> pa.Table:
        keys, parts = chunk.select([clip, time]), []
        for number, width, at, scores in _above(chunk, columns, bank, widths, least):
            taken = keys.take(pa.array(at))
            fixed = [pa.array(np.full(len(at), v, np.int32)) for v in (number, width)]
            parts.append(pa.table([*taken.columns, *fixed, *[pa.array(scores[:, j]) for j in range(len(columns))]], names=arrow.names).cast(arrow))
        return pa.concat_tables(parts)

    return _chunked(kept, _halo(bank, widths), clip, time).groupBy(clip, "_block").applyInArrow(run, schema)


def bank_runs(df: DataFrame, columns: Sequence[str], fs: float, settings: Sequence[Setting], widths: Sequence[int], ks: Sequence[float], channels: Sequence[int], gap: float, clip: str = CLIP, time: str = TIME) -> DataFrame:
    """setting (its number), width, k, channels, clip, start_time, end_time: runs of samples of which ``channels`` scores are above k.

    The scores of ``bank_scores``, cut into runs in the chunk that holds them: flagged samples are never rows. A run ends
    where the next flagged sample is more than ``gap`` later. Only a chunk's first and last run can go on in
    another chunk; these, two a chunk and configuration at most, are merged by time.
    """
    bank, least = _bank(fs, settings), min(ks)
    kept = df.select(clip, time, *columns)
    config = ["setting", "width", "k", "channels"]
    schema = T.StructType([*[T.StructField(name, T.DoubleType() if name == "k" else T.IntegerType()) for name in config], kept.schema[clip], T.StructField("_edge", T.BooleanType()), T.StructField("start_time", T.DoubleType()), T.StructField("end_time", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    choices = [(float(k), int(c)) for k in ks for c in channels]

    def run(chunk: pa.Table) -> pa.Table:
        times = chunk.column(time).combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is NaN
        found, sizes, starts, ends, edges = [], [], [], [], []
        for number, width, at, scores in _above(chunk, columns, bank, widths, least):
            t, votes = times[at], {k: (scores > k).sum(1) for k, _ in choices}
            for k, c in choices:
                some = t[votes[k] >= c]
                if len(some):
                    new = np.flatnonzero(~(np.diff(some) <= gap)) + 1
                    edge = np.zeros(len(new) + 1, bool)
                    edge[[0, -1]] = True
                    found.append((number, width, k, c))
                    sizes.append(len(edge))
                    starts.append(some[np.append(0, new)])
                    ends.append(some[np.append(new, len(some)) - 1])
                    edges.append(edge)
        if not found:
            return arrow.empty_table()
        fixed = [np.repeat(np.array(v), sizes) for v in zip(*found, strict=True)]
        same = chunk.column(clip).take(pa.array(np.zeros(sum(sizes), np.int64)))
        return pa.table([*map(pa.array, fixed), same, pa.array(np.concatenate(edges)), *[pa.array(np.concatenate(v), from_pandas=True) for v in (starts, ends)]], names=arrow.names).cast(arrow)

    chunks = spread(_chunked(kept, _halo(bank, widths), clip, time), clip, "_block")  # they cost much a row
    runs = stored(chunks.groupBy(clip, "_block").applyInArrow(run, schema), "bank-runs")  # read twice
    keys = [*config, clip]
    w = Window.partitionBy(*keys).orderBy("start_time", "end_time")
    new = F.coalesce((F.col("start_time") - F.lag("end_time").over(w) > gap).cast("int"), F.lit(1))
    edge = runs.where("_edge").withColumn("_new", new).withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = edge.groupBy(*keys, "_no").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).drop("_no")
    return runs.where("not _edge").drop("_edge").unionByName(merged)
