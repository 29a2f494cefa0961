"""Residual matching: templates are fitted to a core's signal and subtracted, and what is left is searched again.

Signal and templates are whitened by the channels' noise once, so every product
below is a plain sum. Templates are (unit, time, slot) with their peak in the
middle; contact -1 is an empty slot and reads a silent extra channel.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE_FLOOR = 0.01
MOST_UNITS, MOST_PER_CHANNEL = 4096, 512
CHUNK = 2048  # fits scored at once


@dataclass(frozen=True)
class Rules:
    score: float = 0.65
    margin: float = 0.03
    amplitude: tuple[float, float] = (0.3, 3.0)
    snr: float = 4.5
    passes: int = 3
    late_score: float = 0.85  # from the fourth pass on
    centre: int = 8
    shifts: int = 2
    refractory: int = 2
    apart: int = 5  # a peak is the largest within so many samples
    coupling: float = 0.01
    colours: int = 32
    refit_rounds: int = 0
    refit_fits: int = 64
    refit_refractory: int = 16


@dataclass(frozen=True)
class Fit:
    t: int
    channel: int
    unit: int
    score: float
    runner_up: float
    amplitude: float
    gain: float
    margin: float
    step: int


@dataclass(frozen=True)
class Bank:
    waves: np.ndarray
    contacts: np.ndarray
    identity: np.ndarray

    @cached_property
    def by_channel(self) -> dict[int, np.ndarray]:
        found = {int(c): np.flatnonzero((self.contacts == c).any(axis=1)) for c in np.unique(self.contacts) if c >= 0}
        if any(len(units) > MOST_PER_CHANNEL for units in found.values()):
            raise ValueError(f"a channel has more than {MOST_PER_CHANNEL} templates")
        return found

    @classmethod
    def collected(cls, templates: DataFrame) -> Bank:
        """From rows (unit, contacts, w, identity), w time-major; units number from 0. At most 4,096 rows reach the driver, more are an error."""
        rows = templates.select("unit", "contacts", "w", "identity").orderBy("unit").limit(MOST_UNITS + 1).collect()
        if len(rows) > MOST_UNITS:
            raise ValueError(f"a bank holds at most {MOST_UNITS} templates")
        if [r.unit for r in rows] != list(range(len(rows))):
            raise ValueError("units number from 0 without gaps")
        contacts = np.array([r.contacts for r in rows], int)
        waves = np.array([r.w for r in rows], float).reshape(len(rows), -1, contacts.shape[1])
        if not np.isfinite(waves).all():
            raise ValueError("templates are finite")
        return cls(waves, contacts, np.array([r.identity for r in rows], int))


def _leads(*keys: np.ndarray) -> np.ndarray:
    """Rows that differ from the row before in any of the sorted keys."""
    first = np.ones(len(keys[0]), bool)
    first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return first


class Residual:
    """What is left of a core's whitened signal (time, channel)."""

    def __init__(self, signal: np.ndarray, noise: np.ndarray, bank: Bank) -> None:
        sigma = np.append(np.maximum(noise, NOISE_FLOOR), np.inf)
        self.bank = bank
        self.x = np.hstack([signal, np.zeros((len(signal), 1))]) / sigma
        self.waves = bank.waves / sigma[bank.contacts][:, None, :]
        self.energy = (self.waves**2).sum(axis=(1, 2))
        self.times = self.waves.shape[1]
        self.before = self.times // 2

    def holds(self, t):
        return (t >= self.before) & (t - self.before + self.times <= len(self.x))

    def add(self, fit: Fit, sign: float) -> None:
        begin = fit.t - self.before
        self.x[begin : begin + self.times, self.bank.contacts[fit.unit]] += sign * fit.amplitude * self.waves[fit.unit]

    def peaks(self, snr: float, apart: int) -> list[tuple[int, int, float]]:
        """(t, channel, snr) of every channel's local maxima; the first of equals."""
        size = np.abs(self.x[:, :-1])
        if not len(size):
            return []
        padded = np.pad(size, ((apart, apart), (0, 0)), constant_values=-1.0)
        around = np.lib.stride_tricks.sliding_window_view(padded, 2 * apart + 1, axis=0)
        t, c = np.nonzero((size >= snr) & (around.argmax(axis=2) == apart))
        return [(int(a), int(b), float(size[a, b])) for a, b in zip(t, c, strict=True)]

    def score(self, units: np.ndarray, times: np.ndarray, centre: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cosine over the centre, amplitude and explained energy over the whole template, of templates at times inside the core."""
        near = slice(max(self.before - centre, 0), self.before + centre + 1)
        parts = []
        for a in range(0, len(units), CHUNK):
            u, t = units[a : a + CHUNK], times[a : a + CHUNK]
            seen = self.x[(t[:, None] - self.before + np.arange(self.times))[:, :, None], self.bank.contacts[u][:, None, :]]
            model = self.waves[u]
            product, at = model * seen, np.maximum(self.energy[u], 1e-9)
            whole = product.sum(axis=(1, 2))
            own, observed = (model[:, near] ** 2).sum(axis=(1, 2)), (seen[:, near] ** 2).sum(axis=(1, 2))
            amplitude = whole / at
            usable = (own > 1e-9) & (observed > 1e-9) & (amplitude > 0)
            cosine = product[:, near].sum(axis=(1, 2)) / np.sqrt(np.where(usable, own * observed, 1.0))
            parts.append((np.where(usable, cosine, -1.0), amplitude, np.where(usable, whole * amplitude, 0.0)))
        return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0),) * 3

    def propose(self, events: list[tuple[int, int, float]], rules: Rules, step: int) -> list[Fit]:
        """Each event's best fit, where it is good and far enough ahead of the best of another identity."""
        none = np.zeros(0, int)
        units = [self.bank.by_channel.get(c, none) for _, c, _ in events]
        shifts = np.arange(-rules.shifts, rules.shifts + 1)
        event = np.repeat(np.arange(len(events)), [len(u) * len(shifts) for u in units])
        unit = np.repeat(np.concatenate([none, *units]), len(shifts))
        shift = np.tile(shifts, len(event) // len(shifts))
        t = np.array([e[0] for e in events], int)[event] + shift
        inside = self.holds(t)
        event, unit, shift, t = event[inside], unit[inside], shift[inside], t[inside]
        score, amplitude, gain = self.score(unit, t, rules.centre)
        floor = rules.score if step < 3 else max(rules.score, rules.late_score)
        table = np.rec.fromarrays([event, unit, self.bank.identity[unit], shift, t, score, amplitude, gain], names="event,unit,identity,shift,t,score,amplitude,gain")
        table = table[(score >= floor) & (amplitude >= rules.amplitude[0]) & (amplitude <= rules.amplitude[1])]
        table = table[np.lexsort((table.shift, abs(table.shift), -table.gain, table.unit, table.event))]
        table = table[_leads(table.event, table.unit)]
        table = table[np.lexsort((-table.unit, -table.score, -table.gain, table.identity, table.event))]
        table = table[_leads(table.event, table.identity)]
        table = table[np.lexsort((-table.unit, -table.score, -table.gain, table.event))]
        found = []
        for i in np.flatnonzero(_leads(table.event)):
            best = table[i]
            other = table[i + 1] if i + 1 < len(table) and table[i + 1].event == best.event else None
            if best.gain <= 0:
                continue
            margin = 1.0 if other is None else 1 - other.gain / best.gain
            if best.gain >= rules.snr**2 and margin >= rules.margin:
                found.append(Fit(int(best.t), events[best.event][1], int(best.unit), float(best.score), -1.0 if other is None else float(other.score), float(best.amplitude), float(best.gain), float(margin), step))
        return found


class Couplings:
    """Which fits of one pass may be subtracted together: overlaps may change neither side's amplitude by more than the budget."""

    def __init__(self, residual: Residual, rules: Rules) -> None:
        self.r, self.rules = residual, rules
        self.order: list[tuple[int, int]] = []
        self.fits: list[Fit] = []
        self.charge: list[float] = []
        self.colour: list[int] = []

    def overlap(self, a: int, b: int, later: int) -> float | None:
        """The product of template a with b ``later`` samples after it; None without a common contact."""
        ca, cb = self.r.bank.contacts[a], self.r.bank.contacts[b]
        common, ia, ib = np.intersect1d(ca[ca >= 0], cb[cb >= 0], return_indices=True)
        if not len(common):
            return None
        wa, wb = self.r.waves[a][:, np.flatnonzero(ca >= 0)[ia]], self.r.waves[b][:, np.flatnonzero(cb >= 0)[ib]]
        first, second = (wa[later:], wb[: len(wb) - later]) if later >= 0 else (wa[:later], wb[-later:])
        return abs(float((first * second).sum()))

    def admit(self, fit: Fit) -> bool:
        reach = self.r.times - 1
        own, charges, taken = 0.0, {}, set()
        for _, i in self.order[bisect_left(self.order, (fit.t - reach, -1)) : bisect_left(self.order, (fit.t + reach + 1, -1))]:
            prior = self.fits[i]
            shared = self.overlap(fit.unit, prior.unit, prior.t - fit.t)
            if shared is None:
                continue
            own += shared * prior.amplitude / max(fit.amplitude * self.r.energy[fit.unit], 1e-12)
            charges[i] = shared * fit.amplitude / max(prior.amplitude * self.r.energy[prior.unit], 1e-12)
            taken.add(self.colour[i])
        sure = not charges or (fit.score >= 0.8 and fit.margin >= 0.1)
        if not sure or own > self.rules.coupling or any(self.charge[i] + c > self.rules.coupling for i, c in charges.items()) or len(taken) >= self.rules.colours:
            return False
        for i, c in charges.items():
            self.charge[i] += c
        insort(self.order, (fit.t, len(self.fits)))
        self.fits.append(fit)
        self.charge.append(own)
        self.colour.append(next(k for k in range(self.rules.colours) if k not in taken))
        return True


def refit(residual: Residual, fits: list[Fit], rules: Rules) -> list[Fit]:
    """Uncertain fits again, the least certain first: each is put back into the residual and the best template takes its place, if that explains 5 % more."""
    fits = list(fits)
    for _ in range(rules.refit_rounds):
        doubtful = sorted((i for i, f in enumerate(fits) if f.margin < 0.2 or f.score < 0.85), key=lambda i: (fits[i].margin, fits[i].t, i))
        changed = False
        for i in doubtful[: rules.refit_fits]:
            old = fits[i]
            residual.add(old, 1.0)
            _, amplitude, gain = residual.score(np.array([old.unit]), np.array([old.t]), rules.centre)
            share = old.amplitude / amplitude[0] if amplitude[0] > 0 else 0.0
            least = max(rules.snr**2, 1.05 * gain[0] * (2 * share - share**2))
            strict = replace(rules, score=max(rules.score, 0.85), margin=max(rules.margin, 0.1))
            found = [f for f in residual.propose([(old.t, old.channel, 0.0)], strict, old.step) if f.gain >= least]
            if found and any(j != i and f.unit == found[0].unit and abs(f.t - found[0].t) <= rules.refit_refractory for j, f in enumerate(fits)):
                found = []
            if found:
                fits[i], changed = found[0], True
            residual.add(fits[i], -1.0)
        if not changed:
            break
    return fits


def match(signal: np.ndarray, noise: np.ndarray, bank: Bank, rules: Rules = Rules(), together: bool = True) -> tuple[list[Fit], Residual]:
    """All fits of a core, halo included, and what is left.

    A pass scores its peaks against one residual and subtracts at once those that
    do not disturb each other; the rest waits for the next pass. Without
    ``together`` each fit is subtracted before the next peak is scored.
    """
    residual = Residual(signal, noise, bank)
    fits: list[Fit] = []
    taken: set[tuple[int, int]] = set()

    def free(f: Fit) -> bool:
        return not any((f.t + d, f.unit) in taken for d in range(-rules.refractory, rules.refractory + 1))

    def accept(f: Fit) -> None:
        taken.add((f.t, f.unit))
        fits.append(f)
        residual.add(f, -1.0)

    for step in range(rules.passes):
        events = sorted(residual.peaks(rules.snr, rules.apart), key=lambda e: (-e[2], e[0], e[1]))
        known = len(fits)
        if together:
            admitted, couplings = [], Couplings(residual, rules)
            for f in sorted(residual.propose(events, rules, step), key=lambda f: (-f.gain, f.t, f.unit)):
                near = any(g.unit == f.unit and abs(g.t - f.t) <= rules.refractory for g in admitted)
                if not near and free(f) and couplings.admit(f):
                    admitted.append(f)
            for f in admitted:
                accept(f)
        else:
            for event in events:
                for f in residual.propose([event], rules, step):
                    if free(f):
                        accept(f)
        if len(fits) == known:
            break
    return refit(residual, fits, rules), residual


def match_cores(frames: DataFrame, noise: list[float], bank: Bank, rules: Rules = Rules(), together: bool = True) -> DataFrame:
    """Fits whose centre a core owns.

    ``frames`` (core, t, owned, uv) has each core's rows in one partition, together
    and in order of t, as the int16 source and ``cut_cores`` give them; one core is in memory at a time.
    Noise and bank (4,096 templates at most) go to the executors once.
    """
    held = frames.sparkSession.sparkContext.broadcast((np.array(noise, float), bank))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def matched(rows: pd.DataFrame) -> pd.DataFrame:
            found, _ = match(np.stack(rows["uv"].to_list()).astype(float), *held.value, rules, together)
            t, owned = rows["t"].to_numpy(), rows["owned"].to_numpy()
            kept = [{"core": int(rows["core"].iloc[0])} | vars(f) | {"t": int(t[f.t])} for f in found if owned[f.t]]
            return pd.DataFrame(sorted(kept, key=lambda f: (f["t"], f["channel"], f["step"])), columns=["core", *Fit.__dataclass_fields__])

        core, parts = None, []
        for batch in batches:
            for key, rows in batch.groupby("core", sort=False):
                if parts and key != core:
                    yield matched(pd.concat(parts))
                    parts = []
                core = key
                parts.append(rows)
        if parts:
            yield matched(pd.concat(parts))

    schema = "core long, t long, channel long, unit long, score double, runner_up double, amplitude double, gain double, margin double, step long"
    return frames.select("core", "t", "owned", "uv").mapInPandas(run, schema)


def cut_cores(frames: DataFrame, step: int, halo: int) -> DataFrame:
    """(core, t, owned, uv) from rows (t, uv): each core with the halo on both sides."""
    low, high = F.floor((F.col("t") - halo) / step), F.floor((F.col("t") + halo) / step)
    spread = frames.select("t", "uv", F.explode(F.sequence(low, high)).alias("_c"))
    rows = spread.select((F.col("_c") * step).alias("core"), "t", (F.floor(F.col("t") / step) == F.col("_c")).alias("owned"), "uv")
    return rows.repartition("core").sortWithinPartitions("core", "t")
