"""Updaters on streams: one row in, one state out, rows applied in index order.

Time is the row index, so order needs no clock: a row waits in the state until
its predecessor has come, however many wait. Only where ``max_waiting`` is given, what is
missing is given up if a key still holds more rows than that after all rows of a trigger, which a row
with event ``gap`` says, and the rows after it are applied. Rows at or before the last applied
index are late: they are not applied and come out as rows with event ``late``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelseq import SEQUENCE, TIME
from panelseq.operators import contracts
from panelseq.operators import updaters as U
from panelseq.session import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys are dealt to this many state rows; rows of a bucket that are worked on together.
BUCKETS, GATHERED = 1024, 1 << 17
KINDS = ("constant_gain", "ema", "kalman_fixed", "kalman_adaptive")


class _Ordered:
    """Applies rows of each key in index order; subclasses supply ``advance``.

    A call has a bucket of keys, one state row and one array for each field of it. The next row of every key that
    has it is applied at once, so the work of a call grows with the longest run of a key and not with its rows.
    """

    max_waiting: int | None = None
    #: Names of the state values of a key.
    fields: Sequence[str] = ()

    def prepare(self, kinds: dict[str, str]) -> str:
        """Schema of a bucket's state, whose keys have these types."""
        self.kinds = kinds
        arrays = [*[(f"key{i}", kind) for i, kind in enumerate(kinds.values())], *[(f, "double") for f in self.fields]]
        arrays += [("next", "bigint"), ("late", "bigint"), ("wait_key", "int"), ("wait_t", "bigint"), ("wait_fast", "double"), ("wait_slow", "double")]
        return ", ".join(f"{name} array<{kind}>" for name, kind in arrays)

    def fresh(self) -> list[float]:
        raise NotImplementedError

    def advance(self, s: np.ndarray, fast: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state values and gain of some keys; the first value is the state."""
        raise NotImplementedError

    def _indices(self, pdf: pd.DataFrame, known: dict[tuple, int]) -> np.ndarray:
        """The place of each row's key in ``known``, to which new keys are added."""
        groups = pdf.groupby(list(self.kinds), sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(groups, return_index=True)[1]
        columns = []
        for name, kind in self.kinds.items():
            whole = kind in ("tinyint", "smallint", "int", "bigint")
            columns.append([None if pd.isna(v) else int(v) if whole else v for v in pdf[name].iloc[first].tolist()])
        return np.array([known.setdefault(k, len(known)) for k in zip(*columns, strict=True)], np.int64)[groups]

    def __call__(self, _: tuple, rows: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        known: dict[tuple, int] = {}
        s, nxt, late = np.empty((0, len(self.fields))), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pool = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        if group.exists:
            got, k = list(group.get), len(self.kinds)
            known = {key: i for i, key in enumerate(zip(*got[:k], strict=True))}
            s = np.array(got[k: k + len(self.fields)], float).T.reshape(-1, len(self.fields))
            nxt, late, *pool = (np.array(x, kind) for x, kind in zip(got[k + len(self.fields):], (np.int64, np.int64, np.int64, np.int64, float, float), strict=True))
        for pdf in chain(_gathered(rows), [None]):
            out = []
            if pdf is not None:
                at = self._indices(pdf, known)
                more = len(known) - len(nxt)
                s = np.concatenate([s, np.tile(np.array(self.fresh(), float), (more, 1))])
                nxt, late = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (nxt, late))
                t = pdf[TIME].to_numpy().astype(np.int64)
                held = len(pool[0])
                pool = [np.concatenate([x, y]) for x, y in zip(pool, (at, t, pdf["fast"].to_numpy(float), pdf["slow"].to_numpy(float)), strict=True)]
                order = np.lexsort((pool[1], pool[0]))
                again = np.zeros(len(order), bool)
                # The sort is stable, so of equal rows the first to come stays.
                again[order[1:]] = (pool[0][order[1:]] == pool[0][order[:-1]]) & (pool[1][order[1:]] == pool[1][order[:-1]])
                again[held:] |= t < nxt[at]
                if again.any():
                    key = pool[0][again]
                    count = late[key] + pd.Series(key).groupby(key).cumcount().to_numpy() + 1
                    np.add.at(late, key, 1)
                    out.append((key, pool[1][again], np.nan, np.nan, count, 0, "late"))
                    pool = [x[~again] for x in pool]
            while True:
                pool = self._apply(s, nxt, late, pool, out)
                waiting = np.bincount(pool[0], minlength=len(nxt))
                over = np.flatnonzero(waiting > self.max_waiting) if pdf is None and self.max_waiting is not None else []
                if not len(over):
                    break
                # The pool is in order of key and time.
                found = pool[1][np.searchsorted(pool[0], over)]
                out.append((over, nxt[over], np.nan, np.nan, late[over], found - nxt[over], "gap"))
                nxt[over] = found
            if out:
                yield self._frame(list(known), out)
        group.update((*[[k[i] for k in known] for i in range(len(self.kinds))], *[x.tolist() for x in s.T], nxt.tolist(), late.tolist(), *[x.tolist() for x in pool]))

    def _apply(self, s, nxt, late, pool, out: list) -> list[np.ndarray]:
        """Applies what follows each key's last row without a hole, and returns the other rows in order."""
        order = np.lexsort((pool[1], pool[0]))
        key, t, fast, slow = pool = [x[order] for x in pool]
        head = np.flatnonzero(np.diff(key, prepend=-1))
        size = np.diff(np.append(head, len(key)))
        ready = t - nxt[key] == np.arange(len(key)) - np.repeat(head, size)
        if not ready.any():
            return pool
        run = np.add.reduceat(ready.astype(np.int64), head)
        state, gain = np.empty(len(key)), np.empty(len(key))
        # Longest runs first, so that those still going stand in front.
        longest = np.argsort(-run, kind="stable")
        head, run = head[longest], run[longest]
        going = np.searchsorted(-run, -np.arange(1, run[0] + 1), "right")
        for step, n in enumerate(going.tolist()):
            at = head[:n] + step
            k = key[at]
            s[k], gain[at] = self.advance(s[k], fast[at], slow[at])
            state[at] = s[k, 0]
        np.add.at(nxt, key[ready], 1)
        out.append((key[ready], t[ready], state[ready], gain[ready], late[key[ready]], 0, "state"))
        return [x[~ready] for x in pool]

    def _frame(self, keys: list[tuple], out: list) -> pd.DataFrame:
        parts = []
        for at, t, state, gain, late, missing, event in out:
            part = pd.DataFrame({TIME: t, "state": state, "gain": gain, "late_rows": late, "missing_rows": missing, "event": event})
            if event != "state":
                part[["state", "gain"]] = part[["state", "gain"]].astype(object).where(part[["state", "gain"]].notna(), None)
            for i, name in enumerate(self.kinds):
                values = [k[i] for k in keys]
                part.insert(i, name, np.array(values, object if None in values else None)[at])
            parts.append(part)
        return pd.concat(parts, ignore_index=True)


def _gathered(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames of a call, put together to at least GATHERED rows."""
    parts, size = [], 0
    for pdf in rows:
        parts.append(pdf)
        size += len(pdf)
        if size >= GATHERED:
            yield pd.concat(parts, ignore_index=True)
            parts, size = [], 0
    if size:
        yield pd.concat(parts, ignore_index=True)


class _Linear(_Ordered):
    fields = ("mean", "covariance", "r", "step")

    def __init__(self, kind: str, params) -> None:
        self.kind, self.params = kind, params

    def fresh(self) -> list[float]:
        if self.kind in ("constant_gain", "ema"):
            return [float("nan"), 0.0, 0.0, 0.0]
        p = self.params
        r = float(np.clip(p.r, p.r_min, p.r_max)) if self.kind == "kalman_adaptive" else p.r
        return [float("nan"), p.p0, r, 0.0]

    def advance(self, s: np.ndarray, fast: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, cov, r, step = s.T
        opening = np.isnan(mean)
        if self.kind in ("constant_gain", "ema"):
            prev = np.where(opening, slow if self.kind == "constant_gain" else fast, mean)
            a = float(self.params)
            return np.stack([np.clip(a * fast + (1.0 - a) * prev, 0.0, 1.0), cov, r, step + 1], 1), np.full(len(s), a)
        p = self.params
        if self.kind == "kalman_fixed":
            m, c, _, gain, *_ = U.kalman_step(p, fast, mean, cov, r, 0)
            new = np.stack([np.where(opening, fast, m), np.where(opening, cov, c), r, np.where(opening, 1, step + 1)], 1)
            return new, np.where(opening, 0.0, gain)
        m, c, after, gain, *_ = U.kalman_step(p, fast, np.where(opening, slow, mean), cov, r, step + 1)
        return np.stack([m, c, after, step + 1], 1), gain


class _Tracker(_Ordered):
    def __init__(self, config: U.TrackerConfig) -> None:
        self.config = config
        # The last inputs, the latest at the end, and how many of them there are.
        self.fields = ("mean", "filled", *[f"past{i}" for i in range(config.past_window)])

    def fresh(self) -> list[float]:
        return [float("nan"), *[0.0] * (len(self.fields) - 1)]

    def advance(self, s: np.ndarray, fast: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, filled, window = s[:, 0], s[:, 1].astype(np.int64), s[:, 2:]
        prev = np.where(np.isnan(mean), slow, mean)
        got = U.tracker_step(self.config.__dict__, fast, slow, prev, *U.past_stats(window, filled))
        count = np.minimum(filled + 1, window.shape[1])
        return np.concatenate([got["state"][:, None], count[:, None], window[:, 1:], fast[:, None]], 1), got["alpha"]


def _run(stream: DataFrame, processor: _Ordered, keys: Sequence[str], max_waiting: int | None) -> DataFrame:
    processor.max_waiting = max_waiting
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = {f.name: f.dataType.simpleString() for f in stream.select(*keys).schema.fields}
    ddl = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    state = processor.prepare(kinds)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    return stream.select(*keys, TIME, "fast", "slow", bucket).groupBy("_bucket").applyInPandasWithState(
        lambda key, rows, group: processor(key, rows, group), f"{ddl}, {TIME} long, state double, gain double, late_rows long, missing_rows long, event string",
        state, "append", GroupStateTimeout.NoTimeout)


def stream_update(stream: DataFrame, kind: str, params, keys: Sequence[str] = SEQUENCE, max_waiting: int | None = None) -> DataFrame:
    """Constant gain, EMA, fixed or adaptive Kalman; a new recording is a new key.

    States are rows with event ``state``; see the module for ``late`` and ``gap``.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown updater {kind!r}")
    return _run(stream, _Linear(kind, params), keys, max_waiting)


def stream_change_aware(stream: DataFrame, config: U.TrackerConfig = U.TrackerConfig(), keys: Sequence[str] = SEQUENCE, max_waiting: int | None = None) -> DataFrame:
    """Change-aware tracker with a ring of the last ``past_window`` inputs as state."""
    return _run(stream, _Tracker(config), keys, max_waiting)


def _prefix(streamed: DataFrame, batch: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Streamed states, and the batch rows from the start of each key up to its last streamed row, the first at least."""
    got = streamed.where("event = 'state'").select(*keys, TIME, "state")
    last = got.groupBy(*keys).agg(F.max(TIME).alias("_last"))
    want = batch.select(*keys, TIME, "state").join(last, list(keys), "left").where(F.col(TIME) <= F.coalesce("_last", F.lit(0))).drop("_last")
    return got, want


def check_prefix(streamed: DataFrame, batch: DataFrame, keys: Sequence[str] = SEQUENCE, eps: float = 1e-9) -> DataFrame:
    """Violations where a key's streamed states are not the first rows of the batch table without a hole.

    A key of the batch table that has not been streamed at all lacks its first row.
    """
    got, want = _prefix(streamed, batch, keys)
    return contracts.align_frames(got, want, [*keys, TIME], ["state"], eps)


def prefix_counts(streamed: DataFrame, batch: DataFrame, keys: Sequence[str] = SEQUENCE, eps: float = 1e-9) -> DataFrame:
    """Per key: rows streamed, rows of the batch prefix, and how many of both agree."""
    got, want = _prefix(streamed, batch, keys)
    both = got.withColumnRenamed("state", "_s").join(want.withColumnRenamed("state", "_b"), [*keys, TIME], "full")
    return both.groupBy(*keys).agg(
        F.count("_s").alias("streamed_rows"), F.count("_b").alias("prefix_rows"), F.count_if(F.abs(F.col("_s") - F.col("_b")) <= eps).alias("equal_rows"))
