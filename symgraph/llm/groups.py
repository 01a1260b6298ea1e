"""Whole groups out of batches that are sorted by group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames that end with a group, and where each of their groups begins (with the end as last entry).

    The batches of a partition must be sorted by ``keys``. Only the last group
    of a batch is held back, so memory is bounded by the largest group.
    """
    rest: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        cuts = _cuts(frame, keys)
        last = cuts[-2]
        rest = frame.iloc[last:].reset_index(drop=True)
        if last:
            yield frame.iloc[:last], cuts[:-1]
    if rest is not None:
        yield rest, _cuts(rest, keys)


def _cuts(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(len(frame), bool)
    for k in keys:
        a = frame[k].to_numpy()
        same = (a[1:] == a[:-1]) | (pd.isna(a[1:]) & pd.isna(a[:-1]))
        new[1:] |= ~same.astype(bool)
    new[0] = True
    return np.r_[np.flatnonzero(new), len(frame)]
