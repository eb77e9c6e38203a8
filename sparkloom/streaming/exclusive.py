"""One synchronisation at a time: triggers that come while one runs are skipped, by state kept for each key of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def exclusive(triggers: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """(key, time, ran) of a stream of triggers: one runs if the last that ran for its key is at least `seconds` ago (it is busy so long), else it is skipped.

    The end of the running one is state and outlives micro-batches and restarts.
    In a batch the triggers of a key are taken by time; one that comes in a later batch than its time
    is judged by the state then. Rows without a key or time are left out.
    """
    kind = dict(triggers.dtypes)
    busy = int(seconds * 1_000_000)

    def judge(own: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else None
        rows = pd.concat([c[[key, time]] for c in chunks]).sort_values(time)
        ran = []
        for at in rows[time].astype("datetime64[us]").astype("int64").tolist():
            ran.append(free is None or at >= free)
            if ran[-1]:
                free = at + busy
        state.update((free,))
        yield rows.assign(ran=ran)

    rows = triggers.filter(triggers[key].isNotNull() & triggers[time].isNotNull()).select(key, time)
    return rows.groupBy(key).applyInPandasWithState(judge, f"{key} {kind[key]}, {time} {kind[time]}, ran boolean", "free long", "append", GroupStateTimeout.NoTimeout)
