"""The reservation ledger over an event stream: one state for each period, in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OUT = "period string, seq long, amount long, accepted boolean, held long"
#: Rows of a frame that a step hands on.
ROWS = 10_000


def admit_stream(requests: DataFrame, limit: int) -> DataFrame:
    """Admission of a stream of (period, seq, amount): within a trigger by seq, between triggers by arrival. Kept between triggers: one number
    a period. Within one, a period's rows have to be put in order, for which two numbers of each are held (16 bytes a row); the source's
    rows or files a trigger bound that."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0
        rows = [(p["seq"].to_numpy(np.int64), p["amount"].to_numpy(np.int64)) for p in parts]
        seq, amount = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.argsort(seq, kind="stable")
        for lo in range(0, len(order), ROWS):
            part = order[lo : lo + ROWS]
            accepted, after = [], []
            for a in amount[part].tolist():
                fits = held + a <= limit
                held += a * fits
                accepted.append(fits)
                after.append(held)
            yield pd.DataFrame({"period": key[0], "seq": seq[part], "amount": amount[part], "accepted": accepted, "held": after})
        state.update((held,))

    return requests.select("period", "seq", "amount").groupBy("period").applyInPandasWithState(step, OUT, "held long", "append", GroupStateTimeout.NoTimeout)
