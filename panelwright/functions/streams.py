"""Functions of groups read in order by ``table_function``."""

from __future__ import annotations


def cusum(key: dict, batches):
    """The upper cumulative sum ``max(0, s + x)`` of the whole numbers ``x``, and rows since it was 0; a missing ``x`` adds nothing.

    Yields (id, high, since).  Within a batch the sum is the running total less its running minimum below 0.
    """
    import numpy as np
    import pandas as pd

    high, since = 0, 0
    for rows in batches:
        total = high + np.cumsum(rows["x"].fillna(0).to_numpy(dtype="int64"))
        highs = total - np.minimum(np.minimum.accumulate(total), 0)
        place = np.arange(len(highs))
        zero = np.maximum.accumulate(np.where(highs == 0, place, -1))
        sinces = np.where(zero < 0, since + place + 1, place - zero)
        high, since = int(highs[-1]), int(sinces[-1])
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "high": highs, "since": sinces})
