"""Packing: optimal length buckets.

Dynamic programming over the global histogram of sequence lengths chooses the bucket boundaries that
need the least padding; batches are then formed inside each bucket under a token budget, counted with
the padding. The histogram has each length that occurs, so the boundaries are the best there are, and no text is
ever cut. It has a row for each distinct length, far fewer than there are texts, and comes to the driver as three columns of
numbers; the programme takes (buckets) x (lengths) x (logarithm of lengths) steps, since the best place of a boundary
never moves back as the next one moves on.

A sequence longer than the budget forms a batch of its own. Null and empty texts have one token, the
end mark. Rows that repeat are packed as often as they occur; rows that tie in the order come in any. Of boundaries
that need equally little padding the lower ones count; an empty table has no buckets and no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, with_rank


def byte_tokens(text: Column) -> Column:
    """Length under a byte vocabulary: each UTF-8 byte is a token, and one more ends the text."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def best_bounds(longest: np.ndarray, rows: np.ndarray, buckets: int) -> list[int]:
    """The bounds of at most ``buckets`` buckets that minimise padding, from each length that occurs and its number of rows."""
    if not len(longest):
        return []
    order = np.argsort(longest)
    longest = longest[order].astype(np.float64)
    rows = np.concatenate([[0], np.cumsum(rows[order])]).astype(np.float64)
    n = len(longest)
    # Without the tokens themselves, which are the same for all boundaries, the padding of a bucket is its rows times its length.
    best, came = rows[1:] * longest, [np.zeros(n, np.int64)]
    for _ in range(min(buckets, n) - 1):
        now, back = one_more(best, rows, longest)
        came.append(back)
        best = now
    bounds, j = [], n
    for back in reversed(came):
        if j == 0:
            break
        bounds.append(int(longest[j - 1]))
        j = int(back[j - 1])
    return bounds[::-1]


def one_more(best: np.ndarray, rows: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the first 1, 2, ... lengths, the least cost with one more bucket than ``best`` has, and how many lengths come before the last bucket.

    The middle of each open range is settled first; its answer bounds both halves. All middles of one depth are settled at once.
    """
    n = len(best)
    before = np.concatenate([[0.0], best])  # cost of the first i lengths
    cost, back = np.full(n, np.inf), np.zeros(n, np.int64)
    lo, hi, least, most = (np.array([x], np.int64) for x in (0, n, 0, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        top = np.minimum(most, mid)
        width = top - least + 1
        ends = np.cumsum(width)
        i = np.arange(int(ends[-1])) - np.repeat(ends - width - least, width)
        at = np.repeat(mid, width)
        value = before[i] + (rows[at + 1] - rows[i]) * longest[at]
        found = np.minimum.reduceat(value, ends - width)
        first = np.flatnonzero(value == np.repeat(found, width))
        own = np.searchsorted(first, ends - width)
        back[mid], cost[mid] = i[first[own]], found
        lo, hi, least, most = np.concatenate([lo, mid + 1]), np.concatenate([mid, hi]), np.concatenate([least, back[mid]]), np.concatenate([back[mid], most])
        some = lo < hi
        lo, hi, least, most = lo[some], hi[some], least[some], most[some]
    return cost, back


def pack(df: DataFrame, id_col: str, length: Column, buckets: int = 16, token_budget: int = 65536, order_col: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, bucket, bucket_len, batch and slot within the bucket, padding.

    A bucket's rows fill its batches by ``order_col``; without one, by id.
    """
    order = F.col(id_col if order_col is None else order_col)
    rows = durable(df.select(F.col(id_col).alias("id"), length.alias("n_tokens"), order.alias("order")))
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow()
    bounds = best_bounds(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), buckets)
    limits = F.array(*map(F.lit, bounds)).cast("array<long>")
    bucket = F.size(F.filter(limits, lambda b: b < F.col("n_tokens"))).alias("bucket")
    ranked = with_rank(rows.select("id", "n_tokens", "order", bucket), "bucket", ["order"], "rank").withColumn("bucket_len", F.get(limits, F.col("bucket")))
    fit = F.greatest(F.lit(1), F.expr(f"{int(token_budget)} div bucket_len"))
    return ranked.withColumn("fit", fit).select(
        "id", "n_tokens", "bucket", "bucket_len", F.expr("rank div fit").alias("batch"), F.expr("rank % fit").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding")
    )
