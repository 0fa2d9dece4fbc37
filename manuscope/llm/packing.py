"""Vector bin packing: texts into containers under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one task packs; blocks are packed independently, the open rest of a block is a few containers.
BLOCK_ITEMS = 8_000


def pack_block(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_capacity: int) -> np.ndarray:
    """Container number of each item, filled one container after the other.

    A container takes the item whose vector has the largest dot product with the room left, each
    dimension as a share of its limit and weighed by the demand for it; items of the same kind are
    interchangeable, so kinds are scored and the first item of the best kind is taken.
    """
    n = len(tokens)
    out = np.full(n, -1, np.int64)
    kinds, kind_of = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    by_kind = np.argsort(kind_of, kind="stable")
    first = np.searchsorted(kind_of[by_kind], np.arange(len(kinds)))
    left = np.bincount(kind_of, minlength=len(kinds))
    limits = np.array([capacity, segments, loss_capacity], float)
    vec = np.column_stack([kinds[:, 0], np.ones(len(kinds)), kinds[:, 1]]) / limits
    demand = (vec * left[:, None]).sum(0)
    weight = demand / max(demand.sum(), 1e-12)
    box, todo = 0, n
    while todo:
        room = np.ones(3)
        while True:
            fits = (left > 0) & (vec <= room + 1e-12).all(1)
            if not fits.any():
                break
            score = np.where(fits, vec @ (weight * room), -1.0)
            k = int(np.argmax(score))
            out[by_kind[first[k]]] = box
            first[k] += 1
            left[k] -= 1
            todo -= 1
            room = room - vec[k]
        box += 1
    return out


def pack(items: DataFrame, capacity: int, segments: int = 64, loss_share: float = 1.0, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Places the items (doc_id BIGINT, tokens INT, loss_tokens INT) into containers.

    Columns: container STRING, doc_id, piece_no, start_token, tokens, loss_tokens.  A container holds at most
    ``capacity`` tokens, ``segments`` items and ``loss_share * capacity`` loss-bearing tokens.  Only items
    over ``capacity`` (or over the loss limit) are split, into pieces of that size; each piece is an item.

    Items of null or no tokens are left out; a null loss counts as 0; repeated rows are items of their own;
    ties go to the kind with fewer tokens; extra columns are ignored; an empty table gives an empty result.
    """
    if capacity < 1 or segments < 1 or not 0 < loss_share <= 1:
        raise ValueError("capacity and segments must be positive, loss_share in (0, 1]")
    most_loss = max(1, int(capacity * loss_share))
    size = F.when(F.coalesce("loss_tokens", F.lit(0)) > most_loss, most_loss).otherwise(capacity)
    cut = items.where("tokens > 0").select("doc_id", F.col("tokens").cast("int"), F.least(F.coalesce("loss_tokens", F.lit(0)), "tokens").cast("int").alias("loss_tokens"))
    cut = cut.withColumn("size", size.cast("int")).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / F.col("size")).cast("int") - 1)))
    start = (F.col("piece_no") * F.col("size")).cast("int")
    n = F.least(F.col("size"), F.col("tokens") - start).cast("int")
    before = F.col("tokens") - F.col("loss_tokens")  # the instruction comes first
    lossy = F.greatest(F.lit(0), F.least(n, start + n - before)).cast("int")
    pieces = cut.select("doc_id", "piece_no", start.alias("start_token"), n.alias("n"), lossy.alias("loss"))
    blocks = max(1, -(-pieces.count() // block_items))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(blocks)).cast("int"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["doc_id", "piece_no"], kind="stable").reset_index(drop=True)
        box = pack_block(df["n"].to_numpy(), df["loss"].to_numpy(), capacity, segments, most_loss)
        name = [f"{df['block'].iat[0]}-{x}" for x in box]
        return pd.DataFrame({"container": name, "doc_id": df["doc_id"], "piece_no": df["piece_no"], "start_token": df["start_token"], "tokens": df["n"], "loss_tokens": df["loss"]})

    return pieces.groupBy("block").applyInPandas(run, "container string, doc_id long, piece_no int, start_token int, tokens int, loss_tokens int")
