"""State for each key of a stream: the second mention of a drug for each person."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Where state is kept: in RocksDB it needn't fit the executors' memory.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Lots that keys are dealt to by hash: each has one state and is one call a batch, whatever the number of its keys.
LOTS = 16_384


def _second(keys: Sequence[str], forget_ms: int | None) -> Callable:
    """Keeps the two earliest mentions of each key of a lot; the second is final, and comes out, when the watermark has passed it."""
    columns = [*keys, "first_id", "second_id", "second_micros"]

    def met(lot: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # by key: mentions (micros, id), two at most, and whether the second is out
        held = pickle.loads(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            for part in rows:
                for *key, at, mention in zip(*(part[c].tolist() for c in (*keys, "mention_micros", "mention_id"))):
                    own, done = held.get(tuple(key), ((), False))
                    new = at, mention
                    if not done and new not in own and (len(own) < 2 or new < own[1]):
                        held[tuple(key)] = tuple(sorted((*own, new))[:2]), False
        now, out, until = state.getCurrentWatermarkMs(), [], []
        for key, (own, done) in list(held.items()):
            if len(own) < 2:
                continue
            over = own[1][0] // 1000
            forget = None if forget_ms is None else over + 1 + forget_ms
            if done and forget is not None and forget <= now:
                del held[key]
                continue
            if not done and over < now:
                out.append((*key, own[0][1], own[1][1], own[1][0]))
                held[key] = own, done = own, True
            if not done or forget is not None:
                until.append(forget if done else over)
        if held:
            state.update((pickle.dumps(held),))
            if until:
                state.setTimeoutTimestamp(max(min(until), now, 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return met


def second_mentions(events: DataFrame, keys: Sequence[str], when: str, event_id: str, late: str = "1 hour", forget_ms: int | None = None) -> DataFrame:
    """Rows (keys, first_id, second_id, second_at): each key's second mention by time (then id), once, in append mode.

    It comes out when the latest time seen is ``late`` past it: until then an earlier mention may still arrive. Mentions later
    than that are dropped. State is one entry a key, in a row for each of ``LOTS`` lots of keys; where ``forget_ms`` is given a key is forgotten so long after its second
    mention, and what arrives after that is counted anew. A mention is an id: repeats of one don't count. Rows with null keys are dropped.
    """
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, when, event_id))
    rows = events.filter(known).withWatermark(when, late).select(F.pmod(F.xxhash64(*keys), F.lit(LOTS)).alias("lot"), *keys, when, F.col(event_id).cast("long").alias("mention_id"), F.unix_micros(when).alias("mention_micros"))
    out = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in keys), *(T.StructField(c, T.LongType()) for c in ("first_id", "second_id", "second_micros"))])
    found = rows.groupBy("lot").applyInPandasWithState(_second(keys, forget_ms), out, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*keys, "first_id", "second_id", F.timestamp_micros("second_micros").alias("second_at"))
