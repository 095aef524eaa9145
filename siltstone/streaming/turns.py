"""Chat turns folded as their events come, in any order, over any number of micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDED = "query_id long, content string, guide_id string, error string, finished boolean"
_STATE = "seqs array<long>, events array<string>, data array<string>, latest long"
ENDS = ("done", "error")


def _folded(query_id: int, held: dict[int, tuple[str, str]]) -> pd.DataFrame:
    """A turn's row from its events by number, as ``rag.fold_events`` gives it."""
    content, guide, error, finished = [], None, None, False
    for _, (event, data) in sorted(held.items()):
        body = json.loads(data)
        if event == "token":
            content.append(body["text"])
        elif event == "routing":
            guide = body["agent_id"]
        elif event == "error":
            error = body["message"]
        finished = finished or event == "done"
    return pd.DataFrame([(query_id, "".join(content), guide, error, finished)], columns=[c.split()[0] for c in FOLDED.split(", ")])


def fold_turns(events: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """``query_id, content, guide_id, error, finished`` of each turn, once, when its last event and all before it are there.

    ``events``: query_id, seq, event, data, ts.  An event that comes again changes nothing.  A turn whose end doesn't come
    is given as far as it is there when no event of it has come for ``wait`` of event time (``wait`` is the watermark's
    delay too), and is forgotten then; what comes later still begins anew.  What is held is the events of open turns.
    """
    limit_ms = int(pd.Timedelta(wait).total_seconds() * 1000)

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seqs, names, data, latest = state.get if state.exists else ([], [], [], 0)
        held = dict(zip(seqs, zip(names, data, strict=True), strict=True))
        if state.hasTimedOut:
            state.remove()
            yield _folded(key[0], held)
            return
        for batch in batches:
            for seq, event, body, ts in zip(batch["seq"], batch["event"], batch["data"], batch["ts"], strict=True):
                held.setdefault(int(seq), (event, body))
                latest = max(latest, int(ts.timestamp() * 1000))
        ends = [s for s, (event, _) in held.items() if event in ENDS]
        if ends and len(held) >= min(ends) + 1 and all(s in held for s in range(min(ends) + 1)):
            if state.exists:
                state.remove()
            yield _folded(key[0], held)
            return
        numbers = sorted(held)
        state.update((numbers, [held[s][0] for s in numbers], [held[s][1] for s in numbers], latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + limit_ms)

    kept = events.select("query_id", F.col("seq").cast("long").alias("seq"), "event", "data", "ts").withWatermark("ts", wait)
    return kept.groupBy("query_id").applyInPandasWithState(fold, FOLDED, _STATE, "append", "EventTimeTimeout")
