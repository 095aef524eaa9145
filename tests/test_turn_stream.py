"""Turns folded as a stream give the rows of the batch fold, in whatever order and micro-batches events come."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import rag
from siltstone.streaming.turns import fold_turns

NOW = datetime(2026, 8, 5)
DDL = "query_id long, seq int, event string, data string, ts timestamp"


def turns():
    out = []
    for q in range(12):
        events = [("routing", '{"agent_id":"g%d","name":"N"}' % q), ("citation", '{"citations":[]}')]
        events += [("token", '{"text":"w%d "}' % i) for i in range(q % 5)] + [("error", '{"message":"sorry"}') if q % 4 == 3 else ("done", "{}")]
        out += [(q, i, e, d, NOW + timedelta(seconds=i)) for i, (e, d) in enumerate(events)]
    return out


def run(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{folder}/in/b{i}")
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    fold_turns(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination(240)
    return sorted(tuple(r) for r in spark.read.schema("query_id long, content string, guide_id string, error string, finished boolean").parquet(f"{folder}/out").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_batch_fold(spark, tmp_path, seed):
    rows = turns()
    want = sorted(tuple(r) for r in rag.fold_events(spark.createDataFrame(rows, DDL)).select("query_id", "content", "guide_id", "error", "finished").collect())
    rng = random.Random(seed)
    rng.shuffle(rows)
    first = [r for r in rows if r[1] == 0]  # with the second seed each turn's first event comes twice, before the turn is whole
    batches = [rows[i::3] for i in range(3)] if seed == 1 else [first, first + [r for r in rows if r[1] > 0][::2], [r for r in rows if r[1] > 0][1::2]]
    assert run(spark, str(tmp_path), batches) == want


def test_a_turn_that_never_ends_is_given_up(spark, tmp_path):
    open_turn = [(1, 0, "routing", '{"agent_id":"g","name":"N"}', NOW), (1, 1, "citation", "{}", NOW), (1, 3, "token", '{"text":"late"}', NOW), (1, 2, "token", '{"text":"early "}', NOW)]
    later = [(2, 0, "error", '{"message":"no guide"}', NOW + timedelta(hours=h)) for h in (1,)]
    much_later = [(3, 0, "error", '{"message":"no guide"}', NOW + timedelta(hours=2))]
    got = run(spark, str(tmp_path), [open_turn, later, much_later])
    assert got == [(1, "early late", "g", None, False), (2, "", None, "no guide", False), (3, "", None, "no guide", False)]
