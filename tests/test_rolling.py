"""Sliding distinct actors from sketches by day, over several micro-batches with late events, against exact counts."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from garderobe.streaming import jobs
from garderobe.streaming.runtime import file_stream

DAY = jobs.PANE_MS


def test_sketched_actors(spark, tmp_path):
    rng, exact, counts = random.Random(5), defaultdict(set), defaultdict(int)
    for part in range(3):
        rows = []
        for _ in range(9000):
            day, kind = 2 * part + rng.randint(0, 6), rng.choice(["view", "view", "view", "save"])
            user = f"u{rng.randint(0, 6000)}" if rng.random() < 0.7 else None
            anon = f"a{rng.randint(0, 400)}"
            rows.append((1_600_000_000_000 // DAY * DAY + day * DAY + rng.randint(0, DAY - 1), kind, user, anon))
            for i in range(1, 8):
                end = rows[-1][0] // DAY * DAY + i * DAY
                exact[end, kind].add(user or anon)
                counts[end, kind] += 1
        spark.createDataFrame(rows, "ms long, event_type string, user_id string, anon_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = file_stream(spark, str(tmp_path / "events.parquet"), "*.parquet", files_per_trigger=1).withColumn("ts", F.timestamp_millis("ms"))
    got = {(r.end_ms, r.event_type): (r.n, r.actors) for r in jobs.rolling_actors(stream).collect()}
    assert set(got) == set(exact) and max(map(len, exact.values())) > 4000
    error = 1.04 / math.sqrt(2**jobs.SKETCH_BITS)
    for key, (n, actors) in got.items():
        assert n == counts[key] and abs(actors - len(exact[key])) <= 3 * error * len(exact[key]) + 0.5
