"""Files in the shared folder: whose they are, and when they go."""

import os
import threading

from pyspark.sql import functions as F

from tallyforge.sources import shared


def files(spark):
    root = shared.shared_dir(spark).removeprefix("file:").replace("//", "/")
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names}


def test_a_scope_removes_what_it_wrote(spark):
    before = files(spark)
    with shared.scope(spark) as mine:
        first = shared.checkpoint(spark.range(100).withColumn("x", F.col("id") * 2))
        folder = shared.fresh_folder(spark, "rows")
        first.write.parquet(folder)
        second = shared.checkpoint(first.where("x > 10"))
        shared.drop(first)
        assert len(mine) == 2 and second.count() == 94 and spark.read.parquet(folder).count() == 100
    assert files(spark) == before


def test_threads_keep_their_files(spark):
    before, ready, done, counts = files(spark), threading.Event(), threading.Event(), []

    def other():
        with shared.scope(spark):
            rows = shared.checkpoint(spark.range(50))
            ready.set()
            assert done.wait(60)
            counts.append(rows.count())

    thread = threading.Thread(target=other)
    thread.start()
    assert ready.wait(60)
    with shared.scope(spark):
        shared.checkpoint(spark.range(7)).count()
    done.set()
    thread.join()
    assert counts == [50] and files(spark) == before


def test_without_a_scope_files_stay_until_the_end(spark):
    kept = shared.checkpoint(spark.range(5))
    assert shared._folder(kept) in shared._left
    shared.drop(kept)
    assert shared._folder(kept) not in shared._left
