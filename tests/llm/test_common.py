"""Tables that are written on the way and deleted when they are spent."""

import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from termfield.llm.common import discard, place, written


def where(df):
    return Path(df.inputFiles()[0].removeprefix("file://")).parent


def test_threads_leave_each_others_tables_alone(spark):
    """Two queries write in turn; the first deletes what it wrote while the second still reads."""
    turn = threading.Barrier(2, timeout=120)

    def first():
        since = place()
        a = written(spark.range(3), "a")
        turn.wait()
        turn.wait()  # the other has written in between
        b = written(spark.range(4), "b")
        gone = where(a)
        discard(spark, since)
        turn.wait()
        return gone.exists(), b.count()

    def second():
        since = place()
        turn.wait()
        c, d = written(spark.range(5), "c"), written(spark.range(6), "d")
        turn.wait()
        turn.wait()  # the other has deleted
        sizes = c.count(), d.count()
        gone = where(c)
        discard(spark, since)
        return sizes, gone.exists(), d.count()

    with ThreadPoolExecutor(2) as pool:
        one, two = pool.submit(first), pool.submit(second)
        assert one.result() == (False, 4)
        assert two.result() == ((5, 6), False, 6)
