"""One bad job must not fail the others: a plan that fails is run again on halves of its jobs until the bad ones stand alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.sources.work import staged

#: Bits of a job's hash by which jobs are halved, and bad jobs after which the run is given up: the fault is not theirs.
BITS, MOST_BAD = 30, 100


class TooManyFailures(Exception):
    """So many jobs fail that the input or the plan as a whole must be at fault."""


def isolated(jobs: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """``(results, dead_letters)``: what ``compute`` makes of the jobs ``(key)`` that do not fail it, and ``key, error`` of those that do.

    ``compute`` takes a table of jobs and must work each on its own. All jobs run as one plan; only where that fails
    are they halved by a hash of the key, so that n jobs with one bad one take about 2 log n runs, of half the size each.
    Null is a job like any other. More than MOST_BAD bad jobs raise the last error.
    """
    known = staged(jobs.select(key).distinct().withColumn("_h", F.pmod(F.xxhash64(key), F.lit(1 << BITS))))
    spark, done, dead = jobs.sparkSession, [], []
    todo = [(0, 1 << BITS)]
    while todo:
        low, high = todo.pop()
        part = known.where((F.col("_h") >= low) & (F.col("_h") < high)).select(key)
        try:
            done.append(staged(compute(part)))
            continue
        except Exception as error:  # whatever a job's rows may do to a plan
            names = part.limit(2).collect()
            if len(names) > 1 and high - low > 1:
                middle = (low + high) // 2
                todo += [(middle, high), (low, middle)]
                continue
            if not names or len(dead) >= MOST_BAD:
                raise TooManyFailures(f"{len(dead)} jobs failed before this one") from error
            reason = " ".join(str(error).split())
            dead += [(r[key], reason[:2000]) for r in part.collect()]
    letters = spark.createDataFrame(dead, f"`{key}` {known.schema[key].dataType.simpleString()}, error string")
    if not done:
        done = [compute(known.limit(0).select(key))]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, letters
