"""Several small jobs at once, of one session, that fail as one."""

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def run_together(spark: SparkSession, jobs: Mapping[str, Callable[[], object]], at_once: int = 4) -> dict[str, object]:
    """Run the jobs, at most ``at_once`` at a time, and return what each returns.

    Each runs in a thread that inherits the session's properties, in a scheduler pool of its own, so that under
    ``spark.scheduler.mode=FAIR`` a long job does not hold up short ones; under FIFO they fill each other's idle
    cores. The first failure cancels the jobs that run, starts no further one, and is raised.
    """
    context = spark.sparkContext
    tag = f"panelspark-{uuid.uuid4().hex}"

    def job(name: str, work: Callable[[], object]) -> Callable[[], object]:
        def run() -> object:
            context.addJobTag(tag)
            context.setLocalProperty("spark.scheduler.pool", name)
            try:
                return work()
            finally:
                context.setLocalProperty("spark.scheduler.pool", None)
                context.removeJobTag(tag)

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as threads:
        running = {threads.submit(job(name, work)): name for name, work in jobs.items()}
        done, left = wait(running, return_when=FIRST_EXCEPTION)
        failed = next((f for f in done if f.exception()), None)
        if failed:
            for f in left:
                f.cancel()
            while left:  # a thread may be about to submit its next job
                context.cancelJobsWithTag(tag)
                _, left = wait(left, timeout=0.5)
            raise failed.exception()
        return {running[f]: f.result() for f in done}
