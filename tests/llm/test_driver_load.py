"""Tasks that rounds start where partitions are many and not coalesced: the driver holds a record of each."""

import random

import pytest

from zonata.llm import mixing, neardup

from .conftest import words

PARTITIONS = 40


def tasks_of(spark, work):
    """Tasks run by work() with PARTITIONS shuffle partitions."""
    held = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    group, sc = f"load-{random.random()}", spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, "load")
        work()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(told.getStageInfo, stages) if i)


def copies():
    base = words(random.Random(3), 120).split()
    return [(d, " ".join(base[:d] + [f"own{d}"] + base[d + 1 :])) for d in range(60)]


@pytest.mark.parametrize("operator, most", [("mix", 35), ("link", 24)])
def test_rounds_take_few_tasks(spark, docs, operator, most):
    near = spark.createDataFrame(copies(), "doc_id long, text string").repartition(2)
    run = {"mix": lambda: mixing.mix(spark, docs).collect(), "link": lambda: neardup.link(spark, near, 3, 85).collect()}[operator]
    n = tasks_of(spark, run)
    assert PARTITIONS < n < most * PARTITIONS


def whole_collections(spark):
    """Whole collections of the driver's heap so far."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_rounds_do_not_pile_up_garbage_on_the_driver(spark, monkeypatch):
    """Each round of near-dedup starts with a collected heap."""
    near = spark.createDataFrame(copies(), "doc_id long, text string").repartition(2)
    seen, given = [], neardup.contracted
    monkeypatch.setattr(neardup, "contracted", lambda *a, **b: (seen.append(whole_collections(spark)), given(*a, **b))[1])
    before = whole_collections(spark)
    neardup.link(spark, near, 3, 85).collect()
    assert seen and seen[0] > before and all(a < b for a, b in zip(seen, seen[1:]))
