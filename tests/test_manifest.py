"""Tables of commits: writers that meet, replaced documents, and a log that several append to."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from docmill.operators import audit
from docmill.sources.manifest import Conflict, Table
from docmill.sources.store import Store

SCHEMA = "document_id string, text string"


@pytest.fixture
def table(spark):
    store = Store(spark, "tests")
    yield Table(spark, f"{store.path}/t", SCHEMA, buckets=8)
    store.remove()


def rows(table):
    return sorted(tuple(r) for r in table.read().collect())


def docs(spark, ids, text):
    return spark.createDataFrame([(f"d{i}", text) for i in ids], SCHEMA)


def test_replace_and_versions(spark, table):
    assert rows(table) == [] and table.state().version == 0
    table.replace(docs(spark, range(20), "old"))
    table.append(docs(spark, [50], "loose"))
    table.replace(docs(spark, [1, 2, 50], "new"), keys=docs(spark, [1, 2, 3, 50], ""))
    want = [(f"d{i}", "old") for i in range(20) if i not in (1, 2, 3)] + [(f"d{i}", "new") for i in (1, 2, 50)]
    assert rows(table) == sorted(want)
    assert table.read(1).count() == 20 and table.read(2).count() == 21 and table.state().version == 3


def test_a_second_writer_retries(spark, table):
    """Both read version 0; the one that commits second gets a conflict, and by replace() merges with what the first one wrote."""
    old = table.state()
    table.append(docs(spark, [1], "first"))
    with pytest.raises(Conflict):
        table.commit(old, {"data/none": -1})
    assert table.state().version == 1
    once, met = table.commit, []

    def late(before, folders, notes=None):
        if not met:  # another writer commits between this one's read and its commit
            met.append(1)
            other = Table(spark, table.path, SCHEMA, buckets=8)
            other.replace(docs(spark, [1, 7], "other"))
        return once(before, folders, notes)

    table.commit = late
    table.replace(docs(spark, [1, 9], "mine"))
    table.commit = once
    assert rows(table) == [("d1", "mine"), ("d7", "other"), ("d9", "mine")] and met == [1]


def test_two_writers_append_to_one_log(spark):
    store = Store(spark, "tests")
    path, n = f"{store.path}/log", 12
    events = lambda who: spark.createDataFrame([(who, f"a{i:02d}", "t", None, json.dumps({"i": i})) for i in range(n)], "actor string, action string, target_type string, target_id string, meta string")
    failed = []

    def write(who):
        try:
            for _ in range(2):
                audit.append_to(Table(spark, path, audit.SCHEMA, "seq"), events(who), ["action"])
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=write, args=(w,)) for w in ("ann", "bob")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    log = Table(spark, path, audit.SCHEMA, "seq").read()
    assert [r["seq"] for r in log.orderBy("seq").collect()] == list(range(1, 4 * n + 1))
    assert audit.verify(log).first()["ok"]
    assert {r["actor"]: r["n"] for r in log.groupBy("actor").agg(F.count("*").alias("n")).collect()} == {"ann": 2 * n, "bob": 2 * n}
    store.remove()


def test_since_a_checkpoint(spark):
    events = spark.createDataFrame([("a", f"x{i:05d}", "t", None, "{}") for i in range(2500)], "actor string, action string, target_type string, target_id string, meta string")
    store = Store(spark, "tests")
    log = store.write(audit.chained(events, 0, "", ["action"]), "log")
    known = store.write(audit.checkpoint(log), "known")
    assert [tuple(r)[:2] for r in known.orderBy("level", "range").collect()] == [(0, 0), (0, 1), (1, 0)]
    said = lambda at, column, value: tuple(audit.verify_since(log.withColumn(column, F.when(F.col("seq") == at, F.lit(value)).otherwise(F.col(column))), known).select("ok", "checked", "first_broken_seq", "before").first())
    assert said(-1, "meta", "") == (True, 501, None, None)
    assert said(1500, "meta", '{"n": 1}') == (False, 1000, 1000, True) and said(7, "entry_hash", "0") == (False, 999, 0, True)
    assert said(2100, "meta", '{"n": 1}') == (False, 501, 2100, False)
    assert audit.verify_since(log.where("seq <> 1200"), known).first()["before"]
    nothing = audit.checkpoint(log.limit(0))
    assert nothing.count() == 0 and audit.verify_since(log, nothing).first()["ok"]
    store.remove()
