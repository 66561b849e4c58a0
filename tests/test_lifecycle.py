"""Manifest of the index, deletion in steps, stored embeddings."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tracewell.functions.vectors import hash_counts
from tracewell.operators.deletion import STEPS, Deletion
from tracewell.sources.artifacts import ArtifactFolder
from tracewell.sources.embeddings import EmbeddingStore
from tracewell.sources.index import ChunkIndex

META = {"representation_level": 0, "model_id": "m", "model_sha256": "s", "dimension": 8}
CHUNKS = "tenant_id string, case_id string, document_id string, chunk_id string, embedding_text string"


def chunks(spark, rows):
    return spark.createDataFrame(rows, CHUNKS).withColumn("vector", hash_counts("embedding_text"))


@pytest.fixture
def index(spark, tmp_path):
    made = ChunkIndex(spark, str(tmp_path / "ix"), buckets=2)
    made.create(chunks(spark, [("t", "c", f"d{k}", "1", f"text number {k}") for k in range(6)] + [("t", "other", "z", "1", "far away")]), META)
    return made


def queries(spark):
    return spark.createDataFrame([(1, "text number 3")], "query_id int, text string").withColumn("vector", hash_counts("text"))


def files(index, case):
    return sorted(glob.glob(f"{index.path}/data/tenant_id=t/case_id={case}/bucket=*/*.parquet"))


SCOPE = {"tenant_id": "t", "case_id": "c"}


def test_a_whole_index_is_searched_after_every_write(spark, index):
    index.verify()
    index.upsert(chunks(spark, [("t", "c", "d1", "1", "new"), ("t", "c", "d9", "1", "more")]), META)
    index.verify()
    index.upsert(chunks(spark, [("t", "c", "d2", "1", "new")]).withColumn("page", F.lit(3)), META)
    index.verify()
    assert index.delete(tenant_id="t", case_id="c", document_id="d3") == 1
    index.verify()
    assert index.delete(tenant_id="t", case_id="other") == 1
    index.verify()
    assert index.search(queries(spark), SCOPE, k=3).count() == 3


def test_a_removed_file_fails_with_its_name(spark, index):
    gone = files(index, "c")[0]
    os.remove(gone)
    spark.catalog.refreshByPath(f"{index.path}/data")
    with pytest.raises(ValueError, match=f"{os.path.basename(gone)} is missing"):
        index.search(queries(spark), SCOPE)
    index.search(queries(spark), {"tenant_id": "t", "case_id": "other"})  # only what is read is checked


def test_an_altered_file_fails_with_its_name(spark, index, tmp_path):
    changed = files(index, "c")[0]
    rows = spark.createDataFrame(spark.read.parquet(changed).collect(), spark.read.parquet(changed).schema)
    rows.withColumn("embedding_text", F.lit("other words")).coalesce(1).write.parquet(str(tmp_path / "new"))
    os.replace(glob.glob(str(tmp_path / "new" / "*.parquet"))[0], changed)
    for crc in glob.glob(os.path.join(os.path.dirname(changed), ".*.crc")):
        os.remove(crc)
    spark.catalog.refreshByPath(f"{index.path}/data")
    with pytest.raises(ValueError, match=f"{os.path.basename(changed)} is altered"):
        index.search(queries(spark), SCOPE)


def test_an_unknown_file_is_told(spark, index, tmp_path):
    known = files(index, "c")[0]
    extra = os.path.join(os.path.dirname(known), "part-extra.parquet")
    with open(known, "rb") as a, open(extra, "wb") as b:
        b.write(a.read())
    spark.catalog.refreshByPath(f"{index.path}/data")
    assert [(r.file, r.said) for r in index.corrupt_files(SCOPE).collect()] == [("part-extra.parquet", "unknown")]


class Breaks(Deletion):
    """Fails once behind or before the work of a step."""

    step, behind = None, True

    def _step(self, name, scope):
        found = super()._step(name, scope) if self.behind or name != self.step else None
        if name == self.step:
            self.step = None
            raise RuntimeError("lost")
        return found


@pytest.mark.parametrize("behind", [True, False])
@pytest.mark.parametrize("step", STEPS)
def test_a_deletion_that_failed_at_any_step_ends_the_second_time(spark, index, tmp_path, step, behind):
    folder = ArtifactFolder(spark, str(tmp_path / "files"))
    scope = {**SCOPE, "document_id": "d1"}
    os.makedirs(folder.place(scope))
    os.makedirs(folder.place({**SCOPE, "document_id": "d2"}))
    deletion = Breaks(index, folder, str(tmp_path / "log"))
    deletion.step, deletion.behind = step, behind
    assert deletion.run(**scope) == "FAILED" == deletion.status(scope)
    if STEPS.index(step) < STEPS.index("ARTIFACTS"):
        assert folder.present(scope)  # files outlive vectors that may remain
    # Another process, which only has the log.
    again = Deletion(index, folder, str(tmp_path / "log"))
    assert again.run(**scope) == "DELETED" == again.status(scope)
    assert index.count(scope) == 0 and not folder.present(scope) and folder.present({**SCOPE, "document_id": "d2"}) and index.count() == 6
    steps = [r.status for r in again.history(scope).collect()]
    assert steps.count("FAILED") == 1 and all(steps.count(s) == 1 for s in ("DELETING", "VECTORS", "ARTIFACTS", "DELETED"))
    before = len(steps)
    assert again.run(**scope) == "DELETED" and again.history(scope).count() == before


def test_vectors_that_remain_keep_the_files(spark, index, tmp_path, monkeypatch):
    folder = ArtifactFolder(spark, str(tmp_path / "files"))
    os.makedirs(folder.place(SCOPE))
    deletion = Deletion(index, folder, str(tmp_path / "log"))
    monkeypatch.setattr(index, "delete", lambda **scope: 0)
    assert deletion.run(**SCOPE) == "FAILED" and folder.present(SCOPE)
    last = deletion.history(SCOPE).collect()[-1]
    assert last.chunks == 6 and "6 chunks remain" in last.error
    monkeypatch.undo()
    assert deletion.run(**SCOPE) == "DELETED" and not folder.present(SCOPE)
    with pytest.raises(ValueError):
        deletion.run(document_id="d1")


def test_stored_embeddings_are_joined_in_place(spark, tmp_path):
    name = "test_embeddings"
    store = EmbeddingStore(spark, name, str(tmp_path / "store"), buckets=8)
    texts = spark.createDataFrame([(k, f"text {k % 5}") for k in range(20)] + [(99, None)], "id int, text string")
    counted = spark.sparkContext.accumulator(0)

    def encode(column):
        return hash_counts(column)

    try:
        store.add(texts.where("id < 3"), "text", "p1", encode)
        store.add(texts, "text", "p1", encode)
        store.add(texts, "text", "p2", encode)
        assert store.rows().groupBy("profile").count().orderBy("profile").collect() == [("p1", 5), ("p2", 5)] and counted.value == 0
        assert store.missing(texts, "text", "p1").count() == 0
        rows = {r.id: r.vector for r in store.vectors(texts, "text", "p1", "id").collect()}
        assert len(rows) == 21 and rows[99] is None and rows[3] == rows[8]
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            for frame in (store.missing(texts, "text", "p1"), store.vectors(texts, "text", "p1", "id")):
                plan = frame._jdf.queryExecution().executedPlan().toString()
                stored = plan[plan.index("Join"):]
                # One exchange, of the asking side; none above the scan of the table.
                side = [x for x in stored.split("\n") if "Exchange" in x or "FileScan" in x or "Scan ExistingRDD" in x or "LocalTableScan" in x]
                at = next(k for k, x in enumerate(side) if "FileScan" in x)
                assert "Bucketed: true" in side[at] and "Exchange" not in side[at - 1], plan
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_changes_leave_no_copies(spark, index):
    """What an upsert and a deletion write down on their way is gone afterwards, also when they fail."""
    from tracewell.session import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    held = lambda: {os.path.join(at, n) for at, _, names in os.walk(folder) for n in names}
    before = held()
    index.upsert(chunks(spark, [("t", "c", "d3", "1", "new text"), ("t", "c", "d9", "1", "more")]), META)
    index.delete(tenant_id="t", case_id="c", document_id="d1")
    with pytest.raises(ValueError, match="duplicate"):
        index.upsert(chunks(spark, [("t", "c", "d4", "1", "once"), ("t", "c", "d4", "1", "twice")]), META)
    assert held() == before
    index.verify()
    said = {(r["document_id"], r["embedding_text"]) for r in index.read().where("case_id = 'c'").collect()}
    assert said == {("d0", "text number 0"), ("d2", "text number 2"), ("d3", "new text"), ("d4", "text number 4"), ("d5", "text number 5"), ("d9", "more")}
