"""The index of known addresses: whole answers, few buckets read, nothing of it shuffled."""

import hashlib

import pytest
from pyspark.sql import functions as F

from listwright.operators import address_index
from listwright.operators.address_index import AddressIndex
from listwright.streaming.ingest import Paths, StreamConfig, address_index as open_index, ingest_batch, last_id, stored
from test_streaming import CONFIG, land, paths_in, remotive


def hashes(spark, *names):
    return spark.createDataFrame(
        [(None if n is None else hashlib.sha256(str(n).encode()).hexdigest(),) for n in names], "dedupe_hash string"
    )


def name_of(spark, names):
    return {hashlib.sha256(str(n).encode()).hexdigest(): n for n in names}


def found(index, spark, names):
    by_hash = name_of(spark, names)
    return sorted((by_hash[r["dedupe_hash"]], r["batch_id"]) for r in index.lookup(hashes(spark, *names)).collect())


def plan_of(df, capfd):
    capfd.readouterr()
    df.explain("formatted")
    return capfd.readouterr().out


@pytest.mark.parametrize("named", [1_000, 2])
def test_lookup(spark, tmp_path, monkeypatch, named):
    """The same answer by name and by join."""
    monkeypatch.setattr(address_index, "NAMED", named)
    index = AddressIndex(spark, str(tmp_path / "index"), 8)
    assert found(index, spark, [1, 2, 3]) == []
    index.append(hashes(spark, 1, 2, 2, None, 3), 0)
    index.append(hashes(spark, 4, 5), 1)
    index.append(hashes(spark, 4, 5, 6), 1)  # an attempt that was cut short, run again
    assert found(index, spark, [1, 4, 6, 7, 9]) == [(1, 0), (4, 1), (6, 1)]
    assert index.rows().count() == 6
    assert index.lookup(hashes(spark, None)).collect() == []
    # Another session's view, and the same after compaction.
    assert found(AddressIndex(spark, str(tmp_path / "index"), 8), spark, [2, 5, 8]) == [(2, 0), (5, 1)]
    index.compact()
    assert index.version == 1 and index.rows().count() == 6
    reopened = AddressIndex(spark, str(tmp_path / "index"), 8)
    assert reopened.version == 1
    assert found(reopened, spark, [1, 4, 6, 7, 9]) == [(1, 0), (4, 1), (6, 1)]
    reopened.append(hashes(spark, 7), 2)
    assert found(reopened, spark, [6, 7]) == [(6, 1), (7, 2)]


@pytest.fixture
def a_task_per_file(spark):
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    yield
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_only_the_buckets_of_the_batch_are_read(spark, tmp_path, capfd, a_task_per_file):
    index = AddressIndex(spark, str(tmp_path / "index"), 32)
    index.append(hashes(spark, *range(500)), 0)
    assert index.rows().rdd.getNumPartitions() == 32
    assert index.lookup(hashes(spark, 3)).rdd.getNumPartitions() == 1
    assert index.lookup(hashes(spark, 3, 4, 5)).rdd.getNumPartitions() <= 3
    plan = plan_of(index.lookup(hashes(spark, 3)), capfd)
    assert "Exchange" not in plan and "Join" not in plan


def test_the_index_is_not_shuffled(spark, tmp_path, monkeypatch, capfd):
    """A batch too large to be named: only its own digests are dealt into the buckets."""
    monkeypatch.setattr(address_index, "NAMED", 10)
    index = AddressIndex(spark, str(tmp_path / "index"), 4)
    index.append(hashes(spark, *range(300)), 0)
    plan = plan_of(index.lookup(hashes(spark, *range(200))), capfd)
    tree = plan.split("\n\n")[0]
    assert tree.count("Exchange") == 1 and "BroadcastExchange" not in tree
    scan = next(part for part in plan.split("\n\n") if "Scan parquet" in part and "Bucketed:" in part)
    assert "Bucketed: true" in scan
    # The one exchange lies above the batch's digests, not above the scan of the index.
    assert tree.index("Scan parquet") < tree.index("Exchange") or tree.index("Exchange") > tree.index("Join")


def test_compaction_leaves_one_file_per_bucket(spark, tmp_path):
    index = AddressIndex(spark, str(tmp_path / "index"), 4)
    for batch in range(5):
        index.append(hashes(spark, *range(batch * 50, batch * 50 + 60)), batch)
    # Ten addresses of each batch but the first were stored by the one before.
    assert found(index, spark, [55]) == [(55, 0), (55, 1)]
    index.compact()
    files = list((tmp_path / "index" / "v1").glob("*.parquet"))
    assert len(files) == 4
    assert found(index, spark, [55, 259]) == [(55, 0), (259, 4)]


def test_hot_address(spark, tmp_path):
    """One address in most rows of a batch is one row of the index."""
    index = AddressIndex(spark, str(tmp_path / "index"), 4)
    index.append(spark.range(5_000).select(F.when(F.col("id") % 3 > 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("dedupe_hash")), 0)
    assert index.rows().count() == 1667 + 1


def test_older_tables_get_an_index(spark, tmp_path):
    """A listing table from before the index: its addresses are known, its ids go on."""
    paths = paths_in(tmp_path)
    landing = land(spark, paths.landing, [(1, "remotive", 200, remotive(1, 2))])
    ingest_batch(landing, 0, paths, CONFIG)
    older = Paths(paths.landing, str(tmp_path / "older"), str(tmp_path / "older-runs"), paths.checkpoint)
    stored(spark, paths.listings).write.partitionBy("batch_id", "source").parquet(older.listings)
    ingest_batch(land(spark, paths.landing, [(2, "remotive", 200, remotive(2, 3))]), 1, older, CONFIG)
    assert sorted((r.id, r.url) for r in stored(spark, older.listings).collect()) == [
        (1, "https://j.test/1"), (2, "https://j.test/2"), (3, "https://j.test/3")]
    assert open_index(spark, older).rows().count() == 3


def test_crash_between_rows_and_log(spark, tmp_path):
    """Rows and addresses are written, the log is not: the batch run again stores the same rows under the same ids."""
    paths = paths_in(tmp_path)
    ingest_batch(land(spark, paths.landing, [(1, "remotive", 200, remotive(1))]), 0, paths, CONFIG)
    landing = land(spark, paths.landing, [(2, "remotive", 200, remotive(1, 2, 3))])
    ingest_batch(landing, 1, paths, CONFIG)
    before = sorted((r.id, r.url) for r in stored(spark, paths.listings).collect())
    import shutil

    shutil.rmtree(f"{paths.runs}/batch_id=1")
    ingest_batch(landing, 1, paths, CONFIG)
    assert sorted((r.id, r.url) for r in stored(spark, paths.listings).collect()) == before
    assert last_id(spark, paths.runs, 2) == 3
    assert last_id(spark, paths.runs, 1) == 1
    # An earlier batch run again does not see what later ones have stored.
    ingest_batch(land(spark, str(tmp_path / "again"), [(1, "remotive", 200, remotive(1))]), 0, paths, CONFIG)
    assert sorted((r.id, r.url) for r in stored(spark, paths.listings).collect()) == before
