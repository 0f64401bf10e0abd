"""Batches that are saved once, whatever fails."""

import pytest

from defectlake.operators import ledger

ROWS = "run_id string, task_id string, iteration_number int, payload string, created_at int"
FIRST = [("a", "T1", 1, "old", 1), ("a", "T1", 2, "old", 1), ("b", "T1", 1, "old", 1)]
SECOND = [("a", "T1", 2, "new", 2), ("c", "T2", 1, "new", 2)]
MERGED = {("a", 1, "old"), ("a", 2, "new"), ("b", 1, "old"), ("c", 1, "new")}


def _rows(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def _saved(spark, path):
    rows = [(r.run_id, r.iteration_number, r.payload) for r in ledger.saved_iterations(_rows(spark, []), path).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_a_batch_counts_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert _saved(spark, path) == set()
    assert ledger.save_batch(_rows(spark, FIRST), path, "1") and ledger.save_batch(_rows(spark, SECOND), path, "2")
    assert _saved(spark, path) == MERGED
    assert not ledger.save_batch(_rows(spark, FIRST[:1]), path, "1") and _saved(spark, path) == MERGED
    ledger.compact(_rows(spark, []), path)
    assert _saved(spark, path) == MERGED and not ledger.save_batch(_rows(spark, SECOND), path, "2")


def test_a_failure_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    ledger.save_batch(_rows(spark, FIRST), path, "1")
    before = _saved(spark, path)
    with monkeypatch.context() as m:
        m.setattr(ledger, "_swap", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ledger.save_batch(_rows(spark, SECOND), path, "2")
    assert _saved(spark, path) == before
    assert ledger.save_batch(_rows(spark, SECOND), path, "2") and _saved(spark, path) == MERGED


def test_a_half_written_manifest_is_passed_over(spark, tmp_path):
    path = tmp_path / "t"
    ledger.save_batch(_rows(spark, FIRST), str(path), "1")
    (path / "manifests" / "2").write_text('{"folders": [')
    assert len(_saved(spark, str(path))) == 3
    assert ledger.save_batch(_rows(spark, SECOND), str(path), "2") and _saved(spark, str(path)) == MERGED


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    real, done = ledger.create, []

    def create(*args):
        if not done:  # another writer comes first
            done.append(True)
            assert ledger.save_batch(_rows(spark, SECOND), path, "2")
        return real(*args)

    monkeypatch.setattr(ledger, "create", create)
    assert ledger.save_batch(_rows(spark, FIRST), path, "1") and _saved(spark, path) == MERGED
