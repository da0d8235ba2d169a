"""Tables in the shared folder, and their end."""

from strandtally import files, shared


def test_scratch_deletes_what_was_written_within(spark):
    kept = shared.new_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with shared.scratch():
        inner = shared.materialize(spark.range(5), "inner")
        paths = inner.inputFiles()
        assert inner.count() == 5
        shared.new_path(spark, "never written")
    assert paths and not any(files.exists(p) for p in paths)
    assert spark.read.parquet(kept).count() == 3
    shared.discard(shared._made.index(kept))
    assert kept not in shared._made


def test_shared_folder_of_a_local_session(spark):
    assert shared.shared_dir(spark) == shared.shared_dir(spark)
    assert shared.new_path(spark, "x") != shared.new_path(spark, "x")
