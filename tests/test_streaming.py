from variorum.streaming.revisions import revision_changes


def test_revisions_do_not_depend_on_batches(spark, tmp_path):
    data = [(1, 1, "a\nb\nb"), (1, 2, "a\nb\nc"), (1, 3, "a\nb\nc"), (2, 1, "x"), (2, 2, None)]
    got = []
    for cuts in ([0, 5], [0, 2, 3, 5]):
        folder, at = tmp_path / f"in{len(cuts)}", f"q{len(cuts)}"
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            spark.createDataFrame(data[i:j], "doc_id long, revision long, text string").coalesce(1).write.parquet(f"file://{folder}/{k}")
        stream = spark.readStream.schema("doc_id long, revision long, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{folder}")
        q = revision_changes(stream).writeStream.format("memory").queryName(at).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c{at}").start()
        q.processAllAvailable()
        q.stop()
        got.append(sorted(map(tuple, spark.table(at).collect())))
    assert got[0] == got[1] == [(1, 2, 1, 1, 2), (2, 2, 0, 1, 0)]
