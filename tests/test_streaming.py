"""A stream of files is masked as a table of the same lines is."""

from redactrix.streaming import masking


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ИНН: 123456789012\nтекст\n")
    out = masking.mask_stream(masking.read_lines(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("masked").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["core"] for r in spark.table("masked").collect()) == ["ИНН: [INN]", "текст"]
