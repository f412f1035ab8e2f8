from quire.streaming.landing import land, read_landing


def test_landing_is_incremental(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def arrive(**files):
        for name, text in files.items():
            (source / f"{name}.json").write_text(text, encoding="utf-8")
        for q in land(read_landing(spark, str(source)), out, state):
            q.awaitTermination(60)

    arrive(a='{"@id":"a"}', b="[1]", c="oops")
    arrive(d='{\n"@id":"d"}')
    good = spark.read.parquet(out + "/accepted").collect()
    bad = spark.read.parquet(out + "/rejected").collect()
    assert {(r["request_id"], r["payload"]) for r in good} == {("a", '{"@id":"a"}'), ("d", '{\n"@id":"d"}')}
    assert {(r["request_id"], r["reason"]) for r in bad} == {("b", "not an object"), ("c", "not JSON")}
