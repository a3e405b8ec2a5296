from gridquill.cli import main, print_rows, read


def test_convert_and_read(spark, tmp_path, capsys):
    samples = spark.createDataFrame([("m", "a", 5, 1.0), ("m", "b", 7, 2.0), ("n", None, 9, 3.0)], "__name__ string, job string, ts_ms long, value double")
    samples.write.parquet(f"{tmp_path}/s")
    main(["convert", f"{tmp_path}/s", f"{tmp_path}/out", "--labels", "__name__,job", "--files", "1"])
    main(["read", f"{tmp_path}/out/compact", "--metric", "m", "--columns", "job,__mint", "--text", f"{tmp_path}/text"])
    main(["read", f"{tmp_path}/out/compact", "--metric", "m"])
    assert "read: " in capsys.readouterr().out
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/text").collect()) == ["a 5", "b 7"]
    payloads = read(spark, f"{tmp_path}/out/compact", "n")
    assert [bytes(r[0]) for r in payloads.collect()] == [b"0:3.000"]
    print_rows(payloads, f"{tmp_path}/binary")
    assert [r.value for r in spark.read.text(f"{tmp_path}/binary").collect()] == ["MDozLjAwMA=="]
