"""Logs packed into few files."""


def test_packed_logs_are_whole_in_few_files(spark, tmp_path):
    from evidentia.sources.files import read_logs, write_logs

    rows = [(i, f"[INFO] {i}\r\n\n\"tab\t\" é\x0b{{}}\n") for i in range(200)] + [(None, "none\n"), (7, ""), (7, "twice\n")]
    write_logs(spark.createDataFrame(rows, "run_id long, log string").coalesce(2), f"{tmp_path}/logs")
    assert len(list((tmp_path / "logs").glob("**/part-*"))) == 2
    got = read_logs(spark, f"{tmp_path}/logs", packed=True).collect()
    assert sorted((str(r.run_id), r.log) for r in got) == sorted((str(i), log) for i, log in rows)
