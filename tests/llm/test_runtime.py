from tesserax.llm import runtime


def test_tables_go_to_the_shared_folder_and_are_swept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda _: f"file:{tmp_path}/shared")
    df = runtime.materialize(spark, spark.range(5), "five")
    assert df.count() == 5 and all(f"{tmp_path}/shared/tesserax/" in f for f in df.inputFiles())
    runtime.sweep(spark)
    assert not list((tmp_path / "shared" / "tesserax").iterdir())


def test_a_cluster_must_name_its_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: {"spark.checkpoint.dir": folder}.get(key) or default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    folder = "hdfs://shared/x/"
    assert runtime.shared_dir(Session) == "hdfs://shared/x"
    folder = None
    try:
        runtime.shared_dir(Session)
    except ValueError:
        return
    raise AssertionError("a cluster without a shared folder was accepted")
