import zlib

import corpus_pipeline
from tesserax.llm import mixing, runtime, secrets, toxicity
from tesserax.llm.runtime import finished
from test_mixing import slow as slow_mix
from test_jaccard import slow as slow_groups

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    model = toxicity.fit(*map(list, zip(*[(r[1], labels[r[0]]) for r in sorted(rows) if labels.get(r[0]) in (0, 1) and zlib.crc32(str(r[0]).encode()) % 5])))

    def stage(n, frame):
        out = corpus_pipeline.STAGES[n][1](spark, frame, SF)
        out.write.parquet(f"file:{tmp_path}/{n}")
        return spark.read.parquet(f"file:{tmp_path}/{n}")

    clean = stage(0, docs)
    want = [r for r in rows if model.probability(toxicity.document_margin(model, r[1])) < 0.5]
    assert clean.columns == columns and sorted(map(tuple, clean.collect())) == sorted(want)

    single = stage(1, clean)
    keep = set(slow_groups([(r[0], r[1]) for r in want]))
    assert sorted(map(tuple, single.collect())) == sorted(r for r in want if r[0] in keep)

    masked = stage(2, single)
    got = {r.doc_id: r for r in masked.collect()}
    scanner = secrets.Scanner()
    for r in single.collect():
        spans = sorted((s, e) for _, s, e in scanner.scan(r.text))
        text, at, end = "", 0, 0
        for s, e in spans:
            if s >= end:
                text += r.text[end:s] + secrets.MASK
            end = max(end, e)
        assert got[r.doc_id].text == text + r.text[end:] and got[r.doc_id].source == r.source

    mixed = stage(3, masked)
    want = slow_mix([(r.doc_id, r.text, r.lang, r.source) for r in got.values()], corpus_pipeline.MIX_SHARE_PERCENT, corpus_pipeline.MIX_EPOCHS, mixing.WEIGHTS, mixing.SEED)
    assert mixed.columns == columns and sorted(r.doc_id for r in mixed.collect()) == sorted(r[0] for r in want)

    packed = stage(4, mixed)
    assert sorted(r.doc_id for r in packed.where("piece = 0").collect()) == sorted(r.doc_id for r in mixed.collect())
    bins = {}
    for r in packed.collect():
        bins.setdefault(r.bin, []).append(r)
    assert all(sum(r.tokens for r in b) <= 2048 and len({r.doc_id for r in b}) == len(b) for b in bins.values())


def test_run_has_the_columns_of_the_last_stage_and_leaves_no_other_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda _: f"file:{tmp_path}/shared")
    spark.conf.set("spark.tesserax.ledger", f"file:{tmp_path}/ledger")
    try:
        out = corpus_pipeline.run(spark, SF)
        rows = out.count()
        assert out.columns == ["doc_id", "piece", "start", "tokens", "bin", "at"] and rows > 0
        left = {p.name.rsplit("-", 1)[0] for p in tmp_path.glob("shared/tesserax/*/*")}
        assert left == {"source_mixing", "sizes", "pieces"}
        scanned = spark.read.parquet(f"file:{tmp_path}/ledger").count()
        # A second run finds all blobs in the ledger.
        assert corpus_pipeline.run(spark, SF).count() == rows
        assert 0 < scanned == spark.read.parquet(f"file:{tmp_path}/ledger").count()
    finally:
        spark.conf.unset("spark.tesserax.ledger")


ODD = [
    (1, "plain words of a short text", "en", "s1"), (1, "plain words of a short text", "en", "s1"), (2, None, None, None), (None, "no id here", "de", "s2"), (None, None, None, None),
    (3, "", "en", "s1"), (4, "word " * 60_000, "fr", "s3"), (5, "secret=abcdefgh and more words follow here", "en", "s1"), (6, "\u4f60\u597d " * 50, "zh", "s1"),
]


def test_every_stage_takes_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), "v", -1) for i, t, lang, s in ODD], "doc_id long, text string, lang string, source string, n_chars long, blob string, bin int")
    for frame, least in ((docs, 1), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            columns = frame.columns
            frame, _ = finished(spark, lambda stage=stage, frame=frame: stage(spark, frame, SF), name)
            assert name == "best_fit_packing" or frame.columns == columns
            assert frame.count() >= least
            if name == "secret_scans" and least:
                assert {r.text for r in frame.where("doc_id = 5").collect()} == {"[SECRET] and more words follow here"}
                assert frame.where("doc_id = 1").count() == 1 and frame.where("text is null").count() + frame.where("text = ''").count() == 1
