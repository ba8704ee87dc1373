import brute
import corpus_pipeline

ROOT = "/root/testdata/sf0.01"


def _texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    seen = _texts(docs)
    for (name, stage), least in zip(corpus_pipeline.STAGES[:-1], (990, 900, 700, 700), strict=True):
        out = stage(spark, docs, ROOT)
        assert sorted(out.columns) == sorted(corpus_pipeline.COLUMNS)
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = _texts(docs)
        assert len(got) == docs.count() >= least
        if name == "language ID":
            assert got == {k: t for k, t in seen.items() if any(c.isalpha() for c in t or "")}
        elif name == "line dedup":
            plain = brute.dedup_lines(list(seen.items()))
            assert got == {k: t for k, (_, n, t) in plain.items() if n == 0 or t.strip(" ")}
        elif name == "near-dedup":
            found = brute.near_duplicates(list(seen.items()))
            assert got == {k: t for k, t in seen.items() if found[k][1] == k}
        else:
            leaks = {k for k, t in seen.items() for b in bench if _shares(t, b) and brute.tile_coverage(t, b) >= 0.5}
            assert leaks
            assert got == {k: t for k, t in seen.items() if k not in leaks}
        seen = got
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, ROOT).collect()
    assert {r.doc_id for r in packed} == set(seen)
    assert len({r.sequence_id for r in packed}) == -(-sum(r.length for r in packed) // 4096)


def _shares(text, item):
    w, q = brute.words(text), brute.words(item)
    seeds = {tuple(q[i : i + 5]) for i in range(len(q) - 4)}
    return any(tuple(w[i : i + 5]) in seeds for i in range(len(w) - 4))


def test_run_is_the_registered_query(spark):
    from millrace.llm import catalog

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID"
    assert catalog.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, ROOT).count() == 0


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long), (1, long.upper()), (1, long), (1, "quite another text of the same document"), (2, long), (3, "a b c d e f g"), (None, long), (None, long), (4, " "), (4, " ")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, ROOT)
    assert got.columns == corpus_pipeline.COLUMNS
    want = [(1, long.upper()), (1, "quite another text of the same document"), (3, "a b c d e f g"), (None, long), (None, long), (4, " "), (4, " ")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
