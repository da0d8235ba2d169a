import corpus_pipeline
from tests.conftest import SF
from tests.llm.conftest import rng_text
from tests.llm.test_packing import plain_ids


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_planted_cases(spark):
    """Exact and near copies, a benchmark passage, junk and repeated lines go; clean documents stay."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    line = "a passage of many words that very many of the documents in this corpus repeat again"
    say = lambda seed, n: rng_text(seed, n, 10**6).translate(str.maketrans("0123456789", "etaoinshrd"))
    clean = [(i, say(i, 200)) for i in range(12)]
    near = clean[4][1].split()
    near[40] = "other"
    rows = [*clean, (50, clean[3][1]), (51, " ".join(near)), (52, f"{say(70, 80)} {bench} words after"), (53, "1234 !!! 5678"), (54, None), *[(60 + i, say(900 + i, 60) + "\n" + line) for i in range(6)]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r.doc_id for r in docs.collect()})
    assert seen[0] == {i for i, _ in rows} - {53, 54}
    assert seen[1] == seen[0]
    assert {r.doc_id for r in docs.where(f"text like '%{line}%'").collect()} == {65}
    assert seen[2] == seen[1] - {50, 51}
    assert seen[3] == seen[2] - {52}
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == seen[3]


def test_run_packs_what_is_left(spark):
    from tokenizers import Tokenizer

    from strandtally.llm.packing import byte_bpe_path

    rows = corpus_pipeline.run(spark, SF).toPandas()
    source = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(rows.doc_id) < {r.doc_id for r in source.select("doc_id").collect()}
    tokenizer = Tokenizer.from_file(byte_bpe_path())
    whole = {r.doc_id: len(plain_ids(r.text, tokenizer)) for r in source.collect()}
    got = rows.groupby("doc_id").length.sum()
    assert (got == rows.groupby("doc_id").doc_tokens.first()).all()
    assert all(n <= whole[i] for i, n in got.items())
