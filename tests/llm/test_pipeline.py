import shutil

import pytest
from test_jaccard import brute
from test_models import brute_hits

import corpus_pipeline as P
from parchment.llm.language import Parser, train, training_sample
from parchment.llm.tokens import token_ids, tokenizer_path
from parchment.llm.toxicity import Reader, Restorer, learn

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

def test_stages_keep_columns_and_what_is_clean(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        kept = {r.doc_id for r in out.collect()}
        assert kept <= ids and len(kept) > 0.6 * len(ids), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name

def test_run_packs_what_the_stages_kept(spark, sf):
    out = P.run(spark, sf).collect()
    assert len({r.sequence_id for r in out}) >= 1 and all(r.length > 0 for r in out)
    assert [name for name, _ in P.STAGES] == ["toxicity", "language", "near duplicates", "decontamination", "packing"]

def test_every_stage_against_brute_force(spark, sf):
    """Each stage's rows are those that a plain loop over its input keeps; the columns are those of its input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    counts, known = learn(docs, labels)
    reader = Reader(Restorer(counts), known)
    clean = P.toxicity(spark, docs, sf)
    assert clean.columns == docs.columns and ids(clean) == sorted(d for d, t in rows(docs) if reader.score(t) < 0.3)
    parser = Parser(train(training_sample(clean)))
    spoken = P.language(spark, clean, sf)
    assert spoken.columns == docs.columns and ids(spoken) == sorted(d for d, t in rows(clean) if parser.predict([t])[0][0] != "und")
    single = P.near_duplicates(spark, spoken, sf)
    texts = rows(spoken)
    assert single.columns == docs.columns and ids(single) == sorted({lowest for _, n, lowest in brute(texts) if n} | {d for d, n, _ in brute(texts) if not n})
    sound = P.decontamination(spark, single, sf)
    hits = {d: brute_hits(t, items)[:2] for d, t in rows(single)}
    assert sound.columns == docs.columns and ids(sound) == sorted(d for d, (n, hit) in hits.items() if not (hit > 0 and 20 * hit >= n))
    packed = P.packing(spark, sound, sf).collect()
    tokens = token_ids(tokenizer_path())
    assert {r.doc_id: r.doc_tokens for r in packed} == {d: len(tokens.ids(t)) // 4 + 1 for d, t in rows(sound)}
    at: dict[int, int] = {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0)
        at[r.doc_id] = r.start + r.length
    assert at == {r.doc_id: r.doc_tokens for r in packed}
    ends: dict[int, int] = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length

@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11)]])
def test_nulls_repeats_and_empty_tables(spark, sf, tmp_path, rows):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as uid", "'x' as toxic", "2 as kept_uid2", "'y' as spans")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == ({2} if rows else set())
