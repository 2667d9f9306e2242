import corpus_pipeline
import pytest

from geopanel.llm import packing, paragraphs, simhash_gray


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, each read again from files."""
    sf_dir = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs, after
        docs = after
    return out


def test_columns_and_order(stages):
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "secret_scans", "packing"]
    first = stages["toxicity"][0].columns
    assert all(after.columns == first for name, (_, after) in stages.items() if name != "packing")


def test_near_dedup_keeps_one_of_each_component(stages):
    before, after = stages["near_dedup"]
    group = {r.doc_id: r.component_id for r in simhash_gray.near_duplicates(before).collect()}
    kept = [r.doc_id for r in after.collect()]
    assert sorted(kept) == sorted(set(group.values()))


def test_repeats_are_gone(stages):
    before, after = stages["substring_dedup"]
    cut = {r.doc_id for r in paragraphs.repeated(before).where("removed").collect()}
    old, new = ({r.doc_id: (r.text, r.n_chars) for r in x.collect()} for x in (before, after))
    assert {i for i in new if new[i][0] != old[i][0]} <= cut and set(old) - set(new) <= cut
    assert all(n == len(t) for t, n in new.values())


def test_run_gives_the_last_stage_s_rows(spark, stages):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(rows) == key(stages["packing"][1])


def test_stages_take_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name
        stage(spark, docs, "/root/testdata/sf0.001").collect()
    assert packing.pieces(docs, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"), 1024, 2).count() >= len(odd_rows)


def test_texts_with_one_identifier_are_told_apart(spark, documents, odd_rows):
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, documents(odd_rows), "").collect()]
    assert sorted(t for i, t in left if i == 5) == sorted(t for i, t in odd_rows if i == 5)
    assert left.count((1, "a b c d e")) == 1
    old, new = " ".join(f"u{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, documents([(3, old), (7, new), (7, old)]), "").collect()]
    assert sorted(left) == [(3, old), (7, new)]


def test_texts_that_share_an_identifier_are_cut_on_their_own(spark, documents):
    passage, other = " ".join(f"ü{i}" for i in range(80)), " ".join(f"ßo{i * i}" for i in range(150))
    rows = [(1, passage), (5, "before it " + passage), (5, other), (6, other + " and more"), (None, passage), (7, None)]
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.cut_repeats(spark, documents(rows), "").collect()), key=str)
    assert (5, other) in left and (1, passage) not in left and (None, passage) in left and (7, None) in left
    assert {t for i, t in left if i == 5} == {"before it " + passage, other}  # they come before the other identifiers
    assert [t for i, t in left if i == 6] == ["and more"]


@pytest.mark.parametrize("stage", ["drop_toxic", "drop_near_copies", "cut_repeats", "hide_secrets"])
def test_stages_keep_columns_with_the_names_of_helpers(spark, stage):
    names = ["predicted", "kept", "own", "row", "cut", "cut_id", "key", "gaps", "found", "values", "Row", "least", "most", "ident"]
    docs = spark.createDataFrame([(1, "a b c d e", *names[:10], *names[11:])], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names if n != "Row"))
    assert getattr(corpus_pipeline, stage)(spark, docs, "/root/testdata/sf0.001").collect() == docs.collect()


@pytest.mark.parametrize("stage", ["drop_toxic", "drop_near_copies", "cut_repeats", "hide_secrets", "pack"])
def test_stages_take_empty_tables(spark, documents, stage):
    assert getattr(corpus_pipeline, stage)(spark, documents([]), "/root/testdata/sf0.001").collect() == []
