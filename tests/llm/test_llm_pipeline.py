import __spark_entry__
import corpus_pipeline
import public_tokenizers
import test_llm_decontaminate as leaks
import test_llm_ngram_join as near
import test_llm_paragraphs as lines
from tokenizers import Tokenizer

from wavespark.llm.common import saved
from wavespark.llm.ngram_join import link_documents

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination",
        "BPE encoding and decoding"]
    steps = [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), "stage")
        rows = docs.collect()
        steps.append({r.doc_id: r for r in rows})
        assert len(rows) == len(steps[-1])
        if name != "BPE encoding and decoding":
            assert docs.columns == COLUMNS
    raw, good, single, cut, clean, coded = steps
    # quality: labelled good documents stay, all that stay are unchanged
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(raw[d] == r for d, r in good.items())
    assert sum(d in good for d, q in label.items() if q) >= 0.97 * sum(map(bool, label.values()))
    # near duplicates: the smallest id of each component by all pairs
    parts = near.brute([(d, r.text) for d, r in good.items()], 5, 80, 100)
    assert set(single) == {c if n else d for d, n, c in parts} and all(good[d] == r for d, r in single.items())
    # paragraphs: no repeated long line is left, clean texts are as they were
    gone = lines.brute_lines(sorted((d, r.text) for d, r in single.items()))
    assert set(cut) == set(single)
    for d, at in gone:
        assert single[d].text.split("\n")[at] not in cut[d].text.split("\n")
    assert all(cut[d].n_chars == len(cut[d].text) for d in cut if cut[d].text != single[d].text)
    # benchmark: what goes holds an item, what stays does not
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flat = [" ".join(leaks.words(t)) for t in items]
    for d, r in cut.items():
        t = " " + " ".join(leaks.words(r.text)) + " "
        assert not (d in clean and any(f" {b} " in t for b in flat))
        if d not in clean:
            assert any(leaks.brute(r.text, b) for b in items)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, r in coded.items():
        ids = library.encode(clean[d].text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert set(coded) == set(clean)
    whole = __spark_entry__.queries()["pipeline"](spark, SF)
    assert {r.doc_id: r.ids for r in whole.collect()} == {d: r.ids for d, r in coded.items()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0),
                                  (2, "a b", None, "s", 3), (3, "word " * 50_000, "en", None, None)],
                                 spark.read.parquet(f"{SF}/documents.parquet").schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = saved(stage(spark, frame, SF), "stage")
        frame.count()


def test_near_duplicates_leave_no_links(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = saved(corpus_pipeline.near_duplicates(spark, docs, SF), "left")
    assert link_documents(left).where("doc_id <> component_id").count() == 0
