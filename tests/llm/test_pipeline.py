from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from galleon.llm import decontaminate, quality_rules
from galleon.llm.queries import END, tokenizer_path

from .test_decontaminate import edit
from .test_jaccard_join import brute as groups
from .samples import WORD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        result = stage(spark, docs, SF)
        if name != "sstable_output":
            assert result.columns == columns
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append([r.asDict() for r in docs.collect()])
    return [[r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], *out]


def test_quality_keeps_what_the_judge_keeps(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in stages[1]} == kept and len(stages[1]) == len(kept)
    assert 0 < len(kept) < len(stages[0])


def test_one_of_each_group_stays(stages):
    found = groups([(r["doc_id"], r["text"]) for r in stages[1]])
    assert {r["doc_id"] for r in stages[2]} == {c for _, _, c in found}


def test_contaminated_documents_go(spark, stages):
    bench = [WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in stages[3]}
    for r in stages[2]:
        words = WORD.findall(r["text"].lower())
        far = [edit(x, words) for x in bench] if len(words) < 400 else [0 if " ".join(x) in " ".join(words) else 99 for x in bench]
        if r["doc_id"] in kept:
            assert 0 not in far
        else:
            assert any(f <= int(decontaminate.EDITS * len(x)) for f, x in zip(far, bench, strict=True)) or len(words) >= 400


def test_mixing_drops_nothing_and_bounds_repeats(stages):
    copies = Counter(r["doc_id"] for r in stages[4])
    assert set(copies) == {r["doc_id"] for r in stages[3]} and max(copies.values()) <= 2
    assert {tuple(sorted(r.items())) for r in stages[4]} == {tuple(sorted(r.items())) for r in stages[3]}


def test_output_holds_every_copy(stages):
    import zlib

    tok = Tokenizer.from_file(tokenizer_path())
    digest = lambda t: zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [END], "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in stages[5]) == Counter((r["doc_id"], digest(r["text"])) for r in stages[4])
    at = 0
    for r in sorted(stages[5], key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_awkward_rows_go_through(spark, tmp_path):
    """Null and empty texts, null and repeated ids, ties and a very long text; then a table without rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").limit(40)
    text = some.where("length(text) > 400").first()["text"]
    odd = [(None, text, "en", "s", 1), (9001, None, "en", None, None), (9002, "", None, "s", 0), (9003, text, "en", "s", 1), (9003, text, "en", "s", 1), (9003, text + " and more of it", "fr", "t", 2), (9004, (text + " ") * 300, "en", "s", 3)]
    for name, rows in (("odd", some.union(spark.createDataFrame(odd, docs.schema))), ("none", docs.limit(0))):
        sf = str(tmp_path / name)
        rows.write.parquet(f"{sf}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        at = 0
        for r in sorted(out, key=lambda r: (r["start"], r["n_tokens"])):
            assert r["start"] == at and r["n_tokens"] >= 1
            at += r["n_tokens"]
        assert (len(out) > 20) == (name == "odd")
        if name == "odd":
            assert None in {r["doc_id"] for r in out} and not {9001, 9002} & {r["doc_id"] for r in out}
