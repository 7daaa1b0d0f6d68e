"""The pipeline over a whole table, against each operator's rule applied in plain Python."""

import re
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece

import corpus_pipeline
from tests.llm.test_mixing import shared_out
from tests.llm.test_near_dedup import brute
from tidewater.llm import pii, quality
from tidewater.llm.shared import staged

SF = "/root/testdata/sf0.01"
SPACE = r"[^\x20\x09-\x0D]+"


def test_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = pq.read_table(f"{SF}/documents.parquet").to_pandas().set_index("doc_id")
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas().set_index("doc_id").quality
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name.replace(" ", "-"))
        kept.append({r.doc_id: r for r in docs.collect()} if name != "mixing" else docs.collect())
    good, unique, private, mix, ids = kept

    verdicts = quality.judge(pa.array(table.text.tolist()), quality.LineModel.load())[-1].to_pylist()
    assert set(good) == {i for i, v in zip(table.index, verdicts, strict=True) if v}
    long_enough = [i for i in labels.index if labels[i] == 1 and len(re.findall(SPACE, table.text[i])) >= 50]
    assert sum(i in good for i in long_enough) >= 0.99 * len(long_enough)

    assert set(unique) == set(brute([(i, r.text) for i, r in good.items()], 80).values())

    assert set(private) == set(unique)
    for i, r in private.items():
        base, added = pii.find_spans(pa.array([unique[i].text]), pii.SkipChain.load())
        assert r.text == pii.redact(unique[i].text, base[0] + added[0]) and r.n_chars == len(r.text)
        assert not pii.base_spans(r.text) or base[0]

    sizes, taken = defaultdict(int), defaultdict(int)
    for r in private.values():
        sizes[r.source] += len(re.findall(SPACE, r.text))
    for r in mix:
        assert r.text == private[r.doc_id].text
        taken[r.source] += len(re.findall(SPACE, r.text))
    largest = max(len(re.findall(SPACE, r.text)) for r in private.values())
    assert all(abs(taken[s] - t) <= largest for s, t in shared_out(sizes).items())

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(ids) == {r.doc_id for r in mix}
    assert all(ids[i].ids == library.encode(private[i].text) and ids[i].n_pieces == len(ids[i].ids) for i in ids)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
