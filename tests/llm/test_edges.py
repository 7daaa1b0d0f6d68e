"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import chat_format, importance, license_scan, manifest, mixing, near_dedup, pii, quality, sentencepiece_codec, simhash, token_counts, url_filter

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"word{i % 977} and" for i in range(30_000))
GOOD = " ".join(f"clean{i} words" for i in range(60)) + "."
ROWS = [
    (1, GOOD, "en", "a", 1),
    (1, GOOD, "en", "a", 1),
    (2, GOOD, None, "a", None),
    (3, None, "en", None, 0),
    (4, "", "en", "b", 0),
    (5, " \t\n\r\n  ", "en", "b", 0),
    (None, GOOD + " more", "en", "b", 0),
    (None, None, None, None, None),
    (6, WORDS, "en", "c", 0),
    (7, "x" * 200_000, "en", "c", 0),
    (-8, "Ünï 你好 🙂 +1 (988) 555-2485 a.b@c.de 10.0.0.1, 4111 1111 1111 1111", "en", "c", 0),
    (2**62, "Copyright (c) 2024\nReleased under the MIT License.", "en", "c", 0),
    (8, "one two", "en", "c", 0),
]
CLASHES = ("kept", "size", "range", "cluster", "rid", "node", "ids", "digest", "spans", "ticket", "component_id", "n_tokens", "place", "side", "copy", "turn", "rule", "host", "verdict", "license", "target", "bound")

OPERATORS = {
    "license": license_scan.license_scan,
    "near": lambda d: near_dedup.near_duplicates(d, percent=85),
    "tokens": lambda d: token_counts.token_counts(d, BYTES),
    "mixing": mixing.mix_sources,
    "pieces": lambda d: sentencepiece_codec.encode_pieces(d, PIECES),
    "round_trip": lambda d: sentencepiece_codec.round_trip(d, PIECES),
    "pii": pii.find_pii,
    "simhash": simhash.document_fingerprints,
    "quality": quality.quality_rules,
    "importance": lambda d: importance.importance_ranks(d, d, percent=50),
    "manifest": manifest.verify_tampering,
}


def rows_of(df):
    return sorted(df.collect(), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row_whatever_it_holds(docs, name):
    plain = rows_of(OPERATORS[name](docs))
    assert len(plain) == len(ROWS)
    extra = docs.withColumns({c: F.lit(None).cast("string") for c in CLASHES if c not in docs.columns})
    assert rows_of(OPERATORS[name](extra)) == plain


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, docs, stage):
    name, function = stage
    extra = docs.withColumn("kept", F.lit(1)).withColumn("text_2", F.lit(None).cast("string"))
    out = function(spark, extra, "")
    if name != "sentencepiece":
        assert out.columns == list(corpus_pipeline.COLUMNS)
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert rows_of(out) == rows_of(function(spark, docs, ""))
    assert function(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


NAMES = ("row", "doc", "key", "slot", "byte", "maybe", "of", "of_doc", "of_key", "copies", "bound", "col", "_slot", "_doc", "_key", "_maybe", "_byte", "_spot", "_at", "_bits", "_time", "_of", "_copies", "_bound", "ticket", "n", "first", "digest")


@pytest.mark.parametrize("function", [near_dedup.drop_near_duplicates, mixing.mixed, pii.redact_pii, quality.keep_good], ids=lambda f: f.__name__)
def test_columns_of_any_name_keep_their_values(docs, function):
    named = docs.withColumns({c: F.concat(F.lit(c + " of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in NAMES})
    out = function(named)
    assert out.columns == named.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in NAMES)
    assert sorted(((r.doc_id, r.lang, r.n_chars) for r in rows), key=repr) == sorted(((r.doc_id, r.lang, r.n_chars) for r in function(docs).collect()), key=repr)


@pytest.mark.parametrize("zeros", [3, 5_000, 1_000_000])
def test_addresses_with_long_runs_of_zeros(spark, zeros):
    text = "x " + "0" * zeros + ".1.1.1 y " + "9" * zeros + ".1.1.1 z"
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.find_pii(table).head()
    assert found.n_ip == 1 and f"ip:2:{2 + zeros + 6}" in found.spans.split(",")
    assert pii.redact_pii(table).head().text.startswith("x <IP> y ")


def test_results_on_edges(docs):
    near = {(r.doc_id, r.n_shingles): r for r in OPERATORS["near"](docs).collect()}
    assert near[1, 116].component_id == near[2, 116].component_id == 1
    assert near[1, 116].kept and not near[2, 116].kept
    assert near[3, 0].kept and near[4, 0].kept and near[5, 0].component_id == 5
    assert near[8, 1].n_shingles == 1
    assert near[None, 117].component_id is None and near[None, 117].kept
    tokens = {r.doc_id: r for r in OPERATORS["tokens"](docs).collect() if r.doc_id is not None}
    assert (tokens[3].n_bytes, tokens[3].n_tokens) == (0, 0) and tokens[6].over_limit
    good = {r.doc_id: r for r in OPERATORS["quality"](docs).collect() if r.doc_id is not None}
    assert good[1].kept and not good[3].kept and good[3].base_failed and good[6].base_failed
    prints = {r.doc_id: r for r in OPERATORS["simhash"](docs).collect() if r.doc_id is not None}
    assert prints[3].fingerprint == prints[4].fingerprint == prints[5].fingerprint == "0" * 16
    assert prints[1].fingerprint == prints[2].fingerprint
    said = {r.doc_id: r for r in OPERATORS["pii"](docs).collect() if r.doc_id is not None}
    assert (said[-8].n_email, said[-8].n_ip, said[-8].n_card, said[-8].n_phone) == (1, 1, 1, 1)
    assert said[3].spans == said[4].spans == ""
    licences = {r.doc_id: r for r in OPERATORS["license"](docs).collect() if r.doc_id is not None}
    assert (licences[2**62].notices, licences[2**62].n_notices) == ("MIT", 1)


def test_url_filter_edges(spark):
    rules = [url_filter.Rule("block", "example.org/es/")]
    rows = [(1, "https://a.example.org/es/1"), (1, "https://a.example.org/es/1"), (2, None), (3, ""), (4, "no scheme"), (None, "http://EXAMPLE.org/es/?q"), (5, "http://" + "a." * 5000 + "example.org/es/"), (6, "://")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    plain = rows_of(url_filter.url_filter(pages, rules))
    assert len(plain) == len(rows)
    assert {r.verdict for r in plain if r.page_id in (1, 5, None)} == {"block"} and {r.verdict for r in plain if r.page_id in (2, 3, 4, 6)} == {"allow"}
    assert rows_of(url_filter.url_filter(pages.withColumns({"host": F.lit(1), "rule": F.lit(2)}), rules)) == plain
    assert rows_of(url_filter.url_filter(pages, rules, max_broadcast_chars=0)) == plain
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, []).collect()} == {"allow"}


def test_chat_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, "assistant", "x" * 100_000), (2, 5, "assistant", ""), (2, 4, "we\nird<|im_end|>\\n", "\\<|im_start|>\n\\\\")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for frame in (table, table.withColumn("turns", F.lit(1)).withColumn("mask", F.lit(2))):
        read = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(chat_format.turns_of_table(frame))).collect()}
        assert [(t.role, t.text) for t in read[1].turns] == [("", ""), ("user", "a"), ("user", "a")]
        assert [(t.role, t.text) for t in read[2].turns] == [("we\nird<|im_end|>\\n", "\\<|im_start|>\n\\\\"), ("assistant", "")]
        assert read[2].trained == [""] and read[None].trained == ["x" * 100_000] and read[1].trained == []
    assert chat_format.turns_of_table(table.limit(0)).count() == 0
