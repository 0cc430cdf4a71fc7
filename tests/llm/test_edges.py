"""Null ids, repeated rows, very long texts, empty tables and clashing columns, for every operator."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import bpe, decontaminate, html_extract, language_id, license_scan, line_dedup, pii_bootstrap, queries, simhash_dedup, url_filter, vp_search
from ledgerloom.llm.line_dedup import LineIndex

#: Output columns of all operators: the tables below have columns of these names already.
CLASHING = ("n_words", "n_base", "labels", "score", "lang_pred", "ambiguous", "fp", "fingerprint", "component_id", "n_email", "spans", "base_spans", "n_hit", "items", "n_tokens", "ids", "decoded", "n_lines", "n_dropped", "host", "path", "rule", "verdict", "n_template", "n_slots", "rank", "query_id")
LONG = "Mixed words of every kind, written under the MIT License; call +1 (017) 555-7713 or mail a@b.cd.\n" * 12_000
TEXTS = [None, "", " \t\n", "one", LONG, LONG, "the quick brown fox jumps over the lazy dog near the river bank", "é" * 70_000, "\x00\x1f\ud7ff\U0001f600 ok", "a\u2028b \u00a0 c"]
IDS = [0, 1, 2, None, 4, 5, 6, 7, 8, None]


def table(spark, rows=None):
    rows = list(zip(IDS, TEXTS)) if rows is None else rows
    df = spark.createDataFrame([(i, t, "en") for i, t in rows + rows[:7]], "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("own") for c in CLASHING})


PER_TEXT = {
    "license": (lambda d: license_scan.scan_licenses(d), lambda t: license_scan.scan_text(license_scan.LicenseAutomaton(), t)[:5], ("n_words", "n_base", "first_word", "last_word", "base_labels")),
    "pii": (lambda d: pii_bootstrap.find_personal_data(d), lambda t: pii_bootstrap.examine(t)[:4], ("n_email", "n_ip", "n_card", "n_phone")),
    "simhash": (lambda d: simhash_dedup.fingerprints(d, out="made"), lambda t: ((f := simhash_dedup.fingerprint(t)) - (f >> 63 << 64),), ("made",)),
}


@pytest.mark.parametrize("name", PER_TEXT)
def test_rows_are_judged_by_their_text(spark, name):
    run, one, columns = PER_TEXT[name]
    source = table(spark)
    got = sorted(map(repr, run(source).select("doc_id", *columns).collect()))
    want = [(r["doc_id"], *one((r["text"] or "").encode("utf-8", "surrogatepass"))) for r in source.select("doc_id", "text").collect()]
    rows = spark.createDataFrame([], run(source).select("doc_id", *columns).schema)
    assert got == sorted(repr(r) for r in spark.createDataFrame(want, rows.schema).collect())
    assert run(table(spark).limit(0)).count() == 0


def test_languages_of_odd_rows(spark):
    source = table(spark)
    model = language_id.train(source)
    found = language_id.identify(source, model)
    assert found.columns == ["doc_id", "lang_pred", "score", "ambiguous"] and found.count() == source.count()
    assert {r["lang_pred"] for r in found.filter("doc_id in (0, 1, 2)").collect()} == {"und"} and found.filter("doc_id in (4, 5)").select("lang_pred").distinct().count() == 1
    kept = language_id.keep_identified(source, model)
    assert kept.columns == source.columns and kept.filter("doc_id in (0, 1, 2)").count() == 0 and kept.filter("lang_pred = 'own'").count() == kept.count() > 0
    assert language_id.train(source.limit(0)).languages == [] and language_id.identify(source.limit(0), model).count() == 0


def test_tokens_of_odd_rows(spark):
    path = public_tokenizers.path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    source = table(spark, list(enumerate(TEXTS)))
    texts = dict(enumerate(TEXTS))
    for r in bpe.encode_texts(source, path).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes() and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    source = table(spark)
    assert bpe.encode_texts(source, path).count() == source.count() and bpe.encode_texts(source.limit(0), path).count() == 0


def test_contamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the river bank"), (None, None), (2, ""), (3, "mit license call")], "item_id long, text string")
    source = table(spark)
    found = decontaminate.find_contamination(source, items)
    assert found.columns == ["doc_id", "n_words", "n_hit", "spans", "items"] and found.count() == source.count()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found.filter("doc_id is not null").collect()}
    assert got[0] == got[1] == got[2] == (0, 0, []) and got[6] == (13, 13, ["1"]) and got[4] == got[5] == (20 * 12_000, 3 * 12_000, ["3"])
    left = decontaminate.remove_contamination(source, items)
    assert left.columns == source.columns and left.filter("doc_id = 6").count() == 0 and left.filter("spans = 'own'").count() == left.count()
    assert decontaminate.find_contamination(source, items.limit(0)).filter("n_hit > 0").count() == 0


def test_lines_of_odd_rows(spark):
    source = table(spark)
    found = line_dedup.dedup_lines(source)
    assert found.columns == [c for c in source.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"] and found.count() == source.count()
    assert line_dedup.dedup_lines(source.limit(0)).count() == 0
    index = LineIndex.build(source)
    assert LineIndex.build(source.limit(0)).filters().count() == 0 and index.dropped(source.limit(0)).count() == 0


def test_near_copies_of_odd_rows(spark):
    source = table(spark)
    found = simhash_dedup.near_duplicates(source)
    assert found.columns == ["doc_id", "fingerprint", "component_id"] and found.count() == source.count()
    assert {r["component_id"] for r in found.filter("doc_id in (0, 1, 2)").collect()} == {0} and {r["component_id"] for r in found.filter("doc_id in (4, 5)").collect()} == {4}
    kept = simhash_dedup.drop_near_duplicates(source)
    assert kept.columns == source.columns and kept.count() == found.select("fingerprint").distinct().count()
    assert simhash_dedup.drop_near_duplicates(source.limit(0)).count() == 0


def test_urls_and_pages_of_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.ORG", "x://a.org/" + "p/" * 50_000, "x://example.org/es/?q#f", "x://example.org/es/?q#f"]
    rows = [(i if i % 3 else None, u, None if i % 2 else "<p>Text &amp; more" + "<b>x</b>" * 20_000) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows + rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in CLASHING})
    judged = url_filter.filter_urls(pages)
    assert judged.columns == ["page_id", "host", "path", "rule", "verdict"] and judged.count() == len(rows) * 2
    assert {tuple(r)[1:] for r in judged.filter("host = 'example.org'").collect()} == {("example.org", "/es/", "example.org/es/", "block")}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0 and judged.filter("host = ''").select("verdict").distinct().first()[0] == "allow"
    blocks = url_filter.filter_urls(pages, block_bytes=1)
    assert sorted(map(repr, blocks.collect())) == sorted(map(repr, judged.collect()))
    found = html_extract.extract_pages(pages)
    assert found.columns == ["page_id", "url", "text", "n_template", "n_slots"] and found.count() == len(rows) * 2 and html_extract.extract_pages(pages.limit(0)).count() == 0
    assert {r["text"] for r in found.collect()} == {"", "Text & more" + "x" * 20_000}


def test_vectors_of_odd_rows(spark):
    rows = [(None, [1.0, 2.0]), (20, None), (20, [1.0, 0.0]), (40, [0.0, 0.0]), (60, [1.0]), (80, []), (1, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("own") for c in CLASHING})
    assert [tuple(r) for r in vp_search.nearest(df).collect()] == [(20, 1, 1, 3.0)]


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    source = table(spark).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for rows in (source, source.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == source.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
    assert hashlib.sha256(b"").hexdigest() in {r["decoded_sha256"] for r in corpus_pipeline.encode(spark, source, sf_dir).collect()}
