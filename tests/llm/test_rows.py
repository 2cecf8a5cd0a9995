"""Rows pass through every operator unchanged: large ids beside nulls, early times, clashing column names, repeats, empty tables."""

import datetime as dt

import pytest

from quadrille.llm import decontamination, fingerprints, html_extract, jaccard_join, language_id, lm_scoring, packing, secrets, token_files, url_filters

BIG = 2**60 + 1
EARLY = dt.datetime(1500, 3, 1, 12)
PROSE = "the cat sat on the mat and then it went away again to see what else there was"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (None, f"{PROSE} one two three", 2**60 + 3, EARLY, "a"),
        (BIG, f"{PROSE} four five six and password = hunter2hunter2", 2**61 + 1, EARLY, "b"),
        (BIG + 2, "", None, None, None),
        (BIG + 4, None, 1, EARLY, "c"),
        (BIG + 6, f"{PROSE} seven eight nine", 2, EARLY, "d"),
        (BIG + 6, f"{PROSE} seven eight nine", 2, EARLY, "d"),
        (7, "x " * 40_000, 3, EARLY, "e"),
    ]
    # names that operators use inside, or return
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, at timestamp, key string").selectExpr("*", "key AS id", "key AS node", "n_chars AS part", "key AS held", "key AS model", "key AS _b", "key AS score", "key AS lang")


IDS = sorted([0, BIG, BIG + 2, BIG + 4, BIG + 6, BIG + 6, 7])


def ids(df, column="doc_id"):
    return sorted(r[column] or 0 for r in df.collect())


def same_rows(got, docs, gone=()):
    """All columns as they were, but for the text of the rows that the stage may change."""
    pick = lambda df: sorted((tuple(r) for r in df.drop("text", "n_chars").collect()), key=repr)
    assert got.schema == docs.schema
    want = [r for r in pick(docs) if r[0] not in gone]
    assert pick(got) == want


@pytest.fixture(scope="module")
def model():
    return language_id.train([("en", PROSE)] * 9 + [("xx", "x " * 30)] * 9)


def test_language_id(spark, docs, model):
    assert ids(language_id.identify(docs, model)) == IDS
    same_rows(language_id.keep_identified(docs, model), docs, gone=(BIG + 2, BIG + 4))
    assert language_id.identify(docs.limit(0), model).count() == language_id.label_words(docs.limit(0), model).count() == 0
    assert {r["doc_id"] for r in language_id.label_words(docs, model).collect()} == {None, BIG, BIG + 6, 7}


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(None, PROSE), (BIG, PROSE), (3, None)], "item_id long, text string")
    found = decontamination.find_leaks(docs, items)
    assert ids(found) == sorted([0, BIG, BIG + 6, BIG + 6] * 2) and ids(found, "item_id") == [0] * 4 + [BIG] * 4
    same_rows(decontamination.remove_leaks(docs, items.filter("item_id = 3")), docs)
    same_rows(decontamination.remove_leaks(docs, items), docs, gone=(None, BIG, BIG + 6))
    small = spark.createDataFrame([(4, PROSE)], "item_id int, text string")
    assert decontamination.find_leaks(docs, small).filter("item_id = 4").count() == 4


def test_lm_scoring(docs):
    assert ids(lm_scoring.score_texts(docs)) == IDS


def test_html(spark):
    pages = spark.createDataFrame([(None, "u", "<p>a"), (BIG, None, None), (BIG, "v", "")], "page_id long, url string, html string")
    model = html_extract.Model()
    assert ids(html_extract.extract_text(pages, model), "page_id") == [0, BIG, BIG]
    assert html_extract.extract_text(pages.limit(0), model).count() == 0


def test_secrets(docs):
    assert ids(secrets.scan_secrets(docs)) == IDS
    got = secrets.redact_secrets(docs, count_col="n_chars")
    same_rows(got, docs)
    counts = {(r["doc_id"], r["text"]): r["n_chars"] for r in got.collect()}
    text = f"{PROSE} four five six and [REDACTED]"
    assert counts[BIG, text] == len(text) and counts[None, f"{PROSE} one two three"] == 2**60 + 3


def test_jaccard_join(docs):
    assert ids(jaccard_join.near_duplicates(docs)) == IDS
    kept = jaccard_join.keep_first(docs)
    assert kept.schema == docs.schema and ids(kept) == sorted([0, BIG, BIG + 2, BIG + 4, BIG + 6, 7])


def test_tokens_and_packing(docs):
    assert ids(token_files.read_token_table(token_files.write_token_table(docs))) == IDS
    pieces = packing.pack_documents(docs).filter("piece = 0")
    assert ids(pieces) == IDS


def test_fingerprints_and_urls(spark, docs):
    assert ids(fingerprints.fingerprint_edits(docs)) == IDS
    pages = spark.createDataFrame([(None, "http://a.b/c"), (BIG, None), (BIG, "http://a.b/c")], "page_id long, url string")
    outcomes = spark.createDataFrame([(None, 1), ("a.b", 1)], "host string, bad int")
    assert ids(url_filters.judge_urls(pages, outcomes), "page_id") == [0, BIG, BIG]
