"""Every operator takes nulls, empty and long texts, repeated rows and ids, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import htmltext, langid, licenses, media, mixing, neardup, pii, quality, spm, suffix

CLASH = ["dest", "doc", "fp", "score", "kept", "key", "rank", "root", "spans", "slot", "block", "n", "_text", "blob", "labels", "ids", "n_words", "_lang", "hi_symbols", "base_failed", "word_chars", "_slot", "_nth", "_id", "_first", "_source", "_hash", "_number", "_more", "_text_fp", "_gone", "_doc", "_fp", "release", "deadline", "nth"]


def model(df):
    return langid.train(df)


OPERATORS = {
    "langid": lambda df: langid.identify(df, model(df)),
    "mixing": lambda df: mixing.placed(df.select("doc_id", "source")),
    "mixed": lambda df: mixing.mixed(df),
    "media": lambda df: media.media_columns(media.stored_text(df), "media", ("doc_id", "n_bytes")),
    "quality": lambda df: quality.assess(df),
    "passing": lambda df: quality.passing(df),
    "placed": lambda df: mixing.placed(df),
    "spm": lambda df: spm.encode(df, check=True),
    "neardup": lambda df: neardup.groups(df),
    "without_copies": lambda df: neardup.without_copies(df),
    "pii": lambda df: pii.all_spans(df)[0],
    "masked": lambda df: pii.masked(df),
    "suffix": lambda df: suffix.without_repeats(df),
    "licenses": lambda df: licenses.scan(df),
    "html": lambda df: htmltext.extract(df, "text", ("doc_id",)),
}
#: Of the odd rows: those that go, and of the rows with other ids.
DROPS = {"without_copies": (1, 0), "passing": (7, 6)}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, odd_rows, name):
    got = OPERATORS[name](odd).collect()
    assert len(got) == len(odd_rows) - DROPS.get(name, (0, 0))[0]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(odd, odd_rows, name):
    wide = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumns({c: F.lit("x") for c in CLASH})
    rows = OPERATORS[name](wide).collect()
    assert len(rows) == 7 - DROPS.get(name, (0, 0))[1]
    if name in ("passing", "mixed", "masked", "without_copies"):  # stages: the caller's columns as they were
        assert OPERATORS[name](wide).columns == wide.columns and all(r[c] == "x" for r in rows for c in CLASH)
    if name == "placed":
        assert all(r.slot_given == "x" and r.slot >= 0 for r in rows)


def test_results_of_odd_rows(odd):
    lang = {r.doc_id: r for r in langid.identify(odd, langid.train(odd)).collect()}
    assert lang[2].lang_pred == lang[3].lang_pred == lang[4].lang_pred == "und" and lang[2].score == 0
    assert lang[7].lang_pred != "und"
    groups = neardup.groups(odd).collect()
    assert {r.root_id for r in groups if r.doc_id == 1} == {1} and sum(r.doc == r.root for r in groups) == len(groups) - 1
    assert all(r.n_shingles == 0 and r.root == r.doc for r in groups if r.doc_id in (2, 3, 4))
    rest = suffix.without_repeats(odd).collect()
    assert sorted(r.n_removed for r in rest if r.doc_id == 1) == [0, 118]
    assert next(r for r in rest if r.doc_id == 5).n_removed == 200_000 - 1 and next(r for r in rest if r.doc_id == 2).n_bytes == 0
    assert all(r.round_trip for r in spm.encode(odd, check=True).collect())
    kept = {r.doc_id: r.kept for r in quality.assess(odd).collect()}
    assert kept[1] and not any(kept[i] for i in (2, 3, 4, 5, 6))
    mask = {r.doc_id: r for r in pii.masked(odd).collect()}
    assert mask[None].text == "No id, but a mail: <EMAIL> and <PHONE>." and mask[None].n_chars == len(mask[None].text) and mask[2].text is None
