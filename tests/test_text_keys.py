"""Frames of the tables hold hashes of texts, and what pairs make of them is what they make of the texts."""

from pyspark.sql import functions as F

from tidemark import queries as library
from tidemark.operators import pairs
from tidemark.plans.frame import with_documents


def test_hashes_stand_for_texts(spark, sf_dir):
    ev = library.full_events(spark, sf_dir)
    assert "content" not in ev.columns
    whole = with_documents(ev.drop("text_key", "said"), sf_dir, F.col("content"))
    for cfg in (library.SEMANTIC, library.TEMPLATES):
        flags = lambda df: {(r.event_id, r.has_text) for r in pairs.with_text_flag(df, cfg).select("event_id", "has_text").collect()}  # noqa: B023, E731
        assert flags(ev) == flags(whole)
    assert ev.where("said").count() == whole.where(F.trim(F.coalesce("content", F.lit(""))) != "").count()


def test_texts_of_members_only(spark, sf_dir):
    members = library.events(spark, sf_dir).where("rn < 7").select("rn")
    got = {r.rn: r.content for r in library.texts_of(spark, sf_dir, members).collect()}
    assert sorted(got) == list(range(7)) and any(got.values())
