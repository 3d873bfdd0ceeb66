"""Queries over all rows of their tables, beside their SQL twins, with rows that show what they do."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle_check import compare, connect  # noqa: E402
from tracehound.operators import forensics as fx  # noqa: E402
from tracehound.plans import catalog, views  # noqa: E402

D = "/root/testdata/sf0.001"


def beside_twin(spark, name):
    got = catalog.QUERIES[name](spark, D).toPandas()
    assert compare(got, connect(D).execute(catalog.SQL[name]).df()) is None
    return got


def test_generic_fields_of_all_lines(spark):
    got = beside_twin(spark, "b8_generic_fields_whole")
    lines = views.raw_lines(spark, D)
    assert len(got) == lines.count()
    pairs = lines.where("line LIKE '%src_ip=%'").select("source", "line_no", F.regexp_extract("line", r"src_ip=(\S+)", 1).alias("want")).toPandas()
    found = pairs.merge(got, on=["source", "line_no"])
    assert len(found) == len(pairs) > 0 and (found["f_src_any"] == found["want"]).all()


def names_of(spark):
    return {r[0] for r in views.journal(spark, D).select("file_name").distinct().collect()}


def test_presence_over_the_whole_journal(spark):
    got = beside_twin(spark, "d17_presence")
    assert 0 < len(got) and set(got["name"]) <= names_of(spark)
    t = views.file_timeline(spark, D).select(fx.base_name(F.col("filename")).alias("name"))
    paths = fx.event_paths(views.windows_events(spark, D)).select("name")
    thinned = fx.presence({"Timeline": t, "USN": views.journal(spark, D).where("usn % 3 = 0").select(F.col("file_name").alias("name")), "Events": paths}).toPandas()
    assert set(thinned["name"]) < set(got["name"])


def test_usn_missing_over_the_whole_journal(spark):
    got = beside_twin(spark, "m23_usn_missing")
    base = lambda n: n.replace("\\", "/").rsplit("/", 1)[-1].lower()
    assert 0 < len(got) and not {base(n) for n in got["filename"]} & names_of(spark)
    thinned = fx.usn_missing(views.file_timeline(spark, D), views.journal(spark, D).where("usn % 5 = 0")).toPandas()
    assert set(got["filename"]) < set(thinned["filename"])
    assert fx.usn_missing(views.file_timeline(spark, D), views.journal(spark, D).where("usn < 0")).count() == 0


def test_possibly_copied_needs_an_absent_journal(spark):
    assert len(beside_twin(spark, "m22_possibly_copied")) > 0
    assert fx.possibly_copied(views.file_timeline(spark, D), views.journal(spark, D)).count() == 0


@pytest.mark.parametrize("name", ["d5_uncovered_entries", "k6_user_attack_chain"])
def test_users_without_a_steady_address(spark, name):
    assert len(beside_twin(spark, name)) > 0
