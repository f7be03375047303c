import hashlib

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text as fx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first().y


@pytest.mark.parametrize(("given", "want"), [("/srv/Team Proj.1/", "team-proj-1"), ("/", "unknown"), ("", "unknown"), ("a/b_C--", "b_c"), ("/x/ÄÖ", "unknown")])
def test_slug(spark, given, want):
    assert one(spark, given, fx.project_slug) == want


def test_trim_and_length(spark):
    assert one(spark, "\t  a b　﻿\n", fx.js_trim) == "a b"
    assert one(spark, "🔧a", fx.js_length) == 3
    assert one(spark, " a  b c\n", fx.words) == 3


def test_tokens(spark):
    assert one(spark, "Foo_1, ÄB-同步!", fx.tokens) == ["foo_1", "äb", "同步"]
    assert one(spark, "!!", fx.tokens) == []


def test_counts(spark):
    assert one(spark, "aaAa", lambda c: fx.count_apart(F.col(c), "aa")) == 2
    assert one(spark, "aaAa", lambda c: fx.count_overlapping(F.col(c), "aa")) == 3
    assert one(spark, "x", lambda c: fx.count_apart(F.col(c), "")) == 0


def test_jaccard_rules(spark):
    def sim(a, b):
        t = spark.createDataFrame([(a, b)], "a string, b string")
        return t.select(fx.jaccard(fx.token_set("a"), fx.token_set("b"), F.col("a"), F.col("b")).alias("s")).first().s

    assert sim("a b c", "A c d") == 0.5
    assert sim("!!!", " !!! ") == 1 and sim("!!", "?") == 0 and sim("!", "a") == 0


def test_ids_hashes_times(spark):
    t = spark.createDataFrame([("p", "t", 1767225902820)], "p string, t string, ms long")
    r = t.select(fx.record_id("p", "t", F.timestamp_millis("ms")).alias("i"), fx.short_hash("t").alias("h"), fx.iso_ms("ms").alias("m"), fx.hour_minute("ms").alias("c")).first()
    assert r.i == "mem_20260101_" + hashlib.sha256(b"p\nt").hexdigest()[:6] and r.h == "sha256:" + hashlib.sha256(b"t").hexdigest()[:16]
    assert (r.m, r.c) == ("2026-01-01T00:05:02.820Z", "00:05")


@pytest.mark.parametrize(("sessions", "ok", "bad", "want"), [(1, False, False, 0.5), (2, False, False, 0.65), (4, True, False, 0.95), (1, False, True, 0.25), (0, False, True, 0.1)])
def test_confidence(spark, sessions, ok, bad, want):
    t = spark.createDataFrame([(sessions, ok, bad)], "s int, o boolean, b boolean")
    assert t.select(fx.confidence(F.col("s"), F.col("o"), F.col("b")).alias("c")).first().c == want


@pytest.mark.parametrize(("text", "want"), [
    ("-----BEGIN RSA PRIVATE KEY-----", ["pem-private-key"]), ("key AKIA" + "A1" * 8, ["aws-access-key"]), ("use ghp_" + "a1" * 10 + " now", ["token-prefix"]),
    ("x Ab1$" + "k" * 30, ["high-entropy-token"]), ("Gz1" * 16, ["high-entropy-token"]), ("Gz1" * 15, []), ("https://Ab1$" + "k" * 30, []), ("sha256:" + "0a" * 16, []),
    ("0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f", []), ("lib/Some_path-To.file9" * 3, []), (None, []), ("", []),
])
def test_secrets(spark, text, want):
    assert one(spark, text, fx.secret_labels) == want


def test_fences_and_anchors(spark):
    assert one(spark, " ```json\n[1]\n``` ", fx.without_fences) == "[1]"
    assert one(spark, "## {#a} x {#b} {#a} {#}", fx.anchors) == ["a", "b"]
