"""Fill-in-middle examples against a plain split of the text, and back."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from wayline.llm import fill_middle
from wayline.llm.fill_middle import CHUNK_MOST, Chunks, Counted, Fim, chunk_ends, summary

KINDS = "doc_id long, text string"


def tokens(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def brute(doc_id, text, how=Fim()):
    text, units = text or "", tokens(text or "")
    x = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, plain, order = (int(x[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or plain % 100 >= how.rate or re.search("<[PSM]>", text):
        return doc_id, n, "plain", None, None, text
    a, b = sorted((a % (n + 1), b % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if order % 100 < how.spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def random_text(rnd):
    bits = ["abc", "x", "é", "中", "😀", " ", "\n", "1", "<S", "Zed", "\x00", "a" * 90]
    return "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 5, 40, 2000])))


def test_examples_equal_a_plain_split(spark):
    rnd = random.Random(3)
    passage = random_text(rnd) * 3 + "shared passage " * 200
    rows = [(i, random_text(rnd) + (passage if i % 3 == 0 else "") + random_text(rnd)) for i in range(150)]
    rows += [(None, "null id, one text"), (None, None), (7, None), (7, ""), (8, "same"), (8, "same"), (9, "holds <P> itself"), (10, "<"), (11, "<S<S>")]
    rows += [(12, "w" * 300_000 + " " + "é" * 300_000), (13, "long text, " * 200_000)]
    made = fill_middle.fill_middle(spark.createDataFrame(rows, KINDS).repartition(3))
    found = [tuple(r) for r in made.withColumn("back", fill_middle.restore()).collect()]
    key = repr
    assert sorted([r[:6] for r in found], key=key) == sorted([brute(*r) for r in rows], key=key)
    assert sorted(r[6] for r in found) == sorted(t or "" for _, t in rows)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_rates(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    all_spm = fill_middle.fill_middle(rows, how=Fim(seed=5, rate=100, spm=100))
    assert {r["form"] for r in all_spm.select("form").distinct().collect()} == {"spm"}
    n = {r["form"]: r["count"] for r in fill_middle.fill_middle(rows).groupBy("form").count().collect()}
    assert abs(n["plain"] - 200) < 60 and abs(n["spm"] - 360) < 80


def test_empty_tables_other_ids_and_clashing_columns(spark):
    assert fill_middle.fill_middle(spark.createDataFrame([], KINDS)).collect() == []
    rows = spark.createDataFrame([("a", "one two", 5, "x", 1)], "h0 string, text string, n long, form string, output int")
    assert fill_middle.fill_middle(rows, id_col="h0").collect()[0][:2] == ("a", 3)
    odd = spark.createDataFrame([(1, "one two")], "text long, body string")
    assert fill_middle.fill_middle(odd, id_col="text", text_col="body").first()["n"] == 3


def test_chunks_follow_the_content():
    rnd = random.Random(1)
    passage = "".join(rnd.choice("abcdefgh é中 ") for _ in range(20_000))
    texts = [("head " * k + passage).encode() for k in (1, 17, 333)]
    pieces = []
    for text in texts:
        ends = chunk_ends(np.frombuffer(text, np.uint8), np.array([0, len(text)])).tolist()
        pieces.append([text[a:b] for a, b in zip([0, *ends], ends)])
        assert b"".join(pieces[-1]) == text and max(map(len, pieces[-1])) <= CHUNK_MOST
        assert all(p.decode() for p in pieces[-1])  # no character is cut
    shared = set(pieces[0]) & set(pieces[1]) & set(pieces[2])
    assert sum(map(len, shared)) > 0.8 * len(passage)
    known = Chunks()
    for p in pieces:
        [known.of(x) for x in p]
    assert len(known.known) < 1.3 * len(pieces[0])


def test_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(fill_middle, "CACHE_BYTES", 100)
    known = Chunks()
    for i in range(50):
        assert known.of(b"chunk %d" % i) == summary(b"chunk %d" % i)
        assert known.held <= 120


def test_a_run_of_letters_over_many_chunks():
    pieces = [b"one tw", b"o", b"thr", b"ee", b" 4", b"five"]
    counted = Counted(pieces, [summary(p) for p in pieces])
    assert counted.tokens[-1] == len(tokens("one twothree 4five"))
    for k in range(counted.tokens[-1] + 1):
        assert counted.cut(k)[0] == len("".join(tokens("one twothree 4five")[:k]))
