"""Position-table CRC against zlib; resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from wayline.llm import resampling
from wayline.llm.crc_tables import gram_codes, length_codes
from wayline.llm.resampling import Resampling

KINDS = "doc_id long, text string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_codes_equal_zlib():
    rnd = random.Random(1)
    for _ in range(60):
        words = [rnd.randbytes(rnd.choice([1, 2, 5, 9, 62, 63, 64, 65, 127, 128, 129, 500, 3000])) for _ in range(rnd.randint(1, 12))]
        data = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])[:-1]
        for k, found in enumerate(gram_codes(data, starts, 4), 1):
            assert found.tolist() == [zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]


def test_codes_of_a_very_long_word():
    word = b"ab" * 1_500_000
    data = np.frombuffer(b"x " + word + b" y ", np.uint8)
    one, two = gram_codes(data, np.array([0, 2, len(word) + 3]), 2)
    assert one.tolist() == [zlib.crc32(w) for w in (b"x", word, b"y")]
    assert two.tolist() == [zlib.crc32(b"x " + word), zlib.crc32(word + b" y")]


def test_length_codes():
    lengths = np.array([0, 1, 63, 64, 5000, 1 << 20])
    assert length_codes(lengths).tolist() == [zlib.crc32(bytes(n)) for n in lengths]


def features(text, how):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    runs = [" ".join(words[i : i + k]) for k in range(1, how.longest + 1) for i in range(len(words) - k + 1)]
    return words, [zlib.crc32(r.encode()) % how.buckets for r in runs]


def brute(docs, target, how):
    s, t = (Counter(b for text in texts for b in features(text, how)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()) + how.buckets, sum(t.values()) + how.buckets
    rows = []
    for doc_id, text in docs:
        words, found = features(text, how)
        gains = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words)])
    drawn = sorted((r for r in rows if r[5] >= how.least_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(drawn[: len(drawn) * how.draw_pct // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_draw_equals_a_plain_version(spark):
    rnd = random.Random(5)
    words = ["the", "Über", "naïve", "x1", "中文", "cat", "dog", "and", "z" * 70, "q" * 200]
    docs = [(i, rnd.choice([" ", ", ", "\n"]).join(rnd.choices(words, k=rnd.choice([0, 1, 19, 20, 60, 400])))) for i in range(120)]
    docs += [(None, "a lonely text of a null id " * 5), (200, None), (201, ""), (202, "cat " * 150_000), (203, "w" * 2_000_000)]
    target = ["the cat and the dog", None, "", "naïve cat"] * 3
    for how in (Resampling(), Resampling(buckets=97, longest=3, seed=1, least_words=1, draw_pct=60)):
        got = resampling.resample(
            spark.createDataFrame(docs, KINDS).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), how=how
        )
        assert found(got) == sorted(brute(docs, target, how), key=repr)


def test_equal_ids_and_rows_are_ranked_each(spark):
    docs = [(1, "one two three")] * 40 + [(2, "four five six")] * 40
    how = Resampling(least_words=1, draw_pct=100)
    got = resampling.resample(spark.createDataFrame(docs, KINDS).repartition(7), spark.createDataFrame([("one",)], "text string"), how=how).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 81))
    first, last = sorted(range(2), key=lambda i: -max(r["score"] for r in got if r["doc_id"] == i + 1))
    assert max(r["rank"] for r in got if r["doc_id"] == first + 1) < min(r["rank"] for r in got if r["doc_id"] == last + 1)


def test_empty_tables_and_clashing_columns(spark):
    none, words = spark.createDataFrame([], KINDS), spark.createDataFrame([(1, "one " * 30)], KINDS)
    assert resampling.resample(none, words).collect() == []
    assert [r["weight"] for r in resampling.resample(words, none).collect()] != []
    clash = "part string, text string, at long, rank long, spread int, n_words long"
    rows = spark.createDataFrame([("a", "one two " * 20, 1, 1, 1, 1), ("b", "one " * 40, 1, 1, 1, 1)], clash)
    got = resampling.resample(rows, rows, id_col="part", how=Resampling(draw_pct=50))
    assert got.columns == ["part", "n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] or 0 for r in got.collect()) == [0, 1]
