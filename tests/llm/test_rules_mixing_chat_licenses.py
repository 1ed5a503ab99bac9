"""Quality rules, mixing, chat formatting and license scan: rules by hand, odd rows, empty tables."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wayline.llm import chat_format, licenses, mixing, quality_rules
from wayline.llm.words import covered, repeated, rolling

GOOD = " ".join(f"word{i}" for i in range(60))
SYMBOLS = " ".join(f"w{i}###" for i in range(60))


def test_measures_by_hand():
    texts = [None, "", "\n \n", "a b c a b c", "x y\nx y\n\nx y", "é# ü$\té#", " a\n a\na"]
    m = quality_rules.measure(pa.array(texts))
    assert m["n_words"].tolist() == [0, 0, 0, 6, 6, 3, 3]
    assert m["word_chars"].tolist() == [0, 0, 0, 6, 6, 6, 3]
    assert m["n_symbols"].tolist() == [0, 0, 0, 0, 0, 3, 0]
    assert m["n_dup_lines"].tolist() == [0, 0, 0, 0, 2, 0, 1]
    assert m["n_repeat_words"].tolist() == [0, 0, 0, 6, 6, 0, 0]


def test_windows_codes():
    codes = np.arange(40, dtype=np.uint64)
    for k in range(1, 21):
        assert (rolling(codes, k)[7:8] == rolling(codes[7 : 7 + k], k)).all() and len(rolling(codes, k)) == 41 - k
    assert covered(6, np.array([0, 1, 4]), 2).tolist() == [True, True, True, False, True, True]
    again, shared = repeated(np.array([4, 5, 4, 4], np.uint64))
    assert again.tolist() == [False, False, True, True] and shared.tolist() == [True, False, True, True]


def test_a_host_verdict_takes_documents_with_soft_failures_only(spark):
    rows = [(i, SYMBOLS, "bad.example") for i in range(40)] + [(100, GOOD, "bad.example"), (101, None, None), (102, SYMBOLS, None)]
    rows += [(200 + i, GOOD, f"good{i % 5}.example") for i in range(40)] + [(300, SYMBOLS, "good1.example"), (400, SYMBOLS, "one.example")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, host string, n_words int")
    kept = {r["doc_id"] for r in quality_rules.judge(docs).collect() if r["kept"]}
    assert kept >= {100, 300, *range(200, 240)} and not kept & {101, *range(40)}
    assert {r["doc_id"] for r in quality_rules.keep(docs).collect()} == kept
    assert quality_rules.keep(docs).columns == docs.columns
    rates = {r["host"]: r for r in quality_rules.host_verdicts(quality_rules.measures(docs, "doc_id", "text", "source"), quality_rules.Rules()).collect()}
    assert 0.9 < rates["bad.example"]["host_rate"] < 40 / 41 + 0.01 and rates["one.example"]["host_rate"] < 1


def test_rules_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep(none).count() == 0


def test_prior_is_recovered():
    r = np.random.default_rng(6)
    for mean, strength in ((0.2, 4.0), (0.5, 20.0), (0.1, 1.0)):
        n = np.concatenate([np.ones(20_000, int), r.integers(2, 60, 30_000)])
        p = r.beta(mean * strength, (1 - mean) * strength, len(n))
        x = r.binomial(n, p)
        m, s = quality_rules.prior(len(n), n.sum(), x.sum(), (n.astype(float) ** 2).sum(), (x.astype(float) ** 2 / n).sum())
        assert abs(m - mean) < 0.1 * mean and abs(s - strength) < 0.1 * strength


def test_hosts_of_one_document_or_alike_get_the_common_rate():
    r = np.random.default_rng(7)
    x = r.integers(0, 2, 400)
    assert quality_rules.prior(400, 400, x.sum(), 400, x.sum()) == (x.mean(), quality_rules.STRONGEST)
    n = np.full(300, 50)
    x = r.binomial(n, 0.3)
    _, s = quality_rules.prior(300, n.sum(), x.sum(), (n**2).sum(), (x**2 / n).sum())
    assert s > 300
    assert quality_rules.prior(0, 0, 0, 0, 0) == (0.0, quality_rules.STRONGEST) and quality_rules.prior(2, 9, 0, 41, 0)[1] == quality_rules.STRONGEST


def leaves(spark, tokens):
    rows = [(*path.split("/"), n) for path, n in tokens.items()]
    return spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")


def test_shortages_go_to_siblings_before_ancestors(spark):
    tokens = {"d0/en/a": 10, "d0/en/b": 1000, "d0/fr/c": 1000, "d1/en/d": 2000, "d1/en/e": 10}
    mix = mixing.Mix(weights={"d0/en/a": 3}, budget_pct=50, max_epochs=1)
    got = {f"{r['domain']}/{r['lang']}/{r['source']}": r["budget"] for r in mixing.budgets(leaves(spark, tokens), mix).collect()}
    # 2010 tokens: 1005 a domain; d0: 502 a language; a takes 10 of its 376, the rest stays with its sibling b
    assert got == {"d0/en/a": 10, "d0/en/b": 492, "d0/fr/c": 502, "d1/en/d": 995, "d1/en/e": 10}
    # a short domain's shortage goes to the other domain once its leaves are full
    got = {f"{r['domain']}/{r['source']}": r["budget"] for r in mixing.budgets(leaves(spark, {"d0/en/a": 10, "d1/en/b": 1000}), mix).collect()}
    assert got == {"d0/a": 10, "d1/b": 495}


def test_a_weight_of_nothing_leaves_a_node_out(spark):
    tokens = {"d0/en/a": 100, "d0/en/b": 100, "d0/fr/c": 100, "d1/en/d": 100, "d2/en/e": 100}
    mix = mixing.Mix(weights={"d1": 0, "d0/fr": 0, "d0/en/b": 0, "d2": 3}, budget_pct=40, max_epochs=2)
    got = {f"{r['domain']}/{r['lang']}/{r['source']}": r["budget"] for r in mixing.budgets(leaves(spark, tokens), mix).collect()}
    assert got == {"d0/en/a": 50, "d0/en/b": 0, "d0/fr/c": 0, "d1/en/d": 0, "d2/en/e": 150}
    none = {r["budget"] for r in mixing.budgets(leaves(spark, tokens), mixing.Mix(weights={"*": 0})).collect()}
    assert none == {0}
    docs = spark.createDataFrame([(1, "a b", "en", "src1"), (2, "c", "en", "src2")], "doc_id long, text string, lang string, source string")
    assert [r["doc_id"] for r in mixing.mix_documents(docs, mixing.Mix(weights={"d1": 0}, budget_pct=50)).collect()] == [2]
    for odd in (0.5, -1):
        with pytest.raises(ValueError):
            mixing.Mix(weights={"d0": odd})


def test_a_leaf_gives_whole_epochs_and_a_prefix(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None) for i in range(400)] + [(7, "w w", "en", "src1")] * 3 + [(500, None, "en", "src1")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, epochs int, row string")
    mix = mixing.Mix(weights={"d1": 9}, budget_pct=120, max_epochs=3)
    out = mixing.select_documents(docs, mix).collect()
    sizes, taken = Counter(), Counter()
    for id_, text, lang, source in rows:
        sizes[(mixing_domain(source), lang or "", source or "")] += len((text or "").split())
    for r in out:
        taken[(r["domain"], r["lang"], r["source"])] += r["take_tokens"]
    frame = leaves(spark, {"/".join(k): v for k, v in sizes.items()})
    assert {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(frame, mix).collect()} == {k: taken[k] for k in sizes}
    whole = mixing.mix_documents(docs, mix)
    assert whole.columns == docs.columns
    assert Counter(r["doc_id"] for r in whole.collect()) == Counter(r["doc_id"] for r in out)
    again = mixing.select_documents(docs.repartition(3), mix).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in out)


def mixing_domain(source):
    return f"d{int(source[3:]) % 4}" if source else "other"


def test_mixing_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.select_documents(none, mixing.Mix()).count() == 0 and mixing.mix_documents(none, mixing.Mix()).count() == 0


def test_examples_end_at_each_reply(spark):
    turns = [(1, 0, "user", "hi <s> 100%"), (1, 1, "assistant", "a[b]%3C"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "bye")]
    turns += [(2, 0, None, "alone"), (None, 1, "assistant", "x"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    df = spark.createDataFrame([(*t, 0, "z") for t in turns], "conv_id long, turn long, role string, text string, example int, formatted string")
    examples = {(r["conv_id"], r["example"]): r for r in chat_format.expand(df).collect()}
    assert set(examples) == {(1, 0), (1, 1), (1, 2), (2, 0), (None, 0), (3, 0)}
    first = examples[1, 0]
    assert first["formatted"] == "<s>user[TURN]hi %3Cs> 100%25</s><s>assistant[TURN]a%5Bb]%253C</s>"
    assert first["formatted"][first["loss_start"] :][: first["loss_length"]] == "a%5Bb]%253C"
    assert examples[1, 1]["loss_length"] == 0 and examples[1, 2]["loss_start"] is None
    read = {r["conv_id"]: r for r in chat_format.digest(chat_format.expand(df)).collect()}
    assert read[1]["n_turns"] == 5 and read[1]["loss_chars"] == 7 and read[3]["n_turns"] == 3
    parsed = chat_format.expand(df).where("conv_id = 1 and example = 2").select(chat_format.parse(chat_format.F.col("formatted")).alias("t")).first()["t"]
    assert [tuple(x) for x in parsed] == [(r, t or "") for _, _, r, t in turns[:5]]
    assert chat_format.digest(chat_format.expand(df.limit(0))).count() == 0


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hits = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scan(spark):
    texts = [
        None, "", "MIT License mit-license MITLICENSE", "the General\nPublic License and the Apache License", "Émit license naïve mit  LICENSE.",
        "foo Released under the MIT License. bar", "x Licensed under CC BY-NC 4.0. y", "Licensed under CC BY 4.0", "licensed under a tree by CC",
        "Redistribution and use in source and also binary forms, with or without any modification, are permitted provided that the following conditions are met:",
        "redistribution and use in source " * 3, "w" * 50_000 + " mit license",
    ]
    docs = spark.createDataFrame([(i, t, "x", 2.0) for i, t in enumerate(texts)], "doc_id long, text string, labels string, gram double")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text)
    assert [got[i]["labels"] for i in range(5, 11)] == ["mit", "cc-by-nc", "cc-by", "", "bsd", ""]
    assert got[8]["score"] == 0 and got[9]["score"] >= 0.8 and got[5]["score"] == 1
    assert licenses.scan(docs.limit(0)).count() == 0


def test_labels_stay_with_their_rows(spark):
    words = licenses.TEMPLATES["bsd"][0].split()
    halves = [(None, " ".join(words[: len(words) // 2])), (None, " ".join(words[len(words) // 2 :]))]
    rows = [(1, "Licensed under CC BY 4.0.")] * 2 + [(None, "Licensed under CC BY 4.0."), (1, "none"), (None, None), *halves]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["labels"], r["score"]) for r in got) == [(0, "", 0.0)] * 3 + [(0, "cc-by", 1.0), (1, "", 0.0)] + [(1, "cc-by", 1.0)] * 2


def brute_labels(text):
    """Labels of templates by all pairs of equal 3-grams, diagonals joined where they differ by SLACK at most."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    own, found = words(text), set()
    for label, templates in licenses.TEMPLATES.items():
        for template in map(words, templates):
            hits = sorted((p - t, t) for p in range(len(own) - 2) for t in range(len(template) - 2) if own[p : p + 3] == template[t : t + 3])
            spans, last = [], None
            for d, t in hits:
                if last is None or d - last > licenses.SLACK:
                    spans.append(set())
                spans[-1] |= {t, t + 1, t + 2}
                last = d
            if any(len(s) / len(template) >= licenses.COVERED for s in spans):
                found.add(label)
    return found


def test_labels_equal_all_pairs(spark):
    r = np.random.default_rng(4)
    parts = [t.split() for ts in licenses.TEMPLATES.values() for t in ts]
    texts = []
    for _ in range(120):
        words = []
        for i in r.integers(0, len(parts), r.integers(0, 5)):
            part = list(parts[i])
            for _ in range(r.integers(0, 4)):  # words lost, put in or changed
                at = r.integers(0, len(part))
                part[at : at + r.integers(0, 2)] = ["odd"] * int(r.integers(0, 2))
            words += part + ["and"] * int(r.integers(0, 3))
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((x["doc_id"], x["labels"]) for x in licenses.scan(docs, phrases={}).collect())
    assert got == sorted((i % 7, ",".join(sorted(brute_labels(t)))) for i, t in enumerate(texts))


@pytest.mark.parametrize("shift", [0, 1, 5])
def test_neighbouring_diagonals_merge(spark, shift):
    words = licenses.TEMPLATES["bsd"][0].split()
    text = " ".join([*words[:10], *["and"] * shift, *words[10:]])
    found = licenses.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [r["label"] for r in found] == (["bsd"] if shift <= licenses.SLACK else [])
