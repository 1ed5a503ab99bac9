"""Each stage of the pipeline against brute force on a small table of all kinds of rows."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from wayline.llm.queries import MIX

from tests.llm.test_jaccard import brute as all_pairs
from tests.llm.test_repeats import brute as all_windows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(r.randint(55, 130))]
        if i % 6 == 0:
            words[20:20] = passage
        rows.append((i * 2, " ".join(words), r.choice(["en", "fr"]), f"src{i % 5}"))
    for i in range(0, 60, 10):  # exact and near copies
        rows.append((1000 + i, rows[i][1], "en", "src1"))
        rows.append((2000 + i, rows[i][1] + " " + word(), "en", None))
    rows += [(3000, "short", "en", "src0"), (3001, None, None, None), (3002, "a b c " * 40, "en", "src0"), (4, rows[2][1], "en", "src2")]
    rows = [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def level(nodes, above):
    """Budgets of siblings (name → capacity, weight): full nodes leave, by capacity a weight, until none is full."""
    out, open_, rest = {}, dict(nodes), above
    while open_:
        weight = sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if c * weight <= rest * w]
        if not full:
            return out | {k: min(c, rest * w // weight) for k, (c, w) in open_.items()}
        first = min(full, key=lambda k: (open_[k][0] * 1_000_000 // open_[k][1], k))
        out[first], rest = open_[first][0], rest - open_.pop(first)[0]
    return out


def taken(rows):
    """doc_id → times, by the tree and the seeded order of each leaf."""
    number = lambda s: re.search(r"\d+", s or "")
    leaf = lambda r: (f"d{int(number(r[3])[0]) % 4}" if number(r[3]) else "other", r[2] or "", r[3] or "")
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    tokens = Counter()
    for r in rows:
        tokens[leaf(r)] += size[r]
    weigh = lambda path: MIX.weights.get("/".join(path), MIX.weights.get("/".join(["*"] * (len(path) - 1) + [path[-1]]), 1))
    total = sum(tokens.values())
    budget = {(): min(total * MIX.budget_pct // 100, total * MIX.max_epochs)}
    for depth in (1, 2, 3):
        for parent in [p for p in budget if len(p) == depth - 1]:
            nodes = {}
            for path, n in tokens.items():
                if path[: depth - 1] == parent:
                    nodes[path[:depth]] = (nodes.get(path[:depth], (0,))[0] + n * MIX.max_epochs, weigh(path[:depth]))
            budget |= level(nodes, budget[parent])
    times = Counter()
    for path, n in tokens.items():
        epochs, rest = divmod(budget[path], n) if n else (0, 0)
        hashed = lambda r: hashlib.md5(f"{MIX.seed}:{epochs}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        for r in sorted([r for r in rows if leaf(r) == path], key=lambda r: (hashed(r), r[0], size[r])):
            times[r[0]] += epochs + (rest > 0)
            rest -= size[r] if rest > 0 else 0
    return times


def test_stages_against_brute_force(spark, tables):
    sf_dir, rows = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, now = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        now[name] = [tuple(x) for x in docs.collect()]
        if name != "packing":
            assert docs.columns == columns, name
    assert {r[0] for r in rows} - {r[0] for r in now["quality_rules"]} == {3000, 3001, 3002}
    assert set(now["quality_rules"]) <= set(rows)

    kept = now["quality_rules"]
    groups = all_pairs({r[0]: r[1] for r in kept}.items(), 5, 80)
    stays = sorted(i for i, _, _, component, _ in groups if component == i)
    assert sorted(r[0] for r in now["near_duplicates"]) == stays and set(now["near_duplicates"]) <= set(kept)

    want = {i: text for i, _, text in all_windows([r[:2] for r in now["near_duplicates"]], 20)}
    old = {r[0]: r for r in now["near_duplicates"]}
    assert len(now["repeats"]) == len(old) and any(old[r[0]][1] != r[1] for r in now["repeats"])
    for i, text, lang, source, n_chars in now["repeats"]:
        assert text == (want[i] if want[i] != " ".join(re.findall(r"[^\x20\x09-\x0D]+", old[i][1])) else old[i][1])
        assert (lang, source) == old[i][2:4] and n_chars == len(text)

    times = Counter(r[0] for r in now["source_mixing"])
    assert set(now["source_mixing"]) <= set(now["repeats"]) and max(times.values()) <= MIX.max_epochs
    assert +times == +taken(now["repeats"])

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter()
    for p in now["packing"]:
        tokens[p[0]] += p[2]
    sizes = {r[0]: len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in now["source_mixing"]}
    assert tokens == {i: n * times[i] for i, n in sizes.items()}


def test_stages_of_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_by_rows(spark):
    r = random.Random(3)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(7, a, "en"), (7, b, "en"), (None, c, "en"), (None, c, "en"), (None, d, None), (3, d + " more", "fr"), (9, e, "en"), (9, e, "en"), (9, e, "de")]
    rows += [(8, a.upper(), "en"), (5, "", "en"), (5, "", "en"), (None, None, "en")]
    docs = spark.createDataFrame([(*x, "k", 1, "t") for x in rows], "doc_id long, text string, lang string, block string, again int, text_code string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "")
    assert got.columns == docs.columns
    kept = sorted(((x["doc_id"], x["text"], x["lang"]) for x in got.collect()), key=repr)
    want = [(7, a, "en"), (7, b, "en"), (None, c, "en"), (3, d + " more", "fr"), (9, e, "de"), (5, "", "en"), (5, "", "en"), (None, None, "en")]
    assert kept == sorted(want, key=repr)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, other texts of one id, a very long text, and columns that operators use themselves."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = [(i % 5 if i % 4 else None, " ".join(word() for _ in range(80)), "en", f"src{i % 3}") for i in range(40)]
    rows += [rows[0], rows[1], (50, " ".join(word() for _ in range(150_000)), "en", "src1"), (None, None, None, None)]
    kinds = "doc_id long, text string, lang string, source string, block int, row string, q_n_words long, epoch int, code string"
    spark.createDataFrame([(*x, 1, "r", 2, 3, "c") for x in rows], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert [f.simpleString() for f in docs.schema] == [f.simpleString() for f in spark.read.parquet(f"{tmp_path}/documents.parquet").schema]
        if name == "near_duplicates":
            assert docs.count() == 41  # all texts differ but the two repeats
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert pieces.where("doc_id = 50").agg({"length": "sum"}).first()[0] >= 150_000
