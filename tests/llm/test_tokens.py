"""Token ids, their files and their packing, against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayline.llm import packing, token_files
from wayline.llm.tables import lighten
from wayline.llm.tokens import CACHED, CUTS, Encoder, crc32, encoder, forget

ODD = [
    None, "", "  a", "a <|endoftext|> b", "a  \n\n b\tc 'll don't", "É<|startoftext|> Σας İ x", "é ́a", "a\n\nb", "a b　c",
    "x\x1cy \x85z  ", "   x", "²x½3", "a\n", "a \n b", "a\t\nb", "x\n\tb \n", " \n", "a\x01b", "日本語 text", "ÀÉ ß ﬁ", "a\r\nb", "it's 'S we'll",
]


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "over,", "naïve", "x***", "1234", "don't", "\n", "\n\n", "a  b", "日本", "É!!"]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 60, 700, 3000]))) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(CUTS))
def test_pieces_give_the_ids_of_whole_texts(name):
    encoder, whole = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for text in [*ODD, *texts(1, 40)]:
        assert encoder.encode(text).tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_shard_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 60, n), r.integers(0, 1 << 31, n), np.zeros(n), np.where(r.random(n) < 0.02, 40_000, r.integers(5, 9, n))):
        ids = ids.astype(np.uint32)
        ends = np.sort(np.append(r.integers(0, n + 1, 5), n))
        shard = token_files.Shard(token_files.encode_shard(ids, ends))
        assert (shard.ids() == ids).all()
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            assert shard.document(i).tolist() == ids[a:b].tolist()


def test_outliers_are_patched():
    ids = np.full(2560, 7, np.uint32)
    ids[::40] = 60_000
    shard = token_files.Shard(token_files.encode_shard(ids, np.array([2560])))
    assert shard.widths.max() == 0 and len(shard.high) == 64 and len(shard.data) < 600


def documents(spark):
    rows = [(i * 7 % 101, t) for i, t in enumerate([*ODD, *texts(4, 70)])] + [(None, "null id"), (5, "tie"), (5, "tie"), (5, "a tie")]
    rows += [(1000, "long " * 30_000)]
    return rows, spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, n int, data binary").repartition(6)


def test_files_hold_every_document_in_order(spark):
    rows, docs = documents(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, start, want = Tokenizer.from_file(path), 0, []
    for id_, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)
        want.append((id_, start, len(ids), crc32(ids)))
        start += len(ids)
    files = token_files.write(docs, path, shard_ids=2000)
    assert sorted((tuple(r) for r in token_files.read(files).collect()), key=lambda r: r[1]) == want
    assert files.count() > 5


def test_packing_of_other_ids_and_repeated_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(f"id{i % 9}", "same words here") for i in range(90)] + [(None, "a"), (None, None), ("x", "b")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    pieces = packing.pack(docs, path, how=packing.Packing(capacity=16), group_docs=10).collect()
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)
    assert {p["doc_id"] for p in pieces} == {r[0] for r in rows}
    # equal rows are dealt to several groups
    one = spark.createDataFrame([(1, "same")] * 200, "doc_id long, text string").repartition(4)
    assert len({p["sequence_id"] // packing.GROUP_IDS for p in packing.pack(one, path, group_docs=20).collect()}) > 5


def test_packing_holds_every_id_once(spark):
    rows, docs = documents(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, group_docs=30).collect()
    by = {}
    for p in pieces:
        by.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    want = {}
    for id_, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)
        want.setdefault((id_, len(ids)), []).append(ids)
    assert by.keys() == want.keys()
    for key, found in by.items():
        possible = want[key]
        assert sum(p["length"] for p in found) == key[1] * len(possible)
        for p in found:
            assert any(crc32(ids[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] for ids in possible)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    totals = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        totals.append(at)
    assert max(totals) <= 1024
    assert sum(1024 - t for t in totals) < 4 * 1024  # less than a sequence in each group


def test_assignment_goes_to_the_lowest_cost_with_room():
    how = packing.Packing(capacity=10)
    # 4 goes to the cheaper sequence of the 5, 3 to that of the 6, and 2 is cut in halves
    assert packing.assign([6, 5, 4, 3, 2], how) == [(0, 0, 6, 0, 0), (1, 0, 5, 1, 0), (2, 0, 4, 1, 5), (3, 0, 3, 0, 6), (4, 0, 1, 0, 9), (4, 1, 1, 1, 9)]
    lengths = sorted((random.Random(3).randint(1, 1023) for _ in range(3000)), reverse=True)
    costs = {}
    for item, _, length, s, _ in packing.assign(lengths, packing.Packing()):
        costs[s] = costs.get(s, 0) + packing.Packing().cost(length)
    order = sorted(costs.values())
    assert len(costs) == -(-sum(lengths) // 1024) and order[-2] < 2.1 * order[1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack(none, path).count() == 0
    assert token_files.read(token_files.write(none, path)).count() == 0


def test_block_tasks_drop_cached_pieces():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = encoder(path)
    before = encode.encode("the words of a text")
    assert encode.pieces
    lighten()
    assert not encode.pieces and not encode.pieces.old
    assert np.array_equal(encoder(path).encode("the words of a text"), before)


def test_a_new_word_after_a_space_is_one_pre_token(monkeypatch):
    one, searched = Encoder(public_tokenizers.path("byte_bpe_50k.json")), set()
    cut = one.pre_tokens
    monkeypatch.setattr(one, "pre_tokens", lambda piece: searched.add(piece) or cut(piece))
    text = "Ofonenannt retionerheoure, losasíezmente ertzheitge. ñrrdoción ªº ǅ ÿɏ"
    assert one.encode(text).tolist() == one.tokenizer.encode(text, add_special_tokens=False).ids
    assert searched == {",", "."}


def test_a_worker_holds_two_generations_of_as_many_pieces_as_asked_for():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(60)]
    before = [encoder(path).encode(t) for t in texts]
    forget()
    encode = encoder(path, cached=100)
    for text, ids in zip(texts, before):
        assert np.array_equal(encode.encode(text), ids)
        assert len(encode.pieces) + len(encode.pieces.old) <= 2 * (100 + 3 * 50) and not getattr(encode.pieces.old, "old", None)
    assert encoder(path).cached == CACHED
