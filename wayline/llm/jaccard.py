"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document is the set of its distinct word k-grams. Documents link if their sets' Jaccard
similarity reaches a percentage. A partner of a set of n grams shares at least T = its
percentage of n, rounded up: of the n inverted lists, T - 1 may be left aside, and every partner
stands in one of the n - T + 1 others. So the longest T - 1 lists are never merged; the short
ones are, and a candidate found there is looked up in the long ones by binary search.

1. Census: each block of documents sends its distinct grams with their counts, sorted, to groups
   by range of the gram's code, and gets each gram's list length (documents that have it) back.
2. Each block, formed again, orders a document's grams from short lists to long ones and gives
   its short part, without grams that no other document has. Most documents have none left and
   are done. The others carry their set along.
3. Equal sets are one class; its smallest id stands for it. Classes that share a gram of their
   short parts, directly or in a chain, go to the same task (found by connected components over
   narrow rows); a set is sent there once. What is too large for a task is cut into chunks
   and every pair of chunks is a task: exact, but its work grows with the square of the chunks.
4. A task searches its sets with an inverted index as above and gives each class its number of
   links, and as links only those that join what was not joined yet.
5. Components of the links of all classes.

Defined results: a null or empty text, or one without words, has an empty set and links with
nothing, not even another such; a text of fewer than k words is one gram, its whole sequence;
rows of equal id and rows without one are documents each, linked by their own texts alone; a
component's id is the smallest that any of its rows has, null if none has one; a text of any length
is one set, some 15 times its bytes in a task; no rows give none. Only the
named columns are read, so extra columns can't clash. Grams are compared as 64-bit codes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.blocks import BLOCK_BYTES, in_blocks, in_order, pack
from wayline.llm.components import components
from wayline.llm.tables import arrow_schema, as_table, lighten
from wayline.llm.words import U64, mix, rolling, words_of
from wayline.session import materialize

#: Grams of a census group, about: 4 to 6 bytes each as sent.
GROUP_GRAMS = 2_250_000
#: Grams of the sets in a search task, at most (a longer single set is a chunk of its own): 8 bytes
#: each as sent, and some 8 times as much for the index.
TASK_GRAMS = 2_250_000


def least_overlap(n, pct: int):
    """Grams that a partner of a set of n must share with it."""
    return (n * pct + 99) // 100


def gram_sets(texts: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram codes of all rows one after another, and the bounds of the rows."""
    codes, sizes = [], []
    for w in words_of(texts, lower=True):
        words, places = w.codes(), w.windows(k)
        gram, row = [rolling(words, k)[places]], [w.row[places]]
        for n in range(1, k):  # whole sequences of fewer words
            few = np.flatnonzero(w.counts == n)
            gram.append(rolling(words, n)[w.bounds[few]] if len(few) else gram[0][:0])
            row.append(few)
        gram, row = np.concatenate(gram), np.concatenate(row)
        order = np.argsort(gram)
        order = order[np.argsort(row[order].astype(np.uint16) if w.n_rows < 65536 else row[order], kind="stable")]
        gram, row = gram[order], row[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
        codes.append(gram[new])
        sizes.append(np.bincount(row[new], minlength=w.n_rows))
    sizes = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    return np.concatenate(codes) if codes else np.empty(0, U64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class Census:
    """How a block sends its grams: by the first `bits` of their codes, in `parts` ranges.

    The bits tell all grams of the input apart but for a few; two that share them count as one
    list, which changes the order of lists only.
    """

    def __init__(self, total_grams: int):
        self.bits = min(64, 8 * math.ceil((math.log2(total_grams + 2) + 13) / 8))
        self.parts = max(1, math.ceil(total_grams / GROUP_GRAMS))

    def distinct(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct short codes, how many sets have each, and where each gram's is."""
        return np.unique(grams >> U64(64 - self.bits), return_inverse=True, return_counts=True)

    def edges(self, short: np.ndarray) -> np.ndarray:
        cuts = np.array([(i << self.bits) // self.parts for i in range(1, self.parts)], U64)
        return np.concatenate([[0], np.searchsorted(short, cuts), [len(short)]])

    def encode(self, short: np.ndarray) -> tuple[bytes, bytes]:
        """Low 32 bits, and the rest, which hardly changes from one to the next."""
        return pack(short.astype("<u4")), pack((short >> U64(32)).astype("<u4"))


def _length_class(counts: np.ndarray) -> np.ndarray:
    """List lengths in steps of a quarter power of two; 0 for a list of one."""
    return np.where(counts <= 1, 0, np.minimum(255, 1 + 4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def text_code(text: Column) -> Column:
    """Tells texts apart; null is as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def row_code(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that differ in id or text, never null."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))]
    return F.unhex(F.md5(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")))


def _documents(docs: DataFrame, id_col: str, text_col: str, k: int, pct: int, block_bytes: int, coded: bool) -> DataFrame:
    """doc_id, block, n (grams), a and b (codes of the whole set), short (grams of the short part that others have), grams and code of the row (if asked for).

    short and grams are null for sets without partners, and for repeats of a set in its block.
    """
    text = F.col(f"`{text_col}`").cast("string")
    code = row_code(F.col(f"`{id_col}`").cast("long"), text) if coded else F.lit(None).cast("binary")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), code.alias("code"))
    blocks, block_col, total = in_blocks(narrow, "doc_id", "text", block_bytes)
    census = Census(total // 5)
    sent = arrow_schema(kinds := "block int, part int, low binary, high binary, counts binary")

    def send(block: pa.Table) -> pa.Table:
        lighten()
        grams, _ = gram_sets(in_order(block, "doc_id", "text")["text"], k)
        short, _, counts = census.distinct(grams)
        edges = census.edges(short)
        rows = []
        for part in np.flatnonzero(np.diff(edges)).tolist():
            at = slice(edges[part], edges[part + 1])
            rows.append((block["block"][0].as_py(), part, *census.encode(short[at]), pack(counts[at].astype("<u4"))))
        return as_table(dict(zip(sent.names, zip(*rows) if rows else [[]] * 5)), sent)

    answered = arrow_schema(answer_kinds := "block int, part int, lengths binary")

    def answer(group: pa.Table) -> pa.Table:
        lighten()
        read = lambda name: [np.frombuffer(x.as_buffer(), "<u4") for x in group[name]]
        low = read("low")
        codes = np.concatenate(low).astype(U64) | (np.concatenate(read("high")).astype(U64) << U64(32))
        _, where = np.unique(codes, return_inverse=True)
        lengths = _length_class(np.bincount(where, weights=np.concatenate(read("counts"))))[where]
        lengths = np.split(lengths, np.cumsum([len(x) for x in low])[:-1])
        return as_table({"block": group["block"], "part": group["part"], "lengths": [pack(x) for x in lengths]}, answered)

    answers = blocks.groupBy(block_col).applyInArrow(send, kinds).groupBy("part").applyInArrow(answer, answer_kinds)
    out = arrow_schema(out_kinds := "doc_id long, block int, n long, a long, b long, short array<long>, grams binary, code binary")

    def order(block: pa.Table, found: pa.Table) -> pa.Table:
        if block.num_rows == 0:
            return out.empty_table()
        lighten()
        block = in_order(block, "doc_id", "text")
        grams, bounds = gram_sets(block["text"], k)
        short, where, _ = census.distinct(grams)
        edges, length = census.edges(short), np.zeros(len(short), np.uint8)
        for part, data in zip(found["part"].to_pylist(), found["lengths"]):
            length[edges[part] : edges[part + 1]] = np.frombuffer(data.as_buffer(), np.uint8)
        length = length[where]
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams + U64(1)))])
        a = (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64).tolist()
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams ^ U64(0x5851F42D4C957F2D)))])
        b = (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64).tolist()
        shorts, sets, seen = [], [], set()
        for r, key in enumerate(zip(a, b)):
            own, lists = grams[bounds[r] : bounds[r + 1]], length[bounds[r] : bounds[r + 1]]
            ranked = np.argsort(lists, kind="stable")[: len(own) - least_overlap(len(own), pct) + 1]
            part = own[ranked[lists[ranked] > 0]] if len(own) and key not in seen else own[:0]
            seen.add(key)
            shorts.append(part.view(np.int64) if len(part) else None)
            sets.append(pack(own) if len(part) else None)
        columns = {"doc_id": block["doc_id"], "block": block["block"], "n": np.diff(bounds), "a": a, "b": b, "short": shorts, "grams": sets, "code": block["code"]}
        return as_table(columns, out)

    return blocks.groupBy(block_col).cogroup(answers.groupBy("block")).applyInArrow(order, out_kinds)


class Search:
    """Sets of a task, and their inverted lists."""

    def __init__(self, sets: list[np.ndarray], pct: int):
        self.sets, self.pct = sets, pct
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = np.concatenate(sets) if sets else np.empty(0, U64)
        _, self.gram, counts = np.unique(flat, return_inverse=True, return_counts=True)
        self.list_bounds = np.concatenate([[0], np.cumsum(counts)])
        # documents by gram, ascending within a list
        self.lists = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(self.gram, kind="stable")]

    def partners(self, query: int) -> np.ndarray:
        """Sets before the query that reach the similarity with it, ascending."""
        n = int(self.sizes[query])
        least = least_overlap(n, self.pct)
        grams = self.gram[self.bounds[query] : self.bounds[query + 1]]
        begin, lengths = self.list_bounds[grams], self.list_bounds[grams + 1] - self.list_bounds[grams]
        by_length = np.argsort(lengths, kind="stable")
        short, long = by_length[: n - least + 1], by_length[n - least + 1 :]
        merged = np.concatenate([self.lists[begin[i] : begin[i] + lengths[i]] for i in short[lengths[short] > 1]] or [self.lists[:0]])
        found, times = np.unique(merged[merged < query], return_counts=True)
        size = self.sizes[found]
        fits = (size * 100 >= self.pct * n) & (n * 100 >= self.pct * size)
        found, times = found[fits], times[fits]
        # overlap that the pair needs: 100 * overlap >= pct * (n + size - overlap)
        need = (self.pct * (n + self.sizes[found]) + 99 + self.pct) // (100 + self.pct)
        may = times + len(long) >= need
        found, times, need = found[may], times[may], need[may]
        if len(found) and len(long):
            times = times + self._in_long(found, long, begin, lengths)
        return found[times >= need]

    def _in_long(self, found: np.ndarray, long: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """In how many of the long lists each found set stands: by binary search, or, if that is less work, by a scan."""
        total = np.zeros(len(found), np.int64)
        if len(found) * len(long) * 4 > int(lengths[long].sum()):
            marks = np.zeros(len(self.sets), np.int64)
            for i in long:
                marks[self.lists[begin[i] : begin[i] + lengths[i]]] += 1
            return marks[found]
        for i in long:
            one = self.lists[begin[i] : begin[i] + lengths[i]]
            at = np.searchsorted(one, found)
            total += one[np.minimum(at, len(one) - 1)] == found
        return total


def search_task(ids: np.ndarray, copies: np.ndarray, chunk: np.ndarray, sets: list[np.ndarray], pct: int, across: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join the sets of a task, and each set's number of linked documents.

    If the task is across two chunks, only pairs of both are searched for; one of them may have no sets.
    """
    if across and len(np.unique(chunk)) < 2:
        return [], np.zeros(len(sets), np.int64)
    search = Search(sets, pct)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links, counts = [], np.zeros(len(sets), np.int64)
    for query in range(len(sets)):
        found = search.partners(query)
        if across:
            found = found[chunk[found] != chunk[query]]
        counts[query] += copies[found].sum()
        counts[found] += copies[query]
        for other in found.tolist():
            if (x := root(query)) != (y := root(other)):
                parent[x] = y
                links.append((int(ids[query]), int(ids[other])))
    return links, counts


def _tasks(groups: DataFrame, task_grams: int) -> DataFrame:
    """doc_id, a, b, copies, task, chunk, other: small components share tasks, a large one is cut into pairs of chunks.

    other is the chunk that the row's chunk is paired with in the task, itself included.
    """
    size = groups.groupBy("component").agg(F.sum("n").alias("grams"), F.count(F.lit(1)).alias("sets"))
    groups = groups.join(size.where("sets > 1"), "component")
    total = size.agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0]
    shared = max(1, math.ceil(3 * total / task_grams))
    chunks = F.ceil(F.col("grams") * 2 / task_grams)
    own = F.pmod(F.xxhash64("doc_id", F.lit(5)), chunks)
    small = groups.where(F.col("grams") <= task_grams // 2)
    small = small.select("doc_id", "a", "b", "copies", F.pmod(F.xxhash64("component", F.lit(3)), F.lit(shared)).cast("string").alias("task"), F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("other"))
    large = groups.where(F.col("grams") > task_grams // 2).withColumn("chunk", own)
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    task = F.concat_ws("-", F.lit("c"), "component", F.least("chunk", "other"), F.greatest("chunk", "other"))
    return small.unionByName(large.select("doc_id", "a", "b", "copies", task.alias("task"), "chunk", "other"))


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, pct: int = 80, block_bytes: int = BLOCK_BYTES, task_grams: int = TASK_GRAMS, coded: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with the same set),
    component_id (smallest id reachable by links) and n_links (documents it links with).

    `coded` adds row_code and component: a number that the linked rows share whatever their ids
    are, null for empty sets.
    """
    found = materialize(_documents(docs, id_col, text_col, k, pct, block_bytes, coded), "gram-sets")
    narrow = found.select("doc_id", "n", "a", "b", "code")
    classes = narrow.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    # a class has a number of its own, as ids may be null or stand for several texts
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "gram-classes")
    # a class is searched for once, by the first block that carries its set, once in a block
    heads = found.where("short is not null").groupBy("a", "b", "n").agg(F.min("block").alias("block"))
    heads = materialize(heads.join(classes, ["a", "b", "n"]), "gram-heads")
    posts = found.where("short is not null").select("block", "a", "b", F.explode("short").alias("gram"))
    posts = materialize(posts.join(heads.select("block", "a", "b", "class"), ["block", "a", "b"]).select("class", "gram").distinct(), "gram-posts")
    first = posts.groupBy("gram").agg(F.min("class").alias("b"))
    reach = components(posts.join(first, "gram").select(F.col("class").alias("a"), "b"))
    groups = heads.join(reach, heads["class"] == reach["node"]).select(F.col("class").alias("doc_id"), "a", "b", "n", "copies", "component")
    tasks = _tasks(materialize(groups, "gram-groups"), task_grams).join(heads.select("a", "b", "block"), ["a", "b"])
    sets = found.where("grams is not null").select("block", "a", "b", "grams")
    sets = sets.join(tasks, ["block", "a", "b"]).select(F.col("doc_id").alias("class"), "a", "b", "copies", "task", "chunk", "other", "grams")
    out = arrow_schema(kinds := "a long, b long, links long")

    def run(task: pa.Table) -> pa.Table:
        rows = task.combine_chunks()
        ids, copies, chunk, other = (rows[c].to_numpy() for c in ("class", "copies", "chunk", "other"))
        links, counts = search_task(ids, copies, chunk, [np.frombuffer(x.as_buffer(), "<u8") for x in rows["grams"]], pct, bool(chunk[0] != other[0]))
        some = np.flatnonzero(counts)
        a = np.concatenate([np.array([x for x, _ in links], np.int64), ids[some]])
        b = np.concatenate([np.array([x for _, x in links], np.int64), ids[some]])
        return as_table({"a": a, "b": b, "links": np.concatenate([np.zeros(len(links), np.int64), counts[some]])}, out)

    links = materialize(sets.groupBy("task").applyInArrow(run, kinds), "links")
    label = materialize(components(links.where("a <> b").select("a", "b")), "gram-labels")
    counts = links.where("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    least = label.join(classes, label["node"] == classes["class"]).groupBy("component").agg(F.min("class_id").alias("least"))
    label = label.join(least, "component").select(F.col("node").alias("class"), "component", "least")
    classes = classes.drop("n").join(counts, "class", "left").join(label, "class", "left")
    rows = narrow.join(classes, ["a", "b"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("least", "class_id", "doc_id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.col("code").alias("row_code"),
        F.coalesce("component", "class").alias("component"),
    )
    return rows if coded else rows.drop("row_code", "component")
