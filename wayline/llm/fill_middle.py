"""Fill-in-middle examples, cut between tokens that memoized content-defined chunks count.

A token is a run of ASCII letters or any other single character. A text is cut into chunks where
a rolling hash of its last 32 bytes hits a pattern, so equal passages of different texts fall into
equal chunks. A chunk's summary (its tokens, its characters, whether it begins and ends with a
letter) is computed once a task and cached under the chunk's content, so a hash alone never
vouches for it. A document's tokens are the sum of its chunks' tokens, less one where a run of
letters goes on across an edge; running sums of these counts name the chunk that holds a cut, and
only that chunk is read for the place.

The cuts, the form and the order come from a hash of seed and id, so a lost task gives the same
again. The plain form keeps the text, also where it is empty or holds a mark itself, so `restore`
gives back every text exactly.

Defined results: a null text is empty, hence plain with no tokens; a null id hashes as an empty
string; rows of equal id are cut alike, repeated rows are an example each; a text of any length is
read whole, and takes some ten times its bytes in the task (texts share a run of 1 MB, a longer
text is a run of its own); no rows give none. Only the named columns are read, so extra columns
can't clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.tables import arrow_schema, as_table, fresh, plus
from wayline.llm.words import mix, row_bytes, runs

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that the rolling hash sees; a chunk has so many at least, and 2**CHUNK_BITS more on average.
WINDOW = 32
CHUNK_BITS = 9
#: Longest chunk, in bytes: beyond it a chunk is cut at the next character.
CHUNK_MOST = 4096
#: Content that a task's cache holds; a full cache is emptied.
CACHE_BYTES = 16 << 20

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_CONTINUED = bytes(range(0x80, 0xC0))
#: Byte → a for a letter, . for another character's first byte.
_KINDS = bytes(97 if chr(b).isalpha() and b < 128 else 46 for b in range(256))
_TOKEN = re.compile(rb"[A-Za-z]+|[^A-Za-z][\x80-\xBF]*")


@dataclass(frozen=True)
class Fim:
    seed: int = 1
    #: of 100 texts, those that become examples; the rest stay plain
    rate: int = 90
    #: of 100 examples, those that begin with the suffix
    spm: int = 20


@dataclass(frozen=True)
class Summary:
    """What a chunk adds to its document."""

    tokens: int
    characters: int
    begins: bool  # with a letter
    ends: bool


def summary(chunk: bytes) -> Summary:
    kinds = chunk.translate(_KINDS, _CONTINUED)
    begins = kinds.startswith(b"a")
    return Summary(kinds.count(b".") + kinds.count(b".a") + begins, len(kinds), begins, kinds.endswith(b"a"))


def chunk_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the chunks of consecutive texts, in ascending order; a text's end is one."""
    if not len(data):
        return np.empty(0, np.int64)
    rolled, width = _GEAR[data], 1
    while width < WINDOW:  # sums of twice as many bytes, each shifted by its distance
        rolled[width:] += rolled[:-width] << np.uint32(width)
        width *= 2
    hits = np.flatnonzero(rolled >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    hits = hits[hits < len(data)]
    starts = bounds[np.searchsorted(bounds, hits, "right") - 1]
    hits = hits[(hits - starts >= WINDOW) & (data[hits] & 0xC0 != 0x80)]
    ends = np.unique(np.concatenate([hits, bounds[1:]]))
    ends = ends[ends > 0]
    begins = np.concatenate([[0], ends[:-1]])
    forced = []
    for i in np.flatnonzero(ends - begins > CHUNK_MOST):
        at = int(begins[i]) + CHUNK_MOST
        while at < ends[i]:
            while data[at] & 0xC0 == 0x80:
                at -= 1
            forced.append(at)
            at += CHUNK_MOST
    return np.unique(np.concatenate([ends, np.array(forced, np.int64)])) if forced else ends


class Chunks:
    """Summaries by content, for one task."""

    def __init__(self) -> None:
        self.known: dict[bytes, Summary] = {}
        self.held = 0

    def of(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is None:
            if self.held > CACHE_BYTES:
                self.known.clear()
                self.held = 0
            found = self.known[chunk] = summary(chunk)
            self.held += len(chunk)
        return found


class Counted:
    """A text's chunks with running counts of the tokens that begin in them."""

    def __init__(self, chunks: list[bytes], summaries: list[Summary]) -> None:
        self.chunks = chunks
        # whether a chunk's first letters belong to a token that began before
        self.joined = [i > 0 and x.begins and summaries[i - 1].ends for i, x in enumerate(summaries)]
        self.tokens = [0, *accumulate(x.tokens - j for x, j in zip(summaries, self.joined))]
        self.characters = [0, *accumulate(x.characters for x in summaries)]
        self.bytes = [0, *accumulate(map(len, chunks))]

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and characters of the first k tokens."""
        if k == self.tokens[-1]:
            return self.bytes[-1], self.characters[-1]
        # the chunk in which token k begins: chunks that only go on with a token begin none
        i = bisect_right(self.tokens, k) - 1
        nth = k - self.tokens[i] + self.joined[i]
        at = next(islice(_TOKEN.finditer(self.chunks[i]), nth, None)).start()
        return self.bytes[i] + at, self.characters[i] + summary(self.chunks[i][:at]).characters


def example(text: bytes, counted: Counted, hashes: tuple[int, int, int, int], how: Fim) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, characters of prefix and middle, output."""
    n = counted.tokens[-1]
    a, b, plain, order = hashes
    if not text or plain % 100 >= how.rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((a % (n + 1), b % (n + 1)))
    (p, p_chars), (m, m_chars) = counted.cut(first), counted.cut(last)
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    if order % 100 < how.spm:
        form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return n, form, p_chars, m_chars - p_chars, b"".join(parts)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Fim = Fim()) -> DataFrame:
    """The id column, n (tokens), form, prefix_chars, middle_chars (null if plain), output (text)."""
    rows = docs.select(docs[f"`{id_col}`"], docs[f"`{text_col}`"].cast("string").alias(text := "text_" if id_col == "text" else "text"))
    key = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    names = [fresh(rows, f"h{i}") for i in range(4)]
    hashes = [F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("long").alias(name) for i, name in enumerate(names)]
    rows = rows.select("*", *hashes)
    out = plus(rows.select(f"`{id_col}`").schema, n="long", form="string", prefix_chars="long", middle_chars="long", output="string")
    sent = arrow_schema("n long, form string, prefix_chars long, middle_chars long, output string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Chunks()
        for batch in batches:
            data, bounds = row_bytes(batch.column(1))
            codes = np.stack([batch.column(2 + i).to_numpy() for i in range(4)], 1).tolist()
            for a, b in runs(bounds):
                part, rows_at = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                ends, whole = chunk_ends(part, rows_at), part.tobytes()
                edges = np.concatenate([[0], ends]).tolist()
                last = np.searchsorted(ends, rows_at, "right").tolist()
                made = []
                for r in range(b - a):
                    pieces = [whole[edges[i] : edges[i + 1]] for i in range(last[r], last[r + 1])]
                    counted = Counted(pieces, [known.of(x) for x in pieces])
                    made.append(example(whole[rows_at[r] : rows_at[r + 1]], counted, codes[a + r], how))
                columns = as_table(dict(zip(sent.names, zip(*made))), sent)
                ids = batch.column(0).slice(a, b - a)
                yield from columns.add_column(0, pa.field(id_col, ids.type), ids).to_batches()

    return rows.mapInArrow(run, out)


def restore(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text of an example. A text that isn't plain holds no mark, so marks split it into its parts."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(parts[2], parts[3], parts[1]))
