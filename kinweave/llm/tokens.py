"""Edit-aware token counts: a segment tree of token counts per document, kept as a table.

A document is cut into segments at places where the tokenizer's pre-tokens certainly begin (white space
after anything else), so segments are encoded one by one and their counts add up to the document's. The
counts and lengths are the leaves of a binary tree of sums. An edit finds its segments by descending in
the sums of lengths, re-encodes those that it touches and one more on either side as boundary context,
and updates the sums above them.

``trees`` makes the table of trees, ``edited`` applies a batch of edits to such a table and gives the new
one: only what the edits touch is encoded again.
"""

from __future__ import annotations

import base64
import re
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, shared_dir

#: Characters after which a segment ends at the next sure boundary.
SEGMENT = 512
#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_SURE = re.compile(r"(?<=\S)(?=[ \n\r\t])")


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, size: int = SEGMENT) -> list[str]:
    """Segments of ``text``; together they are the text. The empty text has none."""
    out, at = [], 0
    while at < len(text):
        m = _SURE.search(text, at + size)
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


class SegmentTree:
    """Token counts and lengths of a document's segments, with sums: node i has the children 2i and 2i+1."""

    def __init__(self, text: str, count, size: int = SEGMENT, known: list[tuple[int, int]] | None = None):
        """``known``: characters and tokens of each segment, if they have been counted before."""
        self.count, self.size, self.encoded, self.visited = count, size, 0, 0
        if known is None:
            self.segments = cuts(text, size)
            tokens = [self._encode(s) for s in self.segments]
        else:
            self.segments, at = [], 0
            for chars, _ in known:
                self.segments.append(text[at : at + chars])
                at += chars
            tokens = [n for _, n in known]
        self._sum(tokens)

    def _encode(self, s: str) -> int:
        self.encoded += len(s)
        return self.count(s)

    def _sum(self, tokens):
        n = 1
        while n < max(1, len(tokens)):
            n *= 2
        self.base, pad = n, [0] * (n - len(tokens))
        self.tree = [0] * n + tokens + pad
        self.chars = [0] * n + [len(s) for s in self.segments] + pad
        for i in range(n - 1, 0, -1):
            self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tree[1]

    def text(self) -> str:
        return "".join(self.segments)

    def leaves(self) -> list[tuple[int, int]]:
        n = len(self.segments)
        return list(zip(self.chars[self.base : self.base + n], self.tree[self.base : self.base + n]))

    def _find(self, at: int) -> tuple[int, int]:
        """The segment in which place ``at`` ends or lies, and where it begins."""
        node, start = 1, 0
        while node < self.base:
            self.visited += 1
            node *= 2
            if at > start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.base, start

    def _set(self, i: int, segment: str, tokens: int) -> None:
        self.segments[i] = segment
        node = self.base + i
        more, longer = tokens - self.tree[node], len(segment) - self.chars[node]
        while node and (more or longer):
            self.tree[node] += more
            self.chars[node] += longer
            node //= 2

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replaces ``delete`` characters from ``at`` by ``insert``; both are cut to the text."""
        length = self.chars[1]
        at = min(max(at, 0), length)
        stop = min(at + max(delete, 0), length)
        first, start = self._find(at)
        last, _ = self._find(stop)
        a, b = max(0, first - 1), min(len(self.segments), last + 2)
        if a < first:
            start -= len(self.segments[a])
        old = "".join(self.segments[a:b])
        new = cuts(old[: at - start] + insert + old[stop - start :], self.size)
        if new and 0 < b - a - len(new):  # the same leaves with shorter segments, or empty ones
            new += [""] * (b - a - len(new))
        elif new and len(new) == b - a + 1:  # one more: two share a leaf
            new[-2:] = ["".join(new[-2:])]
        if len(new) == b - a:
            for i, s in enumerate(new, a):
                self._set(i, s, self._encode(s) if s else 0)
        else:  # sums are made anew; other segments are not encoded again
            tokens = self.tree[self.base : self.base + len(self.segments)]
            tokens[a:b] = [self._encode(s) for s in new]
            self.segments[a:b] = new
            self._sum(tokens)


TREE = "doc_id {}, text string, segments array<struct<chars:int,tokens:int>>, n_tokens long"
_SEGMENTS = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))


def _tree_rows(ids, trees, more):
    """A batch of trees; ``more``: names and columns that follow."""
    columns = {
        "doc_id": ids,
        "text": pa.array([t.text() for t in trees], pa.string()),
        "segments": pa.array([[{"chars": c, "tokens": n} for c, n in t.leaves()] for t in trees], _SEGMENTS),
        "n_tokens": pa.array([t.total for t in trees], pa.int64()),
        **more,
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _build(name: str, size: int):
    def run(batches):
        enc = encoder(SparkFiles.get(name))
        count = lambda s: len(enc.encode_ordinary(s))
        for batch in batches:
            more = {batch.schema.names[i]: batch.column(i) for i in range(2, batch.num_columns)}
            yield _tree_rows(batch.column(0), [SegmentTree(t or "", count, size) for t in batch.column(1).to_pylist()], more)

    return run


def _edit(name: str, size: int):
    def run(batches):
        enc = encoder(SparkFiles.get(name))
        count = lambda s: len(enc.encode_ordinary(s))
        for batch in batches:
            done = []
            for text, segments, edits in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4))):
                tree = SegmentTree(text, count, size, [(s["chars"], s["tokens"]) for s in segments])
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["at"] or 0, e["delete"] or 0, e["insert"] or "")
                done.append(tree)
            more = {"n_tokens_before": batch.column(3), "reencoded_chars": pa.array([t.encoded for t in done], pa.int64())}
            yield _tree_rows(batch.column(0), done, more | {batch.schema.names[i]: batch.column(i) for i in range(5, batch.num_columns)})

    return run


def _schema(df: DataFrame, more: str, carry: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([TREE.format(kinds["doc_id"]) + more, *(f"`{c}` {kinds[c]}" for c in carry)])


def _shipped(spark, tokenizer: str) -> str:
    """Name of a rank file that Spark has handed to the executors."""
    sc, name = spark.sparkContext, tokenizer.rsplit("/", 1)[-1]
    if name not in {f.rsplit("/", 1)[-1] for f in sc.listFiles}:
        sc.addFile(tokenizer)
    return name


def trees(docs: DataFrame, tokenizer: str, size: int = SEGMENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """The table of trees of ``docs`` (doc_id, text): doc_id, text, segments (characters and tokens of each
    leaf), n_tokens and the columns named in ``carry``, one row per row. Null and empty texts have no
    segments and count 0."""
    return docs.select("doc_id", "text", *carry).transform(arrow, _build(_shipped(docs.sparkSession, tokenizer), size), _schema(docs, "", carry))


def edited(table: DataFrame, tokenizer: str, size: int = SEGMENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """A table of trees (with a column edits, array<struct<at,delete,insert>>) after its edits, in order:
    the table's columns, n_tokens_before, reencoded_chars and those named in ``carry``. Null edits change
    nothing; places beyond the text are its end, those before it its beginning."""
    rows = table.select("doc_id", "text", "segments", "n_tokens", "edits", *carry)
    return rows.transform(arrow, _edit(_shipped(table.sparkSession, tokenizer), size), _schema(table, ", n_tokens_before long, reencoded_chars long", carry))


def token_counts(docs: DataFrame, tokenizer: str, size: int = SEGMENT, path: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, edits array<struct<at,delete,insert>>): doc_id, n_tokens,
    n_tokens_edited (after the edits, in order), n_segments, reencoded_chars (by the edits).

    The table of trees is written to ``path`` (by default a new folder beside the session's checkpoints)
    and stays there; the edits are applied to what is read from it, as a later batch would be. ``tokenizer``
    is the path of a rank file on the driver, which Spark hands to the executors. Null and empty texts
    count 0; null edits change nothing; places beyond the text are its end; repeated rows give repeated
    results; an empty table gives an empty result. A very long text without white space is one segment.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    trees(docs, tokenizer, size, ("edits",)).write.mode("overwrite").parquet(path, compression="zstd")
    table = spark.read.parquet(path)
    done = edited(table.withColumn("before", F.size("segments")), tokenizer, size, ("before",))
    return done.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.col("before").cast("long").alias("n_segments"), "reencoded_chars")


def sample_edit(text):
    """An edit for each text: three characters in its middle give way to a word and a digit."""
    at = F.floor(F.length(F.coalesce(text, F.lit(""))) / 2).cast("long")
    return F.array(F.struct(at.alias("at"), F.lit(3).cast("long").alias("delete"), F.lit(" revised 7 ").alias("insert")))
