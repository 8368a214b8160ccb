"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A commit adds signed rows: a document inserted counts +1, a deleted one -1, a revised one -1 with its
old and +1 with its new counts. Every commit is written as a folder of its own, rows and their sums; then a
marker, written whole beside and renamed into place only if none is there yet, makes it count. So a batch
that is sent again, or by two drivers at once, counts once, and a commit broken off anywhere leaves nothing.
Totals are the sums of the commits' sums.

Rows lie in parts by the hash of doc_id, so a change reads only the parts of its documents. Compaction puts
all commits so far into one folder, in the same way: what it replaces counts until the new base is in place.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from storkline.llm import text

KEYS = ["source", "lang", "tokenizer"]
AMOUNTS = ["n_docs", "n_tokens", "n_chars"]
#: parts of the rows by doc_id; fixed for a folder once something is written
PARTS = 32
_ROWS = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
_STORED = f"{_ROWS}, part int"
_SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"

#: the pattern that cuts texts before the merges of the rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: a text is cut between words after about so many characters
PIECE = 100_000
#: runs of so much white space are cut off, as the pattern's look-ahead fails on very long ones
RUN = 10_000
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file and their ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _cut(t: str) -> Iterator[str]:
    """A long text in parts that no token crosses: a part ends before a space between two other
    characters, where the pattern always begins anew."""
    at = 0
    while len(t) - at > PIECE:
        end = t.find(" ", at + PIECE)
        while 0 < end < len(t) - 1 and (t[end - 1].isspace() or t[end + 1].isspace()):
            end = t.find(" ", end + 1)
        if not 0 < end < len(t) - 1:
            break
        yield t[at:end]
        at = end
    yield t[at:]


def _parts(t: str) -> Iterator[tuple[bool, str]]:
    """The text in parts that no token crosses, and whether a part is a long run of white space: the
    pattern takes such a run in one piece, but for its last character if another one follows."""
    at = 0
    for m in re.finditer(f"[{_WHITE}]{{{RUN},}}", t) if len(t) >= RUN else ():
        end = m.end() if m.end() == len(t) else m.end() - 1
        yield from ((False, part) for part in _cut(t[at:m.start()]))
        yield True, t[m.start():end]
        at = end
    yield from ((False, part) for part in _cut(t[at:]))


def _counter(ranks: dict[bytes, int], tokenizer: str) -> Callable[[str], int]:
    """How many tokens a text has."""
    import tiktoken

    words, runs = (tiktoken.Encoding(tokenizer, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, r"\s+"))
    return lambda t: sum(len((runs if white else words).encode_ordinary(part)) for white, part in _parts(t))


def _count(ranks, tokenizer: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = _counter(ranks.value, tokenizer)
        for batch in text.chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [tokens_of(t) for t in texts]
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("doc_id", "source", "lang")), pa.array([tokenizer] * n), pa.array([1] * n, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array([len(t) for t in texts], pa.int64())],
                ["doc_id", *KEYS, *AMOUNTS],
            )
    return run


def count(docs: DataFrame, ranks: dict[bytes, int], tokenizer: str) -> DataFrame:
    """A row for every row of `docs`, as an insert: `doc_id`, KEYS and AMOUNTS. A null or empty text has
    no tokens; null ids, sources and languages stay null; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a rank file has a fixed size
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
    return plain.mapInArrow(_count(shared, tokenizer), _ROWS)


_NOT_ZERO = " or ".join(f"{c} <> 0" for c in AMOUNTS)


def _part() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")


class Rollup:
    """Totals below a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marker(self, batch: str):
        name = base64.urlsafe_b64encode(batch.encode()).decode()
        return self._paths(f"{self.path}/commits/{name}")

    def _read(self, path) -> dict | None:
        """What a marker says; None where it was never finished."""
        stream = self._files.open(path)
        try:
            content = bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
        finally:
            stream.close()
        try:
            return json.loads(content)
        except ValueError:
            return None

    def _write(self, path, content: dict) -> None:
        self._files.mkdirs(path.getParent())
        stream = self._files.create(path, False)
        stream.write(json.dumps(content).encode())
        stream.close()

    def _rename(self, source, target) -> None:
        """Put a file in place; fails if one is there."""
        kinds = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(kinds, 1)
        never_over[0] = kinds.NONE
        self._files.mkdirs(target.getParent())
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(source, target, never_over)

    def _put(self, target, content: dict) -> bool:
        """Make a marker, whole or not at all; False if there is one."""
        beside = self._paths(f"{self.path}/pending/{uuid.uuid4().hex}")
        self._write(beside, content)
        try:
            self._rename(beside, target)
        except Exception:
            if self._files.exists(target):  # another driver was first, or this one without being told so
                return self._read(target) == content
            raise
        return True

    def _listed(self, folder: str) -> dict[str, dict]:
        """The finished markers in a folder by name."""
        top = self._paths(f"{self.path}/{folder}")
        if not self._files.exists(top):
            return {}
        found = {status.getPath().getName(): self._read(status.getPath()) for status in self._files.listStatus(top)}
        return {name: content for name, content in found.items() if content}

    def _state(self) -> tuple[int, dict[str, str], dict | None]:
        """The number of bases so far, the commits by marker name and the last base."""
        bases = self._listed("bases")
        last = max(bases, default=None)
        return (int(last) if last else 0), {n: c["folder"] for n, c in self._listed("commits").items()}, bases.get(last)

    def commits(self) -> list[str]:
        """The folders that count: the last base, and the commits that it does not hold."""
        _, commits, base = self._state()
        held = set(base["holds"]) if base else set()
        return ([base["folder"]] if base else []) + [folder for name, folder in commits.items() if name not in held]

    def _load(self, folders: list[str], kind: str, schema: str) -> DataFrame:
        top = f"{self.path}/{kind}"
        read = self.spark.read.schema(f"{schema}, folder string").option("basePath", top)
        return read.parquet(*(f"{top}/folder={own}" for own in folders)) if folders else self.spark.createDataFrame([], schema)

    def _store(self, changes: DataFrame) -> str:
        """Write signed rows, by part, and their sums to new folders of one name."""
        own = uuid.uuid4().hex
        parted = changes.select("doc_id", *KEYS, *AMOUNTS).withColumn("part", _part())
        parted.hint("rebalance", F.col("part")).write.partitionBy("part").parquet(f"{self.path}/rows/folder={own}")
        sums = self._load([own], "rows", _STORED).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in AMOUNTS))
        sums.write.parquet(f"{self.path}/sums/folder={own}")
        return own

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add signed rows (`doc_id`, KEYS, AMOUNTS) under the name of a batch; False if a batch of that
        name counts already, whatever it held."""
        marker = self._marker(batch)
        if self._files.exists(marker):
            if self._read(marker):
                return False
            self._files.delete(marker, False)  # begun by some other means and never finished
        return self._put(marker, {"folder": self._store(changes)})

    def compact(self) -> bool:
        """Put all commits so far into one folder; False if there is nothing to put together, or another
        driver did so first. Commits made meanwhile stay beside it. What was read before stays readable
        until `clean`."""
        number, commits, base = self._state()
        if not set(commits) - set(base["holds"] if base else ()):
            return False
        held = set(base["holds"]) if base else set()
        folders = ([base["folder"]] if base else []) + [folder for name, folder in commits.items() if name not in held]
        rows = self._load(folders, "rows", _STORED).groupBy("part", "doc_id", *KEYS).agg(*(F.sum(c).alias(c) for c in AMOUNTS))
        folder = self._store(rows.filter(_NOT_ZERO))
        return self._put(self._paths(f"{self.path}/bases/{number + 1:012}"), {"folder": folder, "holds": sorted(commits)})

    def clean(self) -> None:
        """Remove folders that do not count and what broken-off commits left. Not while others read or write."""
        kept = {f"folder={own}" for own in self.commits()}
        for top, keep in (("rows", kept), ("sums", kept), ("pending", set())):
            path = self._paths(f"{self.path}/{top}")
            for status in self._files.listStatus(path) if self._files.exists(path) else ():
                if status.getPath().getName() not in keep:
                    self._files.delete(status.getPath(), True)

    def counted(self, ids: DataFrame | None = None) -> DataFrame:
        """The documents that count now, or those of `ids` (`doc_id`): `doc_id`, KEYS and AMOUNTS, inserts
        and deletes set off. Only the parts that ids fall into are read."""
        rows = self._load(self.commits(), "rows", _STORED)
        if ids is not None:
            wanted = ids.select("doc_id").distinct()
            parts = [r.part for r in wanted.select(_part().alias("part")).distinct().collect()]  # PARTS at most
            rows = rows.filter(F.col("part").isin(parts)).join(wanted, "doc_id", "left_semi")
        return rows.groupBy("doc_id", *KEYS).agg(*(F.sum(c).alias(c) for c in AMOUNTS)).filter(_NOT_ZERO)

    def deletes(self, ids: DataFrame, tokenizer: str | None = None) -> DataFrame:
        """The changes that take back the documents of `ids` (`doc_id`), of one tokenizer or all. Ids
        that do not count, repeated ones and null change nothing more."""
        old = self.counted(ids)
        old = old.filter(F.col("tokenizer") == tokenizer) if tokenizer else old
        return old.select("doc_id", *KEYS, *((-F.col(c)).alias(c) for c in AMOUNTS))

    def revisions(self, counts: DataFrame) -> DataFrame:
        """The changes that put new counts (`count`) in place of the old ones of these documents and
        tokenizers; documents that did not count are inserted."""
        old = self.counted(counts).join(counts.select("doc_id", "tokenizer").distinct(), ["doc_id", "tokenizer"], "left_semi")
        return old.select("doc_id", *KEYS, *((-F.col(c)).alias(c) for c in AMOUNTS)).unionByName(counts.select("doc_id", *KEYS, *AMOUNTS))

    def totals(self) -> DataFrame:
        """KEYS and AMOUNTS over all commits, without groups that hold nothing."""
        sums = self._load(self.commits(), "sums", _SUMS).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in AMOUNTS))
        return sums.filter(_NOT_ZERO)
