"""New batches against all accepted history by content hash and SimHash, through an index of immutable segments.

The texts behind the entries are not kept, so the text of an entry is made of what is: its fingerprint is
cut into twice as many blocks as bits may differ, and every choice of half of the blocks is written down as
one word (20 words of 31 to 33 bits for three bits), followed by words for content hash and id. Two
fingerprints that differ in at most ``bits`` places have at least half of the blocks in common, so they share
a whole word. A *segment* is the sparse suffix array over the concatenated texts of one batch: all suffixes
that begin at a word, sorted, in Parquet files of small row groups. It is written once and never changed.

A batch writes its own segment and is looked up in all segments by binary search: footers tell which row
groups can hold a word, only those are read, and ``searchsorted`` finds the range inside. The blocks covered
by a match are aggregated to the coverage of the pair (half of the blocks at least), then bits are compared.
So what a batch reads follows the batch; history is not replayed. Neighbouring segments merge whenever the
newer one has reached the older one's size, so their number is logarithmic. A numbered manifest, put in place by one
rename, names the segments that count; whatever a killed writer left behind is in no manifest.

A suffix carries the two earliest entries (of different ids) of its value, so a fingerprint that a third of
all rows share is one row, and a lookup gives one best entry per row instead of all pairs. Rows that share a
word with many others are spread over tasks by a salt; the files can be read by any task.

Among several earlier entries the one with equal content hash wins, then the nearest, then the earliest.
Defined results: entries without a usable fingerprint only match by content hash and the other way
round; the fingerprint of empty text matches nothing; an id that came before is no case; repeated rows
of an id are one id; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import cut, ensure_checkpoint_dir

EMPTY_TEXT = "e3b0c44298fc1c14"  # fixed value: first 16 digits of the SHA-256 of nothing
BITS = 64
SHARD_ROWS = 1_000_000  # suffixes a shard aims at
TASK_ROWS = 200_000  # lookups a task aims at
HELD = 2_000_000  # matches looked at together
ROW_GROUP = 1 << 18  # bytes of a row group, the unit that a lookup reads
NONE = 1 << 62  # no entry
_KIND = 58  # words begin with five bits that tell their kind
_U = np.uint64


def blocks(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the 2 * bits blocks of a fingerprint."""
    n = max(2, 2 * bits)
    edges = [i * BITS // n for i in range(n + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]


def words(fp: Column, bits: int) -> Column:
    """All words of a fingerprint, as an array."""
    every, out = blocks(bits), []
    for kind, chosen in enumerate(combinations(every, len(every) // 2)):
        value = F.lit(0).cast("bigint")
        for shift, width in chosen:
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")))
        # shifted to the 58 bits that follow the kind
        out.append(F.shiftleft(value, _KIND - sum(w for _, w in chosen)).bitwiseOR(F.lit(kind << _KIND).cast("bigint")))
    return F.array(*out)


def coverage(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Number of blocks that two fingerprints have in common."""
    x, out = a ^ b, np.zeros(len(a), np.int64)
    for shift, width in blocks(bits):
        out += ((x >> _U(shift)) & _U((1 << width) - 1)) == 0
    return out


def _hashed(c: Column, kind: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 64 - _KIND).bitwiseOR(F.lit(kind << _KIND).cast("bigint"))


def _check(c: Column) -> Column:
    return F.xxhash64(F.lit(7), c)


def _power(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder as Spark names it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


class Reader:
    """Sorted Parquet files read by row groups; keeps a few of them, and counts the bytes read."""

    def __init__(self, root: str, columns: tuple[str, ...], kept: int = 16) -> None:
        self.fs, self.root = filesystem(root)
        self.columns, self.kept, self.bytes = list(columns), kept, 0
        self.files: dict[str, list] = {}
        self.groups: OrderedDict = OrderedDict()

    def _open(self, folder: str) -> list:
        """(file, least key of each row group, greatest key, bytes) of a shard; a shard without rows has no folder."""
        if folder not in self.files:
            from pyarrow import fs, parquet

            found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
            out = []
            for x in found:
                if not x.path.endswith(".parquet"):
                    continue
                f = parquet.ParquetFile(self.fs.open_input_file(x.path))
                self.bytes += f.metadata.serialized_size
                at = f.schema_arrow.get_field_index(self.columns[0])
                groups = [f.metadata.row_group(i) for i in range(f.metadata.num_row_groups)]
                stats = [g.column(at).statistics for g in groups]
                out.append((f, np.array([s.min for s in stats], np.int64), np.array([s.max for s in stats], np.int64), [g.total_byte_size for g in groups]))
            self.files[folder] = out
        return self.files[folder]

    def _group(self, folder: str, n: int, i: int) -> list[np.ndarray]:
        at = (folder, n, i)
        if at not in self.groups:
            f, _, _, sizes = self.files[folder][n]
            t = f.read_row_group(i, columns=self.columns)
            self.bytes += sizes[i]
            self.groups[at] = [t.column(c).to_numpy() for c in self.columns]
            while len(self.groups) > self.kept:
                self.groups.popitem(last=False)
        self.groups.move_to_end(at)
        return self.groups[at]

    def matches(self, folder: str, keys: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """(query numbers, columns of the rows with their keys); ``keys`` are sorted. About ``HELD`` rows at a time."""
        for n, (_, least, most, _) in enumerate(self._open(folder)):
            first, last = np.searchsorted(keys, least, "left"), np.searchsorted(keys, most, "right")
            for i in np.flatnonzero(last > first).tolist():
                rows = self._group(folder, n, i)
                part = keys[first[i] : last[i]]
                a, z = np.searchsorted(rows[0], part, "left"), np.searchsorted(rows[0], part, "right")
                total = np.concatenate(([0], np.cumsum(z - a)))
                low = 0
                # whole ranges of several queries together; one long range (a row group at most) alone
                while low < len(part):
                    high = max(low + 1, int(np.searchsorted(total, total[low] + HELD, "right")) - 1)
                    count = (z - a)[low:high]
                    which = np.repeat(np.arange(low, high), count)
                    at = np.arange(len(which)) - np.repeat(total[low:high] - total[low], count) + np.repeat(a[low:high], count)
                    if len(which):
                        yield which + first[i], [c[at] for c in rows]
                    low = high


SUFFIX = ("key", "check", "seq1", "idh1", "seq2")
BEST = "seq bigint, kind int, distance int, at bigint"
SAME_TEXT, SAME_PRINT, SAME_ID, NEAR, READ = 0, 1, 2, 3, 9  # what a lookup found; READ rows hold bytes


def _best(seq: np.ndarray, kind: np.ndarray, distance: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """The nearest and then earliest entry of each (seq, kind)."""
    order = np.lexsort((at, distance, kind, seq))
    seq, kind, distance, at = seq[order], kind[order], distance[order], at[order]
    new = np.concatenate(([True], (seq[1:] != seq[:-1]) | (kind[1:] != kind[:-1]))) if len(seq) else np.zeros(0, bool)
    return pd.DataFrame({"seq": seq[new], "kind": kind[new], "distance": distance[new], "at": at[new]})


class SegmentIndex:
    """Accepted entries as immutable segments in a shared folder. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str, bits: int = 3) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        self.spark, self.bits = spark, bits
        self.root = str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())
        self.fs, self.path = filesystem(self.root)
        self.kinds = len(list(combinations(blocks(bits), len(blocks(bits)) // 2)))
        self._read: list[DataFrame] = []

    # -- manifests

    def manifest(self) -> dict:
        """The newest complete manifest."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/manifest", allow_not_found=True))
        numbers = [int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json")]
        if not numbers:
            return {"version": 0, "batch": -1, "segments": [], "results": {}}
        with self.fs.open_input_stream(f"{self.path}/manifest/{max(numbers):09d}.json") as f:
            return json.loads(f.read())

    def _commit(self, manifest: dict) -> None:
        """Put the next manifest in place by one rename."""
        number = manifest["version"] + 1
        target = f"{self.path}/manifest/{number:09d}.json"
        self.fs.create_dir(f"{self.path}/manifest")
        if self.fs.get_file_info(target).is_file:
            raise RuntimeError(f"manifest {number} exists: another writer was faster")
        part = f"{target}.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(manifest | {"version": number}).encode())
        self.fs.move(part, target)

    def vacuum(self) -> list[str]:
        """Remove what the newest manifest doesn't name; no reader or writer may be at work meanwhile.

        Of merged segments the owners stay, as they hold the results of their batch.
        """
        from pyarrow import fs

        m = self.manifest()
        live, told = {s["name"] for s in m["segments"]}, set(m["results"].values())
        gone = []
        for x in self.fs.get_file_info(fs.FileSelector(f"{self.path}/segments", allow_not_found=True)):
            folder = f"{x.base_name}/suffixes" if x.base_name in told else x.base_name
            if x.base_name not in live and self.fs.get_file_info(f"{self.path}/segments/{folder}").type == fs.FileType.Directory:
                self.fs.delete_dir(f"{self.path}/segments/{folder}")
                gone.append(folder)
        return gone

    # -- writing

    def _write(self, df: DataFrame, folder: str, key: str, shards: int) -> None:
        sharded = df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
        ordered = sharded.repartition(shards, "shard").sortWithinPartitions("shard", key)
        ordered.write.option("parquet.block.size", ROW_GROUP).option("parquet.enable.dictionary", "false").partitionBy("shard").parquet(f"{self.root}/segments/{folder}")

    def _stored(self, part: str, *names: str) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*(f"{self.root}/segments/{n}/{part}" for n in names))

    def _suffixes(self, rows: DataFrame) -> DataFrame:
        def earliest(by: str) -> DataFrame:
            """The earliest entry of each value, and the earliest with another id."""
            per_id = rows.where(F.col(by).isNotNull()).groupBy(by, F.xxhash64("id").alias("idh")).agg(F.min("seq").alias("seq"))
            first = per_id.groupBy(by).agg(F.min(F.struct("seq", "idh")).alias("first"))
            other = per_id.join(first, by).where(F.col("idh") != F.col("first.idh")).groupBy(by).agg(F.min("seq").alias("seq2"))
            both = first.join(other, by, "left")
            return both.select(by, F.col("first.seq").alias("seq1"), F.col("first.idh").alias("idh1"), F.coalesce("seq2", F.lit(NONE)).alias("seq2"))

        entries = ["seq1", "idh1", "seq2"]
        prints = earliest("fp").select(F.explode(words(F.col("fp"), self.bits)).alias("key"), F.col("fp").alias("check"), *entries)
        texts = earliest("ch").select(_hashed(F.col("ch"), self.kinds).alias("key"), _check(F.col("ch")).alias("check"), *entries)
        first = rows.groupBy("id").agg(F.min("seq").alias("seq1"))
        ids = first.select(
            _hashed(F.col("id"), self.kinds + 1).alias("key"), _check(F.col("id")).alias("check"), "seq1", F.xxhash64("id").alias("idh1"), F.lit(NONE).alias("seq2")
        )
        return prints.unionByName(texts).unionByName(ids)

    # -- lookups

    def _spread(self, asked: DataFrame, key: str, rows: int, shards: int) -> DataFrame:
        """Lookups by shard, sorted; a shard that many ask for is split by a salt, as every task can read every file."""
        asked = asked.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
        salts = F.lit(1)
        if rows > TASK_ROWS:
            hot = asked.groupBy("shard").count().where(F.col("count") > TASK_ROWS).collect()  # a number for each hot shard
            for r in hot:
                salts = F.when(F.col("shard") == r[0], F.lit(-(-r[1] // TASK_ROWS))).otherwise(salts)
        salted = asked.withColumn("salt", F.pmod(F.xxhash64(*asked.columns), salts))
        # a small batch is few tasks, as each reads the footers of its shards
        tasks = max(min(self.spark.sparkContext.defaultParallelism, 1 + rows // 2_000), -(-rows // TASK_ROWS))
        return salted.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", key)

    def _lookup(self, asked: DataFrame, rows: int, segments: list[dict]) -> DataFrame:
        """Best entry per (seq, kind). asked: (seq, idh, kind, key, check); ``NEAR`` compares bits, the others are equal."""
        shards = max(s["shards"] for s in segments)
        root, bits, half = f"{self.root}/segments", self.bits, len(blocks(self.bits)) // 2

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader, told = Reader(root, SUFFIX), 0
            for b in batches:
                shard = b["shard"].to_numpy()
                seq, idh, kind, key, check = (b[c].to_numpy() for c in ("seq", "idh", "kind", "key", "check"))
                out = []
                for h in np.unique(shard).tolist():
                    low, high = np.searchsorted(shard, [h, h + 1])
                    for s in segments:
                        for which, (_, c2, seq1, idh1, seq2) in reader.matches(f"{s['name']}/suffixes/shard={h % s['shards']}", key[low:high]):
                            q = which + low
                            k, c1 = kind[q], check[q]
                            x = (c1 ^ c2).view(np.uint64)
                            near = k == NEAR
                            distance = np.where(near, np.bitwise_count(x), 0).astype(np.int32)
                            ok = np.where(near, (distance > 0) & (distance <= bits), x == 0)
                            ok[near] &= coverage(c1[near].view(np.uint64), c2[near].view(np.uint64), bits) >= half
                            at = np.where((idh1 != idh[q]) | (k == SAME_ID), seq1, seq2)
                            ok &= at < seq[q]
                            if ok.any():
                                out.append(_best(seq[q][ok], k[ok], distance[ok], at[ok]))
                if out:
                    whole = pd.concat(out)
                    yield _best(*(whole[c].to_numpy() for c in ("seq", "kind", "distance", "at")))
                yield pd.DataFrame({"seq": [-1], "kind": [READ], "distance": [0], "at": [reader.bytes - told]})
                told = reader.bytes

        found = cut(self._spread(asked, "key", rows, shards).mapInPandas(run, BEST))
        self._read.append(found)
        return found.where(F.col("kind") != READ).groupBy("seq", "kind").agg(F.min(F.struct("distance", "at")).alias("best")).select("seq", "kind", "best.*")

    def _owners(self, asked: DataFrame, rows: int, segments: list[dict]) -> DataFrame:
        """``(at, rep)``: the representatives of entries, by their seq. asked: (at)."""
        shards = max(s["owner_shards"] for s in segments)
        root = f"{self.root}/segments"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader, told = Reader(root, ("seq", "rep")), 0
            for b in batches:
                shard, at = b["shard"].to_numpy(), b["at"].to_numpy()
                for h in np.unique(shard).tolist():
                    low, high = np.searchsorted(shard, [h, h + 1])
                    for s in segments:
                        for which, (_, rep) in reader.matches(f"{s['name']}/owners/shard={h % s['owner_shards']}", at[low:high]):
                            yield pd.DataFrame({"at": at[which + low], "rep": rep, "kind": SAME_ID})
                yield pd.DataFrame({"at": [reader.bytes - told], "rep": [None], "kind": [READ]})
                told = reader.bytes

        found = cut(self._spread(asked, "at", rows, shards).mapInPandas(run, "at bigint, rep string, kind int"))
        self._read.append(found)
        return found.where(F.col("kind") != READ).select("at", "rep")

    def bytes_read(self) -> int:
        """Bytes of segments that the last ingest read."""
        return sum(int(d.where(F.col("kind") == READ).agg(F.sum("at")).head()[0] or 0) for d in self._read)

    # -- batches

    def ingest(self, rows: DataFrame, batch: int, accepted: bool = False) -> bool:
        """Match a batch (seq, id, ch, fp, known_rep), keep its results and add its segment; once for each number.

        ``accepted`` rows are history: they keep the representative they came with and are matched with nothing.
        """
        self.compact()
        m = self.manifest()
        if batch <= m["batch"]:
            return False
        self._read = []
        rows = cut(rows)
        n = rows.count()
        name = f"{batch:06d}-{uuid.uuid4().hex[:12]}"
        shards = _power(n * (self.kinds + 2) / SHARD_ROWS)
        owner_shards = _power(n / SHARD_ROWS)
        segment = {"name": name, "rows": n, "shards": shards, "owner_shards": owner_shards}
        if n:
            self._write(self._suffixes(rows), f"{name}/suffixes", "key", shards)
            told = rows.groupBy("id").agg(F.min("known_rep").alias("rep")) if accepted else self._matched(rows, n, m["segments"], segment)
            if accepted:
                told = rows.select("seq", "id").join(told, "id").select("seq", F.coalesce("rep", "id").alias("rep"), F.lit(False).alias("duplicate"))
            self._write(told, f"{name}/owners", "seq", owner_shards)
        self._commit(m | {"batch": batch, "segments": m["segments"] + ([segment] if n else []), "results": m["results"] | ({str(batch): name} if n else {})})
        return True

    def _matched(self, rows: DataFrame, n: int, old: list[dict], own: dict) -> DataFrame:
        """``(seq, rep, duplicate)`` of every row of a batch."""
        segments = [*old, own]
        idh = F.xxhash64("id").alias("idh")
        same = F.array(
            F.when(F.col("ch").isNotNull(), F.struct(F.lit(SAME_TEXT).alias("kind"), _hashed(F.col("ch"), self.kinds).alias("key"), _check(F.col("ch")).alias("check"))),
            F.when(F.col("fp").isNotNull(), F.struct(F.lit(SAME_PRINT).alias("kind"), F.get(words(F.col("fp"), self.bits), F.lit(0)).alias("key"), F.col("fp").alias("check"))),
            F.struct(F.lit(SAME_ID).alias("kind"), _hashed(F.col("id"), self.kinds + 1).alias("key"), _check(F.col("id")).alias("check")),
        )
        asked = rows.select("seq", idh, F.explode(F.filter(same, lambda x: x.isNotNull())).alias("q")).select("seq", "idh", "q.*")
        equal = self._lookup(asked, 3 * n, segments).groupBy("seq").agg(
            F.min(F.when(F.col("kind") == SAME_ID, F.col("at"))).alias("first"),
            F.min(F.when(F.col("kind") != SAME_ID, F.struct("kind", "distance", "at"))).alias("match"),
        )
        equal = cut(equal)
        left = rows.where("fp is not null").join(equal, "seq", "left_anti")  # of the rows of one fingerprint only the first is left
        near = left.select("seq", idh, F.lit(NEAR).alias("kind"), F.explode(words(F.col("fp"), self.bits)).alias("key"), F.col("fp").alias("check"))
        close = self._lookup(near, self.kinds * left.count(), segments).select("seq", F.lit(None).cast("bigint").alias("first"), F.struct("kind", "distance", "at").alias("match"))
        # a row of a known id leads to the first row of that id, a duplicate to its match
        found = equal.unionByName(close).select("seq", F.coalesce("first", "match.at").alias("at"), F.col("first").isNull().alias("duplicate"))
        links = cut(found)
        up = links.select("seq", "at")
        while True:  # pointer doubling inside of the batch
            step = up.join(up.select(F.col("seq").alias("at"), F.col("at").alias("further")), "at", "left")
            if step.where("further is not null").isEmpty():
                break
            up = cut(step.select("seq", F.coalesce("further", "at").alias("at")))
        ends = up.join(rows.select(F.col("seq").alias("at"), F.col("id").alias("rep")), "at", "left")
        reps = ends.where("rep is not null").select("seq", "rep")
        if old:
            outside = cut(ends.where("rep is null").select("seq", "at"))
            targets = outside.select("at").distinct()
            reps = reps.unionByName(outside.join(self._owners(targets, n, old), "at").select("seq", "rep"))
        return rows.select("seq", "id").join(reps, "seq", "left").join(links.select("seq", "duplicate"), "seq", "left").select(
            "seq", F.coalesce("rep", "id").alias("rep"), F.coalesce("duplicate", F.lit(False)).alias("duplicate")
        )

    def compact(self) -> None:
        """Merge neighbouring segments while the newer one has reached the older one's size."""
        m = self.manifest()
        held = list(m["segments"])
        while len(held) > 1 and held[-2]["rows"] <= held[-1]["rows"]:
            b, a = held.pop(), held.pop()
            n = a["rows"] + b["rows"]
            merged = {"name": f"merged-{uuid.uuid4().hex[:12]}", "rows": n, "shards": _power(n * (self.kinds + 2) / SHARD_ROWS), "owner_shards": _power(n / SHARD_ROWS)}
            read = lambda part: self._stored(part, a["name"], b["name"])  # noqa: B023, E731
            entry = F.struct("seq1", "idh1", "seq2")
            both = read("suffixes").groupBy("key", "check").agg(F.min(entry).alias("x"), F.max(entry).alias("y"), F.count("*").alias("n"))
            other = F.when(F.col("y.idh1") != F.col("x.idh1"), F.col("y.seq1")).otherwise(F.col("y.seq2"))
            self._write(
                both.select("key", "check", "x.seq1", "x.idh1", F.when(F.col("n") > 1, F.least("x.seq2", other)).otherwise(F.col("x.seq2")).alias("seq2")),
                f"{merged['name']}/suffixes", "key", merged["shards"],
            )
            self._write(read("owners"), f"{merged['name']}/owners", "seq", merged["owner_shards"])
            held.append(merged)
        if held != m["segments"]:
            self._commit(m | {"segments": held})

    def results(self, *batches: int) -> DataFrame:
        """``(seq, duplicate_of)`` of the duplicates of ingested batches."""
        told = self.manifest()["results"]
        names = [told[str(b)] for b in batches if str(b) in told]
        if not names:
            return self.spark.createDataFrame([], "seq bigint, duplicate_of string")
        own = self._stored("owners", *names)
        return own.where("duplicate").select("seq", F.col("rep").alias("duplicate_of"))


def entries(df: DataFrame, representative: str | None = None) -> DataFrame:
    """Rows as an index takes them: (seq, id, ch, fp, known_rep)."""
    ch, sh = F.lower(F.trim("contentHash")), F.lower(F.trim("simHash"))
    usable = sh.rlike("^[0-9a-f]{16}$")
    high, low = F.conv(F.substring(sh, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(sh, 9, 8), 16, 10).cast("bigint")
    empty = F.coalesce(ch == EMPTY_TEXT, F.lit(False))
    return df.select(
        F.col("seq").cast("bigint").alias("seq"), "id",
        F.when(~empty & (F.length(ch) > 0), ch).alias("ch"),
        F.when(~empty & usable, F.shiftleft(high, 32).bitwiseOR(low)).alias("fp"),
        (F.col(representative) if representative else F.lit(None)).cast("string").alias("known_rep"),
    ).where("seq is not null and id is not null")


def duplicates(history: DataFrame, batches: DataFrame, bits: int = 3, one_by_one: bool = False) -> DataFrame:
    """``(seq, duplicate_of)`` of the batch rows that repeat an earlier entry.

    Builds an index of its own in the shared folder. Batches that are all there at once are taken as one backlog, or
    ``one_by_one`` in the order of their numbers; the result is the same.
    """
    spark = history.sparkSession
    index = SegmentIndex(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/batches-{uuid.uuid4().hex}", bits)
    index.ingest(entries(history, "representativeId"), 0, accepted=True)
    if not one_by_one:
        index.ingest(entries(batches), 1)
        return index.results(1)
    # one number per batch; rows without one come last
    numbers = [r[0] for r in batches.select("batch_no").distinct().orderBy(F.asc_nulls_last("batch_no")).collect()]
    for i, number in enumerate(numbers, 1):
        index.ingest(entries(batches.where(F.col("batch_no").eqNullSafe(number))), i)
    return index.results(*range(1, len(numbers) + 1))


def found(spark, sf_dir: str) -> DataFrame:
    """Query p5_found: (seq, duplicate_of)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return duplicates(read("candidate_entries"), read("candidate_batches"))


SQL = """
WITH RECURSIVE r AS (
  SELECT seq, id, 0 AS b, lower(trim(contentHash)) AS h, lower(trim(simHash)) AS s, coalesce(representativeId, id) AS known FROM candidate_entries
  UNION ALL SELECT seq, id, batch_no, lower(trim(contentHash)), lower(trim(simHash)), NULL FROM candidate_batches),
v AS (
  SELECT seq, id, b, CASE WHEN h <> 'e3b0c44298fc1c14' AND h <> '' THEN h END AS ch,
    CASE WHEN coalesce(h <> 'e3b0c44298fc1c14', true) AND regexp_matches(s, '^[0-9a-f]{16}$') THEN ('0x' || s)::UBIGINT END AS fp, min(seq) OVER (PARTITION BY id) AS first_seq FROM r),
m AS (
  SELECT a.seq, a.id, {'k': CASE WHEN a.ch = b.ch THEN 0 ELSE 1 END, 'd': CASE WHEN a.ch = b.ch THEN 0 ELSE bit_count(xor(a.fp, b.fp))::INT END, 's': b.seq, 'id': b.id} AS x
  FROM v a JOIN v b ON b.seq < a.seq AND a.id <> b.id AND (a.ch = b.ch OR bit_count(xor(a.fp, b.fp)) <= 3) WHERE a.b > 0 AND a.seq = a.first_seq),
p AS (SELECT seq, id, min(x).id AS parent FROM m GROUP BY seq, id),
c(seq, id, top) AS (SELECT seq, id, parent FROM p UNION ALL SELECT c.seq, c.id, p.parent FROM c JOIN p ON c.top = p.id),
k AS (SELECT id, min(known) AS known FROM r WHERE b = 0 GROUP BY id)
SELECT c.seq, coalesce(k.known, c.top) AS duplicate_of FROM c LEFT JOIN k ON k.id = c.top WHERE c.top NOT IN (SELECT id FROM p)
"""
