"""What the corpus operators share: table access, lineage cuts, word hashing and connected components.

Nothing here keeps a corpus-sized object on the driver. Intermediate tables go to the shared folder that
``spark.checkpoint.dir`` names; a folder of our own is used only where that setting is absent (tests, laptops).
"""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's word table may hold before it is emptied; bounds the memory, never the result.
WORD_TABLE = 400_000
#: The same for the tables of word hashes and votes: what they hold is cheap to find again, and several workers live side by side.
HASH_TABLE = 100_000

#: Bytes of a batch that a map in Python is given, and their setting: rows are no bound where texts and sets differ in length.
BATCH, BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Set by the cluster; only a local master may go without, with a temporary one."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not configured and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="vigil-"))
        current = sc._jsc.sc().getCheckpointDir()
    return configured or current.get()


def _fs_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vigil-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _fs_path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._vigil_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_vigil_path", None)
        if path:
            fs, p = _fs_path(df.sparkSession, path)
            fs.delete(p, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it until no column of ``df`` is called so (case does not matter)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def held_out(doc_id, folds: int, fold: int):
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; a null id is in training (never held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def crc(b: bytes) -> int:
    return zlib.crc32(b) & 0xFFFFFFFF


def text_bytes(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; one per worker, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_TABLE:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _M1
    h = (h ^ (h >> _U(27))) * _M2
    return h ^ (h >> _U(31))


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of word hashes ``h``; fewer than k words are one shingle.

    The length of a short sequence goes into its hash, so that it never equals a full shingle by construction.
    """
    if len(h) == 0:
        return h
    n = min(k, len(h))
    acc = np.full(len(h) - n + 1, _U(n), dtype=np.uint64)
    for i in range(n):
        acc = mix(acc * _P + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; maximal runs of bytes other than space and \\t-\\r."""
    return text.lower().split()


def tidy(run):
    """``run``, after which the worker hands freed memory back: workers live on, and what one stage took counts in the next."""

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim is not None:
            trim(0)

    return wrapped


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df`` mapped by ``run`` in batches of about ``BATCH`` bytes (a longer row alone), memory handed back afterwards.

    The limit stays set in the session, as plans are made when they run; a limit that is set already holds.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(BATCH))
    return df.mapInArrow(tidy(run), schema)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished rounds: it follows the collection of dead plan objects."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


#: Bits of Sieve's map: 4 MB whatever the corpus. When it fills up, it lets more rows through, never fewer.
SIEVE_BITS = 1 << 25


class Sieve:
    """A fixed-size bitmap of ids (two hashes each) that thins out a scan before an exact join.

    With ``local`` the hashes are such as holds() computes inside a task, for ids that arise there.
    """

    def __init__(self, ids: DataFrame, column: str, local: bool = False):
        at = self.places(column)
        if local:
            at = [F.expr(f"(({column} >> {24 * i}) ^ ({column} >> {11 + 24 * i})) & {SIEVE_BITS - 1}L") for i in (0, 1)]
        words = ids.select(F.explode(F.array(*at)).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("b"))
        got = words.toArrow()  # SIEVE_BITS / 64 rows at most
        bits = np.zeros(SIEVE_BITS // 64, dtype=np.int64)
        bits[got.column("w").to_numpy()] = got.column("b").to_numpy()
        self.bits = ids.sparkSession.sparkContext.broadcast(bits)

    @staticmethod
    def places(column: str) -> list:
        """Columns of the two positions, computed where the rows are scanned."""
        return [F.pmod(F.xxhash64(F.col(column).cast("long"), F.lit(i)), F.lit(SIEVE_BITS)).alias(f"_p{i}") for i in (0, 1)]

    @staticmethod
    def passes(bits: np.ndarray, *places: np.ndarray) -> np.ndarray:
        ok = np.ones(len(places[0]), dtype=bool)
        for p in places:
            ok &= (bits[p >> 6] >> (p & 63)) & 1 == 1
        return ok

    @staticmethod
    def holds(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For hashed ids (not negative) of a ``local`` sieve."""
        return Sieve.passes(bits, *(((ids >> 24 * i) ^ (ids >> 11 + 24 * i)) & (SIEVE_BITS - 1) for i in (0, 1)))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of undirected ``edges`` (a, b): label is the least node it reaches.

    Alternating large-star and small-star rounds: O(log n) of them, each a grouped minimum (partial sums on the map
    side) and a join whose large keys AQE can split. The edges are rewritten each round, never collected. It ends when
    each node has one edge, and that to a node without one.
    """
    spark = edges.sparkSession
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")))
    for _ in range(rounds):
        both = e.union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("m", F.explode(F.array("u", "v")).alias("u"))
        nxt = cut(small.where("u <> m").select(F.col("m").alias("v"), "u").distinct())
        drop(e)
        e = nxt
        release(spark)
        roles = e.select(F.col("u").alias("x"), F.lit(1).alias("d")).union(e.select("v", F.lit(0)).distinct())
        if roles.groupBy("x").agg(F.sum("d").alias("d"), F.min("d").alias("head")).where("d > 1 or (d = 1 and head = 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
