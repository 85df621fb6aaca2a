"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every 5-word shingle of the lower-cased words is hashed once (xxHash64). The hash's high bits name one of
``BINS`` bins, the rest is its value; a bin keeps its least value. To find all minima without exploding rows, an
array of keys (bin, value) gets one sentinel per bin, is sorted, and the first key of each bin stays. An empty bin takes
the minimum of the first full bin on its fixed pseudo-random tour of the bins (optimal densification); the few bins whose
first places are all empty look again, then also at bins just filled, which leaves the chance of agreement as it is; what is
empty even then walks its whole tour. A fingerprint
is the lowest ``BITS`` bits of each bin's minimum, packed as hexadecimal digits. Likeness is the share m of equal
bins, corrected for chance agreement of b bits: (m - 2**-b) / (1 - 2**-b), at least 0.

The next document (ascending doc_id) is found without a global window: approximate quantiles of doc_id cut the table
into blocks, the window runs per block, and each block gets a copy of the first row of the one after it.

Defined cases: null text is empty; a text without words has the fingerprint of the empty set (an empty string), which
is like itself (1) and unlike all others (0); fewer than five words are one shingle; ties of doc_id are ordered by the
text's hash, a null doc_id comes first; a single document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, SHINGLE = 256, 8, 5
#: Places of its tour that an empty bin tries in one pass; later passes may also take what earlier ones filled in.
_TRIES, _PASSES = 16, 3
_SHIFT = 52  # of the value inside a key: bin in the bits above


def _tours(bins: int) -> str:
    """SQL literal: per bin, the start and the odd step of its tour; start + k * step reaches all of 2**m bins."""
    rng = np.random.Generator(np.random.PCG64(7))
    return "array(" + ",".join(f"{int(x)}" for x in rng.integers(0, bins, bins) * bins + (rng.integers(0, bins // 2, bins) * 2 + 1)) + ")"


def word_hashes(text: str) -> str:
    """Hashes of the words of the lower-cased text: what stands between runs of blanks and \\t-\\r."""
    bare = f"trim(BOTH ' \t\n\x0b\x0c\r' FROM lower({text}))"
    return f"CASE WHEN {bare} = '' THEN cast(array() AS array<bigint>) ELSE transform(split({bare}, '[ \\\\x09-\\\\x0D]+'), w -> xxhash64(w)) END"


def shingle_keys(h: str) -> str:
    """Keys (bin, value) of all shingles; ``h`` names the column of word hashes."""
    args = ", ".join([f"element_at({h}, i + {k})" for k in range(1, SHINGLE + 1)])
    some = f"transform(sequence(0, size({h}) - {SHINGLE}), i -> {{}})".format(f"xxhash64({args})")
    return f"CASE WHEN size({h}) = 0 THEN cast(array() AS array<bigint>) WHEN size({h}) < {SHINGLE} THEN array(xxhash64({h})) ELSE {some} END"


def with_bins(df: DataFrame, text: str, out: str, bins: int = BINS) -> DataFrame:
    """Adds array ``out`` of the packed low bits of each bin (empty for the empty set)."""
    low = (1 << _SHIFT) - 1
    width = 64 - (bins - 1).bit_length()
    sentinels = f"transform(sequence(0, {bins - 1}), b -> shiftleft(cast(b AS bigint), {_SHIFT}) + {low}L)"
    keys = f"transform({shingle_keys('_h')}, x -> shiftleft(shiftrightunsigned(x, {width}), {_SHIFT}) + (x & {low}L))"
    firsts = f"filter(_s, (x, i) -> i = 0 OR shiftright(x, {_SHIFT}) <> shiftright(element_at(_s, i), {_SHIFT}))"
    full = lambda v: f"({v} & {low}L) <> {low}L"
    m = (bins - 1).bit_length()
    spots = [f"element_at(_d, ((shiftright(tour, {m}) + {k} * (tour & {bins - 1})) & {bins - 1}) + 1)" for k in range(_TRIES)]
    tries = " ".join(f"WHEN {full(v)} THEN {v}" for v in spots)
    fill = f"zip_with(_d, {_tours(bins)}, (x, tour) -> CASE WHEN {full('x')} THEN x {tries} ELSE x END)"
    walk = f"filter(transform(sequence(0, {bins - 1}), k -> element_at(_d, ((shiftright(tour, {m}) + k * (tour & {bins - 1})) & {bins - 1}) + 1)), v -> {full('v')})[0]"
    rest = f"CASE WHEN exists(_d, x -> NOT {full('x')}) THEN zip_with(_d, {_tours(bins)}, (x, tour) -> CASE WHEN {full('x')} THEN x ELSE {walk} END) ELSE _d END"
    pack = f"transform(_d, x -> x & {(1 << BITS) - 1}L)"
    df = df.withColumn("_h", F.expr(word_hashes(text)))
    df = df.withColumn("_s", F.expr(f"sort_array(concat({keys}, {sentinels}))")).withColumn("_e", F.expr("size(_h) = 0")).drop("_h")
    df = df.withColumn("_d", F.expr(f"CASE WHEN _e THEN cast(array() AS array<bigint>) ELSE {firsts} END")).drop("_s", "_e")
    for _ in range(_PASSES):
        df = df.withColumn("_d", F.expr(f"CASE WHEN exists(_d, x -> NOT {full('x')}) THEN {fill} ELSE _d END"))
    df = df.withColumn("_d", F.expr(rest))
    return df.withColumn(out, F.expr(pack)).drop("_d")


def as_text(bins: Column) -> Column:
    return F.array_join(F.transform(bins, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected estimate of the Jaccard likeness from two arrays of packed bins."""
    chance = 2.0**-BITS
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.greatest(F.size(a), F.lit(1))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest((same - chance) / (1 - chance), F.lit(0.0)))


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every text."""
    df = with_bins(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "bins")
    return df.select("doc_id", as_text(F.col("bins")).alias("fingerprint"))


def with_next(df: DataFrame, key: str, tie: str, columns: list[str], prepare=lambda d: d) -> DataFrame:
    """Adds next_<column> of the row that follows in (key, tie) order; after the last row comes the first.

    ``prepare`` adds columns to the rows before they are shuffled; it sees each row once, and the copied ones again.

    Blocks hold about equally many distinct keys; one shuffle moves every row once, and as many more rows as there are
    blocks move twice. Only the block bounds (as many as shuffle partitions) come to the driver.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    bounds = sorted(set(bounds))
    array = ", ".join(f"{b}L" for b in bounds)
    block = F.lit(0) if not bounds else F.expr(f"CASE WHEN {key} IS NULL THEN 0 ELSE size(filter(array({array}), b -> b <= {key})) END")
    df = df.withColumn("_block", block)
    heads = df.groupBy("_block").agg(F.min(F.struct(F.col(key).alias("k"), F.col(tie).alias("t"))).alias("h")).select("_block", "h.k", "h.t").collect()
    heads = sorted(heads, key=lambda r: r["_block"])  # one row per block at most
    first = df.sparkSession.createDataFrame([(r["_block"], r["k"], r["t"], heads[i - 1]["_block"]) for i, r in enumerate(heads)], "_b int, _k long, _t long, _to int")
    ghosts = df.join(F.broadcast(first), (F.col("_block") == F.col("_b")) & F.col(key).eqNullSafe(F.col("_k")) & (F.col(tie) == F.col("_t"))).dropDuplicates(["_block"])
    ghosts = ghosts.withColumn("_block", F.col("_to")).withColumn("_ghost", F.lit(True)).drop("_b", "_k", "_t", "_to")
    df = df.withColumn("_ghost", F.lit(False))
    order = Window.partitionBy("_block").orderBy("_ghost", F.col(key).asc_nulls_first(), tie)
    both = prepare(df.unionByName(ghosts))
    for c in columns:
        both = both.withColumn(f"next_{c}", F.lead(c).over(order))
    return both.where(~F.col("_ghost")).drop("_block", "_ghost")


def edited_pairs(documents: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likenesses (see the query's contract)."""
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("tie", F.xxhash64("text"))
    df = with_next(df, "doc_id", "tie", ["text", "bins"], lambda d: with_bins(d, "text", "bins"))
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars AS int) - cast(floor(n_chars / 2) AS int))"), F.when(half > 0, F.left("next_text", half)).otherwise("")))
    df = df.drop("text", "next_text", "tie").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    df = with_bins(df, "edited", "edited_bins").drop("edited")
    return df.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("bins")).alias("fingerprint"), as_text(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
