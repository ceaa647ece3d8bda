"""Suffix order of many sequences by the difference-cover algorithm, as distributed sorts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, parts


#: Sequences of names of so many in all are ordered by one task (some 120 bytes each); longer ones are sampled again.
TASK_SYMBOLS = 2_000_000


def running(df: DataFrame, order: list[str], sums: dict[str, Column], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Adds, for each name of sums, the sum of its column over all rows before this one in the order given, which must be
    without ties. Rows are dealt out by ranges of the order, summed within a range, and moved up by the ranges before. Beside
    the result, the scratch table that it reads."""
    cut = scratch.put(df.repartitionByRange(parts(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = cut.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    total = total.select("_range", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))  # one row a range
    out = cut.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(n) for n, c in sums.items()))
    return out.join(F.broadcast(total), "_range").select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums)), cut


def ordered_at_once(run: np.ndarray, i: np.ndarray, sym: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The rank of each suffix of a bounded number of symbols, by doubling what is compared until all differ. Behind a sequence's last
    symbol stands its end, which is below all symbols."""
    order = np.lexsort((i, run))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    run, sym, end = run[order], sym[order], end[order]
    last = np.flatnonzero(np.append(run[1:] != run[:-1], True))
    stop = last[np.searchsorted(last, np.arange(len(run)))]  # of each place, where its sequence ends
    below = np.unique(end, return_inverse=True)[1] - len(run)
    rank = np.unique(sym, return_inverse=True)[1].astype(np.int64)
    ahead = 1
    while True:
        at = np.arange(len(run)) + ahead
        inside = at <= stop
        second = np.where(inside, rank[np.minimum(at, len(run) - 1)], below)
        both = np.lexsort((second, rank))
        step = (rank[both][1:] != rank[both][:-1]) | (second[both][1:] != second[both][:-1])
        rank = np.empty(len(run), np.int64)
        rank[both] = np.cumsum(np.insert(step, 0, False))
        if len(run) == 0 or rank[both[-1]] == len(run) - 1 or not inside.any():
            return rank[back]
        ahead *= 2


def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """run, i, rank of all rows (run, i, sym, end)."""
    held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if held:
        run, i, sym, end = (np.concatenate(x) for x in zip(*held))
        rank = ordered_at_once(run, i, sym, end)
        for lo in range(0, len(run), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (run, i, rank)], ["run", "i", "rank"])


def suffix_ranks(seq: DataFrame, scratch: Scratch, task_symbols: int | None = None) -> DataFrame:
    """run, i, rank: the place of each suffix in the order of all suffixes of the sequences (run, i, sym), where i counts from
    0 in each run and sym is not negative. A suffix that ends sorts before those that go on; equal suffixes are ordered by their run.

    Suffixes at i mod 3 in (1, 2) are the sample: their triples of symbols are sorted and named by rank; if names repeat,
    the sequences of names (one of class 1 and one of class 2 for each run) are ordered the same way, or by one task once they are at most
    task_symbols (TASK_SYMBOLS if not given). The others are merged in by two sorts: against class 1 by (symbol, rank of the next suffix),
    against class 2 by (symbol, next symbol, rank of the next but one)."""
    # a symbol for each run's end, its own and below all others; the sequences of names keep it, so ties fall alike at all depths
    bound = TASK_SYMBOLS if task_symbols is None else task_symbols
    return _ranks(seq.select("run", "i", "sym", (-F.shiftrightunsigned(F.xxhash64("run"), 1) - 1).alias("end")), scratch, bound)


def _ranks(seq: DataFrame, scratch: Scratch, bound: int) -> DataFrame:
    one = F.lit(1).cast("long")
    of_run = Window.partitionBy("run").orderBy("i")
    seq = scratch.put(seq.select("run", "i", "sym", "end", F.coalesce(F.lead("sym", 1).over(of_run), "end").alias("s1"), F.coalesce(F.lead("sym", 2).over(of_run), "end").alias("s2")), "triples")
    sample = seq.where("i % 3 != 0")
    names, ranges = running(sample.select("sym", "s1", "s2").distinct(), ["sym", "s1", "s2"], {"name": one}, scratch)
    names = scratch.put(names, "names")
    scratch.drop(ranges)
    named = scratch.put(sample.join(names.hint("merge"), ["sym", "s1", "s2"]).select("run", "i", "name", "end"), "named")
    n, kinds = named.count(), names.count()
    scratch.drop(names)
    ranks = None
    if n > kinds:
        deeper = named.select(F.xxhash64("run", F.col("i") % 3).alias("run"), F.expr("i div 3").alias("i"), F.col("name").alias("sym"), "end")
        ranks = _ranks(deeper, scratch, bound) if n > bound else deeper.coalesce(1).mapInArrow(at_once, "run long, i long, rank long")
        ranked = named.select("run", "i", F.xxhash64("run", F.col("i") % 3).alias("r"), F.expr("i div 3").alias("k")).join(ranks.select(F.col("run").alias("r"), F.col("i").alias("k"), "rank").hint("merge"), ["r", "k"]).select("run", "i", "rank")
    else:
        ranked = named.select("run", "i", F.col("name").alias("rank"))
    after = lambda k: F.coalesce(F.lead("rank", k).over(of_run), "end")
    keyed = seq.join(ranked.hint("merge"), ["run", "i"], "left")
    keyed = scratch.put(keyed.select("run", "i", "sym", "s1", "rank", (F.col("i") % 3).alias("c"), after(1).alias("r1"), after(2).alias("r2")), "keyed")
    scratch.drop(seq, named, ranks)
    is_ = lambda k: F.when(F.col("c") == k, 1).otherwise(0)
    first, at_first = running(keyed.where("c != 2"), ["sym", "r1", "run", "i"], {"zeros": is_(0), "ones": is_(1)}, scratch)
    second, at_second = running(keyed.where("c != 1"), ["sym", "s1", "r2", "run", "i"], {"zeros": is_(0), "twos": is_(2)}, scratch)
    scratch.drop(keyed)
    twos = second.where("c = 0").select("run", "i", "twos")
    zero = first.where("c = 0").select("run", "i", "zeros", "ones").join(twos.hint("merge"), ["run", "i"]).select("run", "i", (F.col("zeros") + F.col("ones") + F.col("twos")).alias("rank"))
    rest = first.where("c = 1").union(second.where("c = 2").select(*first.columns[:-1], F.lit(0).alias("ones"))).select("run", "i", (F.col("rank") + F.col("zeros")).alias("rank"))
    out = scratch.put(zero.union(rest), "ranks")
    scratch.drop(at_first, at_second)
    return out
