"""Operator 2 [native]: mixing sources to target weights by Poisson replication.

A group's mean repetition rate is ``total x weight / size``; a document's count
is the Poisson quantile of a uniform number hashed from seed, id, group, text
and the row's rank among rows equal in these, so it does not depend on
partitions or reruns and repeated or missing ids draw separately.  Each document is exploded
by its count and the copies are dealt and sorted by a hash of the same values
and the copy's number, which is a global shuffle.  Only DataFrame functions;
the driver sees one row per named group.

Ranks cost nothing where no row repeats: digests are counted first, and only
rows whose digest recurs are numbered, each input partition's on its own, with
the counts of the partitions before it added, so a row repeated by a third of
the table is never gathered.

Defined results: groups that the weights do not name, null included, take part
with the rate ``default_rate``; sizes count null as 0, and a group of size 0
has the rate 0; a null id is the empty string and a null text the empty text
where they are hashed; rows equal in id, group and text draw independently, and
which of them draws which number is open where further columns differ; a text of
any length is one row and hashed whole; an empty table gives an empty result;
the caller's columns stay as they are and the operator's own are ``copy``,
``rate`` and ``shuffle_key``, each followed by underscores where the caller has
that name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

HEX = 13  # 52 bits of the digest: exact in a double
BROADCAST_KEYS = 100_000  # digests of repeated rows; more of them are joined by a shuffle


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 digest of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX), 16, 10).cast("double") / float(16**HEX)


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= j) for j from 0 to where the tail is below every hashed number's resolution."""
    most = math.ceil(rate + 12 * math.sqrt(rate) + 30)
    out, total = [], 0.0
    for j in range(most + 1):
        total += math.exp(j * math.log(rate) - rate - math.lgamma(j + 1)) if rate > 0 else float(j == 0)
        out.append(total)
    return out


def poisson_quantile(u: Column, rate: float) -> Column:
    if rate <= 0:
        return F.lit(0)
    steps = F.array(*[F.lit(x) for x in poisson_cdf(rate)])
    return F.size(F.filter(steps, lambda c: u >= c))


def rates(docs: DataFrame, weights: dict[str, float], group_col: str, size: Column, total: float | None = None) -> dict[str, float]:
    """Rate per named group; ``total`` is by default the size of all named groups, so rates average about 1."""
    named = docs.where(F.col(group_col).isin(list(weights)))
    sizes = {r[0]: float(r[1] or 0) for r in named.groupBy(group_col).agg(F.sum(size)).collect()}
    whole = math.fsum(weights.values())
    total = math.fsum(sizes.values()) if total is None else total
    return {g: total * w / whole / sizes[g] if sizes.get(g) else 0.0 for g, w in weights.items()}


def own_names(taken: list[str], wanted: tuple[str, ...] = ("copy", "rate", "shuffle_key")) -> tuple[str, ...]:
    """The wanted names, with underscores behind a name that is taken."""
    names = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name in names:
            name += "_"
        out.append(name)
    return tuple(out)


def digest(seed: int, id_col: str, group_col: str, text_col: str) -> Column:
    """Equal for rows equal in id, group and text."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null is not the empty group
    return F.md5(F.concat_ws(":", F.lit(str(seed)), value(id_col), group, F.md5(value(text_col))))


def ranked(docs: DataFrame, mark: str, rank: str) -> DataFrame:
    """``docs`` with ``rank``: 0, 1, ... among the rows with one ``mark``."""
    part, n = own_names([*docs.columns, rank], ("part", "rows"))
    counts = docs.groupBy(mark).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(mark)
    scratch = Scratch(docs.sparkSession, "mixing")
    counts = scratch.keep(counts)
    repeated = counts.count()
    if not repeated:
        return docs.withColumn(rank, F.lit(0).cast("long"))
    keys = F.broadcast(counts) if repeated <= BROADCAST_KEYS else counts
    # written, so that both readers below see one and the same partition number per row
    again = scratch.keep(docs.withColumn(part, F.spark_partition_id()).join(keys, mark, "left_semi"))
    before = F.sum(n).over(Window.partitionBy(mark).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    pieces = again.groupBy(mark, part).agg(F.count("*").alias(n)).select(mark, part, F.coalesce(before, F.lit(0)).alias(n))
    here = F.row_number().over(Window.partitionBy(mark, part).orderBy(mark))
    numbered = again.withColumn(rank, here.cast("long") - 1).join(pieces, [mark, part]).withColumn(rank, F.col(rank) + F.col(n))
    names = [*docs.columns, rank]
    once = docs.join(keys, mark, "left_anti").withColumn(rank, F.lit(0).cast("long"))
    return once.select(*[F.col(f"`{c}`") for c in names]).union(numbered.select(*[F.col(f"`{c}`") for c in names]))


def mix(docs: DataFrame, weights: dict[str, float], group_col: str, size: Column, seed: int = 0, total: float | None = None, default_rate: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with copy (from 0), rate and shuffle_key, replicated and globally shuffled."""
    copy_name, rate_name, key_name = own_names(docs.columns)
    mark, rank = own_names([*docs.columns, copy_name, rate_name, key_name], ("mark", "rank"))
    rate = rates(docs, weights, group_col, size, total)
    u = uniform(F.col(mark), F.col(rank))
    count, mean = poisson_quantile(u, default_rate), F.lit(float(default_rate))
    for group, r in rate.items():
        same = F.col(group_col) == group
        count, mean = F.when(same, poisson_quantile(u, r)).otherwise(count), F.when(same, F.lit(r)).otherwise(mean)
    copies = F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")))
    out = ranked(docs.withColumn(mark, digest(seed, id_col, group_col, text_col)), mark, rank)
    out = out.withColumn(rate_name, mean).withColumn(copy_name, copies)
    out = out.withColumn(key_name, F.xxhash64(F.col(mark), F.col(rank), F.col(copy_name))).drop(mark, rank)
    return out.repartition(key_name).sortWithinPartitions(key_name)
