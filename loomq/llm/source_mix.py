"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each document gets a count from a Poisson distribution whose mean is its source's target repetition rate, by inverting
the distribution at a number that a hash of seed and doc_id gives; the document is exploded by its count, and all
copies are dealt out and sorted by another hash, of doc_id, text and copy.

Defined cases: a row without doc_id draws by its text in place of it. Null and empty texts are repeated like any other; a
very long text is only hashed. Rows of one doc_id and source get one count, each for itself. A null source is none of the
weights'. An empty table gives no rows. Columns keep their names; `copy` gives way to one that docs has.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared

def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of seed and parts."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def thresholds(mean: float) -> list[float]:
    """P(count <= 0), P(count <= 1), ... of a Poisson distribution, up to where a double no longer grows."""
    first, steps = bounded_thresholds(mean)
    return [0.0] * first + steps


def bounded_thresholds(mean: float) -> tuple[int, list[float]]:
    """(k, P(count <= k), P(count <= k + 1), ...), from where the sum leaves zero, below 2**-53, to where it no longer grows.

    Some 18 standard deviations around the mean, whatever the mean; in logarithms, as exp(-mean) may be no double.
    """
    top = math.floor(mean)
    peak = math.exp(top * math.log(mean) - mean - math.lgamma(top + 1)) if mean else 1.0
    down, term, k = [], peak, top
    while k > 0 and term > 1e-18:
        term *= k / mean
        k -= 1
        down.append(term)
    out, total = [], 0.0
    for x in reversed(down):
        total += x
        out.append(total)
    term, j = peak, top
    while True:
        total += term
        out.append(total)
        if term <= 1e-18 or not mean:
            return k, [x / total for x in out]  # which takes away what lgamma is off by
        j += 1
        term *= mean / j


def poisson(mean: float, seed: str, *key: Column) -> Column:
    """A Poisson count by inversion: how many thresholds the hash-seeded number reaches.

    The thresholds stand in one text, which Catalyst parses once, so that the plan stays small for any mean.
    """
    first, steps = bounded_thresholds(mean)
    parsed = F.split(F.lit(",".join(map(repr, steps))), ",").cast("array<double>")
    return F.aggregate(F.array(uniform(seed, F.lit(0), *key)), F.lit(0), lambda _, u: F.size(F.filter(parsed, lambda t: t <= u)) + F.lit(first))


def rates(counts: Mapping[str | None, int], weights: Mapping[str, float], total: float | None = None) -> dict[str, float]:
    """Repetition rate of each source of `weights`: its share of `total` documents (default: as many as they have now) by what it has.

    A source without documents is left out, and its weight is shared by the others.
    """
    there = {s: w for s, w in weights.items() if counts.get(s) and w > 0}
    total = sum(counts.get(s, 0) for s in weights) if total is None else total
    whole = sum(there.values())
    return {s: total * there[s] / whole / counts[s] if s in there else 0.0 for s in weights if counts.get(s)}


def mixed(docs: DataFrame, weights: Mapping[str, float], *, total: float | None = None, seed: str = "mix", others: float = 0.0, partitions: int | None = None) -> DataFrame:
    """docs repeated so that in expectation each source of `weights` holds its weight's share of `total` documents.

    Columns of docs, then `copy` (from 1; named `copy_` and so on if docs has that name). Documents of a source that is
    not in `weights`, null among them, are repeated at rate `others`.
    Equal seeds give equal results whatever the partitioning. The only thing counted before the draw is the documents of
    each listed source, so the driver gets at most len(weights) + 1 rows; nothing is joined.
    """
    if any(w < 0 or not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    source = docs["source"].cast("string")
    listed = F.when(source.isin(*weights), source) if weights else F.lit(None).cast("string")
    counts = {r["s"]: r["n"] for r in docs.groupBy(listed.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    text = F.coalesce(docs["text"].cast("string"), F.lit("")) if "text" in {c.lower() for c in docs.columns} else F.lit("")
    key = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("null|"), F.md5(text)))
    drawn: Column = poisson(others, seed, key) if others else F.lit(0)
    for s, rate in sorted(rates(counts, weights, total).items(), reverse=True):
        drawn = F.when(source == s, poisson(rate, seed, key)).otherwise(drawn)
    copy = _shared.fresh(docs, "copy")
    copies = docs.where(drawn > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), drawn)))
    order = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.col(copy), F.xxhash64(text)))
    dealt = copies.repartition(partitions, order) if partitions else copies.repartition(order)
    return dealt.sortWithinPartitions(order)


#: Production weights: the large source is held to a fifth, nineteen others share the rest evenly.
WEIGHTS = {"src0": 0.2} | {f"src{k}": 0.8 / 19 for k in range(1, 20)}
#: Production rate of documents of any other source, null among them: as many as there are, in expectation.
OTHERS = 1.0


def oracle(weights: Mapping[str, float], seed: str = "mix", documents: str = "documents", columns: str = "doc_id, source") -> str:
    """DuckDB SQL for the rows of mixed(documents, weights): `columns` and copy. For any mean."""
    rows = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in weights.items())
    return f"""
        WITH w(source, weight) AS (VALUES {rows}),
        n AS (SELECT source, weight, count(*) AS n FROM {documents} JOIN w USING (source) GROUP BY source, weight),
        r AS (SELECT source, sum(n) OVER () * weight / sum(weight) OVER () / n AS mean FROM n WHERE weight > 0),
        steps AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS reached
                  FROM (SELECT source, mean, unnest(range(0, (mean + 12 * sqrt(mean) + 40)::BIGINT)) AS k FROM r)),
        u AS (SELECT {columns}, ('0x' || substr(md5('{seed}|0|' || coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
              FROM {documents})
        SELECT {columns}, (k + 1)::INT AS copy FROM u JOIN steps USING (source) WHERE reached <= u"""
