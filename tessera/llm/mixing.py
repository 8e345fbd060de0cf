"""Mixing sources to target weights by Poisson replication, in SQL expressions only.

The mean repetition rate of a source is its share of the target weights times the target size over its documents. A
hash of (seed, document) seeds an inverted Poisson distribution, so a document's count is the same on every run and in
every partition. Each document is exploded by its count and the copies are shuffled by another hash.

A rate above ``SPLIT`` is the sum of equal parts below it, each with a hash of its own: exact, since Poisson counts add
up, and free of underflow. Sources without a weight of their own form one class which shares ``rest_weight`` evenly by
documents; null sources belong to it. So there are no more classes than weights given, and the table of rates, which is
broadcast, is bounded by the parameters. A weight whose source is absent takes no part.

Defined results: null and empty texts are documents like others; a null key counts as the text ``null``; repeated rows
(one key) get one count each and are all replicated; an empty table gives an empty result; columns of the input named
``n_copies``, ``copy_no`` or ``shuffle_key`` are replaced, all others come back unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT = 16.0
_TERMS = 80  # Poisson(16): what lies beyond has a probability under 2^-80, and the hash has 52 bits
_REST = "*"

#: Production weights; they suit the tables' sources, of which src0 holds a third.
WEIGHTS = {"src0": 0.15, "src1": 0.10, "src2": 0.10, "src3": 0.05}
REST_WEIGHT = 0.60


def uniform(seed: str, *parts: Column) -> Column:
    """In [0, 1), 52 bits of md5."""
    text = F.concat_ws(":", F.lit(seed), *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source: str, weights: dict[str, float], rest_weight: float, total: int | None) -> DataFrame:
    """One row per class: its rate, the parts of the rate and the cumulative distribution of a part."""
    counts = docs.groupBy(_class(source, weights).alias("mix_class")).agg(F.count(F.lit(1)).alias("mix_docs"))
    weight = F.lit(float(rest_weight))
    for name, value in weights.items():
        weight = F.when(F.col("mix_class") == name, F.lit(float(value))).otherwise(weight)
    sums = counts.withColumn("mix_weight", weight)
    whole = sums.agg(  # no more rows than classes
        F.collect_list(F.struct("mix_class", "mix_docs", "mix_weight")).alias("mix_all"),
        F.sum("mix_weight").alias("mix_weights"),
        F.sum("mix_docs").alias("mix_total"),
    )
    sums = whole.select("mix_weights", "mix_total", F.inline("mix_all"))
    target = F.lit(int(total)) if total is not None else F.col("mix_total")
    rated = sums.withColumn("mix_rate", F.col("mix_weight") / F.col("mix_weights") * target / F.col("mix_docs"))
    rated = rated.withColumn("mix_parts", F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / F.lit(SPLIT))).cast("int"))
    rated = rated.withColumn("mix_mean", F.col("mix_rate") / F.col("mix_parts"))
    start = F.struct(F.exp(-F.col("mix_mean")).alias("p"), F.array(F.exp(-F.col("mix_mean"))).alias("cdf"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(_TERMS)),
        start,
        lambda s, k: F.struct(
            (s["p"] * F.col("mix_mean") / k).alias("p"),
            F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * F.col("mix_mean") / k)).alias("cdf"),
        ),
        lambda s: s["cdf"],
    )
    return rated.select("mix_class", "mix_parts", grown.alias("mix_cdf"))


def _class(source: str, weights: dict[str, float]) -> Column:
    return F.when(F.col(source).isin(list(weights)), F.col(source)).otherwise(F.lit(_REST))


def mix(
    docs: DataFrame,
    weights: dict[str, float] = WEIGHTS,
    rest_weight: float = REST_WEIGHT,
    total: int | None = None,
    seed: str = "mix-1",
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """The documents, each ``n_copies`` times, numbered by ``copy_no``, dealt and sorted by ``shuffle_key``."""
    names = [c for c in docs.columns if c not in ("n_copies", "copy_no", "shuffle_key")]
    table = rates(docs, source, weights, rest_weight, total)
    ident = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    # The input's columns travel in one, so no name of theirs can clash.
    packed = docs.select(F.struct(*names).alias("doc"), ident.alias("ident"), _class(source, weights).alias("class"))
    draws = F.transform(F.sequence(F.lit(1), F.col("mix_parts")), lambda j: uniform(seed, F.col("ident"), j.cast("string")))
    drawn = F.aggregate("draws", F.lit(0), lambda n, u: n + F.size(F.filter("mix_cdf", lambda f: u >= f)))
    counted = (
        packed.join(F.broadcast(table), F.col("class") == F.col("mix_class"))
        .withColumn("draws", draws)
        .select("doc", "ident", drawn.alias("n_copies"))
        .filter("n_copies > 0")
    )
    copies = counted.select("doc", "ident", "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy_no"))
    keyed = copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "ident", "copy_no"))
    dealt = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select("doc.*", "n_copies", "copy_no", "shuffle_key")


def oracle(weights: dict[str, float] = WEIGHTS, rest_weight: float = REST_WEIGHT, seed: str = "mix-1") -> str:
    """DuckDB SQL for the columns of the query."""
    names = ", ".join(f"'{n}'" for n in weights)
    cases = " ".join(f"WHEN '{n}' THEN {float(w)!r}::DOUBLE" for n, w in weights.items())
    return f"""
WITH classed AS (SELECT *, CASE WHEN source IN ({names}) THEN source ELSE '{_REST}' END AS class FROM documents),
counts AS (SELECT class, count(*) AS docs FROM classed GROUP BY class),
weighed AS (SELECT class, docs, CASE class {cases} ELSE {float(rest_weight)!r}::DOUBLE END AS weight FROM counts),
rated AS (SELECT class, weight / sum(weight) OVER () * sum(docs) OVER ()::DOUBLE / docs::DOUBLE AS rate FROM weighed),
parts AS (SELECT class, rate, greatest(1, ceil(rate / {SPLIT})::INTEGER) AS parts FROM rated),
dist AS (SELECT class, parts, unnest(range(0, {_TERMS + 1})) AS k, rate / parts AS mean FROM parts),
probs AS (SELECT class, parts, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM dist),
cdf AS (SELECT class, parts, k, sum(p) OVER (PARTITION BY class ORDER BY k) AS f FROM probs),
draws AS (SELECT doc_id, class, unnest(range(1, parts + 1)) AS j FROM classed JOIN parts USING (class)),
uniforms AS (SELECT DISTINCT doc_id, class, j, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':'
    || j::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM draws),
counted AS (SELECT doc_id, class, count(k)::INTEGER AS n FROM uniforms JOIN cdf USING (class) WHERE u >= f GROUP BY ALL)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, n AS n_copies, unnest(range(0, n))::INTEGER AS copy_no
FROM classed d JOIN counted c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.class = d.class"""
