"""Vector math on ``ARRAY<FLOAT|DOUBLE>`` columns with native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token boundary for the hashing embedder: anything but letters and digits.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
DEFAULT_HASH_DIM = 64
NORM_EPS = 1e-12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda binding).

    Catalyst does not share common sub-expressions inside higher-order
    functions, so a value used several times is bound through a one-element
    ``transform`` instead of being written out several times.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double_array(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of element products; NULL elements count as 0."""
    prods = F.zip_with(as_double_array(a), as_double_array(b),
                       lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    sq = F.aggregate(as_double_array(v), F.lit(0.0),
                     lambda acc, x: acc + F.coalesce(x * x, F.lit(0.0)))
    return F.sqrt(sq)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """F16: cosine similarity clamped to [0, 1].

    A missing vector, vectors of different lengths, or a zero norm give 0.
    """
    a_, b_ = _col(a), _col(b)

    def clamp(denom: Column) -> Column:
        sim = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a_, b_) / denom))
        return F.when(denom == F.lit(0.0), F.lit(0.0)).otherwise(F.coalesce(sim, F.lit(0.0)))

    return (F.when(a_.isNull() | b_.isNull(), F.lit(0.0))
            .when(F.size(a_) != F.size(b_), F.lit(0.0))
            .otherwise(let(norm(a_) * norm(b_), clamp)))


def l2_normalize(v: Column | str) -> Column:
    """divide by the L2 norm (a zero vector stays zero)."""
    return let(as_double_array(v), _normalize_bound)


def _normalize_bound(arr: Column) -> Column:
    n = F.greatest(F.sqrt(F.aggregate(arr, F.lit(0.0),
                                      lambda acc, x: acc + F.coalesce(x * x, F.lit(0.0)))),
                   F.lit(NORM_EPS))
    return let(n, lambda nn: F.transform(arr, lambda x: x / nn))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance; NULL when lengths differ."""
    a_, b_ = as_double_array(a), as_double_array(b)
    diffs = F.zip_with(a_, b_, lambda x, y: (x - y) * (x - y))
    total = F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a_) == F.size(b_), total)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - raw cosine (not clamped); NULL for a zero norm."""
    denom = norm(a) * norm(b)
    return F.lit(1.0) - F.try_divide(dot(a, b), denom)


# Longest query that is written into the plan as a literal.
MAX_EXPANDED_DIM = 256


def squared_l2_to(v: Column | str, query: list[float]) -> Column:
    """Squared L2 distance from ``v`` to a known query vector; NULL when the vector has another dimension.

    The query is one array literal, and the terms are computed once and then added in order. Taken from the
    vector one by one in generated code, they make a method that the JVM does not compile, and cast the whole
    vector for every term.
    """
    x, q = _col(v), F.array(*[F.lit(float(qv)) for qv in query])

    def term(e: Column, i: Column) -> Column:
        return (e.cast("double") - F.get(q, i)) * (e.cast("double") - F.get(q, i))

    def added(terms: Column) -> Column:
        total = F.get(terms, F.lit(0))
        for i in range(1, len(query)):
            total = total + F.get(terms, F.lit(i))
        return total

    return F.when(F.size(x) == F.lit(len(query)), let(F.transform(x, term), added))


def distance(a: Column | str, b: Column | str, metric: str = "l2") -> Column:
    if metric == "l2":
        return squared_l2(a, b)
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "ip":
        return F.lit(1.0) - dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def distance_to_score(d: Column | str) -> Column:
    """score = max(0, 1 - distance); a missing distance counts as 1."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(_col(d), F.lit(1.0)))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    parts = F.split(F.lower(_col(text)), TOKEN_SPLIT)
    return F.filter(parts, lambda w: w != F.lit(""))


def token_bucket(w: Column, dim: int) -> Column:
    """Bucket of a token: first 32 bits of its md5, modulo ``dim``.

    For a power-of-two ``dim`` (<= 2^16) the bucket depends only on the last
    hex digits of that 32-bit prefix (2^32 is a multiple of ``dim``), so only
    those digits are converted (measured faster than converting all eight).
    Same value either way.
    """
    if dim & (dim - 1) == 0 and dim <= 1 << 16:
        n = max(1, (dim.bit_length() - 1 + 3) // 4)       # hex digits needed
        digits = F.substring(F.md5(w), 9 - n, n)
        return F.pmod(F.conv(digits, 16, 10).cast("int"), F.lit(dim))
    return F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"),
                  F.lit(dim).cast("bigint")).cast("int")


def hash_embedding(text: Column | str, dim: int = DEFAULT_HASH_DIM) -> Column:
    """Feature-hashing embedding: token counts per bucket, L2-normalised.

    The buckets are sorted and written one after the other; a run of equal ones is one match of a
    pattern, and its length is the count, so counting takes one pass over the text of the buckets.
    """
    buckets = F.sort_array(F.transform(tokens(text), lambda w: token_bucket(w, dim)))
    written = F.concat(F.array_join(buckets, ","), F.lit(","))
    runs = F.regexp_extract_all(written, F.lit(r"(\d+,)\1*+"), F.lit(0))
    return let(let(runs, lambda rs: _dense_counts(rs, dim)), _normalize_bound)


def _dense_counts(runs: Column, dim: int) -> Column:
    """Counts of the buckets 0 to ``dim`` - 1 from runs such as ``7,7,7,``."""
    uniq = F.transform(runs, lambda r: F.substring_index(r, ",", 1).cast("int"))
    counts = F.transform(runs, lambda r: F.length(r) / F.locate(",", r))
    return let(F.map_from_arrays(uniq, counts),
               lambda by_bucket: F.transform(
                   F.sequence(F.lit(0), F.lit(dim - 1)),
                   lambda d: F.coalesce(F.try_element_at(by_bucket, d), F.lit(0.0))))


def explode_array(df, array_col, pos_name: str, value_name: str, *keep):
    """``posexplode`` of a computed array without an inferred pre-filter.

    A plain ``posexplode`` makes the optimiser add ``size(array) > 0`` below
    the generator, which can be pushed under a repartition and evaluates the
    whole array expression a second time; the outer form adds no filter, and
    the empty-array row it emits is dropped here.
    """
    cols = list(keep) if keep else [c for c in df.columns if c != array_col]
    out = df.select(*cols, F.posexplode_outer(array_col).alias(pos_name, value_name))
    return out.where(F.col(pos_name).isNotNull())

